"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, dedup, html, interplay, lines, packing, quality, repair, secrets, tokens, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("__component")).alias("kept"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.formatted(given.unionByName(planted)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_dedup, op3_neighbours, op4_chat, op5_decontamination)}

ORACLE_SQL = {
    "op5_decontamination": r"""
with ws as (select doc_id, rowid_ r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
            from (select *, row_number() over () rowid_ from documents)),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
wins as (select distinct item_id, len, array_to_string(w[i : i + len - 1], ' ') k
         from (select item_id, w, least(10, len(w)) len, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from items where len(w) > 0)),
lens as (select distinct len from wins),
grams as (select r, i, ws.w, lens.len, array_to_string(ws.w[i : i + lens.len - 1], ' ') k
          from (select r, w, unnest(range(1, len(w) + 1)) i from ws) ws, lens where i + lens.len - 1 <= len(ws.w)),
found as (select r, i, grams.len, item_id from grams join wins on grams.k = wins.k and grams.len = wins.len),
hit as (select r, count(distinct p) n from (select r, unnest(range(i, i + len)) p from found) group by r),
its as (select r, count(distinct item_id) n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) l from found group by r)
select doc_id, len(w)::bigint n_words, coalesce(hit.n, 0)::bigint n_hit, coalesce(its.n, 0)::bigint n_items, sha256(coalesce(l, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from ws left join hit using (r) left join its using (r)""",
}


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__cut").alias("n_cut"), "text")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__score").alias("score"), F.col("__keep").alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: F.crc32(doc_id.cast("string")) % 4 != 2)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan under the base rules, and one under the added rules too, which takes what the ledger does not hold."""
    documents = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan(documents, rules=(1,))
    out, _ = secrets.scan(documents, ledger, (1, 2))
    base = [kind for kind, *_ in secrets.BASE]
    told = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}") for kind in base]  # noqa: B023
    digest = F.sha2(told(F.filter("found", lambda x: x["kind"].isin(base))), 256)
    return out.select("doc_id", *counts, digest.alias("base_sha256"), told(F.col("found")).alias("spans"))


QUERIES |= {f.__name__: f for f in (op6_line_dedup, op7_main_text, op8_quality, op9_toxicity, op10_secrets)}


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.interplay(interplay.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES |= {f.__name__: f for f in (op11_token_counts, op12_filter_audit, op13_repair)}

ORACLE_SQL |= {
    "op12_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
low as (select t, min(doc_id) lowest from d group by t),
lab as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) good, coalesce(lab.toxic, 0) toxic,
             map {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t),
                  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > lowest, false)} f
      from d join low using (t) left join lab on lab.doc_id = d.doc_id),
p as (select 'ABCDE'[a.i] a, 'ABCDE'[b.i] b, 'ABCDE'[c.i] c, 'ABCDE'[e.i] e, 'ABCDE'[g.i] g from range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) e(i), range(1, 6) g(i)
      where len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
o as (select a || b || c || e || g filter_order from p),
s as (select filter_order, step, filter_order[step] own, filter_order[1 : step - 1] earlier from o, range(1, 6) r(step)),
x as (select part, filter_order, step, own, f[own] fails, len(list_filter(map_keys(f), lambda k: f[k] and contains(earlier, k))) > 0 gone, len(list_filter(map_values(f), lambda v: v)) n, good, toxic from m, s),
r as (select part, filter_order, step::int step, own, count(*) filter (not fails and not gone) kept, count(*) filter (fails and not gone) removed, count(*) filter (fails and gone) redundant, count(*) filter (fails and n = 1) unique_fails,
             count(*) filter (fails and not gone and good = 1) good_lost, count(*) filter (fails and not gone and toxic = 1) toxic_lost from x group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from r""",
    "op13_repair": r"""
with recursive c as (select conv_id, turn, coalesce(conv_id::varchar, ' ') k, coalesce(role, ' ') role, coalesce(text, ' ') t, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') mark from conversations),
-- the checksum, bit by bit
b as (select mark, flatten(list_transform(string_split(mark, ''), lambda ch: list_transform(range(8), lambda j: (ascii(ch) >> j) & 1))) bits from (select distinct mark from c)),
crc as (select mark, xor(list_reduce(list_prepend(4294967295::bigint, bits), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295::bigint) % 20 fate from b),
d as (select k, turn, case when fate = 4 then 'user' else role end role, case fate when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t, unnest(case when fate = 3 then [1, 2] else [1] end) from c join crc using (mark) where fate <> 0),
m as (select *, row_number() over (partition by k order by turn nulls first, role, sha256(t)) i from d),
n as (select *, row_number() over (partition by k, role, t order by i) nth, regexp_replace(t, '[\x20\x09-\x0D]+$', '') cut from m),
g as (select *, case when cut = '' then 'blank' when nth > 1 then 'duplicate' when right(cut, 1) not in ('.', '!', '?') then 'truncated' else '' end fault, left(role, 1) r0 from n),
p as (select *, coalesce(lag(r0) over (partition by k order by i) || r0 not in ('su', 'ua', 'au'), false) bad from g),
-- for each state of the roles so far (nothing, system, user, assistant): cost, audit, repaired rows; the least of these is kept
w as (select k, 0::bigint i, {'c': 0::bigint, 'a': '', 'o': []::varchar[]} e, {'c': 1000000000::bigint, 'a': '', 'o': []::varchar[]} s, {'c': 2::bigint, 'a': 'I', 'o': ['user:']} u, {'c': 4::bigint, 'a': 'II', 'o': ['user:', 'assistant:']} a from (select distinct k from c)
      union all
      select k, i, e, s,
             least(u1, {'c': a1.c + 2, 'a': a1.a || 'I', 'o': list_append(a1.o, 'user:')}, {'c': e.c + 2, 'a': e.a || 'I', 'o': list_append(e.o, 'user:')}, {'c': s.c + 2, 'a': s.a || 'I', 'o': list_append(s.o, 'user:')}) u,
             least(a1, {'c': u1.c + 2, 'a': u1.a || 'I', 'o': list_append(u1.o, 'assistant:')}, {'c': e.c + 4, 'a': e.a || 'II', 'o': e.o || ['user:', 'assistant:']}, {'c': s.c + 4, 'a': s.a || 'II', 'o': s.o || ['user:', 'assistant:']}) a
      from (select w.k, p.i,
                   {'c': e.c + 3, 'a': e.a || 'D', 'o': e.o} e,
                   least({'c': s.c + 3, 'a': s.a || 'D', 'o': s.o}, {'c': e.c + late + if(r0 = 's', 0, never), 'a': e.a || 'K', 'o': list_append(e.o, role || ':' || t)}) s,
                   least({'c': u.c + 3, 'a': u.a || 'D', 'o': u.o},
                         {'c': e.c + late + if(r0 = 'u', 0, never), 'a': e.a || 'K', 'o': list_append(e.o, role || ':' || t)}, {'c': s.c + late + if(r0 = 'u', 0, never), 'a': s.a || 'K', 'o': list_append(s.o, role || ':' || t)},
                         {'c': a.c + late + if(r0 = 'u', 0, never), 'a': a.a || 'K', 'o': list_append(a.o, role || ':' || t)},
                         {'c': e.c + late + 2, 'a': e.a || 'R', 'o': list_append(e.o, 'user:' || t)}, {'c': s.c + late + 2, 'a': s.a || 'R', 'o': list_append(s.o, 'user:' || t)}, {'c': a.c + late + 2, 'a': a.a || 'R', 'o': list_append(a.o, 'user:' || t)}) u1,
                   least({'c': a.c + 3, 'a': a.a || 'D', 'o': a.o}, {'c': u.c + late + if(r0 = 'a', 0, never), 'a': u.a || 'K', 'o': list_append(u.o, role || ':' || t)}, {'c': u.c + late + 2, 'a': u.a || 'R', 'o': list_append(u.o, 'assistant:' || t)}) a1
            from w join (select *, 1000000000 never, case when fault in ('blank', 'duplicate') then 1000000000 when fault = 'truncated' then 1 else 0 end late from p) p on p.k = w.k and p.i = w.i + 1)),
z as (select k, least(e, a) x from w qualify row_number() over (partition by k order by i desc) = 1),
f as (select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated, count(*) filter (bad) illegal from p group by k),
ids as (select distinct conv_id, k from c)
select conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, x.c cost, x.a audit, sha256(array_to_string(x.o, chr(10))) repaired_sha256
from ids join z using (k) left join f using (k)""",
}
