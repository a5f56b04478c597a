"""The registered queries of the library's own operators, each with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff, eligibility, evalstats, rules, search, tree, verify, versions, worddiff
from ..sources import io
from . import acts, audits, derive, logs  # noqa: F401  they register their own
from .derive import DIFF_SQL, LOG_SQL, NODES_SQL, RESOLVED_SQL, table
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = derive.nodes(spark, sf_dir)
    return n.filter("version = 'v1'"), n.filter("version = 'v2'")


@query(r"""with q as (select item_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) t from benchmark),
d as (select doc_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) t from documents where text is not null),
h as (select item_id, count(doc_id) hits, min(doc_id) doc_id from q left join d on contains(' ' || d.t || ' ', ' ' || q.t || ' ') group by item_id)
select item_id, case hits when 0 then 'not_found' when 1 then 'exact' else 'multiple_matches' end status, hits, coalesce(doc_id, -1) doc_id from h""")
def quotes_exact(spark, sf_dir):
    """Which benchmark passages occur in which documents, word for word, and is the place unique? Postings of each passage's
    rarest token give the candidates."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda c: F.filter(F.split(low(c), r"\s+"), lambda x: x != "")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), split("text").alias("toks"))
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), split("text").alias("toks"))
    met = verify.containing(q, d)
    hits = met.groupBy("quote_id").agg(F.count("id").alias("hits"), F.min("id").alias("doc_id"))
    status = F.when(F.col("hits").isNull(), "not_found").when(F.col("hits") == 1, "exact").otherwise("multiple_matches")
    return q.select("quote_id").join(hits, "quote_id", "left").select(F.col("quote_id").alias("item_id"), status.alias("status"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))


@query(f"with {NODES_SQL} select version, id, ancestor, distance from closure_")
def tree_closure(spark, sf_dir):
    return tree.closure(derive.nodes(spark, sf_dir))


@query(f"with {NODES_SQL} select c.version, c.ancestor, c.id, row_number() over (partition by c.version, c.ancestor order by n.ord) nth from closure_ c join nodes n using (version, id) where distance > 0")
def tree_descendants(spark, sf_dir):
    n = derive.nodes(spark, sf_dir)
    return tree.descendants(n, tree.closure(n))


@query(f"with {NODES_SQL} select version, c.id, arg_min(n.id, distance) as value from closure_ c join nodes n using (version) where n.id = c.ancestor and n.type = 'document' group by version, c.id")
def tree_nearest(spark, sf_dir):
    n = derive.nodes(spark, sf_dir)
    return tree.nearest(n, tree.closure(n), F.col("type") == "document", F.col("id"))


@query(f"with {NODES_SQL} select version, ancestor id, string_agg(case when heading <> '' and text <> '' then heading || chr(10) || text else heading || text end, chr(10) order by ord) as text from closure_ join nodes using (version, id) where heading || text <> '' group by version, ancestor")
def tree_subtree_text(spark, sf_dir):
    n = derive.nodes(spark, sf_dir)
    return tree.subtree_text(n, tree.closure(n))


@query(f"""with {NODES_SQL}, kids as (select version, parent id, count(*) children from nodes where parent is not null group by all)
select n.version, n.id, lag(n.id) over w as before, lead(n.id) over w as after, coalesce(children, 0) children, count(*) over (partition by n.version, n.parent, n.type) - 1 siblings,
 not exists (select 1 from nodes o where o.version = 'v2' and o.id = n.id) missing
from nodes n left join kids k on k.version = n.version and k.id = n.id where n.version = 'v1' window w as (partition by n.version, n.parent, n.type order by n.ord)""")
def tree_neighbours(spark, sf_dir):
    return tree.neighbours(*_versions(spark, sf_dir), most=0).drop("nearest")


@query(f"""with {NODES_SQL}, o_ as (select * from nodes where version = 'v1'), x_ as (select a.id, b.id other, b.ord, row_number() over (partition by a.id order by abs(b.ord - a.ord), b.ord) nth, count(*) over (partition by a.id) n
 from o_ a join o_ b on a.id <> b.id and (a.parent = b.parent or a.parent is null and b.parent is null and a.type = b.type)),
y_ as (select id, any_value(n) siblings, list(other order by ord) nearest, count(*) filter (other not in (select id from nodes where version = 'v2')) n_missing from x_ where nth <= 30 group by id)
select 'v1' as version, o_.id, coalesce(siblings, 0) siblings, coalesce(array_to_string(nearest, ','), '') nearest, coalesce(n_missing, 0)::int n_missing from o_ left join y_ using (id)""")
def tree_siblings(spark, sf_dir):
    """How many siblings each node has, and the nearest 30."""
    out = tree.neighbours(*_versions(spark, sf_dir))
    return out.select("version", "id", "siblings", F.array_join(F.transform("nearest", lambda x: x["id"]), ",").alias("nearest"), F.size(F.filter("nearest", lambda x: x["missing"])).alias("n_missing"))


@query(f"""with {NODES_SQL}, step as (select version, id, ord - lag(ord) over (partition by version order by ord) s from nodes)
select version, id, 'gap' what from step where s > 1 union all
select version, id, 'empty' from nodes n where text = '' and not exists (select 1 from nodes k where k.version = n.version and k.parent = n.id)""")
def tree_violations(spark, sf_dir):
    return tree.violations(derive.nodes(spark, sf_dir))


@query(f"with {DIFF_SQL} select * from diff_")
def diff_nodes(spark, sf_dir):
    return diff.diff_nodes(*_versions(spark, sf_dir))


@query(f"with {DIFF_SQL} select to_id from diff_ where status = 'added' and to_hash in (select from_hash from diff_ where status = 'removed')")
def diff_ambiguous(spark, sf_dir):
    return diff.ambiguous(diff.diff_nodes(*_versions(spark, sf_dir)))


@query(f"with {DIFF_SQL} select status, type, count(*) n from diff_ group by rollup (status, type) having status is not null")
def diff_counts(spark, sf_dir):
    return diff.counts(diff.diff_nodes(*_versions(spark, sf_dir)))


@query(f"""with {DIFF_SQL}, e as (select distinct status, from_id, to_id, ancestor from (
 select status, from_id, to_id, ancestor from diff_ join closure_ on version = 'v1' and id = from_id union all select status, from_id, to_id, ancestor from diff_ join closure_ on version = 'v2' and id = to_id))
select ancestor, count(*) filter (status = 'unchanged') unchanged, count(*) filter (status = 'changed') changed, count(*) filter (status = 'moved') moved, count(*) filter (status = 'added') added, count(*) filter (status = 'removed') removed from e group by ancestor""")
def diff_rollup(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return diff.rollup_diff(diff.diff_nodes(old, new), tree.closure(old), tree.closure(new))


@query(f"""with {DIFF_SQL}, r as (select 'src' || doc_id % 20 || '.d' || doc_id || '.p0' id from documents)
select r.id, coalesce(status, 'unknown_id') status, moved_to, moved_from from r left join (
 select coalesce(from_id, to_id) id, status, case when status = 'moved' then to_id end moved_to, null moved_from from diff_
 union all select to_id, status, null, from_id from diff_ where status = 'moved') d using (id)""")
def diff_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select(F.format_string("src%d.d%d.p0", F.col("doc_id") % 20, "doc_id").alias("id"))
    return diff.lookup(asked, diff.diff_nodes(*_versions(spark, sf_dir)))


@query(f"""with {DIFF_SQL}, o as (select status, unnest(case when type = 'source' then ['all'] else ['all', 'without'] end) scope from diff_ where from_id is not null)
select scope, count(*) total, count(*) filter (status <> 'removed') mapped, floor(count(*) filter (status <> 'removed') / count(*) * 1e6 + 0.5) / 1e6 share from o group by scope""")
def diff_traceability(spark, sf_dir):
    return diff.traceability(diff.diff_nodes(*_versions(spark, sf_dir)), "source")


@query(f"""with {NODES_SQL} select count(*) total, count(b.id) shared, floor(count(b.id) / count(*) * 1e6 + 0.5) / 1e6 share from (select id from nodes where version = 'v1') a left join (select id from nodes where version = 'v2') b using (id)""")
def diff_parity(spark, sf_dir):
    return diff.parity(*_versions(spark, sf_dir))


@query("""with v as (select 'y' || y as version, y || '-03-01' f from (select distinct year(o_orderdate) y from orders)),
i as (select version, case when row_number() over (order by f) = 1 then '0000-01-01' else f end f, lead(f) over (order by f) t from v)
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as_of, version from orders join i on strftime(o_orderdate, '%Y-%m-%d') >= f and (t is null or strftime(o_orderdate, '%Y-%m-%d') < t)""")
def version_as_of(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    known = orders.select(F.year("o_orderdate").alias("y")).distinct().select(F.concat(F.lit("y"), "y").alias("version"), F.concat(F.col("y").cast("string"), F.lit("-03-01")).alias("effective_from"))
    return versions.version_as_of(orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of")), known)


@query(f"""with {NODES_SQL}, r as (select doc_id request_id, source || case when doc_id % 19 = 0 then '.x' when doc_id % 13 = 7 and doc_id % 2 = 0 then '.m' else '.d' end || doc_id || '.p0' id, case when doc_id % 2 = 0 then 'v2' else 'v1' end as version from documents),
o as (select id, arg_max(version, version) v, arg_max(text, version) t from nodes group by id)
select request_id, r.id, case when n.id is not null then r.version else v end found, coalesce(n.text, t) as text, case when n.id is not null then null when v is null then 'unknown_id' else 'not_in_version' end reason
from r left join nodes n on n.version = r.version and n.id = r.id left join o on o.id = r.id""")
def version_lookup(spark, sf_dir):
    d = F.col("doc_id")
    mark = F.when(d % 19 == 0, ".x").when((d % 13 == 7) & (d % 2 == 0), ".m").otherwise(".d")
    asked = table(spark, sf_dir, "documents").select(d.alias("request_id"), F.concat("source", mark, d.cast("string"), F.lit(".p0")).alias("id"), F.when(d % 2 == 0, "v2").otherwise("v1").alias("version"))
    return versions.lookup(asked, derive.nodes(spark, sf_dir))


def _resolved(spark, sf_dir):
    n = derive.nodes(spark, sf_dir)
    chain = tree.closure(n)
    return n, chain, rules.resolve(chain, derive.rules(spark, sf_dir))


@query(f"with {NODES_SQL}, {RESOLVED_SQL} select version, id, rule_id, explicit, applies_from from resolved_")
def rules_resolved(spark, sf_dir):
    return _resolved(spark, sf_dir)[2].select("version", "id", "rule_id", "explicit", "applies_from")


@query(f"""with {NODES_SQL}, {RESOLVED_SQL}, d as (select *, unnest(['2024-06-01', '2026-06-01', '2028-01-01', '2028-08-02']) as_of from resolved_)
select version, id, as_of, case when as_of < applies_from then 'not_yet_applicable_until' when as_of < case rule_id when 'document' then '2028-08-02' else applies_from end then 'unknown' else 'in_force_at_as_of' end state,
 case when as_of < applies_from then applies_from end as until, case when rule_id = 'document' then (as_of < '2027-12-02')::int + (as_of < '2028-08-02')::int else 0 end ahead from d""")
def rules_state(spark, sf_dir):
    dates = F.explode(F.array(*[F.lit(x) for x in ("2024-06-01", "2026-06-01", "2028-01-01", "2028-08-02")]))
    return rules.state_on(_resolved(spark, sf_dir)[2].withColumn("as_of", dates)).select("version", "id", "as_of", "state", "until", F.size("ahead").alias("ahead"))


@query(f"""with {NODES_SQL}, {RESOLVED_SQL}, d as (select r.version, r.id, ord, unnest(case rule_id when 'document' then [applies_from, '2027-12-02', '2028-08-02'] else [applies_from] end) as date from resolved_ r join nodes n using (version, id) where explicit)
select version, ancestor, date, arg_min(d.id, ord) as first from d join closure_ using (version, id) where distance > 0 group by version, ancestor, date""")
def rules_descendant_dates(spark, sf_dir):
    n, chain, resolved = _resolved(spark, sf_dir)
    return rules.descendant_dates(chain, resolved, n)


@query(f"with {NODES_SQL}, {RESOLVED_SQL} select version, type, count(*) nodes, count(*) filter (explicit) explicit, floor(count(*) filter (explicit) / count(*) * 1e6 + 0.5) / 1e6 share from resolved_ group by rollup (version, type) having version is not null")
def rules_coverage(spark, sf_dir):
    n, _, resolved = _resolved(spark, sf_dir)
    return rules.coverage(resolved, n)


BM25_SQL = r"""t as (select doc_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
u as (select id, len(w) len, unnest(w) term from t), idx as (select id, len, term, count(*) tf from u group by all),
sz as (select count(*) n, avg(len) av from (select id, len(w) len from t where len(w) > 0)), df as (select term, count(*) df from idx group by term),
q as (select distinct item_id query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term from benchmark),
s as (select query_id, id, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) * 1e4 + 0.5) / 1e4 score from q join df using (term) join idx using (term), sz group by all)"""


@query(f"with {BM25_SQL} select query_id, rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id) rank from s) where rank <= 8")
def search_bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.words(F.col("text")).alias("terms"))
    words = T.words(F.col("text"))
    return search.search(search.expand(asked), search.build_index(d, words), sizes=search.lengths(d, words))


@query(f"with {BM25_SQL} select query_id, rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id) rank from s) where rank <= 8")
def search_bm25_whole(spark, sf_dir):
    """The same search under its older name."""
    return search_bm25(spark, sf_dir)


@query(f"with {LOG_SQL} select case_id, model, arm, rep, seq, coalesce(correct::varchar, 'none') correct, cost, coalesce(error, '') error from last_")
def eval_latest(spark, sf_dir):
    last = evalstats.latest(derive.log(spark, sf_dir))
    return last.withColumn("correct", F.coalesce(F.col("correct").cast("string"), F.lit("none"))).withColumn("error", F.coalesce("error", F.lit("")))


@query(f"with {LOG_SQL} select * from verdict_")
def eval_verdicts(spark, sf_dir):
    return evalstats.case_verdicts(evalstats.latest(derive.log(spark, sf_dir)))


@query(f"""with {LOG_SQL}, e as (select model, arm, case_id, count(error) errors from last_ group by all), c as (select model, arm, floor(sum(cost) * 100 + 0.5) / 100 as cost from log_ group by rollup (model, arm)),
s as (select model, arm, count(*) cases, count(*) filter (excluded) excluded, count(*) filter (wrong and not excluded) wrong, count(*) filter (any_wrong) any_wrong, sum(runs)::bigint runs, sum(runs - scored)::bigint unparseable, sum(errors)::bigint errors
 from verdict_ join e using (model, arm, case_id) group by rollup (model, arm))
select s.*, c.cost from s join c on s.model is not distinct from c.model and s.arm is not distinct from c.arm""")
def eval_cells(spark, sf_dir):
    return evalstats.cells(derive.log(spark, sf_dir))


@query()
def eval_intervals(spark, sf_dir):
    cells = evalstats.cells(derive.log(spark, sf_dir))
    return evalstats.with_interval(cells.select("model", "arm", F.col("wrong").alias("k"), (F.col("cases") - F.col("excluded")).alias("n")))


@query(f"""with {LOG_SQL}, p as (select case_id, model, arm, rep from (select distinct case_id from log_), (select distinct model from log_), (select distinct arm from log_), (select unnest(range(1, 5))::int rep))
select * from p where not exists (select 1 from last_ l where l.error is null and l.case_id = p.case_id and l.model = p.model and l.arm = p.arm and l.rep = p.rep)""")
def eval_pending(spark, sf_dir):
    runs = derive.log(spark, sf_dir)
    return evalstats.pending(runs.select("case_id").distinct(), runs.select("model").distinct(), runs.select("arm").distinct(), 4, runs)


@query(f"""with {LOG_SQL}, m as (select model, arm, avg(cost) filter (error is null) * 1.5 own from log_ group by all)
select model, arm, floor(coalesce(own, max(own) over (partition by arm), 0.1) * 1e6 + 0.5) / 1e6 estimate from m""")
def eval_estimates(spark, sf_dir):
    return evalstats.estimates(derive.log(spark, sf_dir))


@query("""with p as (select o_custkey as key, o_orderkey seq, o_totalprice estimate from orders), s as (select *, sum(estimate) over (partition by key order by seq) x from p),
f as (select *, max((x > 1000000)::int) over (partition by key order by seq) o from s) select key, seq, floor(x * 100 + 0.5) / 100 spent from f where o = 0""")
def eval_budget(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("estimate"))
    return evalstats.within_budget(plan, 1_000_000).select("key", "seq", (F.floor(F.col("spent") * 100 + 0.5) / 100).alias("spent"))


@query("select page_id, url from pages where length(html) > 2000 and html like '%<html%' and html like '%<article>%' and not regexp_matches(html, '(?i)<title>[^<]*(error|redirect)')")
def source_gate(spark, sf_dir):
    return io.acceptable(table(spark, sf_dir, "pages"), "<article>", 2000).select("page_id", "url")


@query("""with l as (select doc_id, case when doc_id % 7 = 0 then 5 else quality end quality, case when doc_id % 11 = 0 then null else toxic end toxic from labels)
select doc_id id, 'quality' field, 'not one of 0, 1' why from l where quality is null or quality not in (0, 1)
union all select doc_id, 'toxic', 'missing' from l where toxic is null union all select doc_id, 'quality', 'not one of 0, 1' from l where doc_id % 13 = 0 and (quality is null or quality not in (0, 1))
union all select doc_id, 'toxic', 'missing' from l where doc_id % 13 = 0 and toxic is null union all select doc_id, 'doc_id', 'not unique' from l where doc_id % 13 = 0""")
def source_rejects(spark, sf_dir):
    """Labels of which some are made wrong, some missing and some doubled."""
    rules_ = [("quality", ~F.coalesce(F.col("quality").isin(0, 1), F.lit(False)), "not one of 0, 1"), ("toxic", F.col("toxic").isNull(), "missing")]
    d = F.col("doc_id")
    given = table(spark, sf_dir, "labels").select("doc_id", F.when(d % 7 == 0, 5).otherwise(F.col("quality")).alias("quality"), F.when(d % 11 != 0, F.col("toxic")).alias("toxic"))
    return io.validate(given.unionByName(given.filter(d % 13 == 0)), "doc_id", rules_)[1]


@query("select doc_id, sha256(text) hash, sha256(" + logs.PLAIN.format("lang") + " || chr(10) || " + logs.PLAIN.format("text") + ") node_hash from documents where text is not null and lang is not null")
def text_hashes(spark, sf_dir):
    """Content hash, and the hash of normal heading and text."""
    return table(spark, sf_dir, "documents").filter("text is not null and lang is not null").select("doc_id", F.sha2("text", 256).alias("hash"), T.node_hash(F.col("lang"), F.col("text")).alias("node_hash"))


@query(r"""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') iso, (case o_orderkey % 4 when 3 then null else strftime(o_orderdate, '%Y-%m-%d') end) parsed from orders""")
def text_dates(spark, sf_dir):
    """Each order's date is written in one of four ways (one of them impossible) and read back."""
    d = F.col("o_orderdate")
    iso, k = F.date_format(d, "yyyy-MM-dd"), F.col("o_orderkey") % 4
    written = F.when(k == 0, T.readable_date(iso, F.lit("en"))).when(k == 1, T.readable_date(iso, F.lit("de"))).when(k == 2, F.date_format(d, "d.M.yyyy")).otherwise(F.date_format(d, "yyyy-MM-'45'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso.alias("iso"), T.parse_date(written).alias("parsed"))


@query("select doc_id, len(string_split(" + audits.NORM.format("text") + ", ' '))::int - 2 n_tokens, sha256(" + audits.NORM.format("text") + ") tokens from documents where text is not null")
def text_tokens(spark, sf_dir):
    """How many tokens every text has, and a digest of them."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")), 256).alias("tokens"))


@query(rf"""with {NODES_SQL} select a.id, '' deleted, 'amended' inserted, case when regexp_matches(a.text, '\S') then 2 else 1 end::int n_runs
from nodes a join nodes b on a.id = b.id where a.version = 'v1' and b.version = 'v2' and a.hash <> b.hash""")
def diff_words(spark, sf_dir):
    """What was deleted and inserted in each changed node."""
    runs = worddiff.word_diffs(worddiff.changed_texts(*_versions(spark, sf_dir)))
    of = lambda op: F.array_join(F.transform(F.filter("runs", lambda r: r["op"] == op), lambda r: r["text"]), " ")
    return runs.select("id", of("delete").alias("deleted"), of("insert").alias("inserted"), F.size("runs").alias("n_runs"))


@query("""with c as (select case when user_id % 3 = 0 then 'b' else 'a' end arm, event_id % 1000 ti, user_id % 500 tout, value / 100 fee from events),
m as (select arm, count(*) n, avg(ti) i, avg(tout) o, avg(fee) fee from c group by arm), p as (select * from (values ('large', 0.003, 0.015), ('small', 0.0005, 0.002)) v(target, pi, po))
select target, arm, floor(sum(n * (i * pi + o * po + fee)) * 100 + 0.5) / 100 as cost from m, p group by rollup (target, arm) having target is not null""")
def eval_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.when(F.col("user_id") % 3 == 0, "b").otherwise("a").alias("arm"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("user_id") % 500).alias("tokens_out"), (F.col("value") / 100).alias("fee"))
    prices = spark.createDataFrame([("large", 0.003, 0.015), ("small", 0.0005, 0.002)], "target string, price_in double, price_out double")
    return evalstats.project_cost(calls, prices)


OBLIGATIONS = [
    {"id": "records", "effective": "2025-02-02"},
    {"id": "audit", "roles": ["BUILDING", "MACHINERY"], "applies_if": {"eq": ["big", True]}, "effective": "2026-08-02", "not_before": "2026-12-02"},
    {"id": "notice", "roles": ["AUTOMOBILE"], "applies_if": {"in": ["nation", [1, 2, 3, 4, 5]]}},
    {"id": "register", "applies_if": {"all": [{"eq": ["listed", True]}, {"not": {"eq": ["big", True]}}]}, "effective": "2027-08-02"},
]
DERIVED = {"listed": {"any": [{"in": ["nation", [0, 5, 10]]}, {"has": ["roles", "HOUSEHOLD"]}]}}
PROFILES_SQL = """profiles_ as (select c_custkey profile_id, c_mktsegment seg, c_nationkey nation, case when c_custkey % 4 = 0 then null else c_acctbal > 5000 end big,
  c_nationkey in (0, 5, 10) or c_mktsegment = 'HOUSEHOLD' listed, ['2026-01-01', '2026-12-02', '2027-01-01'][c_custkey % 3 + 1] as_of from customer),
met_o as (select profile_id, as_of, 'records' id, '2025-02-02' effective from profiles_ union all
  select profile_id, as_of, 'audit', '2026-12-02' from profiles_ where seg in ('BUILDING', 'MACHINERY') and big union all
  select profile_id, as_of, 'notice', null from profiles_ where seg = 'AUTOMOBILE' and nation between 1 and 5 union all
  select profile_id, as_of, 'register', '2027-08-02' from profiles_ where listed and big is not true),
found_ as (select *, case when effective is null then 'depends' when effective <= as_of then 'applicable' else 'upcoming' end status, greatest(0, effective::date - as_of::date)::int as days from met_o)"""


def _profiles(spark, sf_dir):
    c = F.col("c_custkey")
    as_of = F.get(F.array(F.lit("2026-01-01"), F.lit("2026-12-02"), F.lit("2027-01-01")), (c % 3).cast("int"))
    return table(spark, sf_dir, "customer").select(c.alias("profile_id"), F.array("c_mktsegment").alias("roles"), F.col("c_nationkey").alias("nation"), F.when(c % 4 != 0, F.col("c_acctbal") > 5000).alias("big"), as_of.alias("as_of"))


@query(f"""with {PROFILES_SQL} select profile_id, as_of, id, effective, status, case when effective is not null then days end as days,
row_number() over (partition by profile_id order by case status when 'applicable' then 1 when 'upcoming' then 2 else 3 end, effective nulls last, id)::int nth from found_""")
def obligations_ranked(spark, sf_dir):
    found = eligibility.obligations_of(eligibility.with_derived(_profiles(spark, sf_dir), DERIVED), OBLIGATIONS)
    return eligibility.ranked(found.drop("literal", "routes"))


@query(f"with {PROFILES_SQL} select profile_id, effective, string_agg(id, ',' order by id) ids from found_ where effective >= as_of group by profile_id, effective")
def obligations_timeline(spark, sf_dir):
    return eligibility.timeline(eligibility.obligations_of(eligibility.with_derived(_profiles(spark, sf_dir), DERIVED), OBLIGATIONS))


@query(f"with {PROFILES_SQL} select profile_id, 'big' field from profiles_ where big is null and (listed or seg in ('BUILDING', 'MACHINERY'))")
def obligations_open_questions(spark, sf_dir):
    return eligibility.open_questions(_profiles(spark, sf_dir), OBLIGATIONS, {"big": [True, False]}, DERIVED)
