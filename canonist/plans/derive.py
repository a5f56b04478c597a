"""Inputs of the operators, derived from the given tables by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a tree source > document > line. The newer one lacks every 17th document, changes the first line of
    every 11th, the heading of every 23rd, and names every 13th anew. A document's heading is its first three words. ord is unique and
    rises in document order within a version; hash is that of the text, node_hash that of heading and text."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "text")
    both = docs.withColumn("version", F.explode(F.array(F.lit("v1"), F.lit("v2")))).filter("version = 'v1' or doc_id % 17 != 3")
    name = F.when((F.col("version") == "v2") & (F.col("doc_id") % 13 == 7), F.concat(F.lit("m"), F.col("doc_id"))).otherwise(F.concat(F.lit("d"), F.col("doc_id")))
    both = both.withColumn("did", F.concat_ws(".", "source", name))
    lines = both.select("version", "doc_id", "did", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    line = F.when((F.col("version") == "v2") & (F.col("doc_id") % 11 == 5) & (F.col("p") == 0), F.concat("line", F.lit(" amended"))).otherwise(F.col("line"))
    at = (F.substring_index("did", ".", 1).substr(4, 9).cast("long") + 1) * F.lit(10**14)
    lines = lines.select("version", F.concat_ws(".p", "did", F.col("p").cast("string")).alias("id"), F.col("did").alias("parent"), F.lit("line").alias("type"), F.lit("").alias("heading"), line.alias("text"), (at + (F.col("doc_id") + 1) * 10**5 + F.col("p") + 1).alias("ord"))
    heading = F.concat(F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.when((F.col("version") == "v2") & (F.col("doc_id") % 23 == 4), " revised").otherwise(""))
    docs_ = both.select("version", F.col("did").alias("id"), F.col("source").alias("parent"), F.lit("document").alias("type"), heading.alias("heading"), F.lit("").alias("text"), (at + (F.col("doc_id") + 1) * 10**5).alias("ord"))
    roots = both.select("version", F.col("source").alias("id")).distinct().select("version", "id", F.lit(None).cast("string").alias("parent"), F.lit("source").alias("type"), F.lit("").alias("heading"), F.lit("").alias("text"), ((F.expr("substr(id, 4)").cast("long") + 1) * F.lit(10**14)).alias("ord"))
    return roots.unionByName(docs_).unionByName(lines).withColumn("hash", F.sha2("text", 256)).withColumn("node_hash", F.sha2(F.concat("heading", F.lit("\n"), "text"), 256))


NODES_SQL = r"""both_ as (select version, doc_id, source, text, source || '.' || case when version = 'v2' and doc_id % 13 = 7 then 'm' else 'd' end || doc_id did
  from (select doc_id, source, text, unnest(['v1', 'v2']) version from documents where text is not null) where version = 'v1' or doc_id % 17 <> 3),
split_ as (select version, doc_id, did, source, string_split(text, chr(10)) ls from both_),
lines_ as (select version, doc_id, did, source, unnest(range(0, len(ls))) p, unnest(ls) line from split_),
nodes as (select *, sha256(text) hash, sha256(heading || chr(10) || text) node_hash from (
  select version, did || '.p' || p id, did parent, 'line' as type, '' heading, line || case when version = 'v2' and doc_id % 11 = 5 and p = 0 then ' amended' else '' end as text,
    (substr(source, 4)::bigint + 1) * 100000000000000 + (doc_id + 1) * 100000 + p + 1 ord from lines_
  union all select version, did, source, 'document', array_to_string(string_split(text, ' ')[1:3], ' ') || case when version = 'v2' and doc_id % 23 = 4 then ' revised' else '' end, '', (substr(source, 4)::bigint + 1) * 100000000000000 + (doc_id + 1) * 100000 from both_
  union all select distinct version, source, null, 'source', '', '', (substr(source, 4)::bigint + 1) * 100000000000000 from both_)),
closure_ as (select version, id, id ancestor, 0 distance from nodes
  union all select version, id, parent, 1 from nodes where parent is not null
  union all select a.version, a.id, b.parent, 2 from nodes a join nodes b on a.version = b.version and a.parent = b.id where b.parent is not null)"""


DIFF_SQL = NODES_SQL + r""", both2 as (select coalesce(a.id, b.id) id, a.type ot, a.node_hash oh, b.type nt, b.node_hash nh from (select * from nodes where version = 'v1') a full join (select * from nodes where version = 'v2') b on a.id = b.id),
g1 as (select oh h, min(id) id from both2 where nh is null group by oh having count(*) = 1), c1 as (select nh h, min(id) id from both2 where oh is null group by nh having count(*) = 1),
moves as (select g1.id f, c1.id t, h from g1 join c1 using (h)),
diff_ as (select case when oh = nh then 'unchanged' else 'changed' end status, id from_id, id to_id, nt as type, oh from_hash, nh to_hash from both2 where oh is not null and nh is not null
 union all select case when t is null then 'removed' else 'moved' end, id, t, ot, oh, case when t is not null then oh end from both2 left join moves on f = id where nh is null
 union all select 'added', null, id, nt, null, nh from both2 where oh is null and id not in (select t from moves))"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default, a rule on every other source but for every fifth document, and one on every seventh document. A rule has as
    many rows as nodes that it names."""
    old = nodes(spark, sf_dir).filter("version = 'v1' and type != 'line'").select("id", "type", F.expr("try_cast(substr(split_part(id, '.', 2), 2) as bigint)").alias("d"), F.expr("cast(substr(split_part(id, '.', 1), 4) as bigint)").alias("s"))
    none, own = F.expr("cast(array() as array<string>)"), F.array("id")
    later = F.array(F.lit("2027-12-02"), F.lit("2028-08-02"))

    def rule(rows: DataFrame, name: str, pos: int, date: str, scope, out, later=none) -> DataFrame:
        return rows.select(F.lit(name).alias("rule_id"), F.lit(pos).alias("pos"), F.lit(pos == 0).alias("is_default"), F.lit(date).alias("applies_from"), scope.alias("scope"), out.alias("except"), later.alias("later_dates"))

    document = F.col("type") == "document"
    default = rule(spark.range(1), "default", 0, "2030-01-01", none, none)
    sources = rule(old.filter((F.col("type") == "source") & (F.col("s") % 2 == 0)), "source", 1, "2025-01-01", own, none)
    fifths = rule(old.filter(document & (F.col("d") % 5 == 0)), "source", 1, "2025-01-01", none, own)
    sevenths = rule(old.filter(document & (F.col("d") % 7 == 0)), "document", 2, "2026-01-01", own, none, later)
    return default.unionByName(sources).unionByName(fifths).unionByName(sevenths)


RESOLVED_SQL = r"""met_ as (select version, id, 'source' rule_id, 1 pos, distance from closure_ where instr(ancestor, '.') = 0 and try_cast(substr(ancestor, 4) as bigint) % 2 = 0
  union all select version, id, 'document', 2, distance from closure_ where ancestor like '%.d%' and instr(ancestor, '.p') = 0 and try_cast(substr(split_part(ancestor, '.', 2), 2) as bigint) % 7 = 0
    and (version, ancestor) in (select 'v1', id from nodes where version = 'v1' union all select 'v2', id from nodes where version = 'v1')),
barred_ as (select distinct version, id from closure_ where ancestor like '%.d%' and instr(ancestor, '.p') = 0 and try_cast(substr(split_part(ancestor, '.', 2), 2) as bigint) % 5 = 0
    and ancestor in (select id from nodes where version = 'v1')),
best_ as (select version, id, arg_min(rule_id, distance * 10 + pos) own from met_ m where not (rule_id = 'source' and exists (select 1 from barred_ b where b.version = m.version and b.id = m.id)) group by all),
resolved_ as (select n.version, n.id, n.type, coalesce(own, 'default') rule_id, own is not null explicit,
  case coalesce(own, 'default') when 'default' then '2030-01-01' when 'source' then '2025-01-01' else '2026-01-01' end applies_from
  from nodes n left join best_ using (version, id))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer log from events: user as case, type of event as model, every third user in arm b, four repetitions, the value as
    score (none below 5) and cost; errors are failed calls."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("case_id"), F.col("event_type").alias("model"), F.when(F.col("user_id") % 3 == 0, "b").otherwise("a").alias("arm"), (F.col("event_id") % 4).cast("int").alias("rep"), F.when(F.col("value") < 5, F.lit(None)).otherwise(F.col("value") >= 20).alias("correct"), F.col("value").alias("cost"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "failed").alias("error"))


LOG_SQL = """log_ as (select event_id seq, user_id % 40 case_id, event_type model, case when user_id % 3 = 0 then 'b' else 'a' end arm, (event_id % 4)::int rep,
  case when value < 5 then null else value >= 20 end correct, value as cost, case when event_type = 'error' and event_id % 2 = 0 then 'failed' end error from events),
last_ as (select case_id, model, arm, rep, max(seq) seq, arg_max({'c': correct}, seq).c correct, arg_max({'c': cost}, seq).c as cost, arg_max({'c': error}, seq).c error from log_ group by all),
verdict_ as (select *, wrong_runs * 2 > runs wrong, wrong_runs > 0 any_wrong, scored = 0 excluded, (wrong_runs + runs - scored) * 2 > runs strict_wrong from
  (select model, arm, case_id, count(*) runs, count(*) filter (correct = false) wrong_runs, count(correct) scored from last_ group by all))"""
