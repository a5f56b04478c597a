"""Evidence records in bulk: a quotation's verification with the hashes of the nodes it cites, sealed by a hash, and checked again later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The most characters of each field.
LIMITS = {"question": 2000, "creator": 200, "quote": 5000}
#: What decides whether a record still holds.
DECISIVE = ("status", "id", "found_version", "validity")


def too_long(requests: DataFrame) -> DataFrame:
    """record_id, field: fields beyond their limit."""
    over = F.array_compact(F.array(*[F.when(F.length(f) > n, F.lit(f)) for f, n in LIMITS.items()]))
    return requests.select("record_id", F.explode(over).alias("field"))


def cited_nodes(verified: DataFrame, nodes: DataFrame, key: str = "record_id") -> DataFrame:
    """key, cited (version, lang, id, hash, node_hash; each once, sorted): the nodes that a result names as its place or candidates."""
    place = F.struct(F.col("found_version").alias("version"), F.col("found_lang").alias("lang"), "id")
    others = F.transform(F.coalesce("candidates", F.expr("cast(array() as array<struct<version:string,lang:string,id:string,piece:string>>)")), lambda c: F.struct(c["version"].alias("version"), c["lang"].alias("lang"), c["id"].alias("id")))
    named = verified.select(key, F.explode(F.array_distinct(F.concat(F.array_compact(F.array(F.when(F.col("id").isNotNull(), place))), others))).alias("x")).select(key, "x.*")
    held = named.join(nodes.select("version", "lang", "id", "hash", "node_hash"), ["version", "lang", "id"], "left")
    return held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("version", "lang", "id", "hash", "node_hash"))).alias("cited"))


def _body() -> Column:
    return F.struct("record_id", "question", "creator", "created_at", F.struct("quote", "claimed", "version", "lang").alias("input"), F.struct(*DECISIVE, "similarity", "matched_text").alias("result"), "cited")


def record_hash(body: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct (null members left out)."""
    return F.sha2(T.canonical_json(F.to_json(body)).cast("binary"), 256)


def create(requests: DataFrame, verified: DataFrame, nodes: DataFrame) -> DataFrame:
    """Records of the requests within the limits: requests (record_id, question, creator, created_at, quote, claimed, version, lang) with
    the decisive fields of verified (record_id and what verify tells, with validity), the cited nodes and record_hash."""
    fit = requests.join(too_long(requests).select("record_id").distinct(), "record_id", "left_anti")
    told = verified.select("record_id", *DECISIVE, "similarity", "matched_text")
    out = fit.join(told, "record_id").join(cited_nodes(verified, nodes), "record_id", "left")
    out = out.withColumn("cited", F.coalesce("cited", F.expr("cast(array() as array<struct<version:string,lang:string,id:string,hash:string,node_hash:string>>)")))
    return out.withColumn("record_hash", record_hash(_body()))


def recheck(records: DataFrame, verified: DataFrame, nodes: DataFrame) -> DataFrame:
    """record_id, hash_ok, cited_ok (every cited node is there with both hashes), differences (names of fields that now come out another
    way), failed (names of the checks that failed), all_ok. verified: what verify now tells of the records' inputs."""
    fresh = verified.select("record_id", *[F.col(c).alias(f"now_{c}") for c in DECISIVE]).join(cited_nodes(verified, nodes).withColumnRenamed("cited", "now_cited"), "record_id", "left")
    each = records.select("record_id", F.explode("cited").alias("x")).select("record_id", "x.*")
    there = nodes.select("version", "lang", "id", F.col("hash").alias("h"), F.col("node_hash").alias("nh"))
    bad = each.join(there, ["version", "lang", "id"], "left").groupBy("record_id").agg(F.count_if(~(F.coalesce(F.col("h") == F.col("hash"), F.lit(False)) & F.coalesce(F.col("nh") == F.col("node_hash"), F.lit(False)))).alias("bad"))
    out = records.withColumn("hash_ok", record_hash(_body()) == F.col("record_hash")).join(fresh, "record_id", "left").join(bad, "record_id", "left")
    none = F.expr("cast(array() as array<struct<version:string,lang:string,id:string,hash:string,node_hash:string>>)")
    other = [F.when(~F.col(c).eqNullSafe(F.col(f"now_{c}")), F.lit(c)) for c in DECISIVE] + [F.when(~F.array_sort("cited").eqNullSafe(F.array_sort(F.coalesce("now_cited", none))), F.lit("cited"))]
    out = out.withColumn("cited_ok", F.coalesce("bad", F.lit(0)) == 0).withColumn("differences", F.array_compact(F.array(*other)))
    failed = F.array_compact(F.array(F.when(~F.col("hash_ok"), "record_hash"), F.when(F.size("differences") > 0, "matches_record"), F.when(~F.col("cited_ok"), "cited_nodes")))
    return out.select("record_id", "hash_ok", "cited_ok", "differences", failed.alias("failed"), (F.size(failed) == 0).alias("all_ok"))
