"""Which version holds on a date, and bulk lookup of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C


def intervals(versions: DataFrame) -> DataFrame:
    """versions (version, effective_from) with effective_to (exclusive, null for the last); the first reaches back for ever."""
    order = Window.orderBy("effective_from")  # a handful of rows: the table of versions
    return versions.select("version", F.when(F.row_number().over(order) == 1, F.lit("0000-01-01")).otherwise(F.col("effective_from")).alias("effective_from"), F.lead("effective_from").over(order).alias("effective_to"))


def version_as_of(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (as_of, an ISO string) with the version in force; the day itself belongs to the new version."""
    held = F.broadcast(intervals(versions))
    inside = (F.col("as_of") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("as_of") < F.col("effective_to")))
    return requests.join(held, inside, "left").drop("effective_from", "effective_to")


def lookup(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, id, version -> found version, text, reason: the asked version, else any other, else unknown_id."""
    here = nodes.select("version", "id", F.col("text").alias("own"))
    other = nodes.groupBy("id").agg(F.max_by(F.struct(F.col("version").alias("v"), F.col("text").alias("t")), "version").alias("o"))
    out = requests.join(here, ["version", "id"], "left").join(other, "id", "left")
    missing = F.col("own").isNull()
    return out.select("request_id", "id", F.when(~missing, F.col("version")).otherwise(F.col("o.v")).alias("found"), F.coalesce("own", F.col("o.t")).alias("text"), F.when(~missing, F.lit(None).cast("string")).when(F.col("o").isNull(), "unknown_id").otherwise("not_in_version").alias("reason"))


def provisions(requests: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """request_id, id, version, text, reason, fallback (version and text elsewhere): requests (request_id, citation or id as text, asked: a
    version or null, as_of). The version asked for outweighs the date. reason: not_in_consolidated_version where the newest version lacks
    an id, not_in_version where an older one does, unknown_id where all do."""
    dated = version_as_of(C.with_ids(requests, "citation", "parsed"), known).withColumn("id", F.coalesce("parsed", "citation"))
    dated = dated.withColumn("version", F.coalesce("asked", "version")).drop("parsed")
    here = nodes.select("version", "id", "text", F.lit(True).alias("there"))
    every = nodes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("version", "text"))).alias("all"))  # a row a version
    newest = known.agg(F.max_by("version", "effective_from").alias("newest"))
    out = dated.join(here, ["version", "id"], "left").join(every, "id", "left").join(F.broadcast(newest))
    missing = F.col("there").isNull()
    reason = F.when(missing, F.when(F.col("all").isNull(), "unknown_id").when(F.col("version") == F.col("newest"), "not_in_consolidated_version").otherwise("not_in_version"))
    return out.select("request_id", "id", "version", "text", reason.alias("reason"), F.when(missing, F.get("all", F.lit(0))).alias("fallback"))
