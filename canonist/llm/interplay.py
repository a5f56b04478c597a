"""Interaction of filters: what each removes in every order of applying them, and its Shapley value.

A document's failures are a set of filters. States are the sets of filters applied so far; an edge applies one more. How many orders reach a
state is counted forward, how many leave it backward; an edge's removals, weighted by the orders through it, give the Shapley
sums, and every step of every order reads what its edge holds. So documents are counted once, by part and set of failures, and
all orders are answered from these few counts.

Defined cases: a null text is empty, a null lang the part ""; an empty text has no words, so it fails A alone (and E if repeated); a null
doc_id is smaller and larger than none; rows of equal text and equal doc_id don't make each other fail E; a document with several
rows of labels is good or toxic if one of them says so; an empty table gives no rows; very long texts are read whole. Only doc_id,
text and lang are read, so other columns can't clash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import merge

SPACES = r"[\x20\x09-\x0D]+"
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails the k-th filter; the last one is E), n, good, toxic. Copies are counted together before they
    meet by their text's hash, so that no text is hot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(text).values())), F.lit(0))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), mask.alias("mask"))
    told = labels.groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    marked = rows.join(merge(told), "doc_id", "left").fillna(0, ["good", "toxic"])
    kinds = ["hash", "part", "mask", "good", "toxic"]
    # rows of one doc_id first, then each kind's least doc_id with its rows
    each = marked.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    without = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    kept = each.groupBy(*kinds).agg(F.sum("n").alias("n"), least.alias("least"), without.alias("without"))
    first = F.min("least.doc_id").over(Window.partitionBy("hash"))
    unique = F.col("without") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = kept.withColumn("unique", unique).withColumn("both", F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n"))))
    flat = split.select("part", "good", "toxic", F.explode("both").alias("b")).select("part", "b.mask", "b.n", (F.col("b.n") * F.col("good")).alias("good"), (F.col("b.n") * F.col("toxic")).alias("toxic"))
    return flat.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every state, how many orders reach it from the empty set, and how many lead from it to the full one."""
    states = sorted(range(1 << n), key=int.bit_count)
    reach, leave = [0] * (1 << n), [0] * (1 << n)
    reach[0] = leave[-1] = 1
    for s in states:
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in reversed(states):
        leave[s] += sum(leave[s | 1 << f] for f in range(n) if not s >> f & 1)
    return reach, leave


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """state, filter, orders: the edges of n filters' subsets, with the number of orders through each. Its size depends on n alone."""
    reach, leave = path_counts(n)
    return spark.createDataFrame([(s, f, reach[s] * leave[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1], "state int, filter int, orders long")


def orders(spark: SparkSession, names: str) -> DataFrame:
    """filter_order, step, state, filter: every step of every order as the edge that it takes."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[k] for k in order), step, sum(1 << k for k in order[: step - 1]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def interplay(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from cells(). At most seven filters:
    their orders grow as the factorial."""
    if not 1 <= len(names) <= 7:
        raise ValueError("one to seven filters")
    spark, n = counts.sparkSession, len(names)
    at = counts.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bit = F.expr("shiftleft(1, filter)")
    at = at.withColumn("bit", bit).filter(F.col("state").bitwiseAND(F.col("bit")) == 0)
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0
    count = lambda which, measure="n": F.sum(F.when(which, F.col(measure)).otherwise(0))
    edges = at.groupBy("part", "state", "filter").agg(
        count(~fails & ~before).alias("kept"),
        count(fails & ~before).alias("removed"),
        count(fails & before).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~before, "good").alias("good_lost"),
        count(fails & ~before, "toxic").alias("toxic_lost"),
    )
    own = Window.partitionBy("part", "filter")
    edges = edges.join(F.broadcast(lattice(spark, n)), ["state", "filter"]).withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(own))
    steps = edges.join(F.broadcast(orders(spark, names)), ["state", "filter"])
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
