"""Line dedup by pairwise alignment.

Documents that overlap are found through hashes of runs of lines: the shortest run from each line on, and the shortest up to
each line, that reaches `block_words` words. Every line of a block that two documents share lies in such a run inside the block,
so a later document is paired with the earliest one that holds each of its runs, and a run that a third of all documents
share makes one pair for each of them, not one for every two. Each pair is aligned with patience diff; aligned blocks of at
least `block_words` words go from the later one. An alignment keeps one rising chain: blocks that cross it (moved or
repeated) are then looked up by their runs and go too.

Defined cases: earlier means smaller doc_id (null last), then earlier row; a null or empty text has no lines and stays as
it is; lines that differ in white space only are equal; blank lines don't interrupt a block; a document of which nothing
but blank lines is left by deletion is dropped; all other rows keep all columns (n_chars follows the text), but that __lines and
__cut replace columns of these names. Very long texts are whole; equal rows each count; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merge, numbered, restored

BLOCK_WORDS = 20


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by first) whose seconds rise too: patience sorting."""
    tops, top_at, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back[n] = top_at[k - 1] if k else -1
        tops[k:k + 1], top_at[k:k + 1] = [j], [n]
    out, n = [], top_at[-1] if top_at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines of a and b: common ends, then lines unique in both, then what lies between."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        of_a, of_b = Counter(a[i:i2]), Counter(b[j:j2])
        once = {b[k]: k for k in range(j, j2) if of_b[b[k]] == 1}
        anchors = _longest([(k, once[a[k]]) for k in range(i, i2) if of_a[a[k]] == 1 and a[k] in once])
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i2, j2)], strict=True):
            if anchors:
                todo.append((p + 1, p2, q + 1, q2))
        out += anchors
    return sorted(out)


def runs(x: list[tuple], least: int) -> set[tuple[int, int]]:
    """(from, to) of the shortest runs of lines in a row from each line on, and up to each line, that reach least words."""
    upto, out, at = [0, *accumulate(w for *_, w in x)], set(), 0
    while at < len(x):
        end = at + 1
        while end < len(x) and x[end][0] == x[end - 1][0] + 1:
            end += 1
        for k in range(at, end):
            to, back = bisect_left(upto, upto[k] + least, k + 1, end + 1), bisect_right(upto, upto[k + 1] - least, at, k + 1) - 1
            if to <= end:
                out.add((k, to))
            if back >= at:
                out.add((back, k + 1))
        at = end
    return out


def blocks(a: list[tuple], b: list[tuple], least: int) -> list[int]:
    """Line numbers of a to delete. a, b: (nth, line, hash, words) of the lines that either shares with any document."""
    both, cut, run, words = patience([x[2] for x in a], [x[2] for x in b]), [], [], 0
    last = None
    for i, j in [*both, (None, None)]:
        now = (a[i][0], b[j][0]) if i is not None else None
        if now is None or last is None or now != (last[0] + 1, last[1] + 1):
            if words >= least:
                cut += run
            run, words = [], 0
        if now is not None:
            run.append(a[i][1])
            words += a[i][3]
        last = now
    gone = set(cut)
    held = {tuple(x[2] for x in b[i:j]) for i, j in runs(b, least)}
    for i, j in runs(a, least):  # what crosses the chain
        if not gone.issuperset(x[1] for x in a[i:j]) and tuple(x[2] for x in a[i:j]) in held:
            cut += [x[1] for x in a[i:j]]
    return sorted({*cut})


def deletions(held: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """__uid, cut (line numbers from 0 to delete) of the rows of held (doc_id, text, __uid) that lose lines."""
    scratch = Scratch(held.sparkSession)
    stored = scratch.stored
    plain = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    told = F.filter(F.transform(plain, lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("words"))), lambda x: x["words"] > 0)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__uid")
    rows = held.filter("text is not null").select(at.alias("at"), F.posexplode(told).alias("nth", "x")).select("at", "nth", "x.line", "x.h", "x.words")
    rows = stored(rows, "lines")
    # rare: held by another document too; counted and stored first, so that the join can be split at a frequent line
    owner = rows.groupBy("h").agg(F.min("at").alias("owner"), F.max("at").alias("other")).filter(F.col("owner") != F.col("other")).select("h")
    shared = stored(rows.join(merge(stored(owner, "owners")), "h"), "shared")
    scratch.drop("lines", "owners")
    lists = stored(shared.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("nth", "line", "h", "words"))).alias("own"), F.sum("words").alias("n")).filter(F.col("n") >= block_words).drop("n"), "lists")
    scratch.drop("shared")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for xs in batch.column("own").to_pylist():
                hashes = array("q", [x["h"] for x in xs]).tobytes()
                met = {hashes[8 * i : 8 * j] for i, j in runs([(x["nth"], x["words"]) for x in xs], block_words)}
                keys.append([int.from_bytes(blake2b(k, digest_size=8).digest(), "little", signed=True) for k in met])
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(keys, pa.list_(pa.int64()))], ["at", "keys"])

    seeded = lists.mapInArrow(seeds, f"at {lists.schema['at'].dataType.simpleString()}, keys array<long>")
    keys = stored(seeded.select("at", F.explode("keys").alias("key")), "runs")
    first = keys.groupBy("key").agg(F.min("at").alias("owner"), F.max("at").alias("other")).filter("owner != other").select("key", "owner")
    pairs = stored(keys.join(merge(stored(first, "firsts")), "key").filter("at != owner").select("at", "owner").distinct(), "pairs")
    scratch.drop("runs", "firsts")
    later, earlier = lists.select("at", F.col("own").alias("a")), lists.select(F.col("at").alias("owner"), F.col("own").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tell = lambda xs: [(x["nth"], x["line"], x["h"], x["words"]) for x in xs]
            cuts = [blocks(tell(a), tell(b), block_words) for a, b in zip(batch["a"], batch["b"], strict=True)]
            out = pd.DataFrame({"__uid": batch["__uid"], "cut": cuts})
            yield out[out["cut"].str.len() > 0]

    met = pairs.join(merge(later), "at").join(merge(earlier), "owner").select(F.col("at.__uid").alias("__uid"), "a", "b").mapInPandas(run, "__uid long, cut array<int>")
    cuts = stored(met.groupBy("__uid").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut")), "cuts")
    scratch.drop("lists", "pairs")
    return cuts


def dedup_lines(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of documents, text without the deleted lines, and __lines (before) and __cut (how many went)."""
    held = Scratch(documents.sparkSession).stored(numbered(documents), "documents")
    text = F.col("__row.text").cast("string")
    cuts = deletions(held.select("__uid", F.col("__row.doc_id").alias("doc_id"), text.alias("text")), block_words)
    # the same plan at every size: the cuts grow with the documents, so they are never broadcast
    out = held.join(merge(cuts), "__uid", "left").withColumn("__lines", F.split(text, "\n"))
    cut, lines = F.col("cut"), F.col("__lines")
    left = F.when(cut.isNull(), text).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(cut, i)), "\n"))
    out = out.withColumn("__left", left).filter(cut.isNull() | (F.trim(F.regexp_replace("__left", r"\s+", " ")) != ""))
    results = {"text": F.col("__left"), "__lines": F.coalesce(F.size(lines), F.lit(0)), "__cut": F.coalesce(F.size(cut), F.lit(0))}
    if "n_chars" in documents.columns:
        results["n_chars"] = F.when(cut.isNull(), F.col("__row.n_chars")).otherwise(F.length("__left").cast(dict(documents.dtypes)["n_chars"]))
    return out.select(*restored(documents.columns, results))
