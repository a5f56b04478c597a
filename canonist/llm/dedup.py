"""Near-duplicates by min-max hashing.

Under each random permutation a document keeps both the least and the greatest hash of its word shingles, so half as many
permutations give a signature of the same length, whose share of equal values is an unbiased estimate of the Jaccard
similarity with less variance. Bands of the signature are bucket keys. Equal shingle sets are one class from the start.
Within a bucket each class is held against the bucket's least one (a star, never all pairs). Buckets that then still hold
several components are dealt to blocks of bounded size; of each two blocks the full sets are compared as one product of
matrices, and a link goes out for two components that meet there, never one for each pair. Every link is one of full sets.

Defined cases: a null or wordless text has no shingles and is linked with nothing, not even with its like; equal texts are
linked; equal rows are each a row of the result; a null doc_id never is a component's name unless all its members' are null;
very long texts are whole sets like all others; an empty table gives no rows. Columns of documents keep their names, but one
that is named like a result (__n, __component, __keep) is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merge, numbered, restored
from .components import components

WIDTH = 3
LINK = (85, 100)
BANDS, ROWS = 28, 6
SPACE = " \t\n\v\f\r"
UPPER = {i: i + 32 for i in range(65, 91)}
WORDS_KEPT = 500_000
MEMBERS, SHINGLES = 512, 1 << 19  # of a block of a bucket, about
_known: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_known) > WORDS_KEPT:
        _known.clear()
    for w in {w for w in words if w not in _known}:
        _known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[str]:
    """Words between ASCII white space, A-Z lower-cased."""
    if not text:
        return []
    text = text.lower() if text.isascii() else text.translate(UPPER)
    for c in SPACE[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles; of all words as one where there are fewer."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _band_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), 4096):
        hashed = shingles[at : at + 4096] * a[:, None] + b[:, None]
        low, high = np.minimum(low, hashed.min(axis=1)), np.maximum(high, hashed.max(axis=1))
    both = np.concatenate([low, high]).reshape(2, len(a)).T.reshape(bands, rows)  # a band holds both values of rows / 2 permutations
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + both[:, k])
    return key.view(np.int64)


def signed(held: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """uid, n (shingles), set (digest of the set), bands (a bucket key for each) of rows __uid, text."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 2**63, (2, bands * rows // 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            told = {"uid": batch["uid"], "n": [len(s) for s in sets], "set": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]}
            yield pd.DataFrame(told | {"bands": [_band_keys(s, a, b, bands, rows) if len(s) else None for s in sets]})

    return held.select(F.col("__uid").alias("uid"), "text").mapInPandas(run, "uid long, n long, set binary, bands array<long>")


def shingle_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, shingles of texts (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t, width).view(np.int64) for t in batch["text"]]})

    return texts.select("node", "text").mapInPandas(run, "node long, shingles array<long>")


def linked(sets: list[np.ndarray], of: np.ndarray, part: int, whole: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Two positions for each two components (of) that some sets link: part / whole of the union, at least, is shared."""
    sizes = np.asarray([len(s) for s in sets])
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[code] > 1
    row, code = row[shared], np.cumsum(times > 1)[code[shared]] - 1
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(code, np.arange(0, code[-1] + 1 if len(code) else 0, columns)).tolist() + [len(code)]
    for at, to in zip(edges, edges[1:], strict=False):
        held = np.zeros((len(sets), columns), np.float32)
        held[row[at:to], code[at:to] % columns] = 1
        both += held @ held.T
    good = np.triu(both * whole >= (sizes[:, None] + sizes - both) * part, 1) & (of[:, None] != of)
    x, y = np.nonzero(good)
    if not len(x):
        return []
    _, first = np.unique(np.sort(np.stack([of[x], of[y]]), axis=0), axis=1, return_index=True)
    return list(zip(x[first].tolist(), y[first].tolist(), strict=True))


def block_links(open_: DataFrame, sets: DataFrame, part: int, whole: int, members: int = MEMBERS, shingles: int = SHINGLES) -> DataFrame:
    """u, v: components that meet in a bucket and are linked there. open_: bucket, node, n, component; sets: node, shingles."""
    blocks = open_.groupBy("bucket").agg(F.greatest(F.ceil(F.count("node") / members), F.ceil(F.sum("n") / shingles)).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "bucket").withColumn("b", F.pmod(F.xxhash64("node"), "blocks")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    dealt = dealt.select("bucket", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "node", "component").join(merge(sets), "node")

    def run(group: pa.Table) -> pa.Table:
        names, of = np.unique(group["component"].to_numpy(), return_inverse=True)
        pairs = []
        if of.max() > 0:
            held = group["shingles"].combine_chunks()
            values, ends = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
            pairs = linked(np.split(values, ends[1:-1]), of, part, whole)
        u, v = (names[of[[p[k] for p in pairs]]] if pairs else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "u long, v long")


def similarities(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """pairs u, v with both (size of the intersection) and n (of the union) of the full shingle sets. texts: node, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of_last = None, None
        for batch in batches:
            both, n = [], []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                if a != last:
                    last, of_last = a, shingle_set(a, width)
                y = shingle_set(b, width)
                inter = len(np.intersect1d(of_last, y, assume_unique=True))
                both.append(inter)
                n.append(len(of_last) + len(y) - inter)
            yield pd.DataFrame({"u": batch["u"], "v": batch["v"], "both": both, "n": n})

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(merge(right), "v").join(merge(left), "u").select("u", "v", "a", "b").mapInPandas(run, "u long, v long, both long, n long")


def near_duplicates(documents: DataFrame, width: int = WIDTH, link: tuple[int, int] = LINK, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """All rows and columns of documents, and __n (shingles), __component (least doc_id reachable), __keep (the one row that stays)."""
    part, whole = link
    scratch = Scratch(documents.sparkSession)
    stored, drop = scratch.stored, scratch.drop
    held = stored(numbered(documents), "documents")
    flat = held.select("__uid", F.col("__row.doc_id").alias("doc"), F.col("__row.text").cast("string").alias("text"))
    marks = stored(signed(flat, width, bands, rows), "signatures")
    classes = stored(marks.filter("n > 0").groupBy("set").agg(F.min("uid").alias("node"), F.min("n").alias("n")), "classes")
    firsts = marks.filter("n > 0").select(F.col("uid").alias("node"), "n", "bands").join(merge(classes.select("node")), "node")
    bands_of = stored(firsts.select("node", "n", F.explode("bands").alias("bucket")), "bands")
    centres = bands_of.groupBy("bucket").agg(F.count("node").alias("held"), F.min("node").alias("u")).filter("held > 1").select("bucket", "u")
    placed = stored(bands_of.join(merge(stored(centres, "centres")), "bucket").select("bucket", "node", "n", "u"), "buckets")
    stars = placed.filter("node != u").select("u", F.col("node").alias("v")).distinct()
    texts = flat.select(F.col("__uid").alias("node"), "text").join(merge(placed.select("node").distinct()), "node", "left_semi")
    texts = stored(texts, "texts")
    tested = similarities(stars, texts, width).filter(F.col("both") * whole >= F.col("n") * part)
    edges = stored(tested.select("u", "v"), "stars")
    drop("bands", "centres")
    found = components(edges)
    # what is left: buckets that still hold several components
    named = placed.join(merge(found), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    several = stored(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket"), "several")
    open_ = stored(named.join(merge(several), "bucket"), "open")
    sets = stored(shingle_sets(texts.join(merge(open_.select("node").distinct()), "node", "left_semi"), width), "sets")
    drop("named", "several", "buckets", "texts")
    late = stored(block_links(open_, sets, part, whole), "late")
    drop("open", "sets")
    wider = components(late).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    # a class tells its rows their component: the groups are made of classes, a row for each different set
    docs = marks.filter("n > 0").select("uid", "set").join(merge(flat.select(F.col("__uid").alias("uid"), "doc")), "uid")
    first = docs.groupBy("set").agg(F.min("doc").alias("doc"), F.min(F.struct(F.col("doc").isNull(), "doc", "uid")).alias("first"))
    own = first.join(merge(classes), "set").join(merge(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = stored(own.join(merge(wider), "component", "left").select("set", "doc", "first", F.coalesce("wider", "component").alias("group")), "groups")
    best = of_class.groupBy("group").agg(F.min("doc").alias("component"), F.min("first").alias("first"))
    told = stored(of_class.select("set", "group").join(merge(stored(best, "best")), "group").select("set", "component", F.col("first.uid").alias("kept")), "told")
    out = stored(marks.select("uid", "n", "set").join(merge(told), "set", "left").select(F.col("uid").alias("__uid"), "n", "component", F.coalesce(F.col("kept") == F.col("uid"), F.lit(True)).alias("keep")), "result")
    drop("signatures", "classes", "stars", "late", "groups", "best", "told")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("__row.doc_id"))
    return held.join(merge(out), "__uid").select(*restored(documents.columns, {"__n": F.col("n"), "__component": own, "__keep": F.col("keep")}))
