"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most `capacity` tokens. Pieces are dealt by hash to shards of a bounded number of
pieces; each shard is evolved by several islands (independent populations). Crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold duplicates and best-fits the displaced pieces. Between epochs
each island's elite migrates to the next island of the same shard. The best island's bins stand; pieces of bins that
are not well filled go, with those of the other shards, to a further level of fewer shards.

Defined cases: a null text is an empty one; an empty text is the end token alone; equal rows are packed each on its
own; null doc_ids are kept; an empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merge

CAPACITY = 2048
SHARD = 6000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 40
POPULATION = 10
LEVELS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Runs of spaces, white space other than \t\n\r and space, and the special token: such texts are encoded whole. In all
#: others the byte-level splitter joins nothing across the front of a space, so each space with what follows stands alone.
ODD = r"  |[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|<\|endoftext\|>"


class Encoder:
    """Text to token ids of a byte-level BPE file. Each different word of a batch is encoded once; where the file of the same
    vocabulary as ranks (.tiktoken) lies beside it, words are encoded from that, which takes half the time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.whole = self.joined = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        vocabulary = tokenizer.get_vocab()
        self.sizes = np.zeros(1 + max(vocabulary.values()), np.int64)  # bytes of each token: a character stands for a byte
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        if os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.joined = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text, as little-endian uint32."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = pack_ids(self.whole(texts[i].as_py()))
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if not len(lists):
            return out
        ends, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        code, first = words.indices.to_numpy().copy(), ends[:-1]
        # all different words, a space before each, as one text; its ids are cut where the words end
        pool = np.asarray(self.joined(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")[0].as_py()), "<u4")
        stops = np.searchsorted(np.cumsum(self.sizes[pool]), np.cumsum(1 + pc.binary_length(words.dictionary).to_numpy())) + 1
        heads = [np.asarray(self.whole(w), "<u4") for w in words.dictionary.take(pa.array(code[first])).to_pylist()]
        code[first] = np.arange(len(heads)) + len(stops)
        sizes = np.concatenate([np.diff(stops, prepend=0), [len(x) for x in heads]])
        pool = np.concatenate([pool, *heads])
        starts, counts = np.cumsum(sizes) - sizes, sizes[code]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(starts[code] - upto[:-1], counts) + np.arange(upto[-1])]
        for i, a, b in zip(np.flatnonzero(~odd), upto[ends[:-1]], upto[ends[1:]], strict=True):
            out[i] = ids[a:b].tobytes()
        return out


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def encoder(path: str) -> Encoder:
    """Read once in each Python worker."""
    return Encoder(path)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32, if asked for) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), pack_ids([end_id])
        for batch in batches:
            for some in (batch.slice(i, 4000) for i in range(0, batch.num_rows, 4000)):
                rows = []
                for doc_id, data in zip(some.column(0).to_pylist(), encode.many(some.column(1)), strict=True):
                    data += end
                    n, at, k = len(data) // 4, 0, 0
                    while at < n:
                        length = (n % capacity or capacity) if k == 0 else capacity
                        part = data[4 * at : 4 * (at + length)]
                        rows.append((doc_id, k, at, length, zlib.crc32(part), part))
                        at, k = at + length, k + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names[: 5 + ids])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", ids binary" * ids)


class Bins:
    """Open bins by free space; best fit finds the least space that suffices from one integer's bits."""

    def __init__(self, capacity: int):
        self.capacity, self.members, self.free, self.by_free, self.mask = capacity, [], [], {}, 0

    def add(self, members: list[int], fill: int) -> None:
        self.members.append(members)
        self.free.append(self.capacity - fill)
        self._offer(len(self.free) - 1)

    def _offer(self, b: int) -> None:
        if free := self.free[b]:
            self.by_free.setdefault(free, []).append(b)
            self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        if rest := self.mask >> size:
            free = size + (rest & -rest).bit_length() - 1
            b = (held := self.by_free[free]).pop()
            if not held:
                self.mask ^= 1 << free
            self.members[b].append(item)
            self.free[b] = free - size
            self._offer(b)
        else:
            self.add([item], size)


def packed(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, sizes[i])
    return bins.members


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the fuller ones: smaller is better."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossed(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """a with whole well-filled bins of b injected, a's bins that share a piece with them removed, the displaced best-fitted."""
    good = [x for x in b if capacity - sum(sizes[i] for i in x) <= capacity // 256]
    if not good:
        good = sorted(b, key=lambda x: -sum(sizes[i] for i in x))[: max(1, len(b) // 4)]
    given = [good[i] for i in np.flatnonzero(rng.random(len(good)) < rng.uniform(0.3, 0.9))]
    inside = {i for x in given for i in x}
    child, loose = Bins(capacity), []
    poor = sorted((sum(sizes[i] for i in x) for x in a))[: 1 + len(a) // 20][-1]
    for x in given:
        child.add(list(x), sum(sizes[i] for i in x))
    for x in a:
        if inside.isdisjoint(x) and sum(sizes[i] for i in x) > poor:
            child.add(list(x), sum(sizes[i] for i in x))
        else:
            loose += [i for i in x if i not in inside]
    for i in sorted(loose, key=lambda i: -sizes[i]):
        child.best_fit(i, sizes[i])
    return child.members


def evolved(sizes: list[int], seeds: list[list[list[int]]], capacity: int, rng: np.random.Generator, generations: int, population: int) -> list[list[int]]:
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pool = [*seeds, packed(order, sizes, capacity)]
    score = lambda x: fitness(x, sizes, capacity)
    while len(pool) < population and min(map(len, pool)) > least:
        noisy = np.asarray(sizes) * rng.uniform(0.85, 1.15, len(sizes))
        pool.append(packed(np.argsort(-noisy).tolist(), sizes, capacity))
    pool.sort(key=score)
    for _ in range(generations):
        if len(pool[0]) <= least or len(pool) < 2:
            break
        i, j = rng.choice(min(len(pool), population), 2, replace=False)
        pool = sorted([*pool, crossed(pool[i], pool[j], sizes, capacity, rng), crossed(pool[j], pool[i], sizes, capacity, rng)], key=score)[:population]
    return pool[0]


EVOLVED = "shard long, island int, uid long, length long, bin long, place long, fill long, bins long, fitness double"


def _evolve(epoch: int, capacity: int, generations: int, population: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(group["shard"].iloc[0]), int(group["island"].iloc[0])
        own = group.drop_duplicates("uid").sort_values("uid")
        uids, sizes = own["uid"].to_numpy(), own["length"].tolist()
        seeds = []
        if epoch:
            for _, one in group.groupby("came"):
                one = one.sort_values("uid")
                seeds.append([g.tolist() for g in pd.Series(np.arange(len(one))).groupby(one["bin"].to_numpy()).groups.values()])
        best = evolved(sizes, seeds, capacity, np.random.default_rng([shard, island, epoch]), generations, population)
        n, fit = fitness(best, sizes, capacity)
        out = []
        for k, members in enumerate(best):
            place, fill = 0, sum(sizes[i] for i in members)
            for i in sorted(members):
                out.append((shard, island, uids[i], sizes[i], k, place, fill, n, fit))
                place += sizes[i]
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVOLVED.split(", ")])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, levels: int = LEVELS) -> DataFrame:
    """uid, sequence_id, offset for rows uid (distinct longs), length (1 to capacity)."""
    full = sizes.filter(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    scratch = Scratch(sizes.sparkSession)
    left, done = sizes.filter(F.col("length") < capacity).select("uid", "length"), [full]
    for level in range(levels):
        n = left.count()
        if not n:
            break
        shards = -(-n // shard)
        last = shards == 1 or level == levels - 1
        dealt = left.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uid", "length")
        for epoch in range(epochs):
            if epoch:  # every island gets its own elite and that of the island before it
                dealt = now.select("shard", F.explode(F.array_distinct(F.array("island", ((F.col("island") + 1) % islands)))).alias("goes"), F.col("island").alias("came"), "uid", "length", "bin").withColumnRenamed("goes", "island")  # noqa: F821
            now = scratch.stored(dealt.groupBy("shard", "island").applyInPandas(_evolve(epoch, capacity, generations, population), EVOLVED), f"epoch-{level}")
            scratch.drop(f"epoch-{level}", but=1)
        best = now.groupBy("shard").agg(F.min_by("island", F.struct("bins", "fitness", "island")).alias("island"))
        won = now.join(best, ["shard", "island"])
        stays = F.lit(True) if last else F.col("fill") >= capacity - capacity // 64
        done.append(won.filter(stays).select("uid", (F.lit(level) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), F.col("place").alias("offset")))
        if last:
            break
        left = scratch.stored(won.filter(~stays).select("uid", "length"), "left")
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False, **options) -> DataFrame:
    """Every piece of every document with the sequence it goes to and its offset there."""
    cut = Scratch(documents.sparkSession).stored(pieces(documents, tokenizer, capacity, end_id, ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return cut.join(merge(pack(cut.select("uid", "length"), capacity, **options)), "uid").drop("uid")
