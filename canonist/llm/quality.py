"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good (1), poor (0) or abstain (-1). Expectation-maximisation over the counts of
the vote patterns of all documents estimates how each labeller votes on good and on poor ones, and so the posterior of
each pattern. Those posteriors are the labels on which a linear scorer over hashed features is trained, on a bounded
sample of the documents. The scorer then decides on every whole text; no hand-made label is used.

Defined cases: a null or empty text has no evidence against it and stays with score 0.5; equal texts get equal scores;
an empty table trains nothing and gives no rows; very long texts are whole. __score and __keep replace columns of these names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Documents, at most, that the scorer is trained on: those with the least hash.
SAMPLE = 12_000
SIZE = 1024
KEEP = 0.5
FALSE_ALARMS = 0.002
STATS = ["words", "repeat", "distinct", "upper", "marks", "bars", "lines", "digits", "length"]
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in b" \t\n\r\v\f" else c for c in range(256))
RUN = re.compile(rb"(.)\1+", re.S)


def measured(text: str) -> tuple[list[float], Counter]:
    """STATS of a text, and how often each shape of word occurs in it (runs of a class of characters as one)."""
    words, rows = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    raw = text.encode("utf-8", "surrogatepass").translate(SHAPE)
    size = max(1, len(raw) - raw.count(b" "))
    upper, lower, digits = raw.count(b"A"), raw.count(b"a"), raw.count(b"0")
    repeat = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    bars = words.count("|") / n
    marks = (size - upper - lower - digits) / size
    shapes = Counter(RUN.sub(rb"\1", raw).split())
    return [len(words), repeat, len(set(words)) / n, upper / max(1, upper + lower), marks, bars, len(set(rows)) / max(1, len(rows)), digits / size, size / n], shapes


def votes(s: list[float]) -> list[int]:
    """One vote of each labeller: 1 good, 0 poor, -1 abstain."""
    words, repeat, distinct, upper, marks, bars, rows, digits, length = s
    if not words:
        return [-1] * 8
    between = lambda x, good, poor: 1 if x <= good else 0 if x >= poor else -1
    return [
        between(repeat, 0.03, 0.15),
        -1 if words < 30 else between(-distinct, -0.35, -0.15),
        -1 if words < 5 else between(upper, 0.15, 0.3),
        between(marks, 0.06, 0.14),
        between(bars, 0.01, 0.1),
        -1 if words < 30 else between(-rows, -0.9, -0.6),
        between(digits, 0.1, 0.4),
        1 if 2.5 <= length <= 12 and words >= 20 else 0 if length > 25 else -1,
    ]


def features(s: list[float], shapes: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: steps of each statistic, and the share of each shape of word."""
    total = max(1, sum(shapes.values()))
    steps = [f"{name}:{min(20, int(v * 20))}" if name not in ("words", "length") else f"{name}:{int(np.log2(1 + v))}" for name, v in zip(STATS, s, strict=True)]
    keys = [zlib.crc32(x.encode()) % SIZE for x in steps] + [zlib.crc32(b"shape:" + x) % SIZE for x in shapes]
    return np.asarray(keys), np.asarray([0.3] * len(steps) + [v / total for v in shapes.values()])


def estimated(patterns: np.ndarray, counts: np.ndarray, alarms: float = FALSE_ALARMS, rounds: int = 200) -> np.ndarray:
    """P(good) of each vote pattern, by EM over the labellers' votes, taken as independent given the quality. Abstaining says
    nothing. Kinds of poor documents are noticed by different labellers, so that independence alone would take a kind that
    one labeller notices for a kind of good ones: hence a labeller's rate of false alarms has an upper bound, `alarms`."""
    p, all_ = np.where((patterns == 0).any(1), 0.02, 0.98), counts.sum()
    for _ in range(rounds):
        logs = []
        for good, weight in ((True, p * counts), (False, (1 - p) * counts)):
            log = np.full(len(p), np.log((weight.sum() + 1) / (all_ + 2)))
            for votes_ in patterns.T:
                poor = (weight[votes_ == 0].sum() + 0.1) / (weight[votes_ >= 0].sum() + 0.4)
                poor = min(poor, alarms) if good else max(poor, 50 * alarms)
                log += np.select([votes_ == 0, votes_ == 1], [np.log(poor), np.log(1 - min(poor, 0.999))], 0.0)
            logs.append(log)
        now = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -60, 60)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return p


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights (the last is the constant) of a logistic scorer on soft labels."""
    x = np.zeros((len(rows), SIZE + 1), np.float32)
    for i, (k, v) in enumerate(rows):
        np.add.at(x[i], k, v)
    x[:, -1] = 1
    w, m, s = np.zeros(SIZE + 1, np.float32), np.zeros(SIZE + 1, np.float32), np.zeros(SIZE + 1, np.float32)
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - p).astype(np.float32) / len(rows) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    return w


def _voted(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [votes(measured(t or "")[0]) for t in batch.pop("text")]
            batch["votes"] = ["".join(str(v + 1) for v in x) for x in own]
            yield batch

    return documents.select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")).mapInPandas(run, "h long, votes string")


def train(documents: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The scorer's weights; None for an empty table."""
    scratch = Scratch(documents.sparkSession)
    voted = scratch.stored(_voted(documents), "votes")
    counted = voted.groupBy("votes").count().orderBy("votes").collect()  # at most 3 to the power of the labellers
    scratch.drop("votes")
    if not counted:
        return None
    patterns = np.asarray([[int(c) - 1 for c in r["votes"]] for r in counted])
    posterior = dict(zip((r["votes"] for r in counted), estimated(patterns, np.asarray([r["count"] for r in counted], float)), strict=True))
    n = sum(r["count"] for r in counted)
    texts = documents.select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    edge = min(2**63 - 1, int(2**64 * min(1.0, 1.2 * sample / n)) - 2**63)  # hashes below it: somewhat more than `sample` rows
    some = texts if n <= sample else texts.filter(F.col("h") < edge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [measured(t or "") for t in batch["text"]]
            made = [features(*x) for x in told]
            yield pd.DataFrame({"votes": ["".join(str(v + 1) for v in votes(s)) for s, _ in told], "k": [k.tolist() for k, _ in made], "v": [v.tolist() for _, v in made]})

    rows = some.dropDuplicates(["h"]).orderBy("h").limit(sample).mapInPandas(run, "votes string, k array<int>, v array<float>").collect()
    return fitted([(np.asarray(r["k"], int), np.asarray(r["v"])) for r in rows], np.asarray([posterior[r["votes"]] for r in rows], np.float32))


def classify(documents: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """All columns of documents, __score (P(good)) and __keep."""
    weights = train(documents, sample)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                if not t or not t.strip() or weights is None:
                    out.append(0.5)
                    continue
                k, v = features(*measured(t))
                out.append(float(1 / (1 + np.exp(-np.clip(weights[k] @ v + weights[-1], -60, 60)))))
            yield pd.Series(out, dtype="float64")

    return documents.withColumn("__score", F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col("text").cast("string"))).withColumn("__keep", F.col("__score") >= keep)
