"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings that speak for label 1 is learned from the labelled rows. Features of a whole text:
densities of the lexicon, how near its words stand to a second-person pronoun, capitals, punctuation and words in
disguise (digits or signs for letters). Trees are boosted on part of the labelled rows and calibrated on the rest.

All that is learned comes from at most `sample` labelled rows of each label, those with the least hash, so the driver holds
a bounded table; every text is scored. Defined cases: a null or empty text is scored as one without words; labels that are
null, or of no document, teach nothing; a document with both labels counts as toxic; without documents of both labels the score
is 0. Very long texts are whole; equal texts get equal scores; an empty table gives no rows. Only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled rows of either label, at most, that anything is learned from.
SAMPLE = 4_000
LEXICON = 6_000
#: Rows of either label below which the lexicon learns from those that calibrate too.
FEW = 200
WORD = re.compile(r"[^\W\d_]{2,}")
#: Second-person pronouns of the languages at hand.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú usted ustedes vosotros vos ti tus".split())
DISGUISED = re.compile(r"[^\W\d_](?:[0-9@$*!]+[^\W\d_])|\b(?:[^\W\d_][.\-_*]){3,}[^\W\d_]\b")
#: Digits and signs read as the letters that they stand for.
PLAIN = str.maketrans("013457@$!", "oieastasi")
STRONG = 2.5
TOKENS_KEPT = 400_000
UPPER, LOWER, WIDE = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256))
TREES, DEPTH, RATE, STEPS = 80, 3, 0.15, 32


def units(text: str) -> list[str]:
    """Lexicon units of a text, each once: words, and beginnings of 4, 5 and 6 letters (marked)."""
    words = {w.lower() for w in WORD.findall(text)}
    return list(words | {f"{w[:k]}~" for w in words for k in (4, 5, 6) if len(w) > k})


class Described:
    """The dense features of whole texts. What a token tells is remembered, up to a bound."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def token(self, token: str) -> tuple[float, float, float, bool, bool, bool]:
        """Best weight, weight as a word, weight as a beginning, second person, in disguise, hiding a word of the lexicon."""
        weight = lambda w: self.lexicon.get(w, 0.0)
        words = WORD.findall(token)
        whole = max(map(weight, words), default=0.0)
        begun = max((weight(f"{w[:k]}~") for w in words for k in (4, 5, 6) if len(w) > k), default=0.0)
        masked = bool(DISGUISED.search(token))
        hides = masked and any(weight(w) >= STRONG for w in WORD.findall(re.sub(r"[.\-_*]", "", token).translate(PLAIN)))
        return max(whole, begun), whole, begun, any(w in SECOND for w in words), masked, hides

    def __call__(self, text: str) -> list[float]:
        if len(self.known) > TOKENS_KEPT:
            self.known.clear()
        tokens, known = text.lower().split(), self.known
        for t in {t for t in tokens if t not in known}:
            known[t] = self.token(t)
        told = list(map(known.__getitem__, tokens))
        n, size = max(1, len(tokens)), max(1, len(text))
        hits = [i for i, x in enumerate(told) if x[0]]
        strong = [i for i in hits if told[i][0] >= STRONG]
        different = {tokens[i]: told[i] for i in hits}.values()
        whole, begun = [x[1] for x in different if x[1]], [x[2] for x in different if x[2]]
        top = sorted((x[0] for x in different), reverse=True)[:5]
        near = 0
        if strong:
            second = np.asarray([i for i, x in enumerate(told) if x[3]])
            near = sum(bool((np.abs(second - i) <= 4).any()) for i in strong)
        raw = text.encode("utf-8", "surrogatepass")
        wide = (len(raw) - len(raw.translate(None, delete=WIDE))) // 2
        upper, lower = len(raw) - len(raw.translate(None, delete=UPPER)), len(raw) - len(raw.translate(None, delete=LOWER))
        letters = max(1, upper + lower + wide)
        marks = raw.count(b"!") + raw.count(b"?")
        masked = sum(x[4] for x in told)
        return [
            sum(told[i][0] for i in hits) / n, len(strong) / n, len(strong), len(whole), len(begun), max([0.0, *whole]), max([0.0, *begun]), sum(top) / 5,
            sum(top[:3]) / 3, near / n, near, upper / letters, marks / size, max(0, size - letters - raw.count(b" ")) / size, masked / n + sum(x[5] for x in told), np.log1p(n),
        ]


class Trees:
    """Boosted regression trees of one depth on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, STEPS + 1)[1:-1])) for c in x.T]
        bins, rate = self._binned(x), np.average(y, weights=weight).clip(1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(len(x), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            at, tree = np.zeros(len(x), int), []
            for level in range(DEPTH):
                splits = []
                for node in range(2**level):
                    own = at == node
                    best = (1e-9, 0, STEPS)  # gain, feature, bin: all to the left
                    for f in range(x.shape[1]) if own.sum() >= 10 else ():
                        gs, hs = (np.bincount(bins[own, f], v[own], STEPS + 1).cumsum() for v in (g, h))
                        left, right = gs[:-1] ** 2 / (hs[:-1] + 1), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
                        gain = left + right - gs[-1] ** 2 / (hs[-1] + 1)
                        if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                    splits.append(best[1:])
                tree.append(splits)
                f, k = np.asarray(splits)[at].T
                at = 2 * at + (bins[np.arange(len(x)), f] > k)
            leaves = np.asarray([RATE * g[at == i].sum() / (h[at == i].sum() + 1) for i in range(2**DEPTH)])
            self.trees.append((tree, leaves))
            raw += leaves[at]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = self._binned(x), np.full(len(x), self.start)
        for tree, leaves in self.trees:
            at = np.zeros(len(x), int)
            for splits in tree:
                f, k = np.asarray(splits)[at].T
                at = 2 * at + (bins[np.arange(len(x)), f] > k)
            out += leaves[at]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function nearest to y: pool adjacent violators."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # mean, weight, least raw, greatest raw
    for r, t, w in zip(raw[order], y[order], weight[order], strict=True):
        pools.append([t, w, r, r])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.asarray([r for p in pools for r in (p[2], p[3])]), np.asarray([p[0] for p in pools for _ in (0, 1)])


def learned(documents: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], sample: int = SAMPLE):
    """(lexicon, trees, calibration points), or None where only one label is known."""
    told = labels.filter(F.col("toxic").isin(0, 1)).filter(usable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    h = F.xxhash64("doc_id")
    edges = {k: min(2**63 - 1, int(2**64 * min(1.0, sample / n)) - 2**63) for k, n in counts.items()}
    kept = told.filter(F.col("toxic").isin([k for k, n in counts.items() if n <= sample]) | F.when(F.col("toxic") == 1, h < edges[1]).otherwise(h < edges[0]))
    texts = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(kept.limit(3 * sample)), "doc_id")
    texts = Scratch(documents.sparkSession).stored(texts.select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("calibrates")), "labelled")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of = [units(t) for t in batch["text"]]
            sizes = [len(x) for x in of]
            if sum(sizes):
                yield pd.DataFrame({"unit": [u for x in of for u in x], "toxic": np.repeat(batch["toxic"].to_numpy(), sizes)})

    # what calibrates is kept out of the lexicon too, but where few rows are known: there the lexicon needs them all
    fits = {(r["toxic"], r["calibrates"]): r["count"] for r in texts.groupBy("toxic", "calibrates").count().collect()}
    taught = texts.filter("not calibrates") if fits.get((1, False), 0) >= FEW and fits.get((0, False), 0) >= FEW else texts
    n1, n0 = (float(taught.filter(F.col("toxic") == k).count()) for k in (1, 0))
    per = taught.select("text", "toxic").mapInPandas(split, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 1.5 * n0 / max(1.0, n1)) / (n0 + 1))
    lexicon = dict(per.filter("a >= 3").withColumn("odds", odds).filter("odds >= 1.5").orderBy(F.desc("odds"), "unit").limit(LEXICON).select("unit", "odds").collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describe = Described(lexicon)
        for batch in batches:
            batch["x"] = list(map(describe, batch.pop("text")))
            yield batch

    rows = texts.select("text", "toxic", "calibrates", "doc_id").mapInPandas(run, f"toxic int, calibrates boolean, doc_id {dict(texts.dtypes)['doc_id']}, x array<double>").orderBy("doc_id").limit(4 * sample).collect()
    if len({r["toxic"] for r in rows}) < 2:
        return None
    x, y, late = np.asarray([r["x"] for r in rows]), np.asarray([r["toxic"] for r in rows], float), np.asarray([r["calibrates"] for r in rows])
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))  # as common as among all labels
    if len({*y[late]}) < 2 or len({*y[~late]}) < 2:
        late = np.zeros(len(y), bool)
    trees = Trees(x[~late], y[~late], weight[~late])
    on = late if late.any() else ~late
    return lexicon, trees, isotonic(trees.raw(x[on]), y[on], weight[on])


def score(documents: DataFrame, labels: DataFrame, usable: Callable[[Column], Column] = lambda _: F.lit(True), sample: int = SAMPLE) -> DataFrame:
    """doc_id, score of every row of documents; labels are used where usable(doc_id)."""
    model = learned(documents, labels, usable, sample)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, trees, (at, level) = model or ({}, None, (None, None))
        describe = Described(lexicon)
        for batch in texts:
            if model is None or not len(batch):
                yield pd.Series(np.zeros(len(batch)))
                continue
            raw = trees.raw(np.asarray([describe(t or "") for t in batch]))
            # a little of the raw score keeps the order within a step
            yield pd.Series(0.998 * np.interp(raw, at, level) + 0.002 / (1 + np.exp(-np.clip(raw, -60, 60))))

    return documents.select("doc_id", F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col("text").cast("string")).alias("score"))
