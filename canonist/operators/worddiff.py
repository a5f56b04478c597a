"""What changed inside a changed node, word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4_000_000  # cells of the table that are held at once; a larger one is made anew in parts, with the same result


def _row(word: int, words: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A row of the table (longest common subsequence of what follows) from the one below it."""
    best = np.maximum(below[:-1], (below[1:] + 1) * (words == word))
    return np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)


def _middle(a: list[str], b: list[str], most: int) -> list[tuple[str, str]]:
    """Steps between two lists of words. Rows are halved until they fit `most`: the row in the middle is made from below, the
    upper half is walked first, then the lower one from the column where the walk arrived."""
    codes = {w: i for i, w in enumerate({*a, *b})}
    x, y = np.array([codes[w] for w in a], int), np.array([codes[w] for w in b], int)
    steps, j = [], 0
    todo = [(0, len(a), np.zeros(len(b) + 1, np.int32), 0)]  # rows from, to, the row below them and its first column
    while todo:
        start, stop, below, column = todo.pop()
        below = below[j - column :]
        if stop - start > 1 and (stop - start) * len(below) > most:
            half, row = (start + stop) // 2, below
            for i in range(stop - 1, half - 1, -1):
                row = _row(x[i], y[j:], row)
            todo += [(half, stop, below, j), (start, half, row, j)]
            continue
        first, kept = j, [below]
        for i in range(stop - 1, start - 1, -1):
            kept.append(_row(x[i], y[first:], kept[-1]))
        kept.reverse()
        i = start
        while i < stop:
            if j < len(b) and a[i] == b[j]:
                steps.append(("equal", a[i]))
                i, j = i + 1, j + 1
            elif j == len(b) or kept[i + 1 - start][j - first] >= kept[i - start][j + 1 - first]:
                steps.append(("delete", a[i]))
                i += 1
            else:
                steps.append(("insert", b[j]))
                j += 1
    return steps + [("insert", w) for w in b[j:]]


def word_diff(old: list[str], new: list[str], most: int = MOST) -> list[tuple[str, str]]:
    """Runs (equal, delete or insert; words joined by blanks). Common ends are cut first; the middle keeps a longest common
    subsequence, deletions before insertions on ties."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    steps = [("equal", w) for w in old[:head]]
    steps += _middle(a, b, most)
    steps += [("equal", w) for w in old[len(old) - tail :]]
    runs: list[tuple[str, list[str]]] = []
    for op, word in steps:
        if runs and runs[-1][0] == op:
            runs[-1][1].append(word)
        else:
            runs.append((op, [word]))
    return [(op, " ".join(words)) for op, words in runs]


def word_diffs(changed: DataFrame, most: int = MOST) -> DataFrame:
    """All columns of changed, and runs (array of op, text). changed holds old_text and new_text (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["runs"] = [[{"op": op, "text": t} for op, t in word_diff((a or "").split(), (b or "").split(), most)] for a, b in zip(batch["old_text"], batch["new_text"], strict=True)]
            yield batch

    schema = ", ".join(f"`{n}` {t}" for n, t in changed.dtypes)
    return changed.mapInPandas(run, f"{schema}, runs array<struct<op: string, text: string>>")


def changed_texts(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, old_text, new_text of the nodes whose hash differs between two versions."""
    a, b = old.select("id", F.col("hash").alias("h"), F.col("text").alias("old_text")), new.select("id", F.col("hash").alias("g"), F.col("text").alias("new_text"))
    return a.join(b, "id").filter("h != g").select("id", "old_text", "new_text")
