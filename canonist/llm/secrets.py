"""Secret scans with an incremental ledger of content-addressed blobs.

Every historical version of a text is addressed by its SHA-256. The ledger holds the pairs of blob and rule version that were
scanned and what they hold. A scan takes only unseen pairs, each blob once however many paths and versions carry it, and joins
the findings back to all of them; a new rule version has rules of its own only, so that it never scans anew what older ones
have told. Texts without anything that a rule needs are settled by a filter inside the scan of the table; only the others' texts are
moved, one of each blob.

Defined cases: a null text is empty; equal texts are one blob and get equal findings; rows repeated under one doc_id are
each a version with findings of its own; offsets count code points, ends are exclusive; an empty table gives no rows; very long
texts are whole. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merge

#: Fixed values of the contract: kind, pattern, group whose length counts, least length; in the order of ties.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
ADDED = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ("login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@"), 0, 1),
]
#: Rule versions: their rules, and what every finding of them needs; Java's (?i) folds ASCII letters only, as the rules do.
RULES = {
    1: (BASE, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""),
    2: (ADDED, r"PRIVATE KEY-----|eyJ[A-Za-z0-9_-]{8,}\.eyJ|://[^\s/:@]{1,100}:[^\s/:@]{1,100}@"),
}
FOUND = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules int, found {FOUND}"


def scan_text(text: str, rules: list = BASE) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the kinds' order."""
    out = [(m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(rules) for m in rule.finditer(text) if len(m[group]) >= least]
    return [(rules[k][0], a, b) for a, k, b in sorted(out)]


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[int, ...] = (1,)) -> tuple[DataFrame, DataFrame]:
    """doc_id, blob, found (of all these rule versions, sorted) for every row of versions (doc_id, text); and the ledger's new rows
    (blob, rules, found)."""
    scratch = Scratch(versions.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    needs = F.array_compact(F.array(*[F.when(text.rlike(RULES[v][1]), F.lit(v)) for v in rules]))
    rows = versions.select("doc_id", F.sha2(text, 256).alias("blob"), needs.alias("needs"), text.alias("text"))
    paths = scratch.stored(rows.withColumn("text", F.when(F.size("needs") > 0, F.col("text"))), "paths")
    seen = (ledger if ledger is not None else empty_ledger(versions.sparkSession)).filter(F.col("rules").isin(*rules))
    # one row of each blob before any join, so that no blob is hot in one
    blobs = scratch.stored(paths.groupBy("blob").agg(F.first("needs").alias("needs"), F.first("text").alias("text")), "blobs")
    pairs = blobs.withColumn("rules", F.explode(F.array(*map(F.lit, rules))))
    unseen = pairs.join(merge(seen.select("blob", "rules")), ["blob", "rules"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[dict(kind=k, start=a, end=b) for k, a, b in scan_text(t, RULES[v][0])] for t, v in zip(batch["text"], batch["rules"], strict=True)]
            yield pd.DataFrame({"blob": batch["blob"], "rules": batch["rules"], "found": found})

    needed = F.array_contains("needs", F.col("rules"))
    scanned = unseen.filter(needed).select("blob", "rules", "text").mapInPandas(run, LEDGER)
    blank = unseen.filter(~needed).select("blob", "rules", F.expr(f"cast(array() as {FOUND})").alias("found"))
    new = scratch.stored(scanned.unionByName(blank), "ledger")
    scratch.drop("blobs")
    order = {kind: i for i, kind in enumerate(k for v in sorted(RULES) for k, *_ in RULES[v][0])}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    known = seen.unionByName(new).filter(F.size("found") > 0).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    keyed = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), place[x["kind"]].alias("nth"), x["end"].alias("end"), x["kind"].alias("kind"))))
    known = known.select("blob", F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
    back = paths.select("doc_id", "blob").join(merge(scratch.stored(known, "known")), "blob", "left")
    return back.withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {FOUND})"))), new
