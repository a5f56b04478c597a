"""Repair of conversations: the cheapest edits after which roles run `(s?(ua)+)?` by their initials.

Rows stream sorted by conversation and turn, and a dynamic programme is carried through them across Arrow batches. The first
stream runs from the last turn to the first: for every row and every state of the roles so far it finds the cheapest edit (of equally
cheap ones the ASCII-least) and keeps that as two bits. These backpointers, one byte a row, are written out as rows in chunks of
bounded size, so a giant conversation holds no more than a chunk in memory. The second stream runs from the first turn to the
last, takes the chunks as they come just before their rows, follows them and hashes the repaired rows as they pass.

Defined cases: a null role or text is one space; null turns come first; rows of equal turn are ordered by role, then by the SHA-256 of
their text; a null conv_id is a conversation of its own; repeated rows are duplicates of the first; an empty table gives no rows; a
conversation of dropped rows alone gives zeros; an empty role has no initial and can't be kept; gaps beyond the range of a
long are its largest value; very long texts are whole. Only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CHUNK = 65_536  # backpointers in memory
SPACES = " \t\n\x0b\x0c\r"
#: Edits in the order that decides ties.
EDITS = "DIKR"
DROP, KEEP, REROLE, INSERT = 3, 0, 2, 2
UNFINISHED = 1  # an undeleted truncated row
#: States: nothing yet, after a system row, after a user row, after an assistant row. What an inserted or reroled row leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What a kept row leads to, by its role's initial; -1: it can't be kept.
KEPT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
NONE = (-1, -1, -1, -1)
LINKS = "key string, chunk long, untimed boolean, turn long, links binary, blank long, duplicate long, truncated long"
REPAIRED = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def known(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of conv_id:turn (nulls: one space): dropped (marked, so that its conversation is still known), emptied,
    without sentence marks, repeated, or given to the user."""
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    rows = conversations.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), fate.alias("fate"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("fate") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def step(rest: tuple[int, int, int, int], initial: str, fault: str) -> tuple[tuple[int, int, int, int], int]:
    """The cheapest costs from before a row, by state, out of those from after it; and the edits to begin with, two bits a state."""
    unfinished = UNFINISHED if fault == "truncated" else 0
    kept = KEPT.get(initial, NONE)
    used, cost, link = fault not in ("blank", "duplicate"), [], []
    for q in range(4):
        best, edit = DROP + rest[q], 0
        if used:
            if kept[q] >= 0 and (c := KEEP + unfinished + rest[kept[q]]) < best:
                best, edit = c, 2
            if (c := REROLE + unfinished + rest[NEXT[q]]) < best:
                best, edit = c, 3
        cost.append(best), link.append(edit)
    out = list(cost)
    for q in (USER, ASSISTANT, NOTHING, SYSTEM):  # two inserted rows lead from a state to itself, so one is enough between these two
        on = cost[NEXT[q]] if q >= USER else out[USER]
        if INSERT + on < cost[q] or INSERT + on == cost[q] and link[q] > 1:
            out[q], link[q] = INSERT + on, 1
    return tuple(out), link[0] | link[1] << 2 | link[2] << 4 | link[3] << 6


ENDS = (0, 2 * INSERT, INSERT, 0)


def _backwards(chunk: int):
    """Rows from the last to the first of each conversation: chunks of backpointers, in the order of turns within each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("key", "untimed", "turn", "initial", "fault", "dropped"))
            for own, untimed, turn, initial, fault, dropped in zip(*columns, strict=True):
                if own != key:
                    if key is not None:
                        out.append((key, nth, *at, bytes(links[::-1]), *counts.values()))
                    key, nth, rest, links, at = own, 0, ENDS, bytearray(), (True, 0)
                    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
                if dropped:
                    continue
                if len(links) >= chunk:
                    out.append((key, nth, *at, bytes(links[::-1]), *counts.values()))
                    nth, links, counts = nth + 1, bytearray(), dict.fromkeys(counts, 0)
                rest, link = step(rest, initial, fault)
                links.append(link)
                at = untimed, turn
                if fault:
                    counts[fault] += 1
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in LINKS.split(", ")])
        if key is not None:
            yield pd.DataFrame([(key, nth, *at, bytes(links[::-1]), *counts.values())], columns=[c.split()[0] for c in LINKS.split(", ")])

    return run


class Walk:
    """One conversation, its rows taken in order while the backpointers are followed."""

    def __init__(self, key: str):
        self.key, self.links, self.at, self.state = key, b"", 0, NOTHING
        self.counts, self.cost, self.audit, self.sha, self.begun = [0, 0, 0], 0, bytearray(), hashlib.sha256(), False
        self.before, self.illegal, self.turns, self.first, self.last = None, 0, 0, None, None

    def told(self, links: bytes, counts: tuple[int, int, int]) -> None:
        self.links, self.at = self.links[self.at :] + links, 0
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def write(self, role: str, text: str) -> None:
        self.sha.update(f"{'\n' * self.begun}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.begun = True

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.audit += b"I"
        self.cost += INSERT
        self.write(ROLE[self.state], "")

    def take(self, untimed: bool, turn: int, role: str, text: str, truncated: bool) -> None:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if not untimed and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        link = self.links[self.at]
        self.at += 1
        while (edit := link >> 2 * self.state & 3) == 1:
            self.insert()
        self.audit += EDITS[edit].encode()
        self.cost += (DROP, INSERT, KEEP, REROLE)[edit] + (UNFINISHED if edit > 1 and truncated else 0)
        if edit == 2:
            self.state = KEPT[role[:1]][self.state]
            self.write(role, text)
        elif edit == 3:
            self.state = NEXT[self.state]
            self.write(ROLE[self.state], text)

    def row(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.insert()
        gaps = 0 if self.last is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return self.key, gaps, *self.counts, self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


def _forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    walk = None
    for batch in batches:
        out = []
        columns = (batch[c] for c in ("key", "is_row", "untimed", "turn", "role", "text", "truncated", "dropped", "links", "blanks", "duplicates", "cut"))
        for key, is_row, untimed, turn, role, text, truncated, dropped, links, *counts in zip(*columns, strict=True):
            if walk is None or walk.key != key:
                if walk is not None:
                    out.append(walk.row())
                walk = Walk(key)
            if not is_row:
                walk.told(links, counts)
            elif not dropped:
                walk.take(untimed, turn, role, text, truncated)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")])
    if walk is not None:
        yield pd.DataFrame([walk.row()], columns=[c.split()[0] for c in REPAIRED.split(", ")])


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for rows conv_id, turn, role, text, dropped."""
    last = F.right(F.rtrim(known("text"), F.lit(SPACES)), F.lit(1))
    told = rows.select(
        known("conv_id").alias("key"), F.col("turn").isNull().alias("untimed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        known("role").alias("role"), known("text").alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"), last.alias("last"),
    )
    told = told.withColumn("hash", F.unhex(F.sha2("text", 256))).withColumn("truncated", ~F.col("last").isin(".", "!", "?"))
    # nulls first: of two rows the untimed one is the lesser
    ties = [F.col("untimed").desc(), F.col("turn"), F.col("role"), F.col("hash")]
    again = F.row_number().over(Window.partitionBy("key", "dropped", "role", "hash").orderBy(F.col("untimed").desc(), "turn")) > 1
    slim = told.drop("text").withColumn("again", again & ~F.col("dropped"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    slim = slim.withColumn("fault", fault).withColumn("initial", F.left("role", F.lit(1)))
    ordered = slim.repartition("key").sortWithinPartitions("key", F.col("untimed"), F.col("turn").desc(), F.col("role").desc(), F.col("hash").desc(), F.col("again").desc())
    links = Scratch(rows.sparkSession).stored(ordered.select("key", "untimed", "turn", "initial", "fault", "dropped").mapInPandas(_backwards(chunk), LINKS), "links")
    nothing = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    texts = told.select("key", F.lit(1).alias("is_row"), "untimed", "turn", "role", "text", "truncated", "dropped", "hash", zero.alias("chunk"), nothing("binary").alias("links"), zero.alias("blanks"), zero.alias("duplicates"), zero.alias("cut"))
    chunks = links.select("key", F.lit(0).alias("is_row"), "untimed", "turn", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("truncated"), F.lit(False).alias("dropped"), nothing("binary").alias("hash"), (-F.col("chunk")).alias("chunk"), "links", F.col("blank").alias("blanks"), F.col("duplicate").alias("duplicates"), F.col("truncated").alias("cut"))
    stream = texts.unionByName(chunks).repartition("key").sortWithinPartitions("key", ties[0], ties[1], "is_row", "chunk", *ties[2:])
    out = stream.drop("hash", "chunk").mapInPandas(_forwards, REPAIRED)
    return out.select(F.expr("try_cast(key as bigint)").alias("conv_id"), *[c.split()[0] for c in REPAIRED.split(", ")][1:])
