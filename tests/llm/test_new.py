"""Token counts, the audit of filters and the repair of conversations, held against plain Python."""

import hashlib
import heapq
import itertools
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from canonist.llm import interplay, queries, repair, tokens

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b ", "a<|endoftext|>b  <|endoftext|>  c<|startoftext|>", "it's we'll  I'M\n\n x\t\ty   z ", "!!\x1c?? \x0b\x0c d", "x　 y    z", "​  ᠎﻿ k", "é ́ ÅÅ", "İΣσΣ \U0001f600\U0001f600", "1234567 89", "a" * 50_000, " " * 3000 + "x", "▁a ▁▁b ▁", "\u0000 �", "</s><s> <unk>"]


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("size", [tokens.BLOCK, 5000])
def test_tokens_of_the_library(spark, name, size):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] if os.path.isdir(SF) else []
    given += [(-1 - i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id")]
    count = library(P.path(name))
    want = sorted((str(i), len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t in given)
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("block", "word", "words", "pieces", "place", "n_bytes")})
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, P.path(name), size=size).collect())
    assert got == want and tokens.count_tokens(docs.limit(0), P.path(name)).count() == 0


def test_pretokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json")).pre_tokenizer
    lib = tokens.library(P.path("byte_bpe_50k.json"))
    for text in ODD:
        if text and "<|endoftext|>" not in text:
            assert [w for c in lib.pattern.findall(text) if c for w in lib.words(c)] == ["w" + w for w, _ in plain.pre_tokenize_str(text)]


def test_each_pretoken_is_counted_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the same words here again") for i in range(50)], "doc_id long, text string").repartition(8)
    held = tokens.blocks(docs, P.path("byte_bpe_50k.json"), 60)
    held = held.persist()
    words = [w for r in held.collect() for w in tokens.unpacked_words(r.words)]
    assert len(set(words)) == 5 and all(words.count(w) == held.count() for w in words)
    counted = tokens.piece_counts(tokens.ranges(held, 3), P.path("byte_bpe_50k.json"))
    assert {r.nth for r in counted.collect()} == {0, 1, 2} and {r.n_words for r in held.collect()} == {5}
    assert held.count() > 20 and {r.n_tokens for r in tokens.count_tokens(docs, P.path("byte_bpe_50k.json"), size=60).collect()} == {5}


def failures(rows):
    out = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        told = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": again}
        out.append((i, lang or "", {k for k, v in told.items() if v}))
    return out


def test_audit_of_filters_applied_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(1, None, None), (2, "", "en"), (3, "ABC def", "en"), (3, "ABC def", "en"), (4, "ABC def", ""), (None, "ABC def", "de"), (None, None, None), (5, long, "de"), (6, long, "de"), (7, long + " #", "de"), (8, "a a a " * 60, "fr"), (9, "X " * 300 + "$", "fr"), (9, "X " * 300 + "$", "de"), (2, long, "fr")]
    labels = [(5, 1, 0), (6, 1, 1), (6, 0, None), (8, None, 1), (99, 1, 1), (None, 1, 1), (3, 1, 0), (9, 0, 1)]
    good, toxic = ({i for i, *l in labels if l[k] == 1 and i is not None} for k in (0, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(9) for c in ("part", "mask", "hash", "n", "good", "toxic", "state", "filter", "least")})
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want, sums = {}, {}
    for part in {p for _, p, _ in failures(rows)}:
        own = [(i, f) for i, p, f in failures(rows) if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, k in enumerate(order, 1):
                gone, rest = [(i, f) for i, f in left if k in f], [(i, f) for i, f in left if k not in f]
                want[part, order, step] = (len(rest), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == {k} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                sums[part, k] = sums.get((part, k), 0) + len(gone)
                left = rest
    out = interplay.interplay(interplay.cells(docs, t)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in out}
    assert got == want and len(out) == len(want) and all(r.shapley == sums[r.part, r.filter_order[r.step - 1]] for r in out)
    assert interplay.interplay(interplay.cells(docs.limit(0), t.limit(0))).count() == 0
    with pytest.raises(ValueError, match="seven"):
        interplay.interplay(interplay.cells(docs, t), "ABCDEFGH")


def test_paths_of_the_lattice():
    reach, leave = interplay.path_counts(5)
    assert reach[31] == leave[0] == 120 and all(reach[s] * leave[s] == sum(1 for o in itertools.permutations(range(5)) if sum(1 << k for k in o[: s.bit_count()]) == s) for s in range(32))


def blow(conv, turn, role, text):
    fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if fate == 0:
        return []
    row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
    return [row] * (2 if fate == 3 else 1)


def mended(rows):
    """Shortest path over rows and states, each with its audit: the least cost first, then the least audit."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    # a state is what has been written: "" or its last initial
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        turns = [r for r in "ua" if last + r in ("u", "su", "ua", "au")]
        for r in turns:
            heapq.heappush(queue, (cost + 2, audit + "I", i, r, (*out, {"u": "user", "a": "assistant"}[r] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last, out))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if last + role[:1] in ("s", "u", "su", "ua", "au") and role[:1]:
                    heapq.heappush(queue, (cost + late, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for r in turns:
                    heapq.heappush(queue, (cost + 2 + late, audit + "R", i + 1, r, (*out, f"{ {'u': 'user', 'a': 'assistant'}[r]}:{text}")))
    told = [t for t, *_ in rows if t is not None]
    gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("chunk", [repair.CHUNK, 2])
def test_repair_is_the_shortest_path(spark, chunk):
    import random

    rng, given = random.Random(5), []
    for conv in range(250):
        for turn in range(rng.randrange(12)):
            given.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"]), rng.choice(["a.", "b!", "c", " \n", "", None, "what? ", "d. "])))
    given += [(None, 0, "user", "x."), (None, None, "assistant", "y."), (7_000_000_000_000_000_001, -(2**63), "user", "p."), (7_000_000_000_000_000_001, 2**63 - 1, "assistant", "q.")]
    given += [(1000, t, "user" if t % 2 == 0 else "assistant", f"long {t}." * 500) for t in range(300)]
    t = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("key", "chunk", "links", "cost", "audit", "last", "copy")})
    damaged = {}
    for row in given:
        damaged.setdefault(row[0], []).extend(blow(*row))
    want = {c: mended(in_order(rows)) for c, rows in damaged.items()}
    want[7_000_000_000_000_000_001] = (min(want[7_000_000_000_000_000_001][0], 2**63 - 1), *want[7_000_000_000_000_000_001][1:])
    out = repair.repair(repair.damaged(t), chunk).collect()
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in out} == want and len(out) == len(want)
    assert any(not rows for rows in damaged.values()) and repair.repair(repair.damaged(t.limit(0))).count() == 0


def test_repair_of_whole_conversations(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    damaged = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        damaged.setdefault(r.conv_id, []).extend(blow(r.conv_id, r.turn, r.role, r.text))
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op13_repair(spark, SF).collect()} == {c: mended(in_order(rows)) for c, rows in damaged.items()}
