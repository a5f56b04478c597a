"""Whole queries on the smallest given tables, held against plain Python."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from canonist.llm import packing, quality, queries, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(spark, name, *columns, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def test_op1_tokens_and_places(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    want = {}
    for doc_id, text in rows(spark, "documents", "doc_id", "text"):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k] = (a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()))
    out = queries.op1_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)])]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    sizes = [n for _, n, _ in want.values()]
    seed = packing.packed(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 2048)
    assert -(-sum(sizes) // 2048) <= len(bins) <= len(seed)


def test_op2_components(spark):
    held = {}
    for doc_id, text in rows(spark, "documents", "doc_id", "text"):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
        held[doc_id] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    up = {i: i for i in held}
    for i in held:
        for j in held:
            if i < j and held[i] and 100 * len(held[i] & held[j]) >= 85 * len(held[i] | held[j]):
                a, b = min(up[i], up[j]), max(up[i], up[j])
                up = {k: a if v == b else v for k, v in up.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op2_near_dedup(spark, SF).collect()}
    assert got == {i: (len(s), up[i], up[i] == i) for i, s in held.items()}


def test_op3_recall_scores_and_ties(spark):
    table = rows(spark, "embeddings", "vec_id", "embedding")
    ids, x = np.asarray([i for i, _ in table]), np.asarray([v for _, v in table], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in queries.op3_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    at, hit = {int(i): k for k, i in enumerate(ids)}, 0
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q, found in got.items():
        s = u @ u[at[q]]
        true = {int(ids[k]) for k in sorted((k for k in range(len(ids)) if ids[k] != q), key=lambda k: (-s[k], ids[k]))[:5]}
        hit += len(true & {v for _, v, _ in found}) / 5
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(score - s[at[v]]) < 1e-12 for _, v, score in found)
    assert hit / len(got) >= 0.9


def test_op4_digests(spark):
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows(spark, "conversations", "conv_id", "turn", "role", "text"):
        held[conv].append((turn, role or "", text or ""))
    held[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv, turns in held.items():
        loss = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))), len(loss), sha(loss))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat(spark, SF).collect()} == want


def test_op8_scores_of_plain_python(spark):
    docs = dict(rows(spark, "documents", "doc_id", "text"))
    told = {i: quality.measured(t or "") for i, t in docs.items()}
    voted = {i: tuple(quality.votes(s)) for i, (s, _) in told.items()}
    counts = collections.Counter(voted.values())
    patterns = sorted(counts)
    p = dict(zip(patterns, quality.estimated(np.asarray(patterns), np.asarray([counts[x] for x in patterns], float))))
    once = {docs[i]: i for i in docs}.values()  # equal texts train once
    w = quality.fitted([quality.features(*told[i]) for i in once], np.asarray([p[voted[i]] for i in once], np.float32))
    got = {r.doc_id: (r.score, r.kept) for r in queries.op8_quality(spark, SF).collect()}
    for i, t in docs.items():
        k, v = quality.features(*told[i])
        want = 0.5 if not (t or "").strip() else 1 / (1 + np.exp(-(w[k] @ v + w[-1])))
        assert abs(got[i][0] - want) < 1e-3 and got[i][1] == (got[i][0] >= 0.5)


def test_op8_and_op9_on_labels_never_seen(spark):
    sf = SF.replace("0.001", "0.1")  # a few dozen toxic rows teach too little
    labels = {i: (q, t) for i, q, t in rows(spark, "labels", "doc_id", "quality", "toxic", sf=sf)}
    kept = {r.doc_id: r.kept for r in queries.op8_quality(spark, sf).collect()}
    good, poor = ([kept[i] for i, (q, _) in labels.items() if q == k and i in kept] for k in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.3
    scored = [(r.score, labels[r.doc_id][1]) for r in queries.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels and labels[r.doc_id][1] is not None]
    yes, no = [s for s, t in scored if t], [s for s, t in scored if not t]
    assert np.mean([a > b for a in yes for b in no]) > 0.95 and np.mean([s >= 0.3 for s in no]) < 0.1


def test_op10_spans(spark):
    want, sf = {}, SF.replace("0.001", "0.01")
    for doc_id, text in rows(spark, "documents", "doc_id", "text", sf=sf):
        base, more = secrets.scan_text(text or "", secrets.BASE), secrets.scan_text(text or "", secrets.ADDED)
        order = {k: i for i, (k, *_) in enumerate(secrets.BASE + secrets.ADDED)}
        told = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want[doc_id] = (*(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex")), sha(told(base)), told(sorted(base + more, key=lambda f: (f[1], order[f[0]]))))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in queries.op10_secrets(spark, sf).collect()}
    assert got == want and any(w[4] for w in want.values())
