"""The whole pipeline on a small corpus, against what each stage must do to it."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from canonist.llm import packing, queries

pytest.importorskip("public_tokenizers")


def test_every_stage_takes_effect_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    own = lambda n=60: " ".join(word() for _ in range(n))
    clean = {i: own() + f" {i}." for i in range(100, 260)}
    passage = "\n".join(own(8) for _ in range(6))
    twin, item = own(120), own(14)
    edited = " ".join("changed" if i == 60 else w for i, w in enumerate(twin.split()))
    cut = own()
    docs = clean | {1: own() + "\n" + passage, 2: cut + "\n" + passage, 3: twin, 4: edited, 5: own() + " " + item + " " + own(), 6: None, 7: ""}
    poor = {i: "NOISE!! LOUD!! " * 30 + str(i) for i in range(300, 315)} | {i: "same " * 80 + str(i) for i in range(315, 330)}
    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in (docs | poor).items()]
    rows.append(rows[0])  # a row twice
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: t for i, t in docs.items() if i not in (4, 5)} | {2: cut}
    encode = packing.Encoder(queries.tokenizer_path())
    sizes = dict(zip(want, (1 + len(x) // 4 for x in encode.many(pa.array(list(want.values()), pa.string())))))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in out} == sizes and len(out) == len(sizes)
    bins = {s: sorted((r.offset, r.length) for r in out if r.sequence_id == s) for s in {r.sequence_id for r in out}}
    assert all([o for o, _ in held] == [0, *np.cumsum([n for _, n in held])][:-1] and sum(n for _, n in held) <= 2048 for held in bins.values())


def test_stages_in_turn_on_nulls_repeats_and_nothing(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", None, "s", 0), (2, "one two", "en", "s", 7), (2, "one two", "en", "s", 7), (3, "word " * 30_000, "en", "s", 150_000)]
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, given, str(tmp_path))
            assert name == "packing" or made.columns == docs.columns
            given = made if name == "packing" else spark.createDataFrame(made.collect(), docs.schema)
        assert given.count() <= 100
