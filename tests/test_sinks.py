"""Files that are the same whenever the rows are, and digests of files of any size."""

import hashlib
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from canonist.sources import sinks


def _rows(spark, parts):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "v=1/é").when(F.col("id") % 3 == 1, "v2").alias("version"), F.concat(F.lit("n"), F.col("id") % 700).alias("id"), (F.col("id") % 700).alias("ord"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.array(F.col("id")).alias("more"))
    return rows.repartition(parts, F.rand(parts))


def _held(spark, folder):
    return {r.path: (r.sha256, r.bytes) for r in sinks.manifest(spark, folder).collect()}


def test_equal_rows_give_equal_files(spark, tmp_path):
    """Ties of (ord, id) among them, under several shuffle settings; every file holds 100 rows in order."""
    for name, parts in (("a", 3), ("b", 11)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            sinks.write_nodes(_rows(spark, parts), f"{tmp_path}/{name}", rows_per_file=100)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    a, b = _held(spark, f"{tmp_path}/a"), _held(spark, f"{tmp_path}/b")
    assert a == b and len(a) == 12 and not any(x.startswith(("a.", "b.")) for x in os.listdir(tmp_path))
    for path, (digest, size) in a.items():
        data = (tmp_path / "a" / path).read_bytes()
        assert hashlib.sha256(data).hexdigest() == digest and len(data) == size and path.endswith(f"-{digest[:16]}.zstd.parquet")
        one = [(r["ord"], r["id"], r["more"]) for r in pq.ParquetFile(tmp_path / "a" / path).read().to_pylist()]
        assert one == sorted(one) and len(one) <= 100
    back = spark.read.parquet(f"{tmp_path}/a").collect()
    key = lambda r: (r.version or "", r.id, r.ord, r.text, r.more)
    assert sorted(map(key, back)) == sorted(map(key, _rows(spark, 2).collect()))
    with pytest.raises(FileExistsError):
        sinks.write_nodes(_rows(spark, 1), f"{tmp_path}/a")
    sinks.write_nodes(_rows(spark, 1).filter("text != 'text 5'"), f"{tmp_path}/c", rows_per_file=100)
    checked = sinks.check_manifest(sinks.manifest(spark, f"{tmp_path}/a"), sinks.manifest(spark, f"{tmp_path}/c"))
    assert not sinks.manifest_holds(checked).first().ok
    sinks.write_nodes(_rows(spark, 1).filter("false"), f"{tmp_path}/d")
    assert os.listdir(tmp_path / "d") == []


def test_diffs_and_metrics(spark, tmp_path):
    diff = spark.createDataFrame([("added", None, "b", "t", None, "h"), ("moved", "c", "d", "t", "k", "k"), ("added", None, "a", "t", None, "h")], "status string, from_id string, to_id string, type string, from_hash string, to_hash string")
    sinks.write_diff(diff, f"{tmp_path}/diff")
    assert [r.to_id for r in spark.read.parquet(f"{tmp_path}/diff/status=added").collect()] == ["a", "b"]
    assert sorted(os.listdir(tmp_path / "diff")) == ["status=added", "status=moved"]
    metrics = spark.createDataFrame([("without", 4, 0.5), ("all", 5, 0.6)], "scope string, total long, share double").repartition(2)
    sinks.write_metrics(metrics, f"{tmp_path}/metrics")
    (name,) = (x for x in os.listdir(tmp_path / "metrics") if x.endswith(".json"))
    assert [json.loads(x) for x in (tmp_path / "metrics" / name).read_text().splitlines()] == [{"scope": "all", "total": 5, "share": 0.6}, {"scope": "without", "total": 4, "share": 0.5}]


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "la rge", "wb") as f:
        f.truncate(size)
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        digest.update(zeros)
    digest.update(bytes(5))
    assert _held(spark, str(tmp_path)) == {"la rge": (digest.hexdigest(), size)}


def test_rows_are_shuffled_twice_and_keep_their_columns(spark, tmp_path, monkeypatch):
    """Once into order and once to their files; what numbers them is no window over the rows. Columns of any name are kept."""
    seen, kind = [], type(spark.range(1))
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("k"), "id", (F.col("id") * 7).alias("start"), F.lit("x").alias("pos"))
    rows = rows.withColumn("k", F.when(F.col("k") != "2", F.col("k")))
    monkeypatch.setattr(kind, "repartition", lambda self, *a, f=kind.repartition: seen.append(self) or f(self, *a))
    sinks.write_table(rows, f"{tmp_path}/w", ["id"], ["k"], rows_per_file=10)
    # what is shuffled before are the counts of the ranges
    assert len(seen) == 1 and seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    back = spark.read.parquet(f"{tmp_path}/w")
    assert sorted((r.id, r.start, r.pos, r.k) for r in back.collect()) == [(i, i * 7, "x", (0, 1, None)[i % 3]) for i in range(100)]
    sizes = back.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), (F.max("id") - F.min("id")).alias("d")).collect()
    assert sorted(r.n for r in sizes) == [3, 3, 4] + [10] * 9 and all(r.d == 3 * (r.n - 1) for r in sizes)
