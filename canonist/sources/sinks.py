"""Writers whose files are the same whenever the rows are, and manifests that tell so."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tree import positions
from .scratch import Scratch

#: Bytes that a digest holds at once.
STREAMED = 8 << 20
#: Fixed value: characters that Spark writes as %XX in names of folders.
UNSAFE = r"[\x00-\x1F\x7F\"#%'*/:=?\\{\[\]^]"


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's path class, the file system of a path)"""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_table(rows: DataFrame, path: str, order: list[str], by: list[str] = (), rows_per_file: int = 1_000_000, kind: str = "parquet") -> None:
    """Writes rows (Parquet, or JSON lines) to a new folder: below it one for each value of `by` (as Spark names them, null and empty alike
    as its default), in it files of rows_per_file rows in this order (ties by the other columns), named by their number and digest. So
    equal rows give equal files with equal names, whatever the partitions, executors or shuffle settings. An existing folder is an error; no rows make
    an empty one.

    Files are written aside and the folder gets its name last, so that readers see all or nothing. The driver only renames, file by
    file. A file is written by one task: rows_per_file bounds it. The columns of `by` are in the folders' names and not in the files."""
    spark, by = rows.sparkSession, list(by)
    of, files = _file_system(spark, path)
    if files.exists(of(path)):
        raise FileExistsError(path)
    rest = [f.name for f in rows.schema if f.name not in (*by, *order) and "map<" not in f.dataType.simpleString()]
    keys = by or ["__all"]
    laid = positions(rows.withColumn("__all", F.lit(0)), *keys, *order, *sorted(rest), named="__place")
    # one row for each folder: its first place and the files before its own
    folders = Scratch(spark).stored(laid.groupBy(*keys).agg(F.min("__place").alias("__first"), F.ceil(F.count("*") / rows_per_file).alias("__files")), "folders")
    folders = folders.withColumn("__before", F.coalesce(F.sum("__files").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.floor((F.col("l.__place") - F.col("k.__first")) / rows_per_file)
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys]
    dealt = laid.alias("l").join(F.broadcast(folders.alias("k")), on).select("l.*", (F.col("k.__before") + nth + 1).cast("int").alias("__file")).drop(*by, "__all")
    known = folders.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__files") - 1))).select(*by, "__nth", (F.col("__before") + F.col("__nth") + 1).cast("int").alias("__file"))
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    # sorted by the number of the file first, as a write by folders asks, so that it sorts no more
    dealt.repartition("__file").sortWithinPartitions("__file", "__place").drop("__place").write.option("compression", "zstd" if kind == "parquet" else "none").partitionBy("__file").format(kind).save(f"{aside}/rows")
    told = known.join(manifest(spark, f"{aside}/rows").select("path", "sha256", F.regexp_extract("path", r"__file=(\d+)/", 1).cast("int").alias("__file")), "__file")
    escaped = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(UNSAFE), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x)), "")
    named = lambda c: F.coalesce(F.nullif(escaped(F.col(c).cast("string")), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), named(c)) for c in by]) if by else F.lit("")
    ends = {"parquet": ".zstd.parquet", "json": ".json"}[kind]
    name = F.concat(F.lit("part-"), F.lpad(F.col("__nth").cast("string"), 6, "0"), F.lit("-"), F.left("sha256", F.lit(16)), F.lit(ends))
    files.mkdirs(of(f"{aside}/done"))
    for r in told.select("path", folder.alias("folder"), name.alias("name")).toLocalIterator():
        to = f"{aside}/done/{r.folder}".rstrip("/")
        files.mkdirs(of(to))
        if not files.rename(of(f"{aside}/rows/{r.path}"), of(f"{to}/{r.name}")):
            raise OSError(f"could not rename {r.path}")
    if not files.rename(of(f"{aside}/done"), of(path)):
        raise OSError(f"could not rename {aside}/done")
    files.delete(of(aside), True)


def write_nodes(nodes: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Nodes in document order, a folder for each version and language."""
    write_table(nodes, path, ["ord", "id"], [c for c in ("version", "lang") if c in nodes.columns], rows_per_file)


def write_diff(diff: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Entries of a comparison, a folder for each status, by old and new id."""
    write_table(diff, path, ["from_id", "to_id"], ["status"], rows_per_file)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Shares and counts as JSON lines, sorted by all columns."""
    write_table(metrics, path, metrics.columns, kind="json")


def _opened(path: str):
    """A stream of a file by its URI, as Spark lists it, on any file system that Arrow knows."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    host, _, inner = rest.lstrip("/").partition("/")
    system, root = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return system.open_input_stream(f"{root.rstrip('/')}/{inner}")


def manifest(spark: SparkSession, folder: str, nodes: DataFrame | None = None) -> DataFrame:
    """path (from the folder on), sha256, bytes, and nodes (how many a corpus file holds; nodes: path, a row for each) of every file below a
    folder, sorted by path. Spark lists the files and deals them by size; a task streams its files through the digest, so a file may
    have any size."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with _opened(path) as stream:
                    while block := stream.read(STREAMED):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield batch.assign(sha256=found)

    of, files = _file_system(spark, folder)
    root = files.makeQualified(of(folder)).toString().rstrip("/") + "/"
    out = listed.mapInPandas(digests, "path string, bytes long, sha256 string").select(F.expr("substr(path, {})".format(len(root) + 1)).alias("path"), "sha256", "bytes")
    if nodes is None:
        return out.withColumn("nodes", F.lit(None).cast("long")).orderBy("path")
    return out.join(nodes.groupBy("path").agg(F.count("*").alias("nodes")), "path", "left").orderBy("path")


def check_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path, listed, present, sha256_ok, bytes_ok."""
    a, b = listed.select("path", F.col("sha256").alias("s1"), F.col("bytes").alias("b1")), found.select("path", F.col("sha256").alias("s2"), F.col("bytes").alias("b2"))
    both = a.join(b, "path", "full")
    return both.select("path", F.col("s1").isNotNull().alias("listed"), F.col("s2").isNotNull().alias("present"), F.coalesce(F.col("s1") == F.col("s2"), F.lit(False)).alias("sha256_ok"), F.coalesce(F.col("b1") == F.col("b2"), F.lit(False)).alias("bytes_ok"))


def manifest_holds(checked: DataFrame) -> DataFrame:
    """files, failed, ok: one row; every file is listed, there, and as it was."""
    good = F.col("listed") & F.col("present") & F.col("sha256_ok") & F.col("bytes_ok")
    return checked.agg(F.count("*").alias("files"), F.count_if(~good).alias("failed"), (F.count_if(~good) == 0).alias("ok"))
