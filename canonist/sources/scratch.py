"""Tables that a job writes for itself, in the folder that driver and executors both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder only where that is unset and Spark itself is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def merge(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged at every size: what grows with the input is never broadcast by way of the driver,
    even where it is small as a file. Selections and groupings of df keep this, joins and unions don't."""
    return df.hint("merge")


class Scratch:
    """Tables of one job in the shared folder. A table is written whole before anything reads it, so lineage ends there and
    lost executors lose nothing; it is dropped as soon as all that is made of it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths, self.written = spark, f"{shared_dir(spark)}/job-{uuid.uuid4().hex}", {}, 0

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """df written once as Parquet and read back."""
        self.written += 1
        path = f"{self.folder}/{self.written}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str, but: int = 0) -> None:
        """Deletes the tables of these labels, but for the last `but` of each."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for label in labels:
            held = self.paths.get(label, [])
            gone, self.paths[label] = held[: len(held) - but], held[len(held) - but :]
            for path in gone:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
