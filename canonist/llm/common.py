"""What the operators share: the folder that driver and executors both see, tables written there, rows with numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, merge, shared_dir  # noqa: F401


def numbered(df: DataFrame, *keep: str) -> DataFrame:
    """__uid (different for each row), these columns, and __row: all columns as one struct, so that no name of theirs can
    clash with one of an operator's. To be stored before it is read twice."""
    return df.select(F.monotonically_increasing_id().alias("__uid"), *keep, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def restored(columns: list[str], results: dict[str, Column]) -> list[Column]:
    """The columns of __row, then the results; a result takes the place of a column that has its name."""
    taken = {name.lower(): (name, value) for name, value in results.items()}
    out = [taken.pop(c.lower())[1].alias(c) if c.lower() in taken else F.col("__row").getField(c).alias(c) for c in columns]
    return out + [value.alias(name) for name, value in taken.values()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
