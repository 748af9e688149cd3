"""Writing records: cleaned, in shards, and only if not too many have gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.functions.fields import sanitize, sanitize_all
from weirstone.operators.facets import shard


class TooFewRows(RuntimeError):
    """The new version would have lost more rows than allowed."""


def cleaned(df: DataFrame) -> DataFrame:
    """Control characters out of every string and string array."""
    kinds = dict(df.dtypes)
    return df.select(*[sanitize(F.col(c)).alias(c) if k == "string" else sanitize_all(F.col(c)).alias(c) if k == "array<string>" else F.col(c) for c, k in kinds.items()])


def guarded_write(df: DataFrame, path: str, before: int, share: float = 0.8) -> int:
    """Written beside the old version unless fewer than ``share`` of the rows before are left; the number written."""
    n = df.count()
    if n < share * before:
        raise TooFewRows(f"{n} rows, {before} before")
    cleaned(df).write.mode("overwrite").parquet(path)
    return n


def write_shards(df: DataFrame, path: str, size: int = 2000) -> None:
    """One folder per ``size`` positions; folders that are no longer needed go with the overwrite."""
    s = df.withColumn("shard", shard(F.col("seq"), size))
    s.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def append_inbox(df: DataFrame, path: str) -> None:
    cleaned(df).write.mode("append").parquet(path)


def read_shards(spark: SparkSession, path: str, shards: list[int]) -> DataFrame:
    """Only the named shards are scanned."""
    return spark.read.parquet(path).where(F.col("shard").isin(shards))


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Small tables as JSON lines, a folder each; a report of counts has few rows."""
    for name, df in parts.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
