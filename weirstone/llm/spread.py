"""Input spread over the cluster for work that Python does, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df`` with at least as many partitions as the cluster has cores (small inputs in few files only)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded_sample(df: DataFrame, key: list[str], n: int, usable: Column, wide: int = 4) -> DataFrame:
    """At most ``n`` usable rows of ``df``, the same ones at every run: the smallest by a hash of ``key``.

    Where ``df`` has more than ``wide`` n rows, a share of about ``wide`` n / rows is cut out by another hash
    first, so the final ordering handles a bounded number of rows however large the corpus is. A larger
    ``wide`` is for rows of which few are usable.
    """
    rows = df.count()
    some = df if rows <= wide * n else df.where(F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(10**12)) < int(10**12 * wide * n / rows))
    return some.where(usable).orderBy(F.xxhash64(*key), *key).limit(n)
