"""Every core query by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirstone.operators.timestamps import normalise_times, times_found
from weirstone.queries import annotate, corpus, records
from weirstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "kb").select("seq", "source", "date", "added_at")
    return times_found(kb, table(spark, sf_dir, "sites").select("name", "tz", "date_order"))


def p7_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "kb").select("seq", "source", "date", "added_at")
    out = normalise_times(kb, table(spark, sf_dir, "sites").select("name", "tz", "date_order"), ["date", "added_at"], "seq")
    return out.groupBy("field", "status").count().withColumnRenamed("count", "n")


def queries() -> dict[str, Query]:
    return {"p7_found": p7_found, "p7_status": p7_status} | records.QUERIES | corpus.QUERIES | annotate.QUERIES


def oracle_sql() -> dict[str, str]:
    return records.SQL | corpus.SQL | annotate.SQL
