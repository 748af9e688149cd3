"""Dates of records in push buckets, windows, pages and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ISO = r"^\d{4}-\d{2}-\d{2}$"


def day_of(date: Column) -> Column:
    return F.when(date.rlike(ISO), date).try_cast("date")


def push_bucket(added: Column, date: Column, as_of: str, days: int = 180) -> Column:
    """The day for recent records, the year for older ones, 'unknown' without a readable date."""
    raw = F.coalesce(F.nullif(added, F.lit("")), date)
    d = day_of(raw)
    return F.when(d.isNull(), "unknown").when(d >= F.date_sub(F.lit(as_of).cast("date"), days), raw).otherwise(F.substring(raw, 1, 4))


def window_of(date: Column, as_of: str) -> Column:
    """The narrowest of 7, 30, 90, 180, 365 days and three years that a date lies in."""
    n = F.datediff(F.lit(as_of).cast("date"), day_of(date))
    out = F.when(n.isNull(), "unknown")
    for d in (7, 30, 90, 180, 365, 1095):
        out = out.when(n <= d, f"{d}d")
    return out.otherwise("older")


def pager(df: DataFrame, day: str) -> DataFrame:
    """(day, n, before, after): days with their neighbours. Days are few; the window runs over their counts alone."""
    d = df.groupBy(day).agg(F.count("*").alias("n"))
    w = Window.orderBy(day)
    return d.select(F.col(day).alias("day"), "n", F.lag(day).over(w).alias("before"), F.lead(day).over(w).alias("after"))


def briefs(df: DataFrame, ts: str, units: tuple[str, ...] = ("day", "week", "month", "quarter", "year")) -> DataFrame:
    """(unit, start): one row per record and unit of time; weeks begin on Monday."""
    return df.select("*", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, ts).cast("date").alias("start")) for u in units])).alias("_b")).select("*", "_b.unit", "_b.start").drop("_b")
