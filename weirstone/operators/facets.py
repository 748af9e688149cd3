"""Counts by shard, dimension, term and status; percentages; cross tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.sources.tables import cut


def shard(seq: Column, size: int = 2000) -> Column:
    return F.floor(seq / size).cast("long")


def dimensions(df: DataFrame, dims: dict[str, Column], *keep: str) -> DataFrame:
    """One row per record and dimension: (keep..., dim, value). One narrow explode instead of one scan for each."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.coalesce(c, F.lit("")).alias("value")) for n, c in dims.items()])).alias("x")).select(*keep, "x.dim", "x.value")


def shard_facets(df: DataFrame, dims: dict[str, Column], size: int = 2000) -> DataFrame:
    return dimensions(df.withColumn("shard", shard(F.col("seq"), size)), dims, "shard").groupBy("shard", "dim", "value").agg(F.count("*").alias("n"))


def value_shards(df: DataFrame, dims: dict[str, Column], size: int = 2000) -> DataFrame:
    """(dim, value, shard): each value's shards, a row for each, so that no list grows with the corpus."""
    return dimensions(df.withColumn("shard", shard(F.col("seq"), size)), dims, "shard").distinct()


def term_postings(df: DataFrame, seq: str, terms: Column, size: int = 2000) -> DataFrame:
    """(term, shard): an inverted index from terms to shards, a row for each pair."""
    return df.select(shard(F.col(seq), size).alias("shard"), F.explode(F.array_distinct(terms)).alias("term")).distinct().select("term", "shard")


def term_shards(df: DataFrame, seq: str, terms: Column, size: int = 2000) -> DataFrame:
    """(term, n_shards, first_shard, last_shard) of an inverted index from terms to shards."""
    pairs = df.select(shard(F.col(seq), size).alias("shard"), F.explode(F.array_distinct(terms)).alias("term")).distinct()
    return pairs.groupBy("term").agg(F.count("*").alias("n_shards"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))


def coverage_status(content: Column, kind: Column, pdf: Column, least: int, valid: Column | None = None) -> Column:
    """fulltext, abstract, pdf_only or missing; a text that isn't ``valid`` (by default: too short) is none."""
    has = F.length(F.coalesce(content, F.lit(""))) > 0
    good = (F.length(content) >= least) if valid is None else valid
    return F.when(has & ((kind == "abstract") | content.startswith("摘要")), "abstract").when(has & ~good, "missing").when(has & good, "fulltext").when(F.coalesce(pdf, F.lit("")) != "", "pdf_only").otherwise("missing")


def with_percent(counts: DataFrame, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Adds each count's share of the total in percent, two places; 0 where the total is 0. The totals are one more small aggregation."""
    if by:
        totals = counts.groupBy(*by).agg(F.sum(n).alias("_t"))
        j = counts.join(totals, by)
    else:
        j = counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("_t"))))  # one row
    return j.withColumn("percent", F.round(F.when(F.col("_t") > 0, F.col(n) * 100.0 / F.col("_t")).otherwise(0.0), 2)).drop("_t")


def top_groups(df: DataFrame, group: Column, most: int) -> DataFrame:
    """(value, n): the largest groups; at a tie the one seen first. A report of a fixed length."""
    return df.groupBy(group.alias("value")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(most)


def changes(df: DataFrame, before: Column, after: Column) -> DataFrame:
    return df.select(before.alias("old"), after.alias("new")).where(~before.eqNullSafe(after)).groupBy("old", "new").agg(F.count("*").alias("n"))


def running_best(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value is above all earlier ones of the group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("best_before", F.max(value).over(w)).where(F.col("best_before").isNull() | (F.col(value) > F.col("best_before"))).drop("best_before")


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt out by ranges of its order, whatever its keys, with ``_pid`` rising with it; written, as ranges are drawn from a sample."""
    return cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))


def segments(df: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """(group, segment, label, first, last, n): runs of equal labels in order, which is unique in a group.

    Runs are found range by range, so a group of any size is shared out; where two ranges meet in a group,
    the run of the later one goes on if the labels agree.
    """
    d = _ranged(df.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(label).alias("_l")), F.col("_g"), F.col("_o"))
    w = Window.partitionBy("_pid", "_g").orderBy("_o")
    d = d.withColumn("_new", F.when(F.lag("_l").over(w).eqNullSafe(F.col("_l")) & F.lag("_o").over(w).isNotNull(), 0).otherwise(1)).withColumn("_local", F.sum("_new").over(w))
    borders = d.groupBy("_pid", "_g").agg(F.max("_local").alias("runs"), F.min_by(F.struct("_l"), "_o").alias("head"), F.max_by(F.struct("_l"), "_o").alias("tail"))
    at = Window.partitionBy("_g").orderBy("_pid")  # a row for each range of a group
    borders = borders.withColumn("goes", F.when(F.lag("tail").over(at)["_l"].eqNullSafe(F.col("head")["_l"]) & F.lag("_pid").over(at).isNotNull(), 1).otherwise(0))
    borders = borders.withColumn("before", F.coalesce(F.sum(F.col("runs") - F.col("goes")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    borders = borders.select(F.col("_pid").alias("_p"), F.col("_g").alias("_h"), "goes", "before")
    runs = d.groupBy("_pid", "_g", "_local").agg(F.first("_l").alias("_l"), F.min("_o").alias("_first"), F.max("_o").alias("_last"), F.count("*").alias("_n"))
    j = runs.join(borders, (F.col("_pid") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")))
    return j.groupBy(F.col("_g").alias(group), (F.col("_local") + F.col("before") - F.col("goes")).alias("segment")).agg(F.first("_l").alias("label"), F.min("_first").alias("first"), F.max("_last").alias("last"), F.sum("_n").alias("n"))


def budget_cut(df: DataFrame, size: str, order: list[Column], budget: int, usable: Column | None = None) -> DataFrame:
    """Rows go, in order, until the sizes of those that stay fit the budget: adds ``removed``. Rows that aren't ``usable`` are passed over.

    Sums of ranges tell in which one the budget is met; only that range is added up row by row.
    """
    fit = F.lit(True) if usable is None else usable
    d = _ranged(df.withColumn("_fit", F.coalesce(fit, F.lit(False))).withColumn("_u", F.when(F.col("_fit"), F.col(size)).otherwise(0)), *order)
    sums = d.groupBy("_pid").agg(F.sum("_u").alias("_s"), F.sum(size).alias("_all"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    every = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = F.broadcast(sums.select("_pid", "_s", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), (F.sum("_all").over(every) - budget).alias("_over")))
    d = d.join(edges, "_pid")
    edge = (F.col("_before") < F.col("_over")) & (F.col("_before") + F.col("_s") >= F.col("_over"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = d.where(edge).withColumn("removed", F.col("_fit") & (F.col("_before") + F.coalesce(F.sum("_u").over(inside), F.lit(0)) < F.col("_over")))
    rest = d.where(~edge).withColumn("removed", F.col("_fit") & (F.col("_before") < F.col("_over")))
    return rest.unionByName(part).drop("_pid", "_fit", "_u", "_s", "_before", "_over")


def options(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(dim, value): the different values of each dimension that aren't empty."""
    return dimensions(df, dims).where("value <> ''").distinct()
