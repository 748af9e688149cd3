"""Merging an inbox into the records, as the sequential rule would, by set operations.

The rule, for each inbox row in order: (1) its comparable address is known: skip; (2) else its event key
is known: replace the holder if the quality is strictly higher, without making the new address known;
(3) else append it and make both known. Rounds settle, of the undecided rows, those that come first by
both address and key; few are needed, and each is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.functions.fields import event_key, url_comparable, url_key
from weirstone.sources.tables import cut


def _keyed(df: DataFrame, stored: bool) -> DataFrame:
    ev = F.coalesce(F.nullif(F.col("_ev"), F.lit("")), event_key(F.col("title"))) if stored else event_key(F.col("title"))
    q = F.when(F.col("quality") == "A", 3).when(F.col("quality") == "B", 2).otherwise(1)
    return df.select("seq", F.when(url_comparable(F.col("url")), url_key(F.col("url"))).alias("u"), F.coalesce(ev, F.lit("")).alias("ev"), q.alias("q"))


def merge(kb: DataFrame, inbox: DataFrame) -> DataFrame:
    """(seq, action, holder): appended, replaced (holder is the position taken), skipped; kb rows that lose aren't listed.

    ``replaces`` counts every time a row would have replaced the holder on the way.
    """
    old, new = cut(_keyed(kb, True)), cut(_keyed(inbox, False))
    known = old.where("u is not null").select("u").distinct()
    alive = new.join(known, "u", "left_anti")
    holders = old.groupBy("ev").agg(F.min("seq").alias("holder"), F.min_by("q", "seq").alias("hq"))
    candidates = alive.join(holders.select("ev"), "ev", "left_semi")
    todo = cut(alive.join(holders.select("ev"), "ev", "left_anti"))
    appended = None
    # Every round settles at least the row of the smallest seq, so the rounds end without a bound on their number.
    while not todo.isEmpty():
        by_u = todo.where("u is not null").groupBy("u").agg(F.min("seq").alias("fu"))
        by_e = todo.groupBy("ev").agg(F.min("seq").alias("fe"))
        x = todo.join(by_u, "u", "left").join(by_e, "ev")
        now = cut(x.where("fe = seq and (fu is null or fu = seq)").select("seq", "u", "ev", "q"))
        appended = now if appended is None else appended.unionByName(now)
        todo = cut(todo.join(now.select("ev"), "ev", "left_anti").join(now.where("u is not null").select("u").distinct(), "u", "left_anti"))
    appended = cut(appended) if appended is not None else todo
    first = appended.where("u is not null").select("u", F.col("seq").alias("au"))
    rest = alive.join(appended.select("seq"), "seq", "left_anti").join(first, "u", "left").where("au is null or au > seq").select("seq", "ev", "q")
    places = holders.unionByName(appended.select("ev", F.col("seq").alias("holder"), F.col("q").alias("hq")))
    runs = rest.join(places, "ev").select("ev", "seq", "q", "holder", "hq")
    w = Window.partitionBy("ev").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("best", F.greatest(F.coalesce(F.max("q").over(w), F.lit(0)), "hq")).where("q > best")
    winners = runs.groupBy("ev").agg(F.max_by("seq", F.struct("q", (-F.col("seq")).alias("n"))).alias("seq"), F.min("holder").alias("holder"), F.count("*").alias("replaces"))
    actions = appended.select("seq", F.lit("appended").alias("action"), F.col("seq").alias("holder"), F.lit(0).cast("long").alias("replaces")).join(winners.select(F.col("holder").alias("seq")), "seq", "left_anti")
    actions = actions.unionByName(winners.select("seq", F.lit("replaced").alias("action"), "holder", "replaces"))
    actions = actions.unionByName(winners.join(appended.select(F.col("seq").alias("holder")), "holder", "left_semi").select(F.col("holder").alias("seq"), F.lit("appended_then_replaced").alias("action"), "holder", F.lit(0).cast("long").alias("replaces")))
    return new.select("seq").join(actions, "seq", "left").select("seq", F.coalesce("action", F.lit("skipped")).alias("action"), "holder", F.coalesce("replaces", F.lit(0)).alias("replaces"))
