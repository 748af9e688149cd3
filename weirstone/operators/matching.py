"""Records matched to a table of standards: by code, then by name, then by mutual containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.functions.fields import title_key


def match_standards(records: DataFrame, standards: DataFrame) -> DataFrame:
    """records(seq, doc_no, title), standards(code, name) -> (seq, code, how): code before name before containment; then the shortest name, then the code.

    Containment is found through a shared run of 8 letters of the normal form at the start of either, so it is an equi join; names under 8 letters match by code or equality only.
    """
    s = standards.select("code", title_key(F.col("name")).alias("nk")).where("code is not null")
    r = records.select("seq", "doc_no", title_key(F.col("title")).alias("tk"))
    by_code = r.join(s, F.col("doc_no") == F.col("code")).select("seq", "code", F.lit(1).alias("p"), F.lit("code").alias("how"), F.length("nk").alias("len"))
    by_name = r.where("tk <> ''").join(s, F.col("tk") == F.col("nk")).select("seq", "code", F.lit(2).alias("p"), F.lit("name").alias("how"), F.length("nk").alias("len"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 7), lambda i: F.col(c).substr(i, F.lit(8))))
    head = lambda c: F.col(c).substr(1, 8)
    a, b = r.where(F.length("tk") >= 8), s.where(F.length("nk") >= 8)
    inside = a.select("seq", "tk", F.explode(grams("tk")).alias("g")).join(b.withColumn("g", head("nk")), "g").where(F.col("tk").contains(F.col("nk")) & (F.col("tk") != F.col("nk")))
    around = a.withColumn("g", head("tk")).join(b.select("code", "nk", F.explode(grams("nk")).alias("g")), "g").where(F.col("nk").contains(F.col("tk")) & (F.col("tk") != F.col("nk")))
    by_part = inside.select("seq", "code", "nk").unionByName(around.select("seq", "code", "nk")).select("seq", "code", F.lit(3).alias("p"), F.lit("part").alias("how"), F.length("nk").alias("len"))
    every = by_code.unionByName(by_name).unionByName(by_part)
    return every.groupBy("seq").agg(F.min(F.struct("p", "len", "code", "how")).alias("m")).select("seq", "m.code", "m.how")
