"""Records joined with side tables: full texts, files, known origins, names of laws, repaired addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.functions.fields import title_unbracketed
from weirstone.operators.annotate import first_group


def fulltext(df: DataFrame, key: str, content: str, order: str, least: int = 30) -> DataFrame:
    """(key, order, text): the content of the first record of each key that has more than ``least`` characters; records stay lean without it."""
    some = df.where(F.length(F.trim(F.col(content))) > least)
    return some.groupBy(key).agg(F.min(order).alias(order), F.min_by(content, order).alias("text"))


def lookup(df: DataFrame, stored: DataFrame, key: str, content: str, most: int | None = None) -> DataFrame:
    """Adds ``text``: the record's own content, else the stored one up to ``most`` characters, else ''."""
    text = F.col("_text") if most is None else F.substring("_text", 1, most)
    j = df.join(stored.select(F.col(key).alias("_key"), F.col("text").alias("_text")), F.col(key) == F.col("_key"), "left")
    return j.withColumn("text", F.coalesce(F.nullif(F.col(content), F.lit("")), text, F.lit(""))).drop("_key", "_text")


def files_to_records(files: DataFrame, records: DataFrame, path: str, seq: str) -> DataFrame:
    """files(path) -> (path, seq, n): the first record of each file and how many there are; files without one stay, with null and 0."""
    r = records.groupBy(F.col(path).alias("path")).agg(F.min(seq).alias(seq), F.count("*").alias("n"))
    return files.join(r, "path", "left").select("path", seq, F.coalesce("n", F.lit(0)).alias("n"))


def known_origins(df: DataFrame, title: Column, origins: dict[str, str]) -> DataFrame:
    """Adds ``origin``, the address of the first keyword in the title; rows without one are left out."""
    return df.withColumn("origin", first_group(title, {v: [k] for k, v in origins.items()}, F.lit(None).cast("string"))).where("origin is not null")


def repaired_urls(df: DataFrame, standards: DataFrame, origins: dict[str, str], proxy: str) -> DataFrame:
    """df(seq, title, doc_no, url) -> (seq, url, kind): the page of the record's standard, else a known origin, else the address without its proxy."""
    s = standards.where("code is not null").groupBy("code").agg(F.min("url").alias("_std"))
    known = first_group(F.col("title"), {v: [k] for k, v in origins.items()}, F.lit(None).cast("string"))
    plain = F.when(F.col("url").rlike(proxy), F.regexp_replace("url", proxy, "https://"))
    j = df.join(s, F.col("doc_no") == F.col("code"), "left").withColumns({"_known": known, "_plain": plain})
    kind = F.when(F.col("_std").isNotNull(), "standard").when(F.col("_known").isNotNull(), "known").when(F.col("_plain").isNotNull(), "proxy").otherwise("kept")
    return j.select("seq", F.coalesce("_std", "_known", "_plain", "url").alias("url"), kind.alias("kind"))


def names_to_records(names: DataFrame, records: DataFrame, least: int = 6) -> DataFrame:
    """names(name), records(seq, title) -> (name, seq, how): the first record whose title is equal but for blanks and brackets, else the first one of which one contains the other.

    Containment is an equality of parts: a title's parts of the lengths of the names against the names, and the
    names' parts of the lengths of the titles against the titles. The lengths, at most as many as a name has
    letters, come to the driver; names are the smaller side and are taken apart, titles only at lengths of names.
    """
    n = names.where(F.coalesce("name", F.lit("")) != "").select("name", title_unbracketed(F.col("name")).alias("n")).distinct().where("n <> ''")
    t = records.select("seq", title_unbracketed(F.col("title")).alias("t")).groupBy("t").agg(F.min("seq").alias("seq"))
    equal = n.join(t, F.col("n") == F.col("t")).select("name", "seq", F.lit(0).alias("p"))
    sizes = sorted(r[0] for r in n.select(F.length("n")).distinct().collect())
    long = t.where(F.length("t") >= least)
    parts = lambda c, lengths: F.explode(F.array_distinct(F.flatten(F.array(*[F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i, k=k: F.col(c).substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>")) for k in lengths]))))
    inside = long.select("seq", parts("t", sizes).alias("n")).join(n, "n").select("name", "seq", F.lit(1).alias("p")) if sizes else equal.limit(0)
    around = n.select("name", parts("n", range(least, max(sizes, default=least) + 1)).alias("t")).join(long, "t").select("name", "seq", F.lit(1).alias("p"))
    best = equal.unionByName(inside).unionByName(around).groupBy("name").agg(F.min(F.struct("p", "seq")).alias("m"))
    return best.select("name", "m.seq", F.when(F.col("m.p") == 0, "equal").otherwise("part").alias("how"))


def unique_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``unique``: the key, with an x for each record of the same key before it. Records of one key are few by nature (copies of an address)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("unique", F.concat(F.col(key), F.repeat(F.lit("x"), n)))


def unseen(df: DataFrame, seen: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows of ``df`` none of whose keys is in ``seen``; a key is (of df, of seen), null and empty ones match nothing. One anti join a key, each on distinct values."""
    for name, (mine, theirs) in keys.items():
        known = seen.select(theirs.alias(f"_{name}")).where(F.coalesce(F.col(f"_{name}"), F.lit("")) != "").distinct()
        df = df.withColumn(f"_{name}", mine).join(known, f"_{name}", "left_anti").drop(f"_{name}")
    return df


def apply_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records(seq, title, url), sources(name, url, publisher) -> records with address and publisher of the source whose name they bear; the smallest name where there are several."""
    m = names_to_records(sources.select("name"), records).join(sources.where("url <> ''").groupBy("name").agg(F.min(F.struct("url", "publisher")).alias("s")), "name")
    one = m.groupBy("seq").agg(F.min_by(F.struct("s.url", "s.publisher"), "name").alias("s")).select("seq", F.col("s.url").alias("_url"), F.col("s.publisher").alias("publisher"))
    return records.join(one, "seq", "left").withColumn("url", F.coalesce("_url", "url")).drop("_url")
