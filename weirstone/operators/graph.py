"""Entity co-occurrence graph: nodes in at least two files, edges by shared files, anchors by containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entities(df: DataFrame, key: str, text: Column, vocabulary: dict[str, list[str]], without: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, type, name): vocabulary words in the text, but for the names of a type in ``without``."""
    low, out = F.coalesce(text, F.lit("")), without or {}
    found = F.array_compact(F.array(*[F.when(low.contains(n), F.struct(F.lit(t).alias("type"), F.lit(n).alias("name"))) for t, names in vocabulary.items() for n in names if n not in out.get(t, [])]))
    return df.select(F.col(key).alias("file"), F.explode(found).alias("e")).select("file", "e.type", "e.name")


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(name), 1, 10))


def nodes(found: DataFrame, least: int = 2) -> DataFrame:
    """(id, type, name, cnt)."""
    return found.groupBy("type", "name").agg(F.count_distinct("file").alias("cnt")).where(F.col("cnt") >= least).select(node_id(F.col("type"), F.col("name")).alias("id"), "type", "name", "cnt")


def edges(found: DataFrame, least: int = 2) -> DataFrame:
    """(s, t, w): unordered pairs of nodes by the files they share. A file's entities are at most the vocabulary, so pairs are made inside the row's own array."""
    kept = found.join(nodes(found, least).select("type", "name", "id"), ["type", "name"])
    files = kept.groupBy("file").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    pairs = files.select(F.explode("ids").alias("s"), "ids").select("s", F.explode("ids").alias("t")).where("s < t")
    return pairs.groupBy("s", "t").agg(F.count("*").alias("w")).where(F.col("w") >= least)


def _trie(words: list[str]) -> str:
    """A Java pattern that matches the longest of the words, which are sorted and distinct; a branch for each next character."""
    out, rest = [], [w for w in words if w]
    for c in dict.fromkeys(w[0] for w in rest):
        tails = [w[1:] for w in rest if w[0] == c]
        literal = "\\" + c if c.isascii() and not c.isalnum() else c
        out.append(literal + (_trie(tails) if any(tails) else ""))
    return ("|".join(out) if len(out) == 1 and len(rest) == len(words) else "(?:" + "|".join(out) + ")" + ("?" if len(rest) < len(words) else "")) if out else ""


def mentions(titles: DataFrame, cores: DataFrame) -> DataFrame:
    """(core, n): distinct titles (or whole texts) that contain a core name and aren't it, of any length.

    ``cores`` is a vocabulary and comes to the driver; its names become one pattern, tried at every
    position of a text. That gives the longest name there, and every other one there is a beginning of it.
    """
    names = sorted(r[0] for r in cores.where("core <> ''").select("core").distinct().collect())
    if not names:
        return titles.select(F.lit("").alias("core"), F.lit(0).cast("long").alias("n")).limit(0)
    begins = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*[F.lit(m) for m in names if n.startswith(m)]))])
    longest = F.array_distinct(F.regexp_extract_all("title", F.lit(f"(?=({_trie(names)}))"), F.lit(1)))
    found = titles.select("title", F.explode(F.array_distinct(F.flatten(F.transform(longest, lambda x: begins[x])))).alias("core")).where("core <> title")
    return found.select("core", F.xxhash64("title").alias("t1"), F.xxhash64(F.lit(3), "title").alias("t2")).distinct().groupBy("core").agg(F.count("*").alias("n"))


def title_mentions(df: DataFrame, title: str, out: list[str], least: int = 4) -> DataFrame:
    """(title, n): in how many other titles the core of a title stands; ``out`` are patterns taken out of it.

    A core in another title is equal to a part of it, so all parts of a title that have the length of some
    core are joined with the cores by equality: an equi join that spreads by its hash, whatever the sizes of both
    sides. The lengths that occur, at most as many as a title has letters, come to the driver.
    """
    t = df.where(F.length(title) >= least).select(F.col(title).alias("title")).distinct()
    core = F.col("title")
    for p in out:
        core = F.regexp_replace(core, p, "")
    c = t.withColumn("core", F.trim(core)).where(F.length("core") >= least)
    lengths = sorted(r[0] for r in c.select(F.length("core")).distinct().collect())
    if not lengths:
        return t.select("title", F.lit(0).cast("long").alias("n")).limit(0)
    parts = F.array_distinct(F.flatten(F.array(*[F.when(F.length("other") >= n, F.transform(F.sequence(F.lit(1), F.length("other") - n + 1), lambda i, n=n: F.col("other").substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in lengths])))
    found = t.withColumnRenamed("title", "other").select("other", F.explode(parts).alias("core"))
    # Parts that are no core go before the shuffle's second half: both sides meet on the hash of the part.
    return found.join(c, "core").where("other <> title").groupBy("title").agg(F.count("*").alias("n"))


def anchors(mentions: DataFrame, least: int = 8, most: int = 12) -> DataFrame:
    """The titles that stand in most others, if in ``least`` or more: a report of a fixed length."""
    return mentions.where(F.col("n") >= least).orderBy(F.desc("n"), "title").limit(most)
