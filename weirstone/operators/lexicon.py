"""Matching texts against vocabularies: hits, counts, cascades, best labels, multi-labels.

Vocabularies are lists or (label, term) tables; a text's words are compared inside the row, so no
operator here shuffles texts. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.functions.fields import occurrences


def _text(*parts: Column) -> Column:
    return F.lower(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))


def distinct_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0))


def total_hits(text: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((occurrences(low, t) for t in terms), F.lit(0))


def relevant(title: Column, summary: Column, terms: list[str], least: int = 2) -> Column:
    """A hit in the title, or ``least`` different ones in the summary."""
    return (distinct_hits(title, terms) > 0) | (distinct_hits(summary, terms) >= least)


def cascade(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first (pattern, label) that is found."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), label).otherwise(out)
    return out


def best_label(text: Column, groups: dict[str, list[str]], default: str) -> Column:
    """The label with most occurrences of its terms; the earlier one at a tie; ``default`` without any."""
    scored = F.array(*[F.struct(total_hits(text, terms).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, terms) in enumerate(groups.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["label"]).otherwise(default)


def labels(df: DataFrame, key: str, text: Column, groups: dict[str, list[str]]) -> DataFrame:
    """(key, label): every label with any term in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    marks = F.array(*[F.when(F.greatest(*[low.contains(t).cast("int") for t in terms], F.lit(0)) > 0, F.lit(label)) for label, terms in groups.items()])
    return df.select(key, F.explode(F.array_compact(marks)).alias("label"))


def top_topics(df: DataFrame, key: str, title: str, summary: str, content: str, topics: dict[str, tuple[list[str], list[str]]], most: int = 3) -> DataFrame:
    """(key, topic, score, rank): weighted hits of core and weak terms in title (5, 2), summary (2, 1) and content (1, 0.2).

    Admitted: a core term in the title, or a score of 3 or more. Ties go to more title hits, then to the
    order of the vocabulary. All is computed inside the row; the ranking is a sort of the row's own array.
    """
    cols = []
    for i, (topic, (core, weak)) in enumerate(topics.items()):
        in_title = distinct_hits(F.col(title), core)
        score = in_title * 5 + distinct_hits(F.col(title), weak) * 2 + distinct_hits(F.col(summary), core) * 2 + distinct_hits(F.col(summary), weak) + distinct_hits(F.col(content), core) + distinct_hits(F.col(content), weak) * 0.2
        cols.append(F.struct((-F.round(score, 4)).alias("neg"), (-in_title).alias("neg_title"), F.lit(i).alias("o"), F.lit(topic).alias("topic")))
    admitted = F.filter(F.array_sort(F.array(*cols)), lambda t: (t["neg_title"] < 0) | (t["neg"] <= -3))
    return df.select(key, F.posexplode(F.slice(admitted, 1, most)).alias("p", "t")).select(key, F.col("t.topic").alias("topic"), (-F.col("t.neg")).alias("score"), (F.col("p") + 1).alias("rank"))


def ranked_terms(df: DataFrame, key: str, text: Column, terms: list[str], first: str | None = None, most: int = 24) -> DataFrame:
    """(key, term, n, rank): terms of a lexicon by falling count, longer first, then as listed; values of array ``first`` before them."""
    found = F.filter(F.array(*[F.struct((-occurrences(F.lower(F.coalesce(text, F.lit(""))), t)).alias("neg"), F.lit(-len(t)).alias("len"), F.lit(i).alias("o"), F.lit(t).alias("term")) for i, t in enumerate(terms)]), lambda x: x["neg"] < 0)
    ordered = F.transform(F.array_sort(found), lambda x: F.struct(x["term"].alias("term"), (-x["neg"]).alias("n")))
    if first:
        lead = F.transform(F.array_distinct(F.coalesce(F.col(first), F.array().cast("array<string>"))), lambda t: F.struct(t.alias("term"), F.lit(None).cast("int").alias("n")))
        ordered = F.concat(lead, F.filter(ordered, lambda x: ~F.coalesce(F.array_contains(F.col(first), x["term"]), F.lit(False))))
    return df.select(key, F.posexplode(F.slice(ordered, 1, most)).alias("p", "x")).select(key, F.col("x.term").alias("term"), F.col("x.n").alias("n"), (F.col("p") + 1).alias("rank"))


def keep_first(df: DataFrame, by: list[Column], order: str) -> DataFrame:
    """The first row of each group, by a map-side-combined minimum; the winners are joined back by ``order``, which is unique."""
    return df.join(df.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.min(order).alias(order)).select(order), order, "left_semi")


def first_per_group(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group in order (Spark keeps a group's first rows before the shuffle)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
