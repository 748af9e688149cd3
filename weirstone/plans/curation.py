"""The order in which a corpus is built: fields, merge, scores, labels, facets. One lazy plan, cut only after the merge."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.functions import fields as C
from weirstone.operators import annotate, facets, graph, lexicon, scoring
from weirstone.operators.merge import merge
from weirstone.sources.tables import cut


@dataclass
class Vocabulary:
    """What a corpus is about; every list is data of the caller."""

    core: list[str]
    support: list[str]
    departments: list[str]
    regions: dict[str, str]
    topics: dict[str, tuple[list[str], list[str]]]
    entities: dict[str, list[str]]
    error_marks: list[str] = field(default_factory=list)
    risk_marks: list[str] = field(default_factory=list)
    as_of: str = "2025-06-30"


def normalise(df: DataFrame, v: Vocabulary) -> DataFrame:
    return df.withColumns({"region": C.remap(F.col("region"), v.regions), "department": C.clamp(F.col("department"), v.departments, "其他"), "url": C.repair_doi(F.col("url"))})


def policy_records(items: DataFrame, v: Vocabulary, rules: dict, added_at: str) -> DataFrame:
    """Items of a policy library as records: cleaned, relevant ones only, labelled and with their key."""
    title, summary = C.sanitize(F.col("title")), C.sanitize(F.coalesce("summary", F.lit("")))
    d = items.where((F.coalesce("title", F.lit("")) != "") & lexicon.relevant(F.col("title"), F.col("summary"), v.core)).select(title.alias("title"), "url", "source", "doc_no", summary.alias("summary"), "date")
    text = F.concat_ws(" ", "title", "summary")
    return d.select(
        "*", annotate.first_group(F.concat_ws(" ", "title", "source"), rules["departments"], F.lit("其他")).alias("department"), lexicon.cascade(F.col("title"), rules["categories"], "policy").alias("category"),
        annotate.first_group(text, rules["regions"], F.lit("全国")).alias("region"), F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in v.core])).alias("tags"), C.record_id(F.col("url"), F.col("title"), F.col("date")).alias("cid"), F.lit(added_at).alias("added_at"),
    )


def take_in(kb: DataFrame, inbox: DataFrame) -> DataFrame:
    """kb with the inbox merged: appended rows at the end, replacing rows in their holder's position."""
    shared = [c for c in kb.columns if c in inbox.columns and c != "seq"]
    actions = cut(merge(kb.select("seq", "url", "title", "quality", "_ev"), inbox.select("seq", "url", "title", "quality")))
    moved = actions.where("action in ('appended', 'replaced')").select("seq", "holder")
    new = inbox.join(moved, "seq").select(F.col("holder").alias("seq"), *shared)
    gone = moved.where("holder <> seq").select(F.col("holder").alias("seq"))
    return kb.join(gone, "seq", "left_anti").unionByName(new, allowMissingColumns=True)


def score(df: DataFrame, v: Vocabulary) -> DataFrame:
    body = F.concat_ws("\n", "title", "summary", "content")
    rel = scoring.relevance(F.col("title"), body, v.core, v.support)
    d = df.withColumn("quality_src", F.col("quality")).withColumn("water_rel", rel).withColumn("quality", scoring.downgraded(F.col("quality"), F.col("water_rel")))
    d = d.withColumn("importance", scoring.importance(F.lit(1.5), F.col("quality"), scoring.timeliness(F.col("date"), v.as_of), F.col("water_rel")))
    return d.withColumn("validity", scoring.validity(F.col("title"), F.col("content"), v.error_marks, v.risk_marks))


def outputs(df: DataFrame, v: Vocabulary, shard_size: int = 2000) -> dict[str, DataFrame]:
    """The tables a corpus is served from; each is one plan over the scored records."""
    text = F.concat_ws("\n", "title", "summary", "content")
    found = graph.entities(df, "seq", text, v.entities)
    dims = {"category": F.col("category"), "region": F.col("region"), "department": F.col("department"), "quality": F.col("quality")}
    return {
        "records": df, "topics": lexicon.top_topics(df, "seq", "title", "summary", "content", v.topics), "nodes": graph.nodes(found), "edges": graph.edges(found),
        "facets": facets.shard_facets(df, dims, shard_size), "value_shards": facets.value_shards(df, dims, shard_size), "term_shards": facets.term_shards(df, "seq", C.tokens(F.concat_ws(" ", "title", "summary")), shard_size),
    }


def curate(kb: DataFrame, inbox: DataFrame, v: Vocabulary) -> dict[str, DataFrame]:
    return outputs(score(cut(take_in(normalise(kb, v), normalise(inbox, v))), v), v)
