"""Problem 9: mixing sources to target weights by Pareto order sampling.

For each mix and source the wanted tokens are target_share x total_ratio x all tokens. Whole copies of
the source are allocated first; for the rest each document gets an inclusion probability p proportional to its
size, its tokens divided by the number of exact copies of its text in the source, so that copies together have
the chance of one document. Documents whose p would reach 1 are certain: they are taken out and the factor is
computed anew for the others, until none is left; the factor is such that the expected tokens are those wanted.
Each document is ranked by [u/(1-u)] / [p/(1-p)] with u uniform (a hash of mix, document and seed, so a rerun
after a lost executor draws the same), and those of lowest rank are taken until the wanted size is met.

The factor is found from sums over 64 classes of sizes for each doubling of a source: going down the
sizes, the first class that need not be certain ends the search, which is where taking certain documents out
one by one ends too.

The cut in the ranking is found by histograms of the rank, refined twice, so no source is sorted in one
task; only the documents of one of 2^24 cells are ordered.

Defined results: documents without tokens or with null source are never taken; a source that is wanted
but has no tokens, or too few even at ``max_repeats``, is taken as far as it goes and its shortfall is
reported; max_repeats null or below 1 means not at all; ties are broken by doc_id; repeated mix rows
with the same mix and source are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.llm.byte_bpe import token_counts
from weirstone.sources.tables import cut

_CELLS = 4096
#: Classes of sizes: this many for each doubling.
_FINE = 64


def _uniform(*cols: Column) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / float(1 << 52)


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies), written once to the shared folder; texts don't move."""
    n = token_counts(documents.select(F.struct("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2")).alias("k"), "text"), "k", "text", path)
    n = cut(n.select("k.*", "n_tokens").where("source is not null and n_tokens > 0"))
    same = n.groupBy("source", "h1", "h2").agg(F.count("*").alias("copies"))
    many = same.where("copies > 1")
    n = n.join(many, ["source", "h1", "h2"], "left").select("doc_id", "source", "n_tokens", (F.col("n_tokens") / F.coalesce("copies", F.lit(1))).alias("size"))
    return n.withColumn("class", F.floor(F.log2("size") * _FINE).cast("int"))


def factors(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """(mix_id, source, factor, certain): p is factor x size up to the class ``certain``, and 1 above it."""
    sums = docs.groupBy("source", "class").agg(F.sum("n_tokens").alias("s"), F.sum(F.col("n_tokens") * F.col("size")).alias("q"), F.max("size").alias("top"))
    x = goal.where("rest_tokens > 0").select("mix_id", "source", "rest_tokens").join(sums, "source")
    down = Window.partitionBy("mix_id", "source").orderBy(F.desc("class"))  # classes of sizes only
    x = x.withColumn("above", F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("below", F.sum("q").over(down.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("factor", (F.col("rest_tokens") - F.col("above")) / F.col("below")).where((F.col("factor") > 0) & (F.col("factor") * F.col("top") < 1))
    return x.groupBy("mix_id", "source").agg(F.max(F.struct("class", "factor")).alias("m")).select("mix_id", "source", "m.factor", F.col("m.class").alias("certain"))


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, target_tokens, source_tokens, whole, rest_tokens)."""
    per = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    total = per.agg(F.sum("source_tokens").alias("all_tokens"))
    t = targets.where("mix_id is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"), F.max("total_ratio").alias("total_ratio"))
    t = t.join(per, "source", "left").crossJoin(total)  # one row
    want = F.round(F.col("target_share") * F.col("total_ratio") * F.coalesce("all_tokens", F.lit(0)))
    t = t.withColumn("target_tokens", F.coalesce(want, F.lit(0.0)).cast("long")).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    whole = F.when(F.col("source_tokens") > 0, F.least(F.floor(F.col("target_tokens") / F.col("source_tokens")), F.col("max_repeats").cast("long"))).otherwise(0)
    rest = F.when(F.col("whole") < F.col("max_repeats"), F.col("target_tokens") - F.col("whole") * F.col("source_tokens")).otherwise(0)
    return t.withColumn("whole", whole).withColumn("rest_tokens", rest).select("mix_id", "source", "target_share", "max_repeats", "target_tokens", "source_tokens", "whole", "rest_tokens")


def _before(cells: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Adds the tokens of all lower cells; a group has at most _CELLS rows."""
    w = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("below", F.coalesce(F.sum("cell_tokens").over(w), F.lit(0)))


def select_mixture(documents: DataFrame, targets: DataFrame, seed: int = 1, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection(mix_id, source, doc_id, n_tokens, copies), shares(one row per mix and source))."""
    docs = sized(documents, path)
    goal = cut(plan(docs, targets))
    odds = cut(factors(docs, goal))
    base = docs.join(goal.select("mix_id", "source", "whole", "rest_tokens"), "source").where("whole > 0 or rest_tokens > 0").join(odds, ["mix_id", "source"], "left")
    u = _uniform(F.col("mix_id"), F.col("doc_id"), F.lit(seed))
    # Without a factor every document is certain: all that is left of the source is wanted.
    p = F.when(F.col("factor").isNull() | (F.col("class") > F.col("certain")), 1 - 1e-9).otherwise(F.greatest(F.least(F.col("factor") * F.col("size"), F.lit(1 - 1e-9)), F.lit(1e-12)))
    # The logistic map keeps the order of the ranks and puts them in (0, 1).
    q = F.ln(u / (1 - u)) - F.ln(p / (1 - p))
    base = base.withColumn("r", 1 / (1 + F.exp(-q)))
    c1 = F.floor(F.col("r") * _CELLS)
    base = base.withColumn("c1", c1).withColumn("c2", F.floor((F.col("r") * _CELLS - F.col("c1")) * _CELLS))
    by = ["mix_id", "source"]
    rest = base.where("rest_tokens > 0")
    h1 = _before(rest.groupBy(*by, "c1", "rest_tokens").agg(F.sum("n_tokens").alias("cell_tokens")), by, "c1")
    edge1 = h1.where("below < rest_tokens and below + cell_tokens >= rest_tokens").select(*by, F.col("c1").alias("e1"), F.col("below").alias("b1"))
    edge1 = cut(edge1)  # one row per mix and source
    in1 = rest.join(edge1, by).where("c1 = e1")
    h2 = _before(in1.groupBy(*by, "c2", "rest_tokens", "b1").agg(F.sum("n_tokens").alias("cell_tokens")), by, "c2")
    edge2 = cut(h2.where("b1 + below < rest_tokens and b1 + below + cell_tokens >= rest_tokens").select(*by, F.col("c2").alias("e2"), (F.col("b1") + F.col("below")).alias("b2")))
    edge = edge1.join(edge2, by)
    w = Window.partitionBy(*by).orderBy("r", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = rest.join(edge, by).where("c1 = e1 and c2 = e2").withColumn("run", F.col("b2") + F.sum("n_tokens").over(w))
    # The document that crosses the line is taken if that comes nearer to the wanted size.
    last = last.where((F.col("run") <= F.col("rest_tokens")) | (F.col("run") - F.col("rest_tokens") < F.col("rest_tokens") - (F.col("run") - F.col("n_tokens")))).select("mix_id", "source", "doc_id", F.lit(1).alias("near"))
    marked = base.join(edge, by, "left").join(last, ["mix_id", "source", "doc_id"], "left")
    under = (F.col("c1") < F.col("e1")) | ((F.col("c1") == F.col("e1")) & (F.col("c2") < F.col("e2")))
    extra = F.when(F.col("rest_tokens") <= 0, 0).when(F.col("e1").isNull(), 1).when(under | F.col("near").isNotNull(), 1).otherwise(0)
    chosen = marked.select("mix_id", "source", "doc_id", "n_tokens", (F.col("whole") + extra).cast("long").alias("copies")).where("copies > 0")
    got = chosen.groupBy(*by).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"), F.max("copies").alias("most_copies"))
    sums = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    shares = (
        goal.join(got, by, "left").join(sums, "mix_id", "left")
        .select("mix_id", "source", "target_share", "max_repeats", "target_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("share"), (F.col("target_tokens") > F.col("source_tokens") * F.col("max_repeats")).alias("short"))
    )
    return chosen, shares
