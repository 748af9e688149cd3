"""Problem 4: lines repeated across one source's documents.

Lines are hashed once (128 bits) and written, sorted inside each record, so that the two passes over them
read 24 bytes a line and no text. Per source and line the number of records is counted with map-side
combining; a line's own frequency in the other sources is the sum of those counts. Sources in which the
line is itself repeated count neither for nor against it, else a share prompt used by every site would
look like ordinary prose.

Inside and outside frequencies are compared by a log-likelihood ratio. Where that can't decide (a line
spread thinly over many sources, few counts, a single source), an upper bound of the Poisson tail holds the
count against the frequency of lines in general outside the source: ordinary lines hardly ever recur, so a line that
stands in ``min_records`` records of one source is in excess of them. The smaller of the two p-values,
doubled, goes into the Benjamini-Hochberg rule, evaluated on a fixed grid of -ln p, so no global sort is
needed. Rows come out only for lines in significant excess.

Defined results: null or empty content has no lines; blank and short lines are never cases; null and
empty sources count as one source; repeated rows count like any other; keys are taken as unique; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.functions.text import SPACES, nfkc
from weirstone.sources.tables import cut, stored

MIN_RECORDS, MIN_CHARS, FDR = 5, 10, 0.05
#: Steps of -ln p on which the false-discovery rule is evaluated.
_STEP, _STEPS = 0.25, 400
#: A written table of at most so many rows (some 30 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def hashed_lines(df: DataFrame, key: str, source: str, content: str, min_chars: int) -> DataFrame:
    """(key, source, keys): struct(h1, h2, line_no) of the normal form of every line that is long enough, sorted; written."""
    lines = F.split(squeeze_lines(nfkc(F.col(content))), "\n", -1)
    keyed = F.transform(lines, lambda s, i: F.when(F.length(s) >= min_chars, F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(s, F.lit(1)).alias("h2"), (i + 1).cast("long").alias("line_no"))))
    return stored(df.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.array_sort(F.array_compact(keyed)).alias("keys")), "lines")


def squeeze_lines(text: Column) -> Column:
    """Lower case, all white space but line feeds removed."""
    return F.lower(F.regexp_replace(text, "[" + SPACES.replace(r"\x09-\x0d", r"\x09\x0b-\x0d") + "]+", ""))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _log_chi(llr: Column) -> Column:
    """An upper bound of ln P(chi-squared with one degree of freedom >= llr)."""
    return F.when(llr > 1, -llr / 2 - 0.5 * F.ln(math.pi * llr / 2)).otherwise(0.0)


def _log_tail(n: Column, mean: Column) -> Column:
    """An upper bound of ln P(Poisson(mean) >= n): the first term, Stirling's bound of n!, and a geometric rest."""
    bound = n * F.ln(mean) - mean - (n * F.ln(n) - n + 0.5 * F.ln(2 * math.pi * n)) - F.ln(1 - mean / (n + 1))
    return F.when((mean > 0) & (n > mean), F.least(bound, F.lit(0.0))).when(mean <= 0, F.lit(-1e3)).otherwise(0.0)


def line_statistics(rows: DataFrame, min_records: int = MIN_RECORDS, fdr: float = FDR) -> DataFrame:
    """hashed_lines -> (source, h1, h2, n, n_source, outside, llr, excess) of each line in at least ``min_records`` records of a source."""
    # Equal lines of a record are neighbours in its array; the first of them counts.
    before = F.element_at("keys", F.greatest(F.col("i"), F.lit(1)))
    one = rows.select("source", "keys", F.posexplode("keys").alias("i", "k")).where((F.col("i") == 0) | (before["h1"] != F.col("k.h1")) | (before["h2"] != F.col("k.h2")))
    pairs = stored(one.select("source", "k.h1", "k.h2").groupBy("h1", "h2", "source").agg(F.count("*").alias("n")), "counts")
    often = cut(pairs.where(F.col("n") >= min_records))
    rest = pairs.where(F.col("n") < min_records).join(_sized(often.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.sum("n").alias("rest"))
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_source"))
    # Of lines in general: how many there are outside a source, and in how many records they stand.
    mine = pairs.groupBy("source").agg(F.count("*").alias("kinds"), F.sum("n").alias("stands"))
    total = sizes.agg(F.sum("n_source").alias("n_all")).crossJoin(pairs.where(F.col("n") < min_records).agg(F.count("*").alias("all_kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_stands")))
    own = pairs.where(F.col("n") < min_records).groupBy("source").agg(F.count("*").alias("own_kinds"), F.sum("n").alias("own_stands"))
    by_source = sizes.join(mine, "source", "left").join(own, "source", "left").na.fill(0)
    t = often.join(rest, ["h1", "h2"], "left").join(by_source, "source").crossJoin(total)  # one row
    a, b, n1 = F.col("n").cast("double"), F.coalesce("rest", F.lit(0)).cast("double"), F.col("n_source").cast("double")
    n2 = F.greatest(F.col("n_all") - F.col("n_source"), F.lit(1)).cast("double")
    e1, e2 = (a + b) * n1 / (n1 + n2), (a + b) * n2 / (n1 + n2)
    llr = 2 * (a * F.ln(a / e1) + F.when(b > 0, b * F.ln(b / e2)).otherwise(0.0))
    # A line outside stands in so many records on average; at least in one of as many as there are lines, where nothing is outside.
    kinds, stands = F.col("all_kinds") - F.col("own_kinds"), F.col("all_stands") - F.col("own_stands")
    mean = F.when(kinds > 0, stands / kinds * F.least(n1 / n2, F.lit(1.0))).otherwise(F.lit(1.0))
    t = t.withColumn("outside", b.cast("long")).withColumn("llr", F.when(a / n1 > b / n2, F.greatest(llr, F.lit(0.0))).otherwise(0.0))
    p = F.least(F.least(_log_chi(F.col("llr")), _log_tail(a, mean)) + math.log(2), F.lit(0.0))
    t = cut(t.withColumn("score", -p).select("source", "h1", "h2", "n", "n_source", "outside", "llr", "score"))  # repeated lines only; three plans read it
    # Benjamini-Hochberg on the grid: the smallest t with m * exp(-t) <= fdr * #{score >= t}.
    hist = t.groupBy(F.least(F.floor(F.col("score") / _STEP), F.lit(_STEPS)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    grid = rows.sparkSession.range(_STEPS + 1).select(F.col("id").cast("int").alias("g"))
    cuts = (
        F.broadcast(grid).join(hist, F.col("bin") >= F.col("g"), "left").groupBy("g").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("above"))
        .crossJoin(hist.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("m")))
        .where((F.col("above") > 0) & (F.exp(-F.col("g") * _STEP) * F.col("m") <= fdr * F.col("above")))
        .agg(F.min(F.col("g") * _STEP).alias("cut"))
    )
    return t.crossJoin(cuts).select("source", "h1", "h2", "n", "n_source", "outside", "llr", F.coalesce(F.col("score") >= F.col("cut"), F.lit(False)).alias("excess"))


def repeated_lines(df: DataFrame, key: str = "seq", source: str = "source", content: str = "content", min_records: int = MIN_RECORDS, min_chars: int = MIN_CHARS, fdr: float = FDR) -> DataFrame:
    """(key, line_no, n, llr): each occurrence of a line in significant excess; line_no counts from 1."""
    rows = hashed_lines(df, key, source, content, min_chars)
    stats = cut(line_statistics(rows, min_records, fdr).where("excess").select("source", "h1", "h2", "n", "llr"))
    return rows.select("key", "source", F.explode("keys").alias("k")).select("key", "source", "k.h1", "k.h2", "k.line_no").join(_sized(stats), ["source", "h1", "h2"]).select("key", "line_no", "n", "llr")


def without_repeated_lines(df: DataFrame, key: str = "seq", source: str = "source", content: str = "content", **how) -> DataFrame:
    """(key, content, removed): each record's content with its repeated lines taken out, the rest in order.

    Lines in excess are taken off by an anti-join on record and position, and the others are put together
    by position; records without any such line don't take part.
    """
    gone = stored(repeated_lines(df, key, source, content, **how).select("key", "line_no"), "gone")
    counts = gone.groupBy("key").agg(F.count("*").cast("int").alias("removed"))
    texts = df.select(F.col(key).alias("key"), F.col(content).alias("content"))
    lines = texts.join(counts.select("key"), "key", "left_semi").select("key", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).withColumn("line_no", (F.col("pos") + 1).cast("long"))
    kept = lines.join(gone, ["key", "line_no"], "left_anti").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("at"))
    again = counts.join(kept.select("key", F.array_join(F.transform("at", lambda x: x["line"]), "\n").alias("content")), "key", "left")
    return texts.join(counts, "key", "left_anti").withColumn("removed", F.lit(0)).unionByName(again.select("key", F.coalesce("content", F.lit("")).alias("content"), "removed"))
