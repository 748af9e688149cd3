"""Chunk index and ranked retrieval: BM25, TF-IDF cosine, rank fusion, extractive answers.

The index is three tables: chunks(chunk_id, seq, text, dl), postings(chunk_id, term, tf), frequencies
(term, df). A query is its few terms as literals, so scoring filters postings by them and aggregates by chunk;
document frequencies are counted before any join. ``save`` writes the index for later queries: postings and
frequencies in buckets by the hash of the term, so a query reads the buckets of its terms only (literals in the
partition filter) and tokenises nothing, and the norm of every chunk, so a cosine needs no other terms.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.functions.fields import chunks, sentences, tokens
from weirstone.sources.tables import cut

CANDIDATES, K1, B, FUSION = 200, 1.5, 0.75, 60


#: A written table of at most so many terms is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 300_000


def postings(c: DataFrame) -> DataFrame:
    """chunks -> (chunk_id, dl, term, tf)."""
    return c.select("chunk_id", "dl", F.explode(tokens(F.col("text"))).alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


@dataclass
class Index:
    chunks: DataFrame
    postings: DataFrame
    found: dict = field(default_factory=dict)

    @classmethod
    def build(cls, df: DataFrame, seq: str, text: Column, most: int = 320, cjk: bool = True) -> Index:
        """chunk_id is seq * 100000 + position, so that it is the same at every run. Chunks are cut once and written."""
        c = df.select(F.col(seq).alias("seq"), F.posexplode(chunks(F.coalesce(text, F.lit("")), most, cjk)).alias("p", "text"))
        c = cut(c.select((F.col("seq").cast("long") * 100000 + F.col("p")).alias("chunk_id"), "seq", "text", F.length("text").alias("dl")))
        return cls(c, postings(c))

    def totals(self) -> DataFrame:
        """One row: number of chunks and mean length."""
        return self.chunks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def hits(self, terms: list[str]) -> DataFrame:
        """The postings of ``terms``, written once; only texts that hold one of them as a string are taken apart."""
        key = tuple(sorted(set(terms)))
        if key not in self.found:
            low = F.lower("text")
            some = self.chunks.where(functools.reduce(lambda x, y: x | y, [low.contains(t) for t in key]))
            self.found[key] = cut(postings(some).where(F.col("term").isin(*key)))
        return self.found[key]

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df); without ``terms`` of all, each chunk's made distinct inside its row."""
        t = self.chunks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")) if terms is None else self.hits(terms)
        return t.groupBy("term").agg(F.count("*").alias("df"))


    def norms(self) -> DataFrame:
        """(chunk_id, norm): the length of the TF-IDF vector of every chunk."""
        df = self.frequencies()
        w = self.postings.join(df, "term").crossJoin(F.broadcast(self.totals())).withColumn("w", (1 + F.ln(F.col("tf").cast("double"))) * _idf())
        return w.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    def save(self, path: str, buckets: int = 256) -> None:
        """Writes the index below ``path``; the buckets of postings are sorted by term."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        self.chunks.write.parquet(f"{path}/chunks")
        self.postings.select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        self.frequencies().select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/frequencies")
        self.norms().write.parquet(f"{path}/norms")
        self.totals().select("*", F.lit(buckets).alias("buckets")).write.parquet(f"{path}/totals")


class StoredIndex:
    """A saved index; ``bm25``, ``search`` and ``answer`` take it like one in memory, ``tfidf`` takes its norms."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.chunks = spark.read.parquet(f"{path}/chunks")
        self.buckets = spark.read.parquet(f"{path}/totals").first().buckets

    def _of(self, part: str, terms: list[str]) -> DataFrame:
        one = self.spark.range(1)
        numbers = one.select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in sorted(set(terms))]).first()
        return self.spark.read.parquet(f"{self.path}/{part}").where(F.col("bucket").isin(sorted(set(numbers))) & F.col("term").isin(*set(terms))).drop("bucket")

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals").select("n", "avgdl")

    def hits(self, terms: list[str]) -> DataFrame:
        return self._of("postings", terms)

    def frequencies(self, terms: list[str]) -> DataFrame:
        return self._of("frequencies", terms)

    def norms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/norms")


def _idf() -> Column:
    return F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) + 1


def cosine(index: StoredIndex, terms: list[str], most: int = CANDIDATES) -> DataFrame:
    """What ``tfidf`` gives, from stored postings of the query's terms and stored norms."""
    counts = {t: terms.count(t) for t in terms}
    q = F.coalesce(*[F.when(F.col("term") == t, 1 + F.ln(F.lit(float(n)))) for t, n in counts.items()], F.lit(0.0)) * _idf()
    one, df = F.broadcast(index.totals()), F.broadcast(index.frequencies(list(counts)))
    qn = F.broadcast(index.frequencies(list(counts)).crossJoin(one).select(q.alias("q")).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn")))
    dots = index.hits(list(counts)).join(df, "term").crossJoin(one).groupBy("chunk_id").agg(F.sum((1 + F.ln(F.col("tf").cast("double"))) * _idf() * q).alias("dot")).where("dot > 0")
    s = dots.join(index.norms(), "chunk_id").where("norm > 0").crossJoin(qn)
    return s.select("chunk_id", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 6).alias("score")).orderBy(F.desc("score"), F.desc("chunk_id")).limit(most)


def report(index: Index | StoredIndex, hits: DataFrame, records: DataFrame, terms: list[str], documents: int = 10, points: int = 3, references: int = 12, cjk: bool = True) -> DataFrame:
    """(part, place, label, text) of a report on the hits (chunk_id, seq, score).

    'department': hits by department, most first; 'point': up to ``points`` sentences with a term of the query of each of
    the first ``documents`` hits, or the beginning of the chunk; 'reference': the first hits themselves. All of
    fixed lengths, so its windows run over a few rows.
    """
    w = Window.orderBy(F.desc("score"), F.desc("chunk_id"))
    h = cut(hits.join(records.select("seq", "title", "department", "url"), "seq").withColumn("place", F.row_number().over(w)))
    by = h.groupBy(F.coalesce("department", F.lit("")).alias("label")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    departments = by.select(F.lit("department").alias("part"), F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"), "label", F.col("n").cast("string").alias("text"))
    q = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    top = h.where(F.col("place") <= documents).join(index.chunks.select("chunk_id", F.col("text").alias("chunk")), "chunk_id")
    some = F.filter(sentences(F.col("chunk"), cjk), lambda s: F.arrays_overlap(tokens(s), q))
    chosen = F.when(F.size(some) > 0, F.slice(some, 1, points)).otherwise(F.array(F.substring("chunk", 1, 160)))
    point = top.select("place", "title", F.posexplode(chosen).alias("p", "text")).select(F.lit("point").alias("part"), (F.col("place") * 10 + F.col("p")).alias("place"), F.col("title").alias("label"), "text")
    reference = h.where(F.col("place") <= references).select(F.lit("reference").alias("part"), "place", F.col("title").alias("label"), F.col("url").alias("text"))
    return departments.unionByName(point).unionByName(reference)


def bm25(index: Index, terms: list[str], most: int = CANDIDATES) -> DataFrame:
    """(chunk_id, score), best first; a chunk's length counts in characters."""
    hits = index.hits(terms)
    one = F.broadcast(index.totals())  # one row
    df = F.broadcast(index.frequencies(terms))  # at most one row for each term of the query
    j = hits.join(df, "term").crossJoin(one)
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.groupBy("chunk_id").agg(F.round(F.sum(s), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("chunk_id")).limit(most)


def tfidf(index: Index, terms: list[str], most: int = CANDIDATES) -> DataFrame:
    """(chunk_id, score): cosine of (1 + ln tf) (ln((N - df + 0.5) / (df + 0.5)) + 1); norms take all terms of a chunk that has a hit.

    The chunks with a hit are dealt out by id once, so their terms are counted and added up in place.
    Terms of one chunk alone aren't looked up: what the table of frequencies lacks has df 1.
    """
    ids = index.hits(terms).select("chunk_id").distinct()
    near = postings(index.chunks.select("chunk_id", "dl", "text").join(ids, "chunk_id", "left_semi").repartition("chunk_id"))
    one = F.broadcast(index.totals())
    many = cut(index.frequencies().where("df > 1"))
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    w = near.join(many, "term", "left").withColumn("df", F.coalesce("df", F.lit(1))).crossJoin(one).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) + 1).withColumn("w", (1 + F.ln(F.col("tf").cast("double"))) * F.col("idf"))
    counts = {t: terms.count(t) for t in terms}
    q = F.coalesce(*[F.when(F.col("term") == t, 1 + F.ln(F.lit(float(n)))) for t, n in counts.items()], F.lit(0.0)) * F.col("idf")
    per = w.groupBy("chunk_id").agg(F.sum(F.col("w") * q).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qn = F.broadcast(index.frequencies(list(counts)).crossJoin(one).withColumn("w", F.coalesce(*[F.when(F.col("term") == t, 1 + F.ln(F.lit(float(n)))) for t, n in counts.items()]) * (F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) + 1)).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn")))
    s = per.where("dot > 0 and norm > 0").crossJoin(qn)
    return s.select("chunk_id", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 6).alias("score")).orderBy(F.desc("score"), F.desc("chunk_id")).limit(most)


def fuse(*rankings: DataFrame, k: int = FUSION) -> DataFrame:
    """(chunk_id, rrf): reciprocal ranks added up. Each ranking has at most CANDIDATES rows, so its window is small."""
    w = Window.orderBy(F.desc("score"), F.desc("chunk_id"))
    parts = [r.select("chunk_id", (1.0 / (k + F.row_number().over(w))).alias("r")) for r in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("chunk_id").agg(F.round(F.sum("r"), 8).alias("rrf"))


def search(index: Index, records: DataFrame, terms: list[str], keep: Column, boost: Column, most: int = 8) -> DataFrame:
    """(chunk_id, seq, score): fused candidates joined with their records, filtered after the cut, boosted, best first."""
    hits = fuse(bm25(index, terms), tfidf(index, terms)).join(index.chunks.select("chunk_id", "seq"), "chunk_id").join(records, "seq")
    return hits.where(keep).select("chunk_id", "seq", F.round(F.col("rrf") * boost, 6).alias("score")).orderBy(F.desc("score"), F.desc("chunk_id")).limit(most)


def metadata(department: str | None = None, region: str | None = None, category: str | None = None, quality: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """The filter of a search: parts of department and region, the category, the least quality, the days as text; what isn't given doesn't filter."""
    out = F.lit(True)
    for name, part in (("department", department), ("region", region)):
        if part:
            out = out & F.coalesce(name, F.lit("")).contains(part)
    if category:
        out = out & F.coalesce(F.col("category") == category, F.lit(False))
    if quality:
        out = out & F.coalesce(F.col("quality") <= quality, F.lit(False))
    day = F.coalesce("date", F.lit(""))
    return out & (day >= since if since else F.lit(True)) & (day <= until if until else F.lit(True))


def answer(index: Index, hits: DataFrame, terms: list[str], most: int = 5, cjk: bool = True) -> DataFrame:
    """(sentence, overlap, rank): sentences of the hits by shared tokens, then length; the same beginning once. ``cjk`` as the index was built."""
    s = index.chunks.join(F.broadcast(hits.select("chunk_id", "score")), "chunk_id").select("chunk_id", F.posexplode(sentences(F.col("text"), cjk)).alias("p", "sentence"))
    s = s.withColumn("overlap", F.size(F.array_intersect(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]), tokens(F.col("sentence"))))).where("overlap > 0")
    first = Window.partitionBy(F.substring("sentence", 1, 20)).orderBy(F.desc("overlap"), F.desc(F.length("sentence")), F.desc("chunk_id"), "p")
    s = s.withColumn("r", F.row_number().over(first)).where("r = 1").orderBy(F.desc("overlap"), F.desc(F.length("sentence")), F.desc("chunk_id"), "p").limit(most)
    w = Window.orderBy(F.desc("overlap"), F.desc(F.length("sentence")), F.desc("chunk_id"), "p")  # at most ``most`` rows
    return s.select("sentence", "overlap", F.row_number().over(w).alias("rank"))
