"""The pN_ queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.llm import byte_bpe, encoding_repair, history_dedup, main_text, mixture, residue, scan_repair, shared_spans
from weirstone.llm.repeated_lines import repeated_lines, without_repeated_lines
from weirstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "kb").select("seq", "title", "source", "url", "content", "summary")
    return residue.find(kb, ["content", "summary"]).select(F.col("seq").cast("long").alias("seq"), "field")


def _main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "kb").where("pdf is null").select("seq", "title", "source", "url", "content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _main_text(spark, sf_dir).select(F.col("seq").cast("long").alias("seq"), F.explode("frame").alias("line_no"))


def p2_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _main_text(spark, sf_dir).select("seq", "body")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb, inbox = (table(spark, sf_dir, t).select("seq", "url", "title") for t in ("kb", "inbox"))
    return history_dedup.against_history(kb, inbox, table(spark, sf_dir, "sites"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "kb").where("pdf is null").select("seq", "source", "content")
    return repeated_lines(kb).select(F.col("key").cast("long").alias("seq"), "line_no")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "kb").where("pdf is null").select("seq", "source", "content")
    return without_repeated_lines(kb).select(F.col("key").cast("long").alias("seq"), "content", "removed")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repair(table(spark, sf_dir, "kb").select("seq", "title", "content", "source"), ["content", "title"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select(F.col("seq").cast("long").alias("seq"), "field")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = table(spark, sf_dir, "kb").select("seq", "title", "content", "pdf")
    model = scan_repair.fit(kb.where("pdf is null"), "title", "content")
    return scan_repair.scan_noise(kb.where("pdf is not null"), model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).select(F.col("seq").cast("long").alias("seq"), F.explode("lines").alias("x")).select("seq", "x.line_no", "x.kind")


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).select("seq", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = byte_bpe.decode(byte_bpe.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.select_mixture(docs, table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.fuzzy_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_body, p3_found, p4_found, p4_clean, p5_found, p5_restored, p6_found, p6_text, p8_ids, p8_roundtrip, p9_selection, p9_shares, p10_found, p10_share, p10_passages)}


# DuckDB has no compatibility normalisation; the full-width forms, and nothing else that NFKC changes, occur in lines that repeat.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
SQL = {
    "p4_found": f"""
WITH l AS (SELECT seq, coalesce(source, '') AS source, unnest(string_split(content, chr(10))) AS line,
                  generate_subscripts(string_split(content, chr(10)), 1) AS line_no
           FROM kb WHERE pdf IS NULL AND content IS NOT NULL),
k AS (SELECT seq, source, line_no, lower(translate(regexp_replace(line, '[\\s\\x{{3000}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}]', '', 'g'), '{_WIDE}', '{_NARROW}')) AS k FROM l),
r AS (SELECT source, k FROM k WHERE length(k) >= 10 GROUP BY ALL HAVING count(DISTINCT seq) >= 5)
SELECT seq, line_no FROM k JOIN r USING (source, k)""",
    "p4_clean": f"""
WITH l AS (SELECT seq, coalesce(source, '') AS source, unnest(string_split(content, chr(10))) AS line,
                  generate_subscripts(string_split(content, chr(10)), 1) AS line_no
           FROM kb WHERE pdf IS NULL AND content IS NOT NULL),
k AS (SELECT *, lower(translate(regexp_replace(line, '[\\s\\x{{3000}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}]', '', 'g'), '{_WIDE}', '{_NARROW}')) AS k FROM l),
r AS (SELECT source, k FROM k WHERE length(k) >= 10 GROUP BY ALL HAVING count(DISTINCT seq) >= 5),
t AS (SELECT seq, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE r.k IS NULL), '') AS content, CAST(count(r.k) AS INT) AS removed
      FROM k LEFT JOIN r ON k.source = r.source AND k.k = r.k GROUP BY seq)
SELECT seq, CASE WHEN t.seq IS NULL THEN kb.content ELSE t.content END AS content, coalesce(removed, 0) AS removed FROM kb LEFT JOIN t USING (seq) WHERE pdf IS NULL""",
    "p8_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p10_share": """
WITH d AS (SELECT doc_id, text, coalesce(length(text), 0) AS n FROM documents),
w AS (SELECT doc_id, p, substr(text, p, 100) AS s FROM (SELECT doc_id, text, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100)),
b AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, p, least(100, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 100)) AS k FROM w JOIN b USING (s))
SELECT d.doc_id, d.n AS n_chars, coalesce(x.k, 0)::BIGINT AS shared_chars, round(CASE WHEN d.n > 0 THEN coalesce(x.k, 0) / d.n ELSE 0 END, 6) AS share
FROM d LEFT JOIN (SELECT doc_id, sum(k) AS k FROM c GROUP BY doc_id) x USING (doc_id)""",
    "p10_found": """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 100),
w AS (SELECT doc_id, p, substr(text, p, 100) AS s FROM (SELECT doc_id, text, unnest(range(1, n - 98)) AS p FROM d)),
b AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, p - 1 AS p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS f FROM w JOIN b USING (s)),
g AS (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM c)
SELECT doc_id, min(p) AS span_start, max(p) + 100 AS span_end FROM g GROUP BY doc_id, g""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
