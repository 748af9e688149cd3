"""Queries on counts, texts, retrieval, graph and events, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.functions import fields
from weirstone.operators import digest, facets, graph, lexicon, retrieval
from weirstone.queries import vocabulary as V
from weirstone.queries.records import _hits, _sql, kb
from weirstone.sources.tables import table
from weirstone.streaming.inbox import event_windows

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dims() -> dict[str, Column]:
    return {"category": F.col("category"), "region": F.col("region"), "department": F.col("department"), "quality": F.col("quality"), "year": F.substring("date", 1, 4)}


_DIM_SQL = " UNION ALL ".join(f"SELECT seq // 500 AS shard, '{n}' AS dim, coalesce({c}, '') AS value FROM kb" for n, c in (("category", "category"), ("region", "region"), ("department", "department"), ("quality", "quality"), ("year", "substr(date, 1, 4)")))


@query(f"SELECT shard, dim, value, count(*) AS n FROM ({_DIM_SQL}) GROUP BY ALL")
def shard_facets(spark: SparkSession, d: str) -> DataFrame:
    return facets.shard_facets(kb(spark, d, "category", "region", "department", "quality", "date"), _dims(), 500)


@query(f"SELECT DISTINCT dim, value, shard FROM ({_DIM_SQL})")
def value_shards(spark: SparkSession, d: str) -> DataFrame:
    return facets.value_shards(kb(spark, d, "category", "region", "department", "quality", "date"), _dims(), 500)


_STATUS = "CASE WHEN coalesce(content,'') <> '' AND (content_kind = 'abstract' OR starts_with(content, '摘要')) THEN 'abstract' WHEN coalesce(content,'') <> '' AND length(content) >= 200 THEN 'fulltext' WHEN coalesce(content,'') <> '' THEN 'missing' WHEN coalesce(pdf,'') <> '' THEN 'pdf_only' ELSE 'missing' END"


def _covered(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "content", "content_kind", "pdf", "region", "category", "content_type", "department", "source", "must_know", "url")
    return k.select("seq", "region", "category", "content_type", "department", "source", "must_know", "url", facets.coverage_status(F.col("content"), F.col("content_kind"), F.col("pdf"), 200).alias("status"))


@query(f"SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM kb), 2)::DOUBLE AS percent FROM (SELECT {_STATUS} AS status FROM kb) GROUP BY status")
def coverage_overall(spark: SparkSession, d: str) -> DataFrame:
    return facets.with_percent(_covered(spark, d).groupBy("status").agg(F.count("*").alias("n")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS dim, coalesce({c}, '') AS value, count_if(s = 'fulltext') AS fulltext, count_if(s = 'abstract') AS abstract, count_if(s = 'pdf_only') AS pdf_only, count_if(s = 'missing') AS missing FROM (SELECT *, {_STATUS} AS s FROM kb) GROUP BY {c}" for c in ("region", "category", "content_type", "department")))
def coverage_by_dim(spark: SparkSession, d: str) -> DataFrame:
    c = _covered(spark, d)
    x = facets.dimensions(c, {k: F.col(k) for k in ("region", "category", "content_type", "department")}, "status")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return x.groupBy("dim", "value").agg(n("fulltext"), n("abstract"), n("pdf_only"), n("missing"))


@query("SELECT split_part(source, '//', 1) AS value, count(*) AS n, min(seq) AS first_seq FROM kb GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 25")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return facets.top_groups(kb(spark, d, "source"), F.split("source", "//")[0], 25)


@query("SELECT tag, n, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS percent FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM kb) GROUP BY tag)")
def nav_percent(spark: SparkSession, d: str) -> DataFrame:
    return facets.with_percent(kb(spark, d, "tags").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")))


@query(f"""SELECT kind, {_STATUS.replace('content_kind', 'content_kind')} AS status, count(*) AS n FROM (SELECT *, CASE WHEN coalesce(url,'') = '' THEN 'none' WHEN contains(url, 'doi') THEN 'academic' WHEN contains(url, '-wx.') THEN 'weixin' WHEN contains(url, '-gov.') THEN 'gov' ELSE 'html' END AS kind FROM kb) GROUP BY ALL""")
def url_kinds(spark: SparkSession, d: str) -> DataFrame:
    u = F.coalesce("url", F.lit(""))
    kind = F.when(u == "", "none").when(u.contains("doi"), "academic").when(u.contains("-wx."), "weixin").when(u.contains("-gov."), "gov").otherwise("html")
    return _covered(spark, d).groupBy(kind.alias("kind"), "status").agg(F.count("*").alias("n"))


_TOK = r"list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(lower({0}), '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term")
def token_frequencies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(fields.tokens(F.col("text"))).alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query(f"SELECT term, count(DISTINCT s) AS n_shards, min(s) AS first_shard, max(s) AS last_shard FROM (SELECT doc_id // 100 AS s, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term")
def term_shards(spark: SparkSession, d: str) -> DataFrame:
    return facets.term_shards(table(spark, d, "documents").where("text is not null"), "doc_id", fields.tokens(F.col("text")), 100)


def _sentences_sql(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace({c}, '[\\s\\x{{3000}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{1680}}\\x{{85}}\\x{{b}}\\x{{1c}}-\\x{{1f}}]+', '', 'g'), '([。！？；])', '\\1\x07', 'g'), '\x07'), lambda s: length(s) >= 4)"


@query(f"SELECT doc_id, len(s) AS n, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS chars FROM (SELECT doc_id, {_sentences_sql('text')} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = fields.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).cast("long").alias("n"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query()
def chunked(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.posexplode(fields.chunks(F.coalesce("text", F.lit("")))).alias("p", "chunk"))
    return x.select("doc_id", "p", F.length("chunk").alias("chars"), F.substring(F.sha1("chunk"), 1, 12).alias("digest"))


@query()
def summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fields.make_summary(F.col("text")).alias("summary"))


def _index(spark: SparkSession, d: str) -> retrieval.Index:
    """Contents, or summaries where there is none, in chunks of the usual size; words stay apart."""
    return retrieval.Index.build(table(spark, d, "kb").select("seq", "content", "summary"), "seq", F.coalesce(F.nullif("content", F.lit("")), "summary"), cjk=False)


def _chunks(spark: SparkSession, d: str) -> retrieval.Index:
    """Titles and summaries as one chunk each, as the SQL has it."""
    k = table(spark, d, "kb").select("seq", "title", "summary")
    text = F.concat_ws(" ", F.col("title"), F.col("summary"))
    c = k.select((F.col("seq") * 100000).alias("chunk_id"), "seq", text.alias("text"), F.length(text).alias("dl"))
    return retrieval.Index(c, retrieval.postings(c))


def _terms() -> list[str]:
    out = []
    for w in V.QUESTION:
        out += [w] if w.isascii() else [w[i : i + 2] for i in range(max(1, len(w) - 1))]
    return out


_IN = ", ".join(_sql(t) for t in dict.fromkeys(_terms()))
_INDEX_SQL = f"""c AS (SELECT seq * 100000 AS chunk_id, seq, concat_ws(' ', title, summary) AS text, length(concat_ws(' ', title, summary)) AS dl FROM kb),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, dl, unnest({_TOK.format('text')}) AS term FROM c) GROUP BY ALL), t AS (SELECT count(*) AS n, avg(dl) AS a FROM c), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_BM25 = f"""b AS (SELECT chunk_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))), 6) AS score FROM p JOIN f USING (term), t WHERE term IN ({_IN}) GROUP BY chunk_id HAVING score > 0 ORDER BY score DESC, chunk_id DESC LIMIT 200)"""
_QW = "CASE " + " ".join(f"WHEN term = {_sql(t)} THEN {1.0 if _terms().count(t) == 1 else '1 + ln(' + str(float(_terms().count(t))) + ')'}::DOUBLE" for t in dict.fromkeys(_terms())) + " ELSE 0.0 END"
_TFIDF = f"""w AS (SELECT chunk_id, term, (1 + ln(tf::DOUBLE)) * (ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) + 1) AS w, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) + 1 AS idf FROM p JOIN f USING (term), t WHERE chunk_id IN (SELECT chunk_id FROM p WHERE term IN ({_IN}))),
qn AS (SELECT sqrt(sum(x * x)) AS qn FROM (SELECT ({_QW}) * (ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) + 1) AS x FROM f, t WHERE term IN ({_IN}))),
v AS (SELECT chunk_id, round(dot / (norm * qn), 6) AS score FROM (SELECT chunk_id, sum(w * ({_QW}) * idf) AS dot, sqrt(sum(w * w)) AS norm FROM w GROUP BY chunk_id), qn WHERE dot > 0 ORDER BY score DESC, chunk_id DESC LIMIT 200)"""


@query(f"WITH {_INDEX_SQL}, {_BM25} SELECT chunk_id, score FROM b")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_chunks(spark, d), list(dict.fromkeys(_terms())))


@query(f"WITH {_INDEX_SQL}, {_TFIDF} SELECT chunk_id, score FROM v")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.tfidf(_chunks(spark, d), _terms())


_FUSED = "r AS (SELECT chunk_id, round(sum(x), 8) AS rrf FROM (SELECT chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk_id DESC)) AS x FROM b UNION ALL SELECT chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk_id DESC)) FROM v) GROUP BY chunk_id)"


@query(f"WITH {_INDEX_SQL}, {_BM25}, {_TFIDF}, {_FUSED} SELECT chunk_id, kb.seq, round(rrf * CASE WHEN department = '水利' THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM r JOIN kb ON kb.seq * 100000 = chunk_id WHERE quality IN ('A', 'B') ORDER BY score DESC, chunk_id DESC LIMIT 12")
def rrf_search(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "department", "quality")
    return retrieval.search(_chunks(spark, d), k, _terms(), F.col("quality").isin("A", "B"), F.when(F.col("department") == "水利", 1.6).otherwise(1.0), 12)


@query()
def bm25_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_index(spark, d), list(dict.fromkeys(_terms())))


@query()
def tfidf_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.tfidf(_index(spark, d), _terms())


@query()
def rrf_chunks(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "department", "quality")
    return retrieval.search(_index(spark, d), k, _terms(), F.col("quality").isin("A", "B"), F.when(F.col("department") == "水利", 1.6).otherwise(1.0), 12)


@query()
def ask_sentences(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    hits = retrieval.search(index, kb(spark, d, "quality"), _terms(), F.lit(True), F.lit(1.0), 6)
    return retrieval.answer(index, hits, _terms(), cjk=False)


@query()
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a report: hits by department, points, references."""
    index = _index(spark, d)
    hits = retrieval.search(index, kb(spark, d, "quality"), _terms(), F.lit(True), F.lit(1.0), 12)
    return retrieval.report(index, hits, table(spark, d, "kb"), _terms(), cjk=False)


@query(f"SELECT count(*) AS records, count_if(content_fetched) AS fetched, count_if(coalesce(content, '') <> '') AS with_content, sum(length(content))::BIGINT AS chars FROM kb")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "content_fetched", "content").agg(F.count("*").alias("records"), F.count_if("content_fetched").alias("fetched"), F.count_if(F.coalesce("content", F.lit("")) != "").alias("with_content"), F.sum(F.length("content")).cast("long").alias("chars"))


_VOC = [(t, n) for t, ns in V.ENTITIES.items() for n in ns]
_TEXT = "concat_ws(chr(10), title, summary, content)"
_ENT = f"e AS ({' UNION ALL '.join(f'SELECT seq AS file, {_sql(t)} AS type, {_sql(n)} AS name FROM x WHERE contains(b, {_sql(n)})' for t, n in _VOC)})"
_NODES = "n AS (SELECT type || '_' || substr(sha1(name), 1, 10) AS id, type, name, count(DISTINCT file) AS cnt FROM e GROUP BY type, name HAVING count(DISTINCT file) >= 2)"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities(kb(spark, d, "title", "summary", "content"), "seq", F.concat_ws("\n", "title", "summary", "content"), V.ENTITIES)


@query(f"WITH x AS (SELECT seq, {_TEXT} AS b FROM kb), {_ENT}, {_NODES} SELECT * FROM n")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_entities(spark, d))


@query(f"WITH x AS (SELECT seq, {_TEXT} AS b FROM kb), {_ENT}, {_NODES}, k AS (SELECT file, id FROM e JOIN n USING (type, name)) SELECT a.id AS s, b.id AS t, count(*) AS w FROM k a JOIN k b ON a.file = b.file AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 2")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_entities(spark, d))


_CORE = r"trim(regexp_replace(regexp_replace(title, '[（(].*?[)）]', '', 'g'), '^(关于|20\d\d年)', ''))"


@query(f"WITH t AS (SELECT DISTINCT title FROM kb WHERE length(title) >= 4), c AS (SELECT DISTINCT title, {_CORE} AS core FROM t) SELECT c.title, count(*) AS n FROM c JOIN t ON contains(t.title, c.core) AND t.title <> c.title WHERE length(core) >= 4 GROUP BY c.title")
def title_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Titles whose core (remarks in brackets and common beginnings left out) stands in other titles, and in how many."""
    return graph.title_mentions(kb(spark, d, "title"), "title", [r"[（(].*?[)）]", r"^(关于|20\d\d年)"])


@query("SELECT s.name AS core, count(DISTINCT k.title) AS n FROM (SELECT DISTINCT name FROM sites WHERE name <> '') s JOIN (SELECT title FROM kb UNION ALL SELECT content AS title FROM kb) k ON contains(k.title, s.name) AND k.title <> s.name GROUP BY s.name")
def text_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Like title_mentions, over titles and contents of every length and all names."""
    k = table(spark, d, "kb")
    return graph.mentions(k.select("title").unionByName(k.select(F.col("content").alias("title"))), table(spark, d, "sites").select(F.col("name").alias("core")))


@query(f"""WITH x AS (SELECT seq, lower({_TEXT}) AS b FROM kb), c AS ({' UNION ALL '.join(f"SELECT seq, {i} AS o, {_sql(n)} AS term, CAST((length(b) - length(replace(b, {_sql(n)}, ''))) / {len(n)} AS INT) AS n FROM x" for i, (_, n) in enumerate(_VOC))}),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY n DESC, length(term) DESC, o) AS rank FROM c WHERE n > 0) SELECT seq, term, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def kg_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.ranked_terms(kb(spark, d, "title", "summary", "content"), "seq", F.concat_ws("\n", "title", "summary", "content"), [n for _, n in _VOC], most=5)


@query("SELECT unit, start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest(['day','week','month','quarter','year']) AS unit, unnest([date_trunc('day', ts)::DATE, date_trunc('week', ts)::DATE, date_trunc('month', ts)::DATE, date_trunc('quarter', ts)::DATE, date_trunc('year', ts)::DATE]) AS start FROM events) GROUP BY ALL")
def brief_buckets(spark: SparkSession, d: str) -> DataFrame:
    return digest.briefs(table(spark, d, "events"), "ts").groupBy("unit", "start", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_6h(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(table(spark, d, "events"), "ts", "event_type", "6 hours")


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \t\n\r]+'), ' ') AS words FROM documents WHERE regexp_matches(text, '[^ \t\n\r]')")
def abstract_deinvert(spark: SparkSession, d: str) -> DataFrame:
    """Texts inverted to word -> positions and put together again."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))).alias("p", "w"))
    m = w.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return m.select("doc_id", fields.deinvert(F.col("m")).alias("words"))


@query(f"SELECT doc_id, {_hits('lower(coalesce(text, ' + chr(39) * 2 + '))', V.CORE)} AS core, length(text) AS chars FROM documents")
def document_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lexicon.distinct_hits(F.col("text"), V.CORE).alias("core"), F.length("text").cast("long").alias("chars"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")
