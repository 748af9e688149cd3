"""Queries on records (kb, inbox): fields, labels, scores, merging. Each stands beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.functions import fields
from weirstone.operators import digest, facets, lexicon, matching, merge, scoring
from weirstone.queries import vocabulary as V
from weirstone.sources.tables import table

# Fixed value: the class of TITLE_MARKS for RE2, where white space beyond ASCII must be named.
MARKS = r"""[\s\x{3000}\x{a0}\x{85}\x{1680}\x{1c}-\x{1f}\x{b}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}《》〈〉【】\[\]()（）"''“”‘’·、,，。.：:;；!！?？—\-_/\\]+"""
TITLE_SQL = f"lower(regexp_replace(title, '{MARKS}', '', 'g'))"
_Q = "'"


def _sql(s: str) -> str:
    return _Q + s.replace(_Q, _Q * 2) + _Q


def _hits(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({text}, {_sql(t)}) THEN 1 ELSE 0 END)" for t in terms) + ")"


def _count(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST((length({text}) - length(replace({text}, {_sql(t)}, ''))) / {len(t)} AS INT)" for t in terms) + ")"


def _case(text: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_sql(p)}) THEN {_sql(v)}" for p, v in rules) + f" ELSE {other} END"


def kb(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "kb").select("seq", *cols)


def _body() -> Column:
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "content")])


BODY_SQL = "(coalesce(title,'') || chr(10) || coalesce(summary,'') || chr(10) || coalesce(content,''))"
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT seq, CASE WHEN region IN ('全国(部委)','部委') THEN '全国' WHEN region = '其他省市' THEN '其他' ELSE region END AS region,
CASE WHEN department IN ({", ".join(map(_sql, V.DEPARTMENTS))}) THEN department ELSE '其他' END AS department,
lower(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '')) AS url_key, regexp_replace(trim(url), '[?#].*$', '') AS url_page,
lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, {TITLE_SQL} AS title_key FROM kb""")
def normalize_fields(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "region", "department", "url", "title").select("seq", fields.remap(F.col("region"), V.REGIONS).alias("region"), fields.clamp(F.col("department"), V.DEPARTMENTS, "其他").alias("department"), fields.url_key(F.col("url")).alias("url_key"), fields.url_page(F.col("url")).alias("url_page"), fields.host(F.col("url")).alias("host"), fields.title_key(F.col("title")).alias("title_key"))


@query(f"""SELECT seq, 'ti:' || substr(sha1({TITLE_SQL}), 1, 16) AS ev,
substr(sha1(CASE WHEN lower(trim(coalesce(url,''))) <> '' THEN lower(trim(url)) ELSE coalesce(title,'') || '|' || coalesce(date,'') END), 1, 16) AS rid FROM kb""")
def event_keys(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "url", "title", "date").select("seq", fields.event_key(F.col("title")).alias("ev"), fields.record_id(F.col("url"), F.col("title"), F.col("date")).alias("rid"))


@query(r"""SELECT seq, regexp_replace(url, '^(?:https?://(?:dx\.)?doi\.(?:org|example)/)+(https?://(?:dx\.)?doi\.(?:org|example)/)', '\1') AS url,
regexp_replace(regexp_extract(url, '(10\.\d{4,9}/[^\s?#]+)', 1), '\.+$', '') AS doi FROM kb WHERE contains(url, 'doi')""")
def doi_repair(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "url").where(F.col("url").contains("doi")).select("seq", fields.repair_doi(F.col("url")).alias("url"), fields.bare_doi(F.col("url")).alias("doi"))


@query(r"""SELECT seq, coalesce(CASE WHEN regexp_extract(url, 't((?:19|20)\d{6})', 1) <> '' THEN substr(regexp_extract(url, 't((?:19|20)\d{6})', 1), 1, 4) || '-' || substr(regexp_extract(url, 't((?:19|20)\d{6})', 1), 5, 2) || '-' || substr(regexp_extract(url, 't((?:19|20)\d{6})', 1), 7, 2) END,
CASE WHEN regexp_matches(url, '/((?:19|20)\d\d)-?(0[1-9]|1[0-2])/') THEN regexp_extract(url, '/((?:19|20)\d\d)-?(0[1-9]|1[0-2])/', 1) || '-' || regexp_extract(url, '/((?:19|20)\d\d)-?(0[1-9]|1[0-2])/', 2) || '-01' END,
CASE WHEN regexp_matches(url, '/((?:19|20)\d\d)/') THEN regexp_extract(url, '/((?:19|20)\d\d)/', 1) || '-01-01' END) AS day FROM kb""")
def url_dates(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "url").select("seq", fields.date_of_path(F.col("url")).alias("day"))


@query(f"SELECT min(seq) AS seq FROM kb GROUP BY {TITLE_SQL}")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.keep_first(kb(spark, d, "title"), [fields.title_key(F.col("title"))], "seq").select("seq")


@query(f"""SELECT seq, {_hits("lower(coalesce(title,''))", V.CORE)} AS title_hits, {_hits("lower(coalesce(summary,''))", V.CORE)} AS summary_hits,
least({_hits("lower(" + BODY_SQL + ")", V.CORE)}, 3) AS core_hits,
({_hits("lower(coalesce(title,''))", V.CORE)} > 0 OR {_hits("lower(coalesce(summary,''))", V.CORE)} >= 2) AS relevant FROM kb""")
def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    t, s = F.col("title"), F.col("summary")
    return kb(spark, d, "title", "summary", "content").select("seq", lexicon.distinct_hits(t, V.CORE).alias("title_hits"), lexicon.distinct_hits(s, V.CORE).alias("summary_hits"), F.least(lexicon.distinct_hits(_body(), V.CORE), F.lit(3)).alias("core_hits"), lexicon.relevant(t, s, V.CORE).alias("relevant"))


_RAW = f"({_count('lower(' + BODY_SQL + ')', V.CORE)} + {_count('lower(' + BODY_SQL + ')', V.SUPPORT)} * 0.4::DOUBLE)"
_REL = f"(CASE WHEN {_hits('lower(coalesce(title,' + _Q * 2 + '))', V.CORE)} > 0 THEN 1.0::DOUBLE WHEN {_RAW} >= 4 THEN 1.0 WHEN {_RAW} <= 0 THEN 0.3 ELSE round(0.3::DOUBLE + 0.7::DOUBLE * {_RAW} / 4, 2) END)"


def _relevance() -> Column:
    return scoring.relevance(F.col("title"), _body(), V.CORE, V.SUPPORT)


@query(f"SELECT seq, {_REL} AS rel FROM kb")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title", "summary", "content").select("seq", _relevance().alias("rel"))


@query("""SELECT seq, CASE least((CASE quality WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END) + (CASE WHEN water_rel < 0.35 THEN 2 WHEN water_rel < 0.6 THEN 1 ELSE 0 END), 2) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS quality FROM kb""")
def quality_downgrade(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "quality", "water_rel").select("seq", scoring.downgraded(F.col("quality"), F.col("water_rel")).alias("quality"))


_DAYS = f"date_diff('day', try_cast(CASE WHEN regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN date END AS DATE), DATE '{V.AS_OF}')"
_TIMELY = f"(CASE WHEN {_DAYS} <= 365 THEN 2 WHEN {_DAYS} <= 730 THEN 1 ELSE 0 END)"


@query(f"""SELECT seq, {_TIMELY} AS timely, round((1.5::DOUBLE + (CASE quality WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END) * 0.7::DOUBLE + {_TIMELY}) * (coalesce(water_rel, 0.3::DOUBLE) * 0.6::DOUBLE + 0.4::DOUBLE), 2) AS importance FROM kb""")
def timeliness_importance(spark: SparkSession, d: str) -> DataFrame:
    timely = scoring.timeliness(F.col("date"), V.AS_OF)
    return kb(spark, d, "date", "quality", "water_rel").select("seq", timely.alias("timely"), scoring.importance(F.lit(1.5), F.col("quality"), timely, F.coalesce("water_rel", F.lit(0.3))).alias("importance"))


@query(f"SELECT label, count(*) AS n FROM (SELECT {_case('coalesce(title,' + _Q * 2 + ')', V.CLASSES, _sql('other'))} AS label FROM kb) GROUP BY label")
def cascade_classes(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title").groupBy(lexicon.cascade(F.col("title"), V.CLASSES, "other").alias("label")).agg(F.count("*").alias("n"))


@query(f"""SELECT old, new, count(*) AS n FROM (SELECT category AS old, {_case("coalesce(title,'')", V.CLASSES, "'other'")} AS new FROM kb) WHERE old IS DISTINCT FROM new GROUP BY old, new""")
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    return facets.changes(kb(spark, d, "category", "title"), F.col("category"), lexicon.cascade(F.col("title"), V.CLASSES, "other"))


_LOWBODY = f"lower({BODY_SQL})"


@query(
    f"WITH s AS (SELECT seq, {', '.join(_count('b', t) + f' AS c{i}' for i, t in enumerate(V.LABELS.values()))} FROM (SELECT seq, {_LOWBODY} AS b FROM kb)) SELECT seq, CASE WHEN greatest(c0,c1,c2,c3) = 0 THEN 'none' "
    + " ".join(f"WHEN c{i} = greatest(c0,c1,c2,c3) THEN {_sql(k)}" for i, k in enumerate(V.LABELS))
    + " END AS label FROM s"
)
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title", "summary", "content").select("seq", lexicon.best_label(_body(), V.LABELS, "none").alias("label"))


def _topic_sql() -> str:
    parts = []
    for i, (k, (core, weak)) in enumerate(V.TOPICS.items()):
        parts.append(f"SELECT seq, {i} AS o, {_sql(k)} AS topic, {_hits('t', core)} AS th, round({_hits('t', core)} * 5 + {_hits('t', weak)} * 2 + {_hits('s', core)} * 2 + {_hits('s', weak)} + {_hits('c', core)} + {_hits('c', weak)} * 0.2::DOUBLE, 4) AS score FROM k")
    return f"WITH k AS (SELECT seq, lower(coalesce(title,'')) AS t, lower(coalesce(summary,'')) AS s, lower(coalesce(content,'')) AS c FROM kb), x AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, th DESC, o) AS rank FROM x WHERE th > 0 OR score >= 3) SELECT seq, topic, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"


@query(_topic_sql())
def topic_top3(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.top_topics(kb(spark, d, "title", "summary", "content"), "seq", "title", "summary", "content", V.TOPICS)


@query("SELECT seq, coalesce(" + ", ".join(f"nullif(regexp_extract(title, {_sql(p)}), '')" for p in V.DOC_NO) + ") AS doc_no FROM kb")
def doc_numbers(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title").select("seq", fields.first_match(F.col("title"), V.DOC_NO).alias("doc_no"))


@query(" UNION ALL ".join(f"SELECT seq, {_sql(k)} AS label FROM kb WHERE {_hits('lower(' + BODY_SQL + ')', [t.lower() for t in terms])} > 0" for k, terms in V.PLACES.items()))
def place_labels(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.labels(kb(spark, d, "title", "summary", "content"), "seq", _body(), {k: [t.lower() for t in v] for k, v in V.PLACES.items()})


@query(f"""SELECT seq, {_case("coalesce(title,'')", V.STATUS, "coalesce(status, '有效')")} AS status FROM kb""")
def status_inferred(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title", "status").select("seq", F.coalesce(lexicon.cascade(F.col("title"), V.STATUS, None), "status", F.lit("有效")).alias("status"))


_CLEN = "length(coalesce(content,''))"


def _guard_sql() -> str:
    marks = " ".join(f"WHEN contains(coalesce(content,''), {_sql(m)}) THEN {_sql(kind + ':' + m)}" for kind, ms in (("error_page", V.ERROR_MARKS), ("risk_page", V.RISK_MARKS)) for m in ms)
    return f"""WITH p AS (SELECT seq, title, coalesce(content,'') AS content, list_filter(regexp_extract_all(lower(title), '[a-z0-9\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: length(r) >= 2) AS runs FROM kb),
q AS (SELECT *, list_slice(list_distinct_ordered, 1, 24) AS parts FROM (SELECT *, list_filter(f, lambda e, i: list_position(f, e) = i) AS list_distinct_ordered FROM (SELECT *, flatten(list_transform(runs, lambda r: CASE WHEN length(r) < 6 THEN [r] ELSE list_concat([r], list_transform(range(1, length(r) - 1, 3), lambda i: substr(r, i, 3))) END)) AS f FROM p)))
SELECT seq, CASE WHEN regexp_replace(content, '\\s+', '', 'g') = '' THEN 'empty' {marks.replace("coalesce(content,'')", "content")} WHEN length(content) < 200 THEN 'too_short:' || length(content)
WHEN regexp_matches(title, '[\\x{{4e00}}-\\x{{9fff}}]') AND length(regexp_replace(content, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / length(content) < 0.25 THEN 'not_chinese'
WHEN len(parts) > 0 AND len(list_filter(parts, lambda p: contains(lower(content), p))) / len(parts) < 0.34 THEN 'title_mismatch' ELSE 'ok' END AS validity FROM q"""


@query(_guard_sql())
def content_validity(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title", "content").select("seq", scoring.validity(F.col("title"), F.col("content"), V.ERROR_MARKS, V.RISK_MARKS, 200).alias("validity"))


@query("SELECT seq, n AS articles, (n >= 5 AND length(content) >= 300) AS complete FROM (SELECT seq, content, len(list_distinct(regexp_extract_all(coalesce(content,''), '[0-9]+\\.[0-9]+'))) AS n FROM kb)")
def articles_complete(spark: SparkSession, d: str) -> DataFrame:
    n = scoring.articles(F.col("content"), r"[0-9]+\.[0-9]+")
    return kb(spark, d, "content").select("seq", n.cast("long").alias("articles"), ((n >= 5) & (F.length("content") >= 300)).alias("complete"))


@query()
def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge(kb(spark, d, "url", "title", "quality", "_ev"), table(spark, d, "inbox").select("seq", "url", "title", "quality"))


@query(f"""WITH k AS (SELECT seq, {TITLE_SQL} AS ev, CASE quality WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END AS q FROM inbox),
r AS (SELECT *, max(q) OVER (PARTITION BY ev ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k) SELECT seq, ev, q FROM r WHERE b IS NULL OR q > b""")
def running_quality(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("quality") == "A", 3).when(F.col("quality") == "B", 2).otherwise(1)
    x = table(spark, d, "inbox").select("seq", fields.title_key(F.col("title")).alias("ev"), q.alias("q"))
    return facets.running_best(x, "ev", "seq", "q")


@query("""WITH n AS (SELECT seq, url, row_number() OVER () AS r FROM inbox) SELECT i.seq FROM inbox i WHERE NOT EXISTS (SELECT 1 FROM kb WHERE kb.url = i.url)""")
def unseen_addresses(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "kb").where("url is not null").select("url").distinct()
    return table(spark, d, "inbox").select("seq", "url").join(seen, "url", "left_anti").select("seq")


@query("""WITH s AS (SELECT code, lower(regexp_replace(name, '""" + MARKS + """', '', 'g')) AS nk FROM std_index WHERE code IS NOT NULL), r AS (SELECT seq, doc_no, """ + TITLE_SQL + """ AS tk FROM kb),
m AS (SELECT seq, code, 1 AS p, 'code' AS how, length(nk) AS len FROM r JOIN s ON doc_no = code UNION ALL SELECT seq, code, 2, 'name', length(nk) FROM r JOIN s ON tk = nk AND tk <> ''
UNION ALL SELECT seq, code, 3, 'part', length(nk) FROM r JOIN s ON tk <> nk AND length(tk) >= 8 AND length(nk) >= 8 AND (contains(tk, nk) OR contains(nk, tk)))
SELECT seq, code, how FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY p, len, code) AS r FROM m) WHERE r = 1""")
def std_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_standards(kb(spark, d, "doc_no", "title"), table(spark, d, "std_index"))


@query("SELECT seq, array_to_string(tags, ',') AS tags, len(tags) AS n FROM (SELECT seq, list_filter(u, lambda x, i: list_position(u, x) = i) AS tags FROM (SELECT seq, list_concat(coalesce(tags, []), coalesce(kg_terms, [])) AS u FROM kb))")
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    u = F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("kg_terms", none)))
    return kb(spark, d, "tags", "kg_terms").select("seq", F.array_join(u, ",").alias("tags"), F.size(u).cast("long").alias("n"))


@query("""SELECT seq, quality, follower, read FROM (SELECT seq, quality, metrics.follower AS follower, metrics.read AS read, water_rel FROM kb) WHERE water_rel >= 0.6 AND (read >= 500 OR follower >= 1000)""")
def metric_filter(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "quality", "metrics", "water_rel").where("water_rel >= 0.6 and (metrics.read >= 500 or metrics.follower >= 1000)").select("seq", "quality", "metrics.follower", "metrics.read")


@query("SELECT seq, must_rank, importance FROM kb WHERE coalesce(content, '') = '' ORDER BY coalesce(must_rank, 999), importance DESC, seq LIMIT 50")
def backfill_priority(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "must_rank", "importance", "content").where(F.coalesce("content", F.lit("")) == "").orderBy(F.coalesce("must_rank", F.lit(999)), F.desc("importance"), "seq").limit(50).select("seq", "must_rank", "importance")


@query("""WITH k AS (SELECT seq, coalesce(length(content), 0) AS size, coalesce(importance, 0) >= 5 AS core, coalesce(summary, '') <> '' AS fit FROM kb),
r AS (SELECT *, coalesce(sum(CASE WHEN fit THEN size ELSE 0 END) OVER (ORDER BY core, size DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(size) OVER () AS total FROM k)
SELECT seq, size, fit AND run < total - 300000 AS removed FROM r""")
def budget_removed(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "content", "importance", "summary")
    x = k.select("seq", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size"), (F.coalesce("importance", F.lit(0.0)) >= 5).alias("core"), (F.coalesce("summary", F.lit("")) != "").alias("fit"))
    return facets.budget_cut(x, "size", [F.col("core"), F.desc("size"), F.col("seq")], 300_000, F.col("fit")).select("seq", "size", "removed")


@query("""WITH k AS (SELECT source, seq, quality FROM kb), n AS (SELECT *, CASE WHEN lag(quality) OVER (PARTITION BY source ORDER BY seq) IS NOT DISTINCT FROM quality AND lag(seq) OVER (PARTITION BY source ORDER BY seq) IS NOT NULL THEN 0 ELSE 1 END AS b FROM k),
g AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY seq) AS segment FROM n) SELECT source, CAST(segment AS BIGINT) AS segment, min(quality) AS label, min(seq) AS first, max(seq) AS last, count(*) AS n FROM g GROUP BY source, segment""")
def quality_segments(spark: SparkSession, d: str) -> DataFrame:
    return facets.segments(kb(spark, d, "source", "quality"), "source", "seq", "quality")


@query("""SELECT seq, source, rank FROM (SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY importance DESC, seq) AS rank FROM kb) WHERE rank <= 3""")
def best_per_source(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.first_per_group(kb(spark, d, "source", "importance"), "source", [F.desc("importance"), F.col("seq")], 3).select("seq", "source", "rank")


_BUCKET_RAW = "coalesce(nullif(added_at, ''), date)"
_DAY = f"try_cast(CASE WHEN regexp_matches({_BUCKET_RAW}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {_BUCKET_RAW} END AS DATE)"


@query(f"SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN {_DAY} IS NULL THEN 'unknown' WHEN {_DAY} >= DATE '{V.AS_OF}' - 180 THEN {_BUCKET_RAW} ELSE substr({_BUCKET_RAW}, 1, 4) END AS bucket FROM kb) GROUP BY bucket")
def push_buckets(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "added_at", "date").groupBy(digest.push_bucket(F.col("added_at"), F.col("date"), V.AS_OF).alias("bucket")).agg(F.count("*").alias("n"))


_WIN = "CASE WHEN n IS NULL THEN 'unknown' " + " ".join(f"WHEN n <= {x} THEN '{x}d'" for x in (7, 30, 90, 180, 365, 1095)) + " ELSE 'older' END"


@query(f"SELECT win, count(*) AS n FROM (SELECT {_WIN} AS win FROM (SELECT {_DAYS} AS n FROM kb)) GROUP BY win")
def time_windows(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "date").groupBy(digest.window_of(F.col("date"), V.AS_OF).alias("win")).agg(F.count("*").alias("n"))


@query("SELECT date AS day, n, lag(date) OVER (ORDER BY date) AS before, lead(date) OVER (ORDER BY date) AS after FROM (SELECT date, count(*) AS n FROM kb WHERE regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') GROUP BY date)")
def day_pager(spark: SparkSession, d: str) -> DataFrame:
    return digest.pager(kb(spark, d, "date").where(F.col("date").rlike(digest.ISO)), "date")


@query("""SELECT seq, CAST(row_number() OVER (ORDER BY date DESC, CASE department WHEN '生态环境' THEN 0 WHEN '水利' THEN 1 ELSE 2 END, seq) AS INT) AS place FROM kb WHERE date >= '2024-01-01' AND regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') ORDER BY date DESC, CASE department WHEN '生态环境' THEN 0 WHEN '水利' THEN 1 ELSE 2 END, seq LIMIT 100""")
def digest_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    p = F.when(F.col("department") == "生态环境", 0).when(F.col("department") == "水利", 1).otherwise(2)
    order = [F.desc("date"), p, F.col("seq")]
    top = kb(spark, d, "date", "department").where((F.col("date") >= "2024-01-01") & F.col("date").rlike(digest.ISO)).orderBy(*order).limit(100)
    return top.select("seq", F.row_number().over(Window.orderBy(*order)).alias("place"))
