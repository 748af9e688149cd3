"""Queries on labels, clean-up of fields, markup and record sets, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirstone.functions import fields
from weirstone.operators import annotate as A
from weirstone.operators import digest, facets, graph, html, joins, lexicon, retrieval, scoring
from weirstone.queries import vocabulary as V
from weirstone.queries.records import _sql, kb
from weirstone.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL text of rules.
_SPACE = r"\s\x{3000}\x{a0}\x{85}\x{1680}\x{1c}-\x{1f}\x{b}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
_WS = f"[{_SPACE}]"
T, S, C, U = ("coalesce(title,'')", "coalesce(summary,'')", "coalesce(content,'')", "coalesce(url,'')")


def _any(text: str, terms: list[str]) -> str:
    return "(" + (" OR ".join(f"contains({text}, {_sql(t)})" for t in terms) or "false") + ")"


def _in(x: str, values: list[str]) -> str:
    return f"({x} IN ({', '.join(map(_sql, values))}))" if values else "false"


def _when(parts: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in parts) + f" ELSE {other} END"


def _groups(text: str, groups: dict[str, list[str]], other: str) -> str:
    return _when([(_any(text, ts), _sql(k)) for k, ts in groups.items()], other)


def _rules(text: str, rules: list[tuple[str, str]], other: str) -> str:
    return _when([(f"regexp_matches({text}, {_sql(p)})", _sql(k)) for k, p in rules], other)


def _word(text: str, term: str) -> str:
    return f"regexp_matches({text}, {_sql(A.word_pattern(term))})"


# Clean-up of fields.


@query(f"""SELECT seq, regexp_replace({T}, '{_WS}+', '', 'g') AS unspaced, regexp_replace({T}, '[{_SPACE}《》（）()【】\\[\\]]', '', 'g') AS unbracketed, regexp_replace({T}, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]+', '', 'g') AS letters FROM kb""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return kb(spark, d, "title").select("seq", fields.title_unspaced(t).alias("unspaced"), fields.title_unbracketed(t).alias("unbracketed"), fields.title_letters(t).alias("letters"))


_NAME = f"regexp_replace(regexp_replace(regexp_replace(split_part(regexp_replace(coalesce(name,''), '代替|替代', chr(7)), chr(7), 1), '{_WS}+', ' ', 'g'), '^[ 《》]+', ''), '[ 《》]+$', '')"
_PICKED = f"regexp_replace(regexp_replace(translate(regexp_extract(n, {_sql(V.DASHED_CODE)}), '－—–', '---'), '{_WS}+', '', 'g'), '^({V.CODE_PREFIX})([0-9])', '\\1 \\2')"


@query(f"""WITH x AS (SELECT code AS raw, coalesce(code,'') || '  ' || coalesce(name,'') || ' 代替 GB 1-1990' AS name FROM std_index), y AS (SELECT raw, {_NAME} AS n FROM x)
SELECT raw, n AS name, {_PICKED} AS code, {_rules("raw", [("national", "^GB|^ZLB"), ("sector", "^HJ|^SL|^XT"), ("local", "^DB")], "'sector'")} AS level FROM y""")
def standard_codes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "std_index").select(F.col("code").alias("raw"), F.concat(F.coalesce("code", F.lit("")), F.lit("  "), F.coalesce("name", F.lit("")), F.lit(" 代替 GB 1-1990")).alias("name"))
    level = A.first_rule(F.col("raw"), [("national", "^GB|^ZLB"), ("sector", "^HJ|^SL|^XT"), ("local", "^DB")], F.lit("sector"))
    return x.select("raw", fields.standard_title(F.col("name")).alias("name"), fields.standard_code(F.col("name"), V.DASHED_CODE, V.CODE_PREFIX).alias("code"), level.alias("level"))


@query(f"""WITH a AS (SELECT seq, title, regexp_extract({T}, '《([^》]{{4,60}})》', 1) AS named, regexp_replace(regexp_replace({T}, {_sql(V.NEWS)}, '', 'g'), '[（(【\\[].*?[)）】\\]]', '', 'g') AS t FROM kb),
b AS (SELECT *, regexp_replace(regexp_replace(t, '({V.NEWS_ENDINGS})$', ''), '^.{{0,12}}?[：:·｜|]{_WS}*', '') AS u FROM a)
SELECT seq, CASE WHEN named <> '' THEN named ELSE substr(regexp_replace(u, '[{_SPACE}“”"''《》]+', '', 'g'), 1, 60) END AS query, regexp_matches({T}, {_sql(V.NEWS)}) AS news FROM b""")
def document_queries(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title").select("seq", fields.document_query(F.col("title"), V.NEWS, V.NEWS_ENDINGS).alias("query"), F.coalesce("title", F.lit("")).rlike(V.NEWS).alias("news"))


@query(f"""WITH a AS (SELECT seq, list_filter(list_transform(coalesce(kg_terms, []), lambda x: trim(x)), lambda x: length(x) > 1 AND NOT regexp_matches(x, {_sql(V.KG_NOISE)}) AND NOT regexp_matches(x, '^[A-Za-z][A-Za-z\\s\\-&/]{{2,}}$') AND NOT regexp_matches(x, '^\\d{{4}}$')) AS f FROM kb)
SELECT seq, array_to_string(list_slice(list_filter(f, lambda x, i: list_position(f, x) = i), 1, 14), '|') AS terms FROM a""")
def kg_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "kg_terms").select("seq", F.array_join(fields.cleaned_terms(F.col("kg_terms"), V.KG_NOISE), "|").alias("terms"))


@query("SELECT seq, CASE WHEN added_at = (SELECT max(added_at) FROM kb WHERE regexp_matches(added_at, '^\\d{4}-\\d{2}-\\d{2}$')) AND date < '2024-01-01' THEN date ELSE added_at END AS added_at FROM kb")
def restamped(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "date", "added_at")
    last = k.where(F.col("added_at").rlike(digest.ISO)).agg(F.max("added_at").alias("last"))  # one row
    return k.crossJoin(F.broadcast(last)).select("seq", F.when((F.col("added_at") == F.col("last")) & (F.col("date") < "2024-01-01"), F.col("date")).otherwise(F.col("added_at")).alias("added_at"))


@query(f"SELECT seq, {_when([(f'contains({T}, {_sql(k)})', _sql(v)) for k, v in V.PATCHES.items()], 'content')} AS content FROM kb")
def patched_contents(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "title", "content").select("seq", A.first_group(F.col("title"), {v: [k] for k, v in V.PATCHES.items()}, F.col("content")).alias("content"))


@query("SELECT seq, coalesce(nullif(trim(journal), ''), nullif(trim(source), '')) AS journal FROM kb")
def journal_names(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "journal", "source").select("seq", fields.first_name(F.col("journal"), F.col("source")).alias("journal"))


_SQUEEZED = f"trim(regexp_replace(regexp_replace(regexp_replace(x, '{_WS}+', ' ', 'g'), '^ ', ''), ' $', ''))"


@query(f"""WITH k AS (SELECT seq, {_NAME.replace('name', 'title')} AS t, coalesce(nullif(doc_no, ''), '-') || CASE WHEN coalesce(date,'') <> '' THEN '，' || date || ' 起实施' ELSE '' END AS tail, content_kind, pdf, content, summary FROM kb)
SELECT seq, CASE WHEN content_kind = 'pdf_text' AND coalesce(content,'') <> '' THEN '《' || t || '》全文 ' || length(content) || ' 字（' || tail || '）' WHEN coalesce(pdf,'') <> '' THEN '《' || t || '》原件 ' || pdf || '（' || tail || '）'
WHEN length(content) > 300 THEN '《' || t || '》页面文本 ' || length(content) || ' 字（' || tail || '）' ELSE '《' || t || '》条目（' || tail || '）' END AS summary FROM k""")
def standard_summaries(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "title", "doc_no", "date", "content", "content_kind", "pdf")
    text = F.when(F.col("content_kind") == "pdf_text", F.col("content"))
    s = fields.standard_summary(F.col("title"), F.col("doc_no"), F.col("date"), text, F.col("pdf"), F.col("content"))
    # What follows the colon is the text itself, which the SQL can't clean in the same way.
    return k.select("seq", F.when(F.coalesce(text, F.lit("")) != "", F.regexp_extract(s, r"(?s)^(.*?）)：", 1)).otherwise(s).alias("summary"))


@query("SELECT doc_id, url_encode(substr(text, 1, length(text))) = '' AS blank, url_decode(url_encode(text)) = text AS same FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x{20}-\\x{7e}\\n]*')")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("text").rlike(r"^[\x20-\x7e\n]*$") & ~F.col("text").rlike(r"[^\x20-\x7e\n]"))
    return t.select("doc_id", (F.url_encode("text") == "").alias("blank"), (F.url_decode(F.url_encode("text")) == F.col("text")).alias("same"))


# Markup, made from records: the tables hold none.

_HTML = f"""'<html><head><title>' || {T} || '_某站</title><script>var a = "<p>";</script></head><body><p>' || coalesce(summary,'') || '</p><a href="/art/' || seq || '.html">' || {T} || '</a> <a href="files/' || seq || '.pdf">原文下载</a><img src="/i/' || seq || '.png"></body></html>'"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    t, seq = F.coalesce("title", F.lit("")), F.col("seq").cast("string")
    m = F.concat(F.lit("<html><head><title>"), t, F.lit('_某站</title><script>var a = "<p>";</script></head><body><p>'), F.coalesce("summary", F.lit("")), F.lit('</p><a href="/art/'), seq, F.lit('.html">'), t, F.lit('</a> <a href="files/'), seq, F.lit('.pdf">原文下载</a><img src="/i/'), seq, F.lit('.png"></body></html>'))
    return kb(spark, d, "title", "summary").where(~t.rlike("[<>&_|—∷]") & ~F.coalesce("summary", F.lit("")).rlike("[<>&]")).select("seq", m.alias("markup"), F.lit("http://a.example/list/index.html").alias("base"))


_PLAIN = f"NOT regexp_matches({T}, '[<>&_|—∷]') AND NOT regexp_matches({S}, '[<>&]')"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _run(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}+', ' ', 'g')"




@query(f"SELECT seq, substr({_trim(T)}, 1, 80) AS title FROM kb WHERE {_PLAIN}")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("seq", html.page_title(F.col("markup")).alias("title"))


@query(f"SELECT seq, CASE WHEN length(t) BETWEEN 8 AND 130 THEN 'http://a.example/art/' || seq || '.html' END AS href FROM (SELECT seq, regexp_replace({_trim(T)}, '{_WS}+', ' ', 'g') AS t FROM kb WHERE {_PLAIN})")
def article_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("seq", F.get(html.article_links(F.col("markup"), F.col("base")), F.lit(0))["href"].alias("href"))


@query(f"SELECT seq, 'http://a.example/list/files/' || seq || '.pdf' AS original, 'http://a.example/i/' || seq || '.png' AS image, 'files/' || seq || '.pdf' AS file FROM kb WHERE {_PLAIN}")
def original_links(spark: SparkSession, d: str) -> DataFrame:
    m, b = F.col("markup"), F.col("base")
    return _pages(spark, d).select("seq", html.original_links(m, b, "原文|附件", r"\.pdf$")[0].alias("original"), html.image_links(m, b, "(?i)^data:|logo")[0].alias("image"), html.file_links(m)[0].alias("file"))


@query(f"""WITH r AS (SELECT seq, list_filter([{_trim(_run(S))}, {_trim(_run(T))}, '原文下载'], lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^下载')) AS runs FROM kb WHERE {_PLAIN})
SELECT seq, array_to_string(CASE WHEN len(list_filter(runs, lambda x: length(x) >= 15)) > 0 THEN list_filter(runs, lambda x: length(x) >= 15) ELSE runs END, chr(10)) AS text FROM r""")
def run_texts(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("seq", html.run_text(F.col("markup"), "^下载").alias("text"))


@query(f"SELECT seq, array_to_string(list_filter(list_transform(string_split({S} || chr(10) || {T}, chr(10)), lambda x: {_trim('x')}), lambda x: length(x) >= 12), chr(10)) AS text FROM kb WHERE {_PLAIN}")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace("markup", r"(?s)<title>.*?</title>", "")
    return _pages(spark, d).select("seq", html.page_lines(body).alias("text"))


# Predicates.

_ACADEMIC = f"(regexp_matches(lower({U}), {_sql(V.ACADEMIC_URL)}) OR coalesce(category,'') = 'literature' OR coalesce(content_type,'') = '研究文献')"


def _academic() -> Column:
    return F.lower(F.coalesce("url", F.lit(""))).rlike(V.ACADEMIC_URL) | (F.coalesce("category", F.lit("")) == "literature") | (F.coalesce("content_type", F.lit("")) == "研究文献")


@query(f"""SELECT seq, {_ACADEMIC} AS academic, {_any("lower(coalesce(source,''))", V.ACADEMIC_SOURCES)} AS academic_source, regexp_matches({T} || ' ' || {S}, {_sql(V.PLACES_ABROAD)}) AS china, regexp_matches({U}, {_sql(V.MUST_FETCH)}) AS list_page,
{_word(T, "river")} AS river, {_word(S, "fish passage")} AS passage, ends_with({U}, '.html') AS page FROM kb""")
def record_tests(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "title", "summary", "url", "category", "content_type", "source")
    u, t, s = (F.coalesce(c, F.lit("")) for c in ("url", "title", "summary"))
    return k.select("seq", _academic().alias("academic"), A.any_of(F.lower("source"), V.ACADEMIC_SOURCES).alias("academic_source"), F.concat_ws(" ", t, s).rlike(V.PLACES_ABROAD).alias("china"), u.rlike(V.MUST_FETCH).alias("list_page"), A.has_word(F.col("title"), "river").alias("river"), A.has_word(F.col("summary"), "fish passage").alias("passage"), u.endswith(".html").alias("page"))


@query("""SELECT seq FROM kb WHERE contains(lower(coalesce(title,'') || coalesce(summary,'')), '水') AND category = 'policy' AND quality IN ('A', 'B') AND date >= '2015-01-01' AND date <= '2023-12-31' AND list_contains(coalesce(topic, []), coalesce(topic[1], '')) AND coalesce(status, '') <> '已废止'""")
def portal_filter(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "title", "summary", "category", "quality", "date", "topic", "status")
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    first = F.coalesce(F.get("topic", F.lit(0)), F.lit(""))
    return k.where(text.contains("水") & (F.col("category") == "policy") & F.col("quality").isin("A", "B") & F.col("date").between("2015-01-01", "2023-12-31") & F.array_contains(F.coalesce("topic", F.array().cast("array<string>")), first) & (F.coalesce("status", F.lit("")) != "已废止")).select("seq")


# Classes and labels.

_ACLASS = _rules(f"lower({T} || ' ' || {S})", V.ACADEMIC_CLASSES, "'literature'")
_PCLASS = _rules(T, [(v, p) for p, v in V.CLASSES], "'policy'")


@query(f"SELECT old, new, count(*) AS n FROM (SELECT category AS old, CASE WHEN {_ACADEMIC} THEN {_ACLASS} ELSE {_PCLASS} END AS new FROM kb) WHERE old IS DISTINCT FROM new GROUP BY old, new")
def reclassified_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Papers by the rules for papers, all others by those for policies."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    new = F.when(_academic(), A.first_rule(text, V.ACADEMIC_CLASSES, F.lit("literature"))).otherwise(lexicon.cascade(F.col("title"), V.CLASSES, "policy"))
    return facets.changes(kb(spark, d, "category", "title", "summary", "url", "content_type"), F.col("category"), new)


def _topics_sql() -> str:
    rows = []
    for o, (name, terms) in enumerate(V.TOPIC_TERMS.items()):
        score, head, body = [], ["0"], ["0"]
        for (kind, w), ts in zip(A.WEIGHTS.items(), terms):
            for t in ts:
                at = [_word(p, t) if kind.endswith("_en") else f"contains({p}, {_sql(t)})" for p in "tsc"]
                score += [f"(CASE WHEN {a} THEN {x}::DOUBLE ELSE 0 END)" for a, x in zip(at, w)]
                if kind.startswith("core"):
                    head.append(f"CAST({at[0]} OR {at[1]} AS INT)")
                    body.append(f"CAST({at[2]} AND NOT ({at[0]} OR {at[1]}) AS INT)")
        rows.append(f"SELECT seq, {o} AS o, {_sql(name)} AS topic, round({' + '.join(score)}, 2) AS score, {' + '.join(head)} AS head, {' + '.join(body)} AS body FROM k WHERE given IS NULL")
    given = _when([(f"contains({T}, {_sql(k)})", "[" + ", ".join(map(_sql, V.OVERRIDES[k])) + "]") for k in sorted(V.OVERRIDES, key=lambda k: (-len(k), k))], "NULL")
    return f"""WITH k AS (SELECT seq, regexp_replace({T}, '{_WS}+', '', 'g') AS t, {S} AS s, {C} AS c, {given} AS given FROM kb), x AS ({' UNION ALL '.join(rows)}),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, head DESC, o) AS rank FROM x WHERE score > 0 AND ((head >= 1 AND score >= 2) OR (head = 0 AND body >= 2 AND score >= 3) OR (head = 0 AND body = 0 AND score >= 6)))
SELECT seq, topic, score, CASE WHEN (head >= 1 AND score >= 4) OR head >= 2 THEN 'high' ELSE 'low' END AS confidence, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3
UNION ALL SELECT seq, topic, 9.9::DOUBLE, 'high', CAST(rank AS INT) FROM (SELECT seq, unnest(given) AS topic, generate_subscripts(given, 1) AS rank FROM k WHERE given IS NOT NULL)"""


@query(_topics_sql())
def topics_annotated(spark: SparkSession, d: str) -> DataFrame:
    topics = {k: A.Topic(*v) for k, v in V.TOPIC_TERMS.items()}
    return A.annotated_topics(kb(spark, d, "title", "summary", "content"), "seq", "title", "summary", "content", topics, V.OVERRIDES)


_LEVEL = f"CASE WHEN {_in('coalesce(content_type,' + chr(39) * 2 + ')', V.LEVELS)} THEN content_type ELSE {_rules(T, V.LEVEL_RULES, f'CASE WHEN {_ACADEMIC} THEN {_sql(chr(0x7814) + chr(0x7a76) + chr(0x6587) + chr(0x732e))} ELSE coalesce(nullif(content_type, {chr(39) * 2}), {_sql(chr(0x52a8) + chr(0x6001))}) END')} END"
_DEPT = _groups(f"({T} || ' ' || coalesce(source,'') || ' ' || {U})", V.DEPARTMENT_TERMS, _rules(U, V.DEPARTMENT_HOSTS, "coalesce(nullif(department, ''), '其他')"))
_REGION = _when([(f"({_any(f'({T} || {S})', ws)} OR regexp_matches({U}, {_sql(p)}))", _sql(k)) for k, ws, p in V.REGION_RULES] + [(f"regexp_matches({U}, {_sql(V.ACADEMIC_URL)})", "'abroad'"), (_any(f"({T} || {S})", ["水库", "湿地"]), "'basin'")], "coalesce(nullif(region, ''), '全国')")
_KCLASS = _when([(_ACADEMIC, "'research'")] + [(f"({_in('level', ls)} OR {_any('hay', ws)})", _sql(k)) for k, ls, ws in V.KCLASSES], "'other'")
_R = V.CONTENT_RULES
_CCLASS = _when([(_ACADEMIC, "'academic'"), (_in("level", _R["policy"]), "'policy_standard'"), (f"(regexp_matches({T}, {_sql(_R['report'])}) OR {_in('level', _R['reports'])})", "'report_bulletin'"), (_in("level", _R["guides"]), "'tech_method'"), (f"({_any(f'({T} || {_sql(chr(32))} || {S})', _R['borrow'])} AND NOT regexp_matches({T}, {_sql(_R['noise'])}))", "'case_practice'"), ("coalesce(category,'') = 'tech'", "'tech_method'"), (f"({_any(f'({T} || {_sql(chr(32))} || {S})', _R['expert'])} OR regexp_matches({T}, {_sql(_R['body'])}))", "'expert_org'")], "'news'")
_TIER = _when([(_any("j", V.REJECTED), "'reject'")] + [(_any("j", v), _sql(k)) for k, v in V.TIERS.items()], "'ok'")
_HOST = f"lower(regexp_extract({U}, '^[A-Za-z]+://([^/?#]+)', 1))"
_AUTH = _when([(f"regexp_matches({_HOST}, {_sql(p)})", f"{s}::DOUBLE") for p, s, _ in V.AUTHORITIES], "0.4::DOUBLE")
_BASE = _when([(f"level = {_sql(k)}", f"{v}::DOUBLE") for k, v in V.LEVEL_BASE.items()] + [("category = 'literature'", "5.0::DOUBLE")], "5.5::DOUBLE")
_BONUS = _when([(f"region2 = {_sql(k)}", f"{v}::DOUBLE") for k, v in V.REGION_BONUS.items()], "0.0::DOUBLE")


@query(f"""WITH a AS (SELECT *, {_LEVEL} AS level, {_DEPT} AS dept, {_REGION} AS region2, {T} || ' ' || {S} || ' ' || {C} AS hay, lower(coalesce(source,'') || ' ' || coalesce(journal,'')) AS j FROM kb)
SELECT seq, level, dept, region2 AS region, {_KCLASS} AS kclass, {_CCLASS} AS content_class, {_TIER} AS tier, {_AUTH} AS authority,
round(round(least(greatest({_BASE} + {_BONUS} + (CASE WHEN regexp_matches({T}, {_sql(V.ISSUERS)}) THEN 0.3::DOUBLE ELSE 0 END) + coalesce(water_rel, 0) * 0.3::DOUBLE, 0), 10), 6), 2) AS importance,
CASE WHEN {_in("level", ["技术规范"])} OR regexp_matches({T}, '〔[0-9]{{4}}〕[0-9]+号') THEN 'A' WHEN {_in("level", ["公报报告", "规范性文件"])} THEN 'B' WHEN level = '研究文献' THEN coalesce(nullif(quality, ''), 'C') WHEN quality IN ('A', 'B', 'C') THEN quality ELSE 'C' END AS quality FROM a""")
def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Level, department, region, classes, tier, authority, importance and quality of every record in one narrow pass."""
    k = kb(spark, d, "title", "summary", "content", "url", "source", "journal", "category", "content_type", "department", "region", "quality", "water_rel")
    t, s, u = F.col("title"), F.col("summary"), F.col("url")
    k = k.withColumn("level", A.level(F.col("content_type"), t, V.LEVELS, V.LEVEL_RULES, _academic(), "研究文献", "动态"))
    k = k.withColumn("place", A.region(F.concat(A.blank(t), A.blank(s)), u, V.REGION_RULES, V.ACADEMIC_URL, "abroad", ["水库", "湿地"], "basin", F.col("region"), "全国"))
    lv, hay = F.col("level"), F.concat_ws(" ", A.blank(t), A.blank(s), A.blank(F.col("content")))
    return k.select(
        "seq", "level", A.department([t, F.col("source"), u], u, V.DEPARTMENT_TERMS, V.DEPARTMENT_HOSTS, F.col("department"), "其他").alias("dept"), F.col("place").alias("region"),
        A.knowledge_class(lv, hay, _academic(), V.KCLASSES, "research", "other").alias("kclass"), A.content_class(_academic(), lv, t, s, F.col("category"), V.CONTENT_RULES).alias("content_class"),
        A.tier(F.concat_ws(" ", A.blank(F.col("source")), A.blank(F.col("journal"))), V.REJECTED, V.TIERS).alias("tier"), A.authority(fields.host(u), V.AUTHORITIES, (0.4, "other"))["score"].alias("authority"),
        A.importance_by_level(lv, F.col("category"), F.col("place"), t, F.col("water_rel"), V.LEVEL_BASE, V.REGION_BONUS, V.ISSUERS).alias("importance"),
        A.quality_by_level(lv, t, F.col("quality"), ["技术规范"], ["公报报告", "规范性文件"], "〔[0-9]{4}〕[0-9]+号", "研究文献").alias("quality"),
    )


_BI = r"CASE WHEN length({0}) > 1 THEN list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) ELSE [] END"
_CJK = r"regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')"


@query(f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t, {_CJK.format("coalesce(text, '')")} AS c, regexp_replace(coalesce(text, ''), '[{_SPACE}]+', '', 'g') AS q FROM documents),
x AS (SELECT doc_id, list_concat({_BI.format("c")}, regexp_extract_all(lower(t), '[a-z0-9]{{2,}}')) AS a, list_concat(regexp_extract_all(q, '[a-zA-Z0-9_]{{2,}}'), {_BI.format("c")}) AS b FROM c)
SELECT doc_id, len(a) AS shard_n, coalesce(array_to_string(list_slice(a, -3, -1), ' '), '') AS shard_last, len(b) AS ingest_n, coalesce(array_to_string(list_slice(b, 1, 3), ' '), '') AS ingest_first FROM x""")
def token_forms(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", A.shard_tokens(F.col("text")).alias("a"), A.ingest_tokens(F.col("text")).alias("b"))
    last = F.slice("a", F.greatest(F.size("a") - 2, F.lit(1)), F.lit(3))
    return x.select("doc_id", F.size("a").cast("long").alias("shard_n"), F.array_join(last, " ").alias("shard_last"), F.size("b").cast("long").alias("ingest_n"), F.array_join(F.slice("b", 1, 3), " ").alias("ingest_first"))


@query(f"""WITH q AS (SELECT seq, regexp_replace({S}, '{_WS}+', '', 'g') AS t FROM kb), p AS (SELECT seq, list_concat(regexp_extract_all(t, '[a-zA-Z0-9_]{{2,}}'), {_BI.format(_CJK.format("t"))}) AS b FROM q),
u AS (SELECT seq, unnest(b) AS tag, generate_subscripts(b, 1) AS i FROM p), c AS (SELECT seq, tag, 1 AS kind, count(*) AS n, min(i) AS i FROM u WHERE length(tag) = 2 AND NOT {_in("tag", V.TAG_STOP + V.SUPPORT)} AND NOT regexp_matches(tag, '.[省市区县]') GROUP BY seq, tag
UNION ALL {" UNION ALL ".join(f"SELECT seq, {_sql(t)}, 0, 0, {i} FROM q WHERE contains(t, {_sql(t)})" for i, t in enumerate(V.SUPPORT))}),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY kind, n DESC, i) AS rank FROM c) SELECT seq, tag, CAST(rank AS INT) AS rank FROM r WHERE rank <= 6""")
def record_tags(spark: SparkSession, d: str) -> DataFrame:
    return A.tags(kb(spark, d, "summary"), "seq", F.col("summary"), V.SUPPORT, V.TAG_STOP, "省市区县")


# Record sets.


@query(f"SELECT cid, min(seq) AS seq, CASE WHEN coalesce(max_by(content, -seq), '') <> '' THEN max_by(content, -seq) ELSE '' END AS text FROM kb WHERE length(trim({C})) > 30 GROUP BY cid")
def fulltext_table(spark: SparkSession, d: str) -> DataFrame:
    return joins.fulltext(kb(spark, d, "cid", "content"), "cid", "content", "seq", 30).select("cid", "seq", "text")


@query(f"""WITH f AS (SELECT cid, max_by(content, -seq) AS text FROM kb WHERE length(trim({C})) > 30 GROUP BY cid)
SELECT seq, coalesce(CASE WHEN seq % 2 = 0 THEN nullif(content, '') END, substr(f.text, 1, 3000), '') AS text FROM kb LEFT JOIN f USING (cid)""")
def fulltext_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "cid", "content")
    stored = joins.fulltext(k, "cid", "content", "seq", 30)
    return joins.lookup(k.withColumn("content", F.when(F.col("seq") % 2 == 0, F.col("content"))), stored, "cid", "content", 3000).select("seq", "text")


@query("""WITH p AS (SELECT DISTINCT pdf FROM kb WHERE coalesce(pdf, '') <> ''), r AS (SELECT pdf, min(seq) AS seq, count(*) AS n FROM kb WHERE coalesce(pdf, '') <> '' AND quality <> 'C' GROUP BY pdf) SELECT p.pdf AS path, r.seq, coalesce(r.n, 0) AS n FROM p LEFT JOIN r USING (pdf)""")
def files_of_records(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "pdf", "quality").where(F.coalesce("pdf", F.lit("")) != "")
    return joins.files_to_records(k.select(F.col("pdf").alias("path")).distinct(), k.where("quality <> 'C'"), "pdf", "seq")


@query(f"SELECT seq, {_when([(f'contains({T}, {_sql(k)})', _sql(v)) for k, v in V.ORIGINS.items()], 'NULL')} AS origin FROM kb WHERE {_any(T, list(V.ORIGINS))}")
def known_origins(spark: SparkSession, d: str) -> DataFrame:
    return joins.known_origins(kb(spark, d, "title"), F.col("title"), V.ORIGINS).select("seq", "origin")


_PROXY = "^https?://big5\\.[^/]+/gate/big5/"


@query(f"""WITH k AS (SELECT seq, title, doc_no, url, CASE WHEN seq % 3 = 0 THEN 'http://big5.a.example/gate/big5/' || regexp_replace(url, '^[a-z]+://', '') ELSE url END AS u FROM kb WHERE regexp_matches(coalesce(url,''), '^https?://')), s AS (SELECT code, min(url) AS su FROM std_index WHERE code IS NOT NULL GROUP BY code),
r AS (SELECT seq, {_when([(f'contains({T}, {_sql(x)})', _sql(v)) for x, v in V.ORIGINS.items()], 'NULL')} AS known, CASE WHEN regexp_matches(u, '{_PROXY}') THEN regexp_replace(u, '{_PROXY}', 'https://') END AS plain, s.su AS std, u, url FROM k LEFT JOIN s ON doc_no = code)
SELECT seq, coalesce(std, known, plain, u) AS url, CASE WHEN std IS NOT NULL THEN 'standard' WHEN known IS NOT NULL THEN 'known' WHEN plain IS NOT NULL THEN 'proxy' ELSE 'kept' END AS kind FROM r""")
def repaired_urls(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "title", "doc_no", "url").where(F.coalesce("url", F.lit("")).rlike("^https?://"))
    k = k.withColumn("url", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("http://big5.a.example/gate/big5/"), F.regexp_replace("url", "^[a-z]+://", ""))).otherwise(F.col("url")))
    return joins.repaired_urls(k, table(spark, d, "std_index"), V.ORIGINS, _PROXY)


def _law(x: str) -> str:
    return f"regexp_replace({x}, '[{_SPACE}《》（）()【】\\[\\]]', '', 'g')"




@query(f"""WITH s AS (SELECT DISTINCT name, {_law("coalesce(name,'')")} AS n FROM std_index WHERE coalesce(name,'') <> ''), r AS (SELECT seq, {_law(T)} AS t FROM kb),
e AS (SELECT name, min(seq) AS seq FROM s JOIN r ON n = t GROUP BY name), c AS (SELECT name, min(seq) AS seq FROM s JOIN r ON length(t) >= 6 AND (contains(t, n) OR contains(n, t)) WHERE n <> '' GROUP BY name)
SELECT name, coalesce(e.seq, c.seq) AS seq, CASE WHEN e.seq IS NOT NULL THEN 'equal' ELSE 'part' END AS how FROM s LEFT JOIN e USING (name) LEFT JOIN c USING (name) WHERE coalesce(e.seq, c.seq) IS NOT NULL""")
def law_records(spark: SparkSession, d: str) -> DataFrame:
    return joins.names_to_records(table(spark, d, "std_index").select("name"), kb(spark, d, "title"))


@query("""SELECT 'core' AS subset, count(*) AS n, count_if(coalesce(content,'') <> '') AS with_text, round(avg(importance), 4) AS importance FROM kb WHERE importance >= 5 UNION ALL SELECT 'must_know', count(*), count_if(coalesce(content,'') <> ''), round(avg(importance), 4) FROM kb WHERE must_know = 1""")
def subset_coverage(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "importance", "must_know", "content")
    sets = F.array_compact(F.array(F.when(F.col("importance") >= 5, F.lit("core")), F.when(F.col("must_know") == 1, F.lit("must_know"))))
    return k.select(F.explode(sets).alias("subset"), "content", "importance").groupBy("subset").agg(F.count("*").alias("n"), F.count_if(F.coalesce("content", F.lit("")) != "").alias("with_text"), F.round(F.avg("importance"), 4).alias("importance"))


@query("SELECT substr(coalesce(date,''), 1, 4) AS year, count(*) AS n, round(avg(coalesce(water_rel, 0)), 4) AS rel FROM kb GROUP BY 1")
def year_stats(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "date", "water_rel").groupBy(F.substring(F.coalesce("date", F.lit("")), 1, 4).alias("year")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("water_rel", F.lit(0.0))), 4).alias("rel"))


@query(" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS dim, {c} AS value FROM kb WHERE coalesce({c}, '') <> ''" for c in ("department", "region", "content_type")))
def option_lists(spark: SparkSession, d: str) -> DataFrame:
    return facets.options(kb(spark, d, "department", "region", "content_type"), {c: F.col(c) for c in ("department", "region", "content_type")})


@query("SELECT coalesce(status,'') AS status, coalesce(content_kind,'') AS kind, count(*) AS n FROM kb GROUP BY 1, 2")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "status", "content_kind").groupBy(F.coalesce("status", F.lit("")).alias("status"), F.coalesce("content_kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


_FILE = f"content_type IS NOT NULL AND {_in('content_type', ['policy', 'standard', '技术规范', '规范性文件', 'notice', 'report'])}"


@query(f"""WITH x AS (SELECT seq, concat_ws(chr(10), title, summary, content) AS b FROM kb WHERE length({T}) >= 4 AND coalesce(quality,'') <> 'C'),
e AS ({' UNION ALL '.join(f"SELECT seq, {_sql(t)} AS type, {_sql(n)} AS name FROM x WHERE contains(b, {_sql(n)})" for t, ns in V.ENTITIES.items() for n in ns if n != "总氮")}),
n AS (SELECT type, name, count(DISTINCT seq) AS cnt FROM e GROUP BY type, name HAVING count(DISTINCT seq) >= 2) SELECT type, count(*) AS nodes, sum(cnt)::BIGINT AS files FROM n GROUP BY type""")
def graph_by_type(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "title", "summary", "content", "quality").where((F.length("title") >= 4) & (F.coalesce("quality", F.lit("")) != "C"))
    found = graph.entities(k, "seq", F.concat_ws("\n", "title", "summary", "content"), V.ENTITIES, {"pollutant": ["总氮"]})
    return graph.nodes(found).groupBy("type").agg(F.count("*").alias("nodes"), F.sum("cnt").alias("files"))


@query(f"""WITH x AS (SELECT seq, concat_ws(chr(10), title, summary, content) AS b FROM kb), e AS ({' UNION ALL '.join(f"SELECT seq, {_sql(t)} AS type, {_sql(n)} AS name FROM x WHERE contains(b, {_sql(n)})" for t, ns in V.ENTITIES.items() for n in ns)})
SELECT name, count(DISTINCT seq) AS cnt FROM e GROUP BY type, name HAVING count(DISTINCT seq) >= 2 ORDER BY cnt DESC, name LIMIT 12""")
def graph_top(spark: SparkSession, d: str) -> DataFrame:
    found = graph.entities(kb(spark, d, "title", "summary", "content"), "seq", F.concat_ws("\n", "title", "summary", "content"), V.ENTITIES)
    return graph.nodes(found).orderBy(F.desc("cnt"), "name").limit(12).select("name", "cnt")


@query(f"""WITH t AS (SELECT DISTINCT title FROM kb WHERE length(title) >= 4), c AS (SELECT title, trim(regexp_replace(regexp_replace(title, '[（(].*?[)）]', '', 'g'), '^(关于|20\\d\\d年)', '')) AS core FROM t)
SELECT c.title, count(*) AS n FROM c JOIN t ON contains(t.title, c.core) AND t.title <> c.title WHERE length(core) >= 4 GROUP BY c.title HAVING count(*) >= 2 ORDER BY n DESC, title LIMIT 12""")
def graph_anchors(spark: SparkSession, d: str) -> DataFrame:
    return graph.anchors(graph.title_mentions(kb(spark, d, "title"), "title", [r"[（(].*?[)）]", r"^(关于|20\d\d年)"]), 2)


_PRIO = _when([("department = '生态环境'", "0"), ("department = '水利'", "1")], "2")
_CATS = {"policy": 0, "standard": 1, "management": 2, "tech": 3}
_CORD = _when([(f"category = {_sql(k)}", str(v)) for k, v in _CATS.items()], "99")


@query(f"SELECT seq, day, CAST(row_number() OVER (PARTITION BY day ORDER BY {_CORD}, {_PRIO}, seq) AS INT) AS place FROM (SELECT *, coalesce(nullif(date, ''), nullif(added_at, ''), 'unknown') AS day FROM kb)")
def archive_order(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("department") == "生态环境", 0).when(F.col("department") == "水利", 1).otherwise(2)
    c = F.lit(99)
    for k, v in _CATS.items():
        c = F.when(F.col("category") == k, v).otherwise(c)
    k = kb(spark, d, "date", "added_at", "department", "category")
    day = F.coalesce(F.nullif("date", F.lit("")), F.nullif("added_at", F.lit("")), F.lit("unknown"))
    return k.select("seq", day.alias("day"), F.row_number().over(Window.partitionBy(day).orderBy(c, p, "seq")).alias("place"))


@query(f"SELECT seq, rank FROM (SELECT seq, source, CAST(row_number() OVER (PARTITION BY source ORDER BY round(coalesce(water_rel, 0) + 0.1::DOUBLE * {_AUTH}, 4) DESC, seq) AS INT) AS rank FROM kb WHERE coalesce(water_rel, 0) >= 0.35) WHERE rank <= 6")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(F.coalesce("water_rel", F.lit(0.0)) + A.authority(fields.host(F.col("url")), V.AUTHORITIES, (0.4, "other"))["score"] * 0.1, 4)
    k = kb(spark, d, "source", "water_rel", "url").where(F.coalesce("water_rel", F.lit(0.0)) >= 0.35)
    return lexicon.first_per_group(k.withColumn("score", score), "source", [F.desc("score"), F.col("seq")], 6).select("seq", "rank")


@query("SELECT DISTINCT doc_id // 100 AS shard, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents)")
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    return facets.term_postings(table(spark, d, "documents"), "doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)), 100)


@query("SELECT seq, cid || repeat('x', CAST(row_number() OVER (PARTITION BY cid ORDER BY seq) - 1 AS INT)) AS unique FROM kb")
def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    return joins.unique_ids(kb(spark, d, "cid"), "cid", "seq").select("seq", "unique")


_KEY = "lower(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', ''))"


@query(f"SELECT seq FROM inbox i WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_KEY} AS u FROM kb WHERE coalesce(url, '') <> '') k WHERE k.u = {_KEY.replace('url', 'i.url')}) AND NOT EXISTS (SELECT 1 FROM kb k WHERE k.title = i.title AND coalesce(k.title, '') <> '') AND NOT EXISTS (SELECT 1 FROM kb k WHERE k._ev = i._ev AND coalesce(k._ev, '') <> '')")
def unseen_records(spark: SparkSession, d: str) -> DataFrame:
    u, t, e = fields.url_key(F.col("url")), F.col("title"), F.col("_ev")
    return joins.unseen(table(spark, d, "inbox").select("seq", "url", "title", "_ev"), kb(spark, d, "url", "title", "_ev"), {"u": (u, u), "t": (t, t), "e": (e, e)}).select("seq")


@query("SELECT seq FROM kb WHERE contains(coalesce(department,''), '水') AND category = 'policy' AND quality <= 'B' AND coalesce(date,'') >= '2012' AND coalesce(date,'') <= '2024-06-30'")
def metadata_filtered(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "department", "region", "category", "quality", "date").where(retrieval.metadata("水", None, "policy", "B", "2012", "2024-06-30")).select("seq")


_OWN = r"regexp_replace(name, '[^\x{4e00}-\x{9fff}A-Za-z0-9]+', '', 'g')"


@query(f"""WITH x AS (SELECT seq, title, coalesce(length(content), 0) AS n, coalesce(water_rel, 0) AS m, pdf, CASE WHEN seq % 2 = 0 THEN '关于《' || title || '》的说明' ELSE title END AS t, title AS name, content FROM kb WHERE title IS NOT NULL),
y AS (SELECT *, {_OWN} AS own, list_filter(list_transform(regexp_extract_all(t, '《([^》]{{4,60}})》', 1), lambda z: regexp_replace(z, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]+', '', 'g')), lambda z: length(z) >= 6) AS named FROM x)
SELECT seq, CASE WHEN (len(named) = 0 OR (len(list_filter(named, lambda z: contains(own, z) OR contains(z, own))) > 0 AND m >= 0.8)) AND m >= 0.45 AND n >= 600 THEN round(0.7::DOUBLE * 0.4::DOUBLE + least(1.0::DOUBLE, n / 4000.0::DOUBLE) * 0.3::DOUBLE + m * 0.3::DOUBLE + (CASE WHEN coalesce(pdf,'') <> '' THEN 0.03::DOUBLE ELSE 0 END), 3) ELSE 0.0 END AS score FROM y""")
def origin_scores(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "title", "content", "water_rel", "pdf").where("title is not null")
    t = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("关于《"), "title", F.lit("》的说明"))).otherwise(F.col("title"))
    s = scoring.origin_score(t, F.col("title"), F.coalesce("water_rel", F.lit(0.0)), F.coalesce(F.length("content"), F.lit(0)), F.lit(0.7), F.coalesce("pdf", F.lit("")) != "", F.lit(True))
    return k.select("seq", s.alias("score"))


@query("SELECT seq, to_json({'title': coalesce(title, ''), 'year': substr(coalesce(date, ''), 1, 4), 'n': coalesce(length(content), 0)}) AS line FROM kb WHERE NOT contains(coalesce(title,''), chr(92)) AND NOT contains(coalesce(title,''), '/')")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    k = kb(spark, d, "title", "date", "content").where(~F.coalesce("title", F.lit("")).rlike("[\\\\/]"))
    return k.select("seq", F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("date", F.lit("")), 1, 4).alias("year"), F.coalesce(F.length("content"), F.lit(0)).alias("n"))).alias("line"))


_GROUPS = {"water": ["水利", "水"], "eco": ["生态", "环境"], "build": ["住建"]}


@query(f"SELECT priority, count(*) AS n FROM (SELECT {_when([(_any('coalesce(department,' + chr(39) * 2 + ')', ts), str(i)) for i, ts in enumerate(_GROUPS.values())], str(len(_GROUPS)))} AS priority FROM kb) GROUP BY priority")
def department_priority(spark: SparkSession, d: str) -> DataFrame:
    return kb(spark, d, "department").groupBy(A.priority(F.col("department"), _GROUPS).alias("priority")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT name, min(struct_pack(u := url, p := code)) AS s FROM std_index WHERE coalesce(name,'') <> '' AND url <> '' GROUP BY name), n AS (SELECT name, {_law("coalesce(name,'')")} AS n FROM s), r AS (SELECT seq, {_law(T)} AS t FROM kb),
e AS (SELECT name, min(seq) AS seq FROM n JOIN r ON n = t GROUP BY name), c AS (SELECT name, min(seq) AS seq FROM n JOIN r ON length(t) >= 6 AND (contains(t, n) OR contains(n, t)) WHERE n <> '' GROUP BY name),
m AS (SELECT s.name, coalesce(e.seq, c.seq) AS seq, s.s FROM s LEFT JOIN e USING (name) LEFT JOIN c USING (name)), o AS (SELECT seq, min_by(s, name) AS s FROM m WHERE seq IS NOT NULL GROUP BY seq)
SELECT kb.seq, coalesce(o.s.u, kb.url) AS url, o.s.p AS publisher FROM kb LEFT JOIN o USING (seq)""")
def sourced_records(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "std_index").select("name", "url", F.col("code").alias("publisher"))
    return joins.apply_sources(kb(spark, d, "title", "url"), s).select("seq", "url", "publisher")
