"""Recorded responses of harvested services, and record files, as DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.functions.fields import deinvert, inline_text, strip_tags

RECORD = "title string, url string, source string, date string, added_at string, category string, content_type string, department string, region string, visibility string, status string, quality string, quality_src string, summary string, tags array<string>, kg_terms array<string>, topic array<string>, waterbody array<string>, topic_score map<string,double>, content string, content_fetched boolean, content_kind string, pdf string, note string, journal string, journal_tier string, doc_no string, must_know int, must_rank int, importance double, water_rel double, metrics struct<read:bigint,follower:bigint>, cid string, _ev string"
_ITEM = "struct<title:string,url:string,pcode:string,puborg:string,summary:string,pubtimeStr:string,pubtime:bigint,ptime:bigint>"
POLICY = f"searchVO struct<catMap:map<string,struct<listVO:array<{_ITEM}>>>>"
WORK = "results array<struct<title:string,doi:string,id:string,publication_date:string,abstract_inverted_index:map<string,array<int>>,cited_by_count:int,primary_location:struct<source:struct<display_name:string>>>>"
ITEM = "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,published:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,`is-referenced-by-count`:int,link:array<struct<URL:string,`content-type`:string>>>>>"


def records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records. A broken file fails; it is never read as empty."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``seq``, the position in the file (files are read in order of their names)."""
    return df.withColumn("_at", F.monotonically_increasing_id()).select(F.col("_at").alias("seq"), *df.columns)


def policy_items(responses: DataFrame, body: str = "body") -> DataFrame:
    """Recorded pages of a policy library: one row per item of every category."""
    x = responses.select(F.from_json(body, POLICY).alias("r")).select(F.explode("r.searchVO.catMap").alias("list_name", "v")).select("list_name", F.explode("v.listVO").alias("i"))
    day = F.regexp_extract("i.pubtimeStr", r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})", 0)
    parts = F.split(day, r"[.\-/]")
    date = F.when(day != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).otherwise(F.date_format(F.timestamp_millis(F.coalesce("i.pubtime", "i.ptime")), "yyyy-MM-dd"))
    return x.select("list_name", inline_text(F.col("i.title")).alias("title"), "i.url", F.col("i.pcode").alias("doc_no"), F.col("i.puborg").alias("source"), inline_text(F.col("i.summary")).alias("summary"), date.alias("date"))


def works(responses: DataFrame, body: str = "body") -> DataFrame:
    """Recorded pages of a works index whose abstracts are inverted."""
    x = responses.select(F.explode(F.from_json(body, WORK)["results"]).alias("w"))
    return x.select("w.title", F.coalesce("w.doi", "w.id").alias("url"), F.col("w.publication_date").alias("date"), deinvert(F.col("w.abstract_inverted_index")).alias("abstract"), F.col("w.primary_location.source.display_name").alias("journal"), F.least(F.lit(5), 1 + F.floor(F.coalesce("w.cited_by_count", F.lit(0)) / 50)).cast("int").alias("importance"))


def registered_items(responses: DataFrame, body: str = "body") -> DataFrame:
    """Recorded pages of a DOI registry: date parts with missing month or day set to 1."""
    x = responses.select(F.explode(F.from_json(body, ITEM)["message"]["items"]).alias("i"))
    d = F.get(F.col("i.published.date-parts"), F.lit(0))
    date = F.date_format(F.make_date(F.get(d, F.lit(0)), F.coalesce(F.get(d, F.lit(1)), F.lit(1)), F.coalesce(F.get(d, F.lit(2)), F.lit(1))), "yyyy-MM-dd")
    files = F.filter("i.link", lambda u: u["content-type"].contains("pdf") | F.lower(u["URL"]).endswith(".pdf"))
    return x.select(F.get(files, F.lit(0))["URL"].alias("pdf"), F.get("i.title", F.lit(0)).alias("title"), F.concat(F.lit("https://doi.org/"), "i.DOI").alias("url"), strip_tags(F.col("i.abstract")).alias("abstract"), date.alias("date"), F.get(F.col("i.container-title"), F.lit(0)).alias("journal"), F.least(F.lit(5), 1 + F.floor(F.coalesce("i.is-referenced-by-count", F.lit(0)) / 50)).cast("int").alias("importance"))


def listing(responses: DataFrame, body: str = "body") -> DataFrame:
    """Recorded list pages of standards: code, name, address, date of taking effect."""
    row = r"""(?is)<a\b[^>]*href=["']([^"']*t(\d{8})_\d+\.s?html?)["'][^>]*>\s*([^<]+?)\s*</a>\s*(?:<[^>]+>\s*)*((?:\d{4}-\d{2}-\d{2})?)"""
    at = lambda i: F.regexp_extract_all(body, F.lit(row), F.lit(i))
    z = responses.select(F.explode(F.arrays_zip(at(1).alias("url"), at(2).alias("day"), at(3).alias("name"), at(4).alias("impl"))).alias("x"))
    return z.select("x.url", F.concat_ws("-", F.substring("x.day", 1, 4), F.substring("x.day", 5, 2), F.substring("x.day", 7, 2)).alias("date"), "x.name", F.regexp_extract("x.name", r"([A-Z]{2,5}(?:/T)?\s?\d+(?:\.\d+)?[-—]\d{4})", 1).alias("code"), F.nullif("x.impl", F.lit("")).alias("impl"))


def media(spark: SparkSession, path: str, magic: bytes = b"%PDF") -> DataFrame:
    """Files with their size and whether they begin as their name says; the bytes themselves aren't kept."""
    x = spark.read.format("binaryFile").load(path)
    return x.select("path", F.col("length").alias("size"), (F.substring("content", 1, len(magic)) == F.lit(magic)).alias("genuine"))


_PAPER = "resultList struct<result:array<struct<id:string,source:string,title:string,doi:string,pmcid:string,abstractText:string,firstPublicationDate:string,citedByCount:int,journalInfo:struct<journal:struct<title:string>>,fullTextUrlList:struct<fullTextUrl:array<struct<url:string,documentStyle:string>>>>>>, nextCursorMark string"


def papers(responses: DataFrame, body: str = "body", year: str = "year") -> DataFrame:
    """Recorded pages of a life-science index, one row per paper with a title; a missing date is the first day of the page's year, a missing identifier leaves the index's own address."""
    x = responses.select(F.col(year).cast("string").alias("_y"), F.explode(F.from_json(body, _PAPER)["resultList"]["result"]).alias("i")).where(F.coalesce("i.title", F.lit("")) != "")
    files = F.filter("i.fullTextUrlList.fullTextUrl", lambda u: F.lower(u["documentStyle"]) == "pdf")
    own = F.concat(F.lit("https://europepmc.org/article/"), F.coalesce("i.source", F.lit("MED")), F.lit("/"), F.coalesce("i.id", F.lit("")))
    return x.select(
        "i.title", F.coalesce(F.concat(F.lit("https://doi.org/"), F.nullif("i.doi", F.lit(""))), own).alias("url"), F.coalesce(F.nullif(F.substring("i.firstPublicationDate", 1, 10), F.lit("")), F.concat("_y", F.lit("-01-01"))).alias("date"),
        strip_tags(F.col("i.abstractText")).alias("abstract"), F.col("i.journalInfo.journal.title").alias("journal"), F.get(files, F.lit(0))["url"].alias("pdf"), F.col("i.pmcid").alias("pmcid"), cited_importance(F.col("i.citedByCount")).alias("importance"),
    )


def next_cursors(responses: DataFrame, body: str = "body", sent: str = "cursor") -> DataFrame:
    """Adds ``next``: the cursor of the following page, null where there is none or it doesn't move."""
    n = F.from_json(body, _PAPER)["nextCursorMark"]
    return responses.withColumn("next", F.when((n != "") & ~n.eqNullSafe(F.col(sent)), n))


def next_year(year: Column, first: int, last: int) -> Column:
    """The cursor of years goes back and, behind the first, starts again at the last."""
    return F.when(year.isNull() | (year - 1 < first), F.lit(last)).otherwise(year - 1)


def cited_importance(cited: Column) -> Column:
    return F.least(F.lit(5), 1 + F.floor(F.coalesce(cited, F.lit(0)) / 50)).cast("int")


def dated(df: DataFrame, since: str, until: str, text: str | None = None) -> DataFrame:
    """Only what was published in the window, ends included, and, if asked, has a text."""
    out = df.where(F.col("date").between(since, until))
    return out if text is None else out.where(F.coalesce(F.col(text), F.lit("")) != "")


def posts(responses: DataFrame, site: str, allowed: list[str], body: str = "body", least: int = 6) -> DataFrame:
    """Recorded pages of an account search: (title, url, source, summary, date, authority) of posts whose title has ``least`` characters. Dates are seconds since 1970, in UTC."""
    item = r"""(?s)<h3>\s*<a[^>]*href="(/link\?url=[^"]+)"[^>]*>(.*?)</a>\s*</h3>.*?class="txt-info"[^>]*>(.*?)</p>.*?class="all-time-y2"[^>]*>([^<]+).*?timeConvert\('(\d+)'\)"""
    at = lambda i: F.regexp_extract_all(body, F.lit(item), F.lit(i))
    z = responses.select(F.explode(F.arrays_zip(at(1).alias("url"), at(2).alias("title"), at(3).alias("summary"), at(4).alias("account"), at(5).alias("ts"))).alias("x"))
    source = F.trim("x.account")
    known = F.lit(False)
    for a in allowed:
        known = known | source.contains(a)
    d = F.date_format(F.timestamp_seconds(F.col("x.ts").cast("long")), "yyyy-MM-dd")
    out = z.select(inline_text(F.col("x.title")).alias("title"), F.concat(F.lit(site), F.replace("x.url", F.lit("&amp;"), F.lit("&"))).alias("url"), source.alias("source"), inline_text(F.col("x.summary")).alias("summary"), d.alias("date"), known.alias("authority"))
    return out.where(F.length("title") >= least)


def noticed(df: DataFrame, rel: Column, read: Column, follower: Column, min_read: int, min_follower: int) -> DataFrame:
    """Posts of known accounts, and others that are relevant (0.6) and read or followed enough."""
    return df.where(F.col("authority") | (rel >= 0.6) & ((F.coalesce(read, F.lit(0)) >= min_read) | (F.coalesce(follower, F.lit(0)) >= min_follower)))


_PLACE = "struct<url_for_pdf:string>"


def open_files(responses: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``pdf``: the best open file of a recorded answer of an open-access locator, else the first one that has any."""
    r = F.from_json(body, f"best_oa_location {_PLACE}, oa_locations array<{_PLACE}>")
    rest = F.filter(r["oa_locations"], lambda x: F.coalesce(x["url_for_pdf"], F.lit("")) != "")
    return responses.withColumn("pdf", F.coalesce(F.nullif(r["best_oa_location"]["url_for_pdf"], F.lit("")), F.get(rest, F.lit(0))["url_for_pdf"]))


def repository_abstracts(responses: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``abstract`` of a recorded answer of a repository registry: what is called so, else the first description."""
    d = F.filter(F.from_json(body, "data struct<attributes:struct<descriptions:array<struct<descriptionType:string,description:string>>>>")["data"]["attributes"]["descriptions"], lambda x: F.coalesce(x["description"], F.lit("")) != "")
    named = F.filter(d, lambda x: F.lower(x["descriptionType"]) == "abstract")
    return responses.withColumn("abstract", strip_tags(F.coalesce(F.get(named, F.lit(0))["description"], F.get(d, F.lit(0))["description"])))


def original_candidates(responses: DataFrame, prefer: list[str], least: int = 60) -> DataFrame:
    """Items of recorded library pages by preferred list; a list is taken only while those before it, of the same ``query``, gave fewer than ``least``."""
    i = policy_items(responses).where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & F.col("list_name").isin(prefer))
    i = i.withColumn("rank", F.array_position(F.array(*[F.lit(p) for p in prefer]), F.col("list_name")).cast("int"))
    counts = i.groupBy("rank").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(F.broadcast(counts).alias("b"), F.col("b.rank") < F.col("a.rank"), "left").groupBy("a.rank").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # a row for each list
    return i.join(F.broadcast(before), "rank").where(F.col("before") < least).drop("before")


def noted_addresses(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines 'address|note' -> (url, note); blank lines and other words are left out, addresses once each."""
    p = F.split(F.trim(F.col(line)), r"\|", 2)
    return lines.select(F.trim(p[0]).alias("url"), F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("note")).where(F.col("url").rlike("^https?://")).groupBy("url").agg(F.max("note").alias("note"))


def seeded(spark: SparkSession, rows: list[dict], added_at: str) -> DataFrame:
    """Literal records of the declared schema, ``seq`` their place, ``added_at`` filled in where it is missing."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    data = [[i, *[r.get(f.name) for f in schema.fields]] for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, StructType.fromDDL("seq bigint, " + RECORD))
    return df.withColumn("added_at", F.coalesce(F.nullif("added_at", F.lit("")), F.lit(added_at)))
