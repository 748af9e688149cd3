"""Recorded responses, record files and sinks on literals."""

import json

import pytest

from pyspark.sql import functions as F
from weirstone.sources import harvest, sinks


def body(spark, *objects, **more):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x), *more.values()) for x in objects], ["body", *more])


def test_papers_and_cursors(spark):
    page = {"resultList": {"result": [{"id": "1", "title": "A", "doi": "10.1/x", "abstractText": "<p>t</p>", "firstPublicationDate": "2024-05-06", "citedByCount": 120, "journalInfo": {"journal": {"title": "J"}}, "fullTextUrlList": {"fullTextUrl": [{"url": "h", "documentStyle": "html"}, {"url": "f", "documentStyle": "pdf"}]}}, {"id": "2", "title": "B"}, {"id": "3", "title": ""}]}, "nextCursorMark": "n"}
    r = body(spark, page, year=2023, cursor="*")
    got = {x.title: x for x in harvest.papers(r).collect()}
    assert set(got) == {"A", "B"} and got["A"].url == "https://doi.org/10.1/x" and got["A"].pdf == "f" and got["A"].importance == 3 and got["A"].abstract == "t"
    assert got["B"].url == "https://europepmc.org/article/MED/2" and got["B"].date == "2023-01-01"
    assert harvest.next_cursors(r).first().next == "n" and harvest.next_cursors(body(spark, page, cursor="n")).first().next is None
    years = spark.createDataFrame([(2000,), (2010,), (None,)], "y int").select(harvest.next_year(F.col("y"), 2000, 2024)).collect()
    assert [x[0] for x in years] == [2024, 2009, 2024]
    assert [x.title for x in harvest.dated(harvest.papers(r), "2024-01-01", "2024-12-31", "abstract").collect()] == ["A"]


def test_posts(spark):
    page = """<h3><a href="/link?url=a&amp;b">水质<em>月报</em>第一期</a></h3><p class="txt-info">摘要</p><span class="all-time-y2">某水利</span><script>timeConvert('1700000000')</script>
<h3><a href="/link?url=c">短</a></h3><p class="txt-info">s</p><span class="all-time-y2">b</span>timeConvert('0')"""
    x = harvest.posts(body(spark, page), "https://a.example", ["水利"]).collect()
    assert [tuple(r) for r in x] == [("水质月报第一期", "https://a.example/link?url=a&b", "某水利", "摘要", "2023-11-14", True)]
    df = spark.createDataFrame([(True, 0.1, 0, 0), (False, 0.7, 900, 0), (False, 0.7, 1, 1), (False, 0.5, 900, 900)], "authority boolean, rel double, r int, f int")
    assert harvest.noticed(df, F.col("rel"), F.col("r"), F.col("f"), 500, 1000).count() == 2


def test_locators_candidates_and_seeds(spark):
    assert harvest.open_files(body(spark, {"best_oa_location": {"url_for_pdf": ""}, "oa_locations": [{"url_for_pdf": None}, {"url_for_pdf": "p"}]})).first().pdf == "p"
    assert harvest.repository_abstracts(body(spark, {"data": {"attributes": {"descriptions": [{"descriptionType": "Other", "description": "o"}, {"descriptionType": "Abstract", "description": "<b>a</b>"}]}}})).first().abstract == "a"
    lists = {"x": {"listVO": [{"title": f"t{i}", "url": f"u{i}"} for i in range(3)]}, "y": {"listVO": [{"title": "t", "url": "u"}]}, "z": {"listVO": [{"title": "q", "url": "r"}]}}
    r = body(spark, {"searchVO": {"catMap": lists}})
    assert {x.list_name for x in harvest.original_candidates(r, ["y", "x", "z"], 4).collect()} == {"y", "x"}
    lines = spark.createDataFrame([("http://a.example/1|  note",), ("",), ("words",), ("http://a.example/1",)], "value string")
    assert [tuple(x) for x in harvest.noted_addresses(lines).collect()] == [("http://a.example/1", "note")]
    s = harvest.seeded(spark, [{"title": "a"}, {"title": "b", "added_at": "2020-01-01"}], "2025-01-01").orderBy("seq").collect()
    assert [(x.seq, x.title, x.added_at) for x in s] == [(0, "a", "2025-01-01"), (1, "b", "2020-01-01")]
    item = {"message": {"items": [{"DOI": "10.1/a", "title": ["t"], "link": [{"URL": "h", "content-type": "text/html"}, {"URL": "x.pdf", "content-type": "application/pdf"}]}]}}
    assert harvest.registered_items(body(spark, item)).first().pdf == "x.pdf"


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    got = {x.path.rsplit("/", 1)[1]: (x.size, x.genuine) for x in harvest.media(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (8, True), "b.pdf": (6, False)}
    inbox = str(tmp_path / "inbox")
    rows = spark.createDataFrame([(1, "a\x01b")], "seq long, title string")
    sinks.append_inbox(rows, inbox)
    sinks.append_inbox(rows, inbox)
    assert [x.title for x in spark.read.parquet(inbox).collect()] == ["ab", "ab"]
    with pytest.raises(sinks.TooFewRows):
        sinks.guarded_write(rows, str(tmp_path / "kb"), 5)
