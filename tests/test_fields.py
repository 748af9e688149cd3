from pyspark.sql import functions as F

from weirstone.functions import fields, text
from weirstone.operators import html, scoring
from weirstone.sources import harvest, sinks


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def test_doi_is_idempotent(spark):
    d = spark.createDataFrame([("https://doi.org/https://doi.org/10.1/x",), ("https://doi.org/10.1/x",), (None,)], "u string")
    once = [r[0] for r in d.select(fields.repair_doi(F.col("u"))).collect()]
    assert once == ["https://doi.org/10.1/x", "https://doi.org/10.1/x", None]


def test_query_keeps_pages_apart(spark):
    r = one(spark, "a string, b string", ("http://x/a?hcno=1#t", "http://x/a?hcno=2"), fields.url_key(F.col("a")), fields.url_key(F.col("b")), fields.url_comparable(F.col("a")))
    assert r[0] != r[1] and r[2] is False


def test_titles_with_a_long_common_prefix(spark):
    r = one(spark, "a string, b string", ("水质 第7部分：测定", "水质 第16部分：测定"), fields.event_key(F.col("a")), fields.event_key(F.col("b")))
    assert r[0] != r[1]


def test_sanitize(spark):
    assert one(spark, "a string", ("a\x00b\n\tc\x1f",), fields.sanitize(F.col("a")))[0] == "ab\n\tc"


def test_tokens_and_chunks(spark):
    r = one(spark, "a string", ("水文站 GB 3838",), fields.tokens(F.col("a")), fields.chunks(F.col("a")))
    assert r[0] == ["gb", "3838", "水文", "文站"] and r[1] == ["水文站GB3838"]
    r = one(spark, "a string", ("甲乙丙丁。" * 5,), fields.chunks(F.col("a"), 12))
    assert r[0] == ["甲乙丙丁。" * 2] * 4


def test_deinvert(spark):
    assert one(spark, "m map<string,array<int>>", ({"b": [1, 3], "a": [0], "c": [2]},), fields.deinvert(F.col("m")))[0] == "a b c b"


def test_nfkc(spark):
    import unicodedata

    samples = ["ＡＢ，。", "ﬁ…℃㎡①½", "éÅ", "水　文", "", None, "한", "\U0002f800"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", text.nfkc(F.col("s")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [None if s is None else unicodedata.normalize("NFKC", s) for s in samples]


def test_html(spark):
    page = '<html><head><title>标题_站点</title><script>x</script></head><body><div class="article main"><p>正文 &amp; 内容</p><div>' + "字" * 320 + '</div></div><a href="/2024/05/a.html">这是一条足够长的标题</a><a href="x.pdf">附件</a></body></html>'
    r = one(spark, "m string, b string", (page, "https://a.example/list/index.html"), html.page_title(F.col("m")), html.article_links(F.col("m"), F.col("b")), html.file_links(F.col("m")), html.container_text(["article"])(F.col("m")), html.run_text(F.col("m"), "版权"))
    assert r[0] == "标题" and [x.href for x in r[1]] == ["https://a.example/2024/05/a.html"] and r[2] == ["x.pdf"]
    assert r[3].startswith("正文 & 内容") and "字" * 320 in r[3] and "字" * 320 in r[4]


def test_validity(spark):
    d = spark.createDataFrame([("题", "页面不存在" * 20), ("水法条文", "水法条文" * 50), ("水法条文", "水法条文规定" * 120), ("水法条文", "  "), (None, None)], "t string, c string")
    got = [r[0] for r in d.select(scoring.validity(F.col("t"), F.col("c"), ["页面不存在"], [])).collect()]
    assert got == ["error_page:页面不存在", "too_short:200", "ok", "empty", "empty"]


def test_harvested(spark):
    works = '{"results":[{"title":"T","doi":"https://doi.org/10.1/a","publication_date":"2024-01-02","abstract_inverted_index":{"x":[1],"y":[0]},"cited_by_count":120}]}'
    assert harvest.works(spark.createDataFrame([(works,)], "body string")).first()[:4] == ("T", "https://doi.org/10.1/a", "2024-01-02", "y x")
    item = '{"message":{"items":[{"DOI":"10.1/b","title":["B"],"published":{"date-parts":[[2023,5]]},"container-title":["J"]}]}}'
    assert harvest.registered_items(spark.createDataFrame([(item,)], "body string")).first().date == "2023-05-01"
    policy = '{"searchVO":{"catMap":{"gongwen":{"listVO":[{"title":"<em>水</em>法","url":"u","pubtimeStr":"2024.5.6"}]}}}}'
    assert harvest.policy_items(spark.createDataFrame([(policy,)], "body string")).first().date == "2024-05-06"
    page = '<a href="/x/t20240506_12.shtml">水质 GB/T 3838-2002 测定</a> <span>2024-08-01</span>'
    r = harvest.listing(spark.createDataFrame([(page,)], "body string")).first()
    assert (r.date, r.code, r.impl) == ("2024-05-06", "GB/T 3838-2002", "2024-08-01")


def test_sinks(spark, tmp_path):
    import pytest

    d = spark.createDataFrame([(i, "a\x01b", ["c\x02"]) for i in range(10)], "seq long, t string, tags array<string>")
    assert sinks.guarded_write(d, str(tmp_path / "a"), 10) == 10
    assert spark.read.parquet(str(tmp_path / "a")).first()[1:] == ("ab", ["c"])
    with pytest.raises(sinks.TooFewRows):
        sinks.guarded_write(d.limit(3), str(tmp_path / "a"), 10)
    sinks.write_shards(d, str(tmp_path / "s"), 4)
    assert sinks.read_shards(spark, str(tmp_path / "s"), [2]).count() == 2


def test_records_fail_loudly(spark, tmp_path):
    import pytest

    (tmp_path / "kb.json").write_text('[{"title": "a", "tags": ["x"]}, {"title": "b"}]')
    assert harvest.numbered(harvest.records(spark, str(tmp_path / "kb.json"))).count() == 2
    (tmp_path / "bad.json").write_text('[{"title": "a"')
    with pytest.raises(Exception):
        harvest.records(spark, str(tmp_path / "bad.json")).collect()
