"""Names in texts, against a plain search."""

from weirstone.operators import graph


def test_mentions_of_every_length(spark):
    names = ["水文", "水文站", "水文站网", "站网", "a", "Taixiu Journal of Inland Waters", "河(长)", "长.江", "🙂é", "文站网监", "水文", "", None, "水文站网监测数据年鉴汇编与质量控制技术规程说明书二〇二四版"]
    texts = ["水文站网监测", "水文", "水文站网监测数据年鉴汇编与质量控制技术规程说明书二〇二四版（试行）", "前" * 400 + "水文站", "x" * 5000 + "Taixiu Journal of Inland Waters", "河(长)制与长江、长.江", "🙂é🙂é", "a", "aa", "", None, "水文站网监测", "河长"]
    got = dict(map(tuple, graph.mentions(spark.createDataFrame([(t,) for t in texts], "title string"), spark.createDataFrame([(n,) for n in names], "core string")).collect()))
    want = {n: len({t for t in texts if t and n in t and t != n}) for n in set(names) if n}
    assert got == {n: k for n, k in want.items() if k}
    assert graph.mentions(spark.createDataFrame([("a",)], "title string"), spark.createDataFrame([], "core string")).count() == 0
