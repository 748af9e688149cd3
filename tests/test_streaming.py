from weirstone.streaming.inbox import inbox_stream, merge_stream, unique_addresses


def test_inbox_merged_as_it_arrives(spark, tmp_path):
    schema = "seq long, url string, title string, quality string, arrived_at timestamp"
    src = tmp_path / "in"
    for i, (seq, url, title) in enumerate([(10, "http://a/1", "甲"), (11, "http://a/2", "乙"), (12, "http://a/1", "丙")]):
        spark.createDataFrame([(seq, url, title, "B", None)], schema).coalesce(1).write.mode("append").parquet(str(src))
    kb = spark.createDataFrame([(1, "http://a/2", "旧", "B", None)], "seq long, url string, title string, quality string, _ev string")
    kb.write.parquet(str(tmp_path / "kb"))
    done = {}

    def sink(actions, number):
        done.update({r.seq: r.action for r in actions.collect()})

    merge_stream(inbox_stream(spark, str(src), schema, 10), lambda: spark.read.parquet(str(tmp_path / "kb")), sink, str(tmp_path / "cp")).awaitTermination()
    assert done == {10: "appended", 11: "skipped", 12: "skipped"}


def test_unique_addresses(spark, tmp_path):
    from datetime import datetime

    schema = "seq long, url string, arrived_at timestamp"
    spark.createDataFrame([(i, u, datetime(2024, 1, 1)) for i, u in enumerate(["http://a", "http://a/", None, None])], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = unique_addresses(inbox_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("u").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("u").count() == 3
