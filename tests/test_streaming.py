from datetime import datetime

from termloom.streaming.feeds import insert_ignore_stream, read_feed, term_counts


def test_insert_ignore_stream(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(1, 10, "a"), (1, 11, "late"), (None, 12, "x")], "pmid long, no long, t string").coalesce(1).write.mode("append").parquet(feed)
    spark.createDataFrame([(2, 20, "b"), (1, 21, "again"), (2, 19, "first")], "pmid long, no long, t string").coalesce(1).write.mode("append").parquet(feed)
    target = str(tmp_path / "target")
    q = insert_ignore_stream(read_feed(spark, feed, "pmid long, no long, t string", 1), "pmid", "no", target, str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(target).select("pmid", "no", "t").collect()
    assert sorted(r.pmid for r in got) == [1, 2] and {r.t for r in got if r.pmid == 2} == {"first"}


def test_windowed_counts(spark, tmp_path):
    feed = str(tmp_path / "events")
    rows = [(datetime(2024, 1, d, 12), "a") for d in (1, 1, 2, 20)]
    spark.createDataFrame(rows, "ts timestamp, term string").coalesce(1).write.parquet(feed)
    stream = term_counts(read_feed(spark, feed, "ts timestamp, term string"), "ts", "term")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("select * from counts").collect()) == [1, 1, 2]
