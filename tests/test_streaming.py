import datetime as dt

from evigraph.operators import mutations
from evigraph.streaming import jobs
from pyspark.sql import functions as F
from test_engine import NOW, REVIEW


def test_windows_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=7 * k), k % 3, ("a", "b")[k % 2], float(k)) for k in range(400)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(999, start + dt.timedelta(days=30), 0, "a", 0.0)], frame.schema)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, job in (("w", jobs.event_windows), ("s", jobs.event_sessions)):
        query = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in job(frame).collect()}
        assert want - got == set() and len(got) >= len(want)


def test_classifier_keeps_the_last_content(spark, tmp_path):
    schema = "path string, sha256 string, structural_sha256 string, seq long"
    rows = [("p", "1", "s", 1), ("p", "1", "s", 2), ("p", "2", "s", 3), ("p", "3", "t", 4), ("q", "1", None, 5), ("q", "1", None, 6)]
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = jobs.classify(stream).writeStream.format("memory").queryName("classes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r["path"], r["sha256"], r["change"]) for r in spark.table("classes").collect())
    assert got == [("p", "1", "full"), ("p", "1", "unchanged"), ("p", "2", "cosmetic"), ("p", "3", "full"), ("q", "1", "full"), ("q", "1", "full")]


def test_ingest_appends_each_batch_once(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "review.md").write_text(REVIEW)
    query = jobs.ingest(jobs.read_files(spark, str(tmp_path / "docs")), str(tmp_path / "log"), str(tmp_path / "ck"), NOW)
    try:
        query.processAllAvailable()
        assert query.exception() is None
    finally:
        query.stop()
    g = mutations.state(jobs.read_log(spark, str(tmp_path / "log")))
    assert (g.nodes.count(), g.edges.count(), g.evidence.count()) == (4, 5, 3)
    assert g.nodes.where(F.col("kind") == "Kpi").count() == 3
