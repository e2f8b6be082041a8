from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrylens.streaming import net

T0 = datetime(2024, 1, 1)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_lifecycle(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        (1, at(0), "a", "req", "http://x/1", "GET", None, None, None),
        (2, at(1), "a", "redirect", "http://x/2", "GET", None, None, None),
        (3, at(2), "a", "res", None, None, 200, "text/html", 10),
        (4, at(3), "b", "req", "http://x/3", "POST", None, None, None),
        (5, at(4), "b", "fail", None, None, None, None, None),
        (6, at(5), "c", "req", "http://x/4", "GET", None, None, None),
    ]
    write(spark, tmp_path / "in", rows, net.EVENT)
    events = net.read_events(spark, str(tmp_path / "in"))
    out = {r.req_id: r for r in net.run_once(net.lifecycle(events), "life", str(tmp_path / "ck")).collect()}
    assert out["a"].state == "finished" and out["a"].url == "http://x/2" and out["a"].redirects == ["http://x/1"] and out["a"].status == 200
    assert out["b"].state == "failed" and "c" not in out


def test_batch_and_stream_counts_agree(spark, tmp_path, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = events.agg(F.max("ts")).first()[0] + timedelta(days=2)
    events.limit(1).withColumn("ts", F.lit(late)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = net.read_events(spark, str(tmp_path / "in"), schema=events.schema, files_per_trigger=8)
    got = net.run_once(net.window_counts(stream, "event_type", "value"), "win", str(tmp_path / "ck"))
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(map(tuple, got.where(F.col("start") < late - timedelta(days=1)).select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_changed_bodies_and_repeats(spark, tmp_path):
    rows = [("u", T0 + timedelta(seconds=k), b) for k, b in enumerate(["a", "a", "b", "a"])]
    write(spark, tmp_path / "in", rows, "url string, ts timestamp, body string")
    bodies = net.read_events(spark, str(tmp_path / "in"), schema="url string, ts timestamp, body string")
    out = net.run_once(net.changed_bodies(bodies), "bodies", str(tmp_path / "c1"))
    assert [r.body for r in out.orderBy("ts").collect()] == ["a", "b", "a"]
    once = net.run_once(net.without_repeats(bodies, ["url", "body"]), "once", str(tmp_path / "c2"))
    assert sorted(r.body for r in once.collect()) == ["a", "b"]
