"""Readers on files written here, and streams against their batch form."""

import json

from pyspark.sql import functions as F

from corrobora.operators import assignment as A, belief_filter as B
from corrobora.plans.inputs import events
from corrobora.sources import files
from corrobora.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_episodes(spark, tmp_path):
    for e in ("e1", "e2"):
        (tmp_path / e).mkdir()
        spark.createDataFrame([("anchor", "p1", "g1", None, None, None, "z", None, 1.0, 2.0)], files.EPISODE).coalesce(1).write.parquet(str(tmp_path / e / "events.parquet"))
        (tmp_path / e / "meta.json").write_text(json.dumps({"seed": e}))
    got = files.read_episodes(spark, str(tmp_path)).orderBy("episode").collect()
    assert [(r["episode"], json.loads(r["meta"])["seed"], r["entity"]) for r in got] == [("e1", "e1", "p1"), ("e2", "e2", "p1")]


def test_observation_windows(spark, tmp_path):
    good = {"entity": "m1", "channels": ["a", "b"], "timestamps": [1.0, 2.0], "values": [[1.0, 2.0], [3.0, 4.0]]}
    lines = [good, good | {"entity": " "}, good | {"timestamps": [2.0, 2.0]}, good | {"values": [[1.0, 2.0]]}, good | {"values": [[1.0, None], [3.0, 4.0]]}, good | {"timestamps": [1.0], "values": [[1.0, 2.0]]}]
    (tmp_path / "w.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    samples, rejects = files.read_observation_windows(spark, str(tmp_path / "w.jsonl"))
    assert samples.count() == 6 and samples.agg(F.sum("value")).first()[0] == 13.0
    assert sorted(r["reason"] for r in rejects.collect()) == ["no entity", "shape", "times do not increase", "unreadable", "value not finite"]


def test_business_tables(spark, tmp_path):
    (tmp_path / "bins.csv").write_text('bin_id,frame,position_json\nb1,map,"[1.0, 2.0, 3.0]"\n')
    (tmp_path / "inventory.csv").write_text("item_id,bin,mass_kg\ni1,b1,2.5\n")
    (tmp_path / "work_orders.csv").write_text("work_order_id,source_bin,target_location,item_id,status,priority\nw1,b1,t,i1,open,high\n")
    t = files.read_business_tables(spark, str(tmp_path))
    assert t["bins"].first()["position"] == [1.0, 2.0, 3.0] and t["inventory"].first()["mass_kg"] == 2.5 and t["work_orders"].count() == 1


def test_event_log_round_trip_and_dedupe(spark, tmp_path):
    e = spark.createDataFrame([(f"e{i % 5}", "x.y", f"s{i % 2}", None, f"2024-01-01 00:00:0{i}", "observed", 0.5, None) for i in range(8)], "event_id string, type string, subject string, valid_time string, tx_time string, modality string, p double, evidence string")
    e = e.withColumn("tx_time", F.col("tx_time").cast("timestamp")).drop("valid_time", "evidence")
    files.emit_events(e, str(tmp_path / "log"))
    stream = jobs.dedupe_events(files.event_stream(spark, str(tmp_path / "log"), files_per_trigger=100), "event_id", "tx_time")
    q = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("deduped").select("event_id").distinct().count() == spark.table("deduped").count() == 5


def test_belief_stream_equals_batch(spark, tmp_path):
    e = events(spark, SF).select("user_id", "t", F.when(F.col("event_type") == "purchase", "claim").otherwise("observed").alias("kind"), "p", F.lit("s").alias("source"))
    e.where("t < 1000000").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    e.where("t >= 1000000").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = jobs.belief_stream(stream, "user_id", idle_ms=None)
    q = out.writeStream.format("memory").queryName("beliefs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    last = spark.table("beliefs").groupBy("user_id").agg(F.max_by("p", "t").alias("p"), F.count("*").alias("n"))
    want = B.belief_filter(e, ["user_id"], ["t"]).groupBy("user_id").agg(F.max_by("p", "t").alias("p"), F.count("*").alias("n"))
    assert {(r[0], round(r[1], 9), r[2]) for r in last.collect()} == {(r[0], round(r[1], 9), r[2]) for r in want.collect()}


def test_standing_queries_and_period(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["b"])], "id int, tags array<string>").write.json(str(tmp_path / "in"))
    q = spark.createDataFrame([("q1", ["b"]), ("q2", ["c", "x"])], "query_id string, tags array<string>")
    stream = spark.readStream.schema("id int, tags array<string>").json(str(tmp_path / "in"))
    seen = []
    jobs.periodic(jobs.standing_queries(stream, q, "tags", "id"), lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(seen) == [("q1", 1), ("q1", 3), ("q2", 2)]


def test_watermarks_and_replay(spark):
    marks = spark.createDataFrame([("a", 5.0), ("b", 9.0)], "k string, mark double")
    new = spark.createDataFrame([("a", 6.0), ("b", 7.0), ("c", 1.0)], "k string, t double")
    assert sorted(r["k"] for r in jobs.only_new(new, marks, ["k"], "t").collect()) == ["a", "c"]
    assert sorted(map(tuple, jobs.advance_watermark(marks, new, ["k"], "t").collect())) == [("a", 6.0), ("b", 9.0), ("c", 1.0)]
    log = spark.range(1000).withColumn("source", F.when(F.col("id") < 100, "cam.1").when(F.col("id") < 998, "x"))
    through = log.where("id >= 100 AND id % 5 <> 0").select("id")
    got = {r["reason"]: r["count"] for r in jobs.delivery_report(log, through, "id", "source").groupBy("reason").count().collect()}
    assert got == {"partition": 100, "drop": 180, None: 720}
    assert jobs.unacknowledged(log.withColumnRenamed("id", "command_id"), spark.range(10).withColumnRenamed("id", "command_id")).count() == 990


def test_assignment_is_best():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        c = rng.random((n, m)).round(2)
        got = A.assign(c)
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        small = c if n <= m else c.T
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(int(max(n, m))), int(min(n, m))))
        assert abs(sum(c[i, j] for i, j in got) - best) < 1e-9
