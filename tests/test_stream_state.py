"""Windows, exactly-once handlers, measures and checked sinks of streams, over file streams, with restarts and crashes."""

import random

import pytest
from pyspark.sql import functions as F

from corrobora.plans.inputs import table
from corrobora.sources import files
from corrobora.streaming import exactly_once as O, metrics as M, windows as X

SF = "/root/testdata/sf0.001"


@pytest.fixture
def state_store(spark):
    for name, value in X.STATE_STORE.items():
        spark.conf.set(name, value)
    yield
    for name in X.STATE_STORE:
        spark.conf.unset(name)


def brute_windows(rows, capacity, min_span, at):
    """By definition, from (key, t, p, recorded, tie)."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[1] <= at), key=lambda r: (r[1], r[4]))
        samples = sorted({r[1]: r[2] for r in own if not r[3]}.items())[-capacity:]
        records = [(r[1], r[2]) for r in own if r[3]][-capacity:]
        if len(samples) < 2 or samples[-1][0] - samples[0][0] < min_span:
            continue
        gaps = sorted(b[0] - a[0] for a, b in zip(samples, samples[1:]))
        got = {}
        for t, p in records:
            if t >= samples[0][0] - gaps[len(gaps) // 2] / 2:
                got[min(range(len(samples)), key=lambda i: abs(samples[i][0] - t))] = p
        out += [(key, t, p, got.get(i)) for i, (t, p) in enumerate(samples)]
    return sorted(map(str, out))


def test_series_windows_against_definition(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcdef"), float(rng.randrange(600)), rng.random(), rng.random() < 0.3, f"{i:05d}") for i in range(500)]
    rows += [("g", 5.0, 0.5, False, "x"), ("h", 1.0, 0.1, False, "x"), ("h", 400.0, 0.1, False, "y"), ("h", 200.5, 0.9, True, "z"), ("h", -500.0, 0.9, True, "w")]
    odd = [(None, 1.0, 0.5, False, "q"), ("a", None, 0.5, False, "q"), ("a", 3.0, None, True, "q"), ("a", float("nan"), 0.5, False, "q")]
    df = spark.createDataFrame(rows + odd, "key string, t double, p double, r boolean, tie string")
    for capacity, span, at in ((360, 300.0, 1e9), (10, 30.0, 300.0), (2, 0.0, 1e9)):
        got = X.series_windows(df, "key", "t", "p", F.col("r"), "tie", capacity, span, at)
        assert sorted(str(tuple(r)) for r in got.collect()) == brute_windows(rows, capacity, span, at)
    assert X.series_windows(df.limit(0), "key", "t", "p", F.col("r"), "tie").count() == 0
    with pytest.raises(ValueError):
        X.series_windows(df, "key", "t", "p", F.col("r"), "tie", 10, 300.0, step=10.0)


def test_window_stream_equals_batch_over_a_restart(spark, state_store, tmp_path):
    e = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = e.agg((F.min("ts") + F.expr("INTERVAL 12 DAYS")).alias("cut")).first()["cut"]
    e.where(F.col("ts") < late).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 150).parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    day = 86400.0
    made = X.window_stream(stream, "user_id", "ts", "value", F.col("event_type") == "purchase", "event_id", capacity=15, period_s=3 * day, delay_s=day, idle_s=15 * day)
    start = lambda: made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert start().awaitTermination(120)
    before = spark.read.parquet(f"{tmp_path}/out").select("at").distinct().count()
    # the job ends; more events come; it goes on from its state
    e.where(F.col("ts") >= late).orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 150).parquet(f"{tmp_path}/in/1")
    assert start().awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    marks = [r[0] for r in out.select("at").distinct().orderBy("at").collect()]
    assert 0 < before < len(marks) and len(marks) >= 7
    rows = [(r["user_id"], r["t"], r["value"], r["event_type"] == "purchase", str(r["event_id"])) for r in e.withColumn("t", F.unix_micros("ts") / 1e6).collect()]
    for at in marks:
        got = sorted(str(tuple(r)) for r in out.where(F.col("at") == at).select("user_id", "t", "observed", "recorded").collect())
        assert got == brute_windows(rows, 15, 300.0, at), at


def test_idle_keys_are_forgotten(spark, state_store, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "k string, us long, p double, r boolean, i string").select("k", F.timestamp_micros("us").alias("ts"), "p", "r", "i").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    minute = 60_000_000
    put("0", [("a", i * minute, 0.5, False, f"a{i}") for i in range(10)])
    put("1", [("b", i * minute, 0.5, False, f"b{i}") for i in range(10, 200)])
    put("2", [("a", 201 * minute, 0.7, False, "new"), ("b", 260 * minute, 0.5, False, "end")])
    stream = spark.readStream.schema("k string, ts timestamp, p double, r boolean, i string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    made = X.window_stream(stream, "k", "ts", "p", F.col("r"), "i", capacity=100, min_span=300.0, period_s=1800.0, delay_s=0.0, idle_s=3600.0)
    assert made.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    a = spark.table("idle").where("k = 'a'")
    # its last sample is at nine minutes: out at 30, 60 and 90 minutes, then forgotten; the new sample alone makes no window
    assert sorted({r["at"] for r in a.collect()}) == [1800.0, 3600.0, 5400.0]
    assert a.where("observed = 0.7").count() == 0
    assert spark.table("idle").where("k = 'b'").groupBy("at").count().agg(F.max("count")).first()[0] == 100


def put_events(spark, folder, name, ids):
    spark.createDataFrame([(i, 1_700_000_000_000_000 + (h % 400) * 600_000_000, h) for i, h in ids], "event_id string, us long, h int").select("event_id", F.timestamp_micros("us").alias("t"), "h").coalesce(1).write.json(f"{folder}/{name}")


def numbered(n, m):
    return [(f"e{i}", i) for i in range(n, m)]


def test_each_event_once_over_crashes(spark, tmp_path, monkeypatch):
    put_events(spark, f"{tmp_path}/in", "0", numbered(0, 50) + numbered(0, 10))
    put_events(spark, f"{tmp_path}/in", "1", numbered(40, 90) + [(None, 1), (None, 1)])
    put_events(spark, f"{tmp_path}/in", "2", numbered(0, 120))
    effects, fail = [], {"left": 0, "crash": False}

    def handler(rows, batch_id):
        ids = [r["event_id"] for r in rows.collect()]
        if batch_id == 1 and fail["left"]:
            fail["left"] -= 1
            raise RuntimeError("handler")
        effects.extend(ids)

    def start(group):
        stream = spark.readStream.schema("event_id string, t timestamp, h int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
        return O.process_once(stream, handler, group, f"{tmp_path}/marks", f"{tmp_path}/c-{group}", "event_id", F.col("t"), retries=1, wait_s=0.0)

    want = sorted([f"e{i}" for i in range(120)])
    # a handler that fails once is tried again; one that fails for good undoes its marks and stops the stream
    fail["left"] = 3
    with pytest.raises(Exception, match="handler"):
        start("a").awaitTermination(120)
    assert not O.Marks(spark, f"{tmp_path}/marks", "a").has("begun", "batch=1") and not O.Marks(spark, f"{tmp_path}/marks", "a").has("done", "batch=1")
    start("a").awaitTermination(120)  # one failure is left, the retry goes through
    assert sorted(x for x in effects if x) == want and effects.count(None) == 2
    # stopped after the handler and its marks, before the stream's own commit
    effects.clear()
    commit = O.Marks.commit

    def crash(self, batch_id):
        commit(self, batch_id)
        if batch_id == 1:
            raise RuntimeError("crash")

    monkeypatch.setattr(O.Marks, "commit", crash)
    with pytest.raises(Exception, match="crash"):
        start("b").awaitTermination(120)
    monkeypatch.setattr(O.Marks, "commit", commit)
    start("b").awaitTermination(120)
    assert sorted(x for x in effects if x) == want
    # a new query of the same group, without its checkpoint: all was handled
    effects.clear()
    marks = O.Marks(spark, f"{tmp_path}/marks", "b")
    marks.compact("event_id", "string", keep=1)
    assert marks.done("event_id", "string").select("event_id").distinct().count() == 120 and marks.done("event_id", "string").select("batch").distinct().count() == 2
    marks.compact("event_id", "string", keep=1)
    again = spark.read.schema("event_id string, t timestamp, h int").option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    assert O.handle_once(marks, again.where("event_id IS NOT NULL"), 77, handler, "event_id", F.col("t")) and effects == []


def test_metrics_by_hand_and_as_a_stream(spark, tmp_path):
    u = spark.createDataFrame([("a", 10.0, 12.0, 15.0, 3.0, 1.0, None, 0.5), ("a", 30.0, 12.0, 15.0, 0.0, 0.0, 0.0, 1.0), ("b", 70.0, 71.0, None, 1.0, 1.0, 2.0, 0.5)], "k string, h double, b double, d double, o double, r double, pl double, p double")
    c = F.col
    measure = lambda df: M.event_metrics(df, c("h"), c("b"), c("d"), c("o"), c("r"), c("pl"), c("p"), ["k"], F.lit("x"))
    got = {(r["k"], r["name"], round(r["value"], 6)) for r in measure(u).where("at = 15").collect()}
    assert got == {("a", "update_latency", 3.0), ("a", "event_log_lag", 5.0), ("a", "event_log_lag", 0.0), ("a", "contrib_observed", 0.75), ("a", "contrib_record", 0.25), ("a", "contrib_plan", 0.0), ("a", "belief_entropy", 0.693147), ("a", "belief_entropy", 0.0)}
    for i in range(3):
        u.withColumn("d", c("d") + i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    log = M.TriggerLog("updates", seen.append)
    spark.streams.addListener(log)
    try:
        M.metric_stream(measure(M.watched(stream, "updates", c("h"))), f"{tmp_path}/out", f"{tmp_path}/c", 60.0, ("k",)).awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(log)
    out = M.flushed(spark.read.parquet(f"{tmp_path}/out"), "k")
    want = M.by_period(measure(spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")), 60.0, "k")
    pick = lambda df: sorted(str((r["period"], r["name"], r["k"], r["n"], round(r["total"], 6), r["least"], r["greatest"])) for r in df.collect())
    assert pick(out) == pick(want) and len(pick(out)) >= 6
    assert sum(s["input_rows"] for s in seen) == 9 and {s["latest"] for s in seen if s.get("rows")} == {70.0}


def test_checked_sink(spark, tmp_path):
    schema = "event_id string, type string, subject string, tx_time timestamp, modality string, p double, evidence array<struct<kind:string,ref:string,source:string,raw_score:double>>"
    now = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t").first()[0]
    ok = [(f"e{i}", "x.y", f"s{i % 3}", now, "observed", 0.5, None) for i in range(9)]
    bad = [(None, "x.y", "s", now, "observed", 0.5, None), ("b1", "x.y", " ", now, "observed", 0.5, None), ("b2", "x.y", "s", None, "observed", 0.5, None), ("b3", "x.y", "s", now, "seen", 0.5, None), ("b4", "x.y", "s", now, "inferred", 1.5, None), ("b5", "x.y", "s", now, "observed", 0.5, [("rule", None, None, None)]), ("b6", "x.y", "s", now, "inferred", None, [("rule", None, None, 2.0)])]
    good, mixed = spark.createDataFrame(ok, schema), spark.createDataFrame(ok + bad, schema)
    assert files.emit_events(good, str(tmp_path / "log")) == 9 and spark.read.json(str(tmp_path / "log")).count() == 9
    with pytest.raises(files.BadEnvelopes, match="7 of 16"):
        files.emit_events(mixed, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    faults = [r["fault"] for r in files.envelope_faults(mixed).where("fault IS NOT NULL").orderBy("event_id").collect()]
    assert faults == ["no event_id", "no subject", "no tx_time", "unknown modality", "p out of range", "observed with derived evidence", "evidence score out of range"]
    mixed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(mixed.schema).parquet(str(tmp_path / "in"))
    assert files.emit_stream(stream, str(tmp_path / "c"), str(tmp_path / "rejects"), str(tmp_path / "out")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 9 and spark.read.json(str(tmp_path / "rejects")).count() == 7
