"""Queries of resolutions, write-backs, effects, dwell, drift, weak labels and linear dynamics, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from .inputs import CLAIMS, EVENTS, claims, events, table
from .queries import query, r6

_T = "(epoch_us(o_orderdate) - 1704067200000000) / 1e6"


def _orders(spark, d):
    from .inputs import seconds

    return table(spark, d, "orders").withColumn("t", seconds("o_orderdate"))


@query("""
    WITH s AS (SELECT o_orderkey, list_distinct([o_custkey % 10, o_orderkey % 10]) AS subjects, CASE o_orderkey % 5 WHEN 0 THEN 'correction' WHEN 1 THEN 'negative_label' WHEN 2 THEN 'concept_candidate' WHEN 3 THEN 'observation_request' END AS output, o_totalprice / 500000 AS sev FROM orders),
    u AS (SELECT o_orderkey, unnest(subjects) AS subject, output, sev FROM s WHERE output IS NOT NULL)
    SELECT o_orderkey AS discrepancy, subject, fluent, output, round(CASE WHEN output = 'observation_request' THEN sev ELSE 1.0 END, 6) AS weight FROM u, (SELECT unnest(['place', 'state']) AS fluent)
""")
def h10_resolutions(spark, d):
    o = _orders(spark, d)
    cases = o.select(F.col("o_orderkey").alias("discrepancy"), F.array_distinct(F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 10)).alias("subjects"), F.array(F.lit("place"), F.lit("state")).alias("fluents"), (F.col("o_totalprice") / 500000).alias("severity"))
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("physical_correct", "record_correct", "both_wrong", "undetermined", "other")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    first = o.select(F.col("o_orderkey").alias("discrepancy"), F.lit("undetermined").alias("outcome"), F.lit(0).alias("at"))
    out = L.apply_resolution(cases, first.unionByName(o.select(F.col("o_orderkey").alias("discrepancy"), outcome.alias("outcome"), F.lit(1).alias("at"))))
    return out.withColumn("weight", r6("weight"))


@query("""
    SELECT 'undo-cmd-' || o_orderkey AS command_id, o_orderkey AS key, 'o_orderstatus' AS column_name, 'F' AS old_value, o_orderstatus AS new_value FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'F'
    UNION ALL SELECT 'cmd-' || o_orderkey, o_orderkey, 'o_orderstatus', o_orderstatus, 'F' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'F'
""")
def h11_write_back(spark, d):
    """Every order's status and colour are to be corrected; a third of the commands was applied, colours have no column."""
    o = table(spark, d, "orders")
    command = F.concat(F.lit("cmd-"), F.col("o_orderkey").cast("string")).alias("command_id")
    wanted = o.select(command, F.col("o_orderkey").alias("key"), F.explode(F.array(F.lit("status"), F.lit("colour"))).alias("property"), F.lit("F").alias("new_value"))
    now = o.select(F.col("o_orderkey").alias("key"), F.lit("status").alias("property"), F.col("o_orderstatus").alias("old_value"))
    mapping = spark.createDataFrame([("status", "o_orderstatus")], "property string, column_name string")
    diff, undo = L.write_back_plan(wanted, now, mapping, o.where("o_orderkey % 3 = 0").select(command))
    return diff.unionByName(undo)


@query(f"""
    WITH c AS (SELECT * FROM (VALUES ('F', 'shipped', 10), ('F', 'paid', 30), ('O', 'packed', 5)) v(action, fluent, days))
    SELECT o_orderkey AS plan, action, fluent, {_T} + days * 86400 AS deadline FROM orders JOIN c ON action = o_orderstatus WHERE o_orderkey % 4 <> 0
""")
def h14_contract_effects(spark, d):
    """Every fourth order was not executed."""
    a = _orders(spark, d).select(F.col("o_orderkey").alias("plan"), F.col("o_orderstatus").alias("action"), F.col("o_custkey").alias("target"), F.when(F.col("o_orderkey") % 4 != 0, F.col("t")).alias("executed_at"))
    c = spark.createDataFrame([("F", "shipped", 0.9, 1.0, 864000.0), ("F", "paid", 0.9, 1.0, 2592000.0), ("O", "packed", 0.8, 1.0, 432000.0)], "action string, fluent string, lower double, upper double, duration double")
    return L.expectations_for(a, c).select("plan", "action", "fluent", "deadline")


@query(f"""
    WITH {EVENTS}, l AS (SELECT unnest([0, 60, 300]) AS lead) SELECT event_id, lead, round(t + lead, 6) AS valid_from, round(p, 6) AS p FROM ev, l WHERE lead > 0 AND NOT (event_id % 2 = 0 AND lead = 60)
""")
def h19_predicted_rows(spark, d):
    """Each event forecasts three points, one of them no forecast; every second one's first is written already."""
    e = events(spark, d)
    points = F.array(*[F.struct(F.lit(lead).alias("lead"), F.col("p").alias("p")) for lead in (0, 60, 300)])
    f = e.select(F.col("event_id").alias("entity"), F.col("t").alias("origin"), points.alias("points"))
    done = f.where("entity % 2 = 0").select("entity", "origin", F.lit(60).alias("lead"))
    return L.forecast_assertions(f, "points", done).select(F.col("entity").alias("event_id"), "lead", r6("valid_from").alias("valid_from"), r6("p").alias("p"))


@query(f"""
    WITH {EVENTS}, s AS (SELECT user_id, t, event_id, sqrt((x - lag(x) OVER w) ** 2 + (p - lag(p) OVER w) ** 2) / (t - lag(t) OVER w) <= 0.01 AND sqrt(x ** 2 + p ** 2) <= 45 AS still FROM (SELECT user_id, t, min(event_id) AS event_id, min(x) AS x, min(p) AS p FROM ev GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    b AS (SELECT user_id, t, coalesce(still, FALSE) AS on_, row_number() OVER w - row_number() OVER (PARTITION BY user_id, coalesce(still, FALSE) ORDER BY t) AS run, lead(t) OVER w AS nx FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    r AS (SELECT user_id, min(t) AS "start", count(*) AS samples, coalesce(max(coalesce(nx, 1e18)), 0) AS nx, max(t) AS last FROM b WHERE on_ GROUP BY user_id, run), f AS (SELECT *, CASE WHEN nx >= 1e18 THEN last ELSE nx END AS stop FROM r)
    SELECT user_id, round("start", 6) AS "start", round(stop, 6) AS "end", samples FROM f WHERE stop > "start" AND stop - "start" >= 3600
""")
def e10_stationary_dwell(spark, d):
    e = events(spark, d).groupBy("user_id", "t").agg(F.min("x").alias("x"), F.min("p").alias("p"))
    out = L.stationary_dwell(e, ["user_id"], "t", "x", "p", (0.0, 0.0), 45.0, 0.01, 3600.0)
    return out.select("user_id", r6("start").alias("start"), r6("end").alias("end"), "samples")


@query("""
    WITH a AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'scan' WHEN 'click' THEN 'gate_in' WHEN 'purchase' THEN 'gate_out' WHEN 'error' THEN 'scale' ELSE 'other' END AS kind, user_id % 25 AS place FROM events), z AS (SELECT n_nationkey AS place, CASE n_regionkey WHEN 0 THEN 'storage' WHEN 1 THEN 'pick' ELSE 'aisle' END AS use FROM nation),
    s AS (SELECT event_id, CASE kind WHEN 'gate_in' THEN 'receiving' WHEN 'gate_out' THEN 'shipping' WHEN 'scale' THEN 'inspecting' WHEN 'scan' THEN CASE use WHEN 'storage' THEN 'storing' WHEN 'pick' THEN 'picking' END END AS biz_step FROM a LEFT JOIN z USING (place))
    SELECT * FROM s WHERE biz_step IS NOT NULL
""")
def e13_zone_steps(spark, d):
    from ..functions.scalar import lookup

    kind = lookup("event_type", {"view": "scan", "click": "gate_in", "purchase": "gate_out", "error": "scale"}, "other")
    a = table(spark, d, "events").select("event_id", kind.alias("kind"), (F.col("user_id") % 25).alias("place"))
    z = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.when(F.col("n_regionkey") == 0, "storage").when(F.col("n_regionkey") == 1, "pick").otherwise("aisle").alias("use"))
    return L.business_events(a, z).select("event_id", "biz_step")


@query(f"""
    WITH {EVENTS}, a AS (SELECT event_id, event_type, floor(value / 10)::BIGINT AS zone, user_id FROM ev WHERE event_id % 10 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS event_type, floor(value / 10)::BIGINT + (event_id % 3 = 0)::INT AS zone, user_id FROM ev WHERE event_id % 11 <> 0)
    SELECT coalesce(b.event_type, a.event_type) AS event_type, count(a.event_id) AS before, count(b.event_id) AS after, count(*) FILTER (a.event_id = b.event_id) AS matched, count(*) FILTER (a.zone <> b.zone) AS zone_changed, count(*) FILTER (a.user_id <> b.user_id) AS user_id_changed FROM a FULL JOIN b USING (event_id) GROUP BY 1
""")
def d43_drift_rows(spark, d):
    e = events(spark, d).select("event_id", "event_type", F.floor(F.col("value") / 10).alias("zone"), "user_id")
    later = e.withColumn("event_type", F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type"))).withColumn("zone", F.col("zone") + (F.col("event_id") % 3 == 0).cast("int"))
    return L.drift_report(e.where("event_id % 10 <> 0"), later.where("event_id % 11 <> 0"), "event_id", ["zone", "user_id"], "event_type")


@query(f"""
    WITH {EVENTS}, g AS (SELECT t - lag(t) OVER (PARTITION BY user_id, t >= 1296000 ORDER BY t, event_id) AS gap, t >= 1296000 AS late FROM ev), r AS (SELECT late, gap, rank() OVER (ORDER BY gap) AS lo, count(*) OVER (PARTITION BY gap) AS same FROM g WHERE gap IS NOT NULL),
    n AS (SELECT count(*) FILTER (late) AS p, count(*) FILTER (NOT late) AS q, sum(lo + (same - 1) / 2) FILTER (late) AS ranks FROM r) SELECT round((ranks - p * (p + 1) / 2) / (p * q), 6) AS auroc, p AS positives, q AS negatives FROM n
""")
def d43_drift_auroc(spark, d):
    e = events(spark, d)
    out = L.drift_auroc(e.where("t < 1296000"), e.where("t >= 1296000"), ["user_id"], "t", "event_id")
    return out.select(r6("auroc").alias("auroc"), "positives", "negatives")


@query(f"""
    WITH {EVENTS}, s AS (SELECT event_type, t % 600 AS seconds, value > 30 AS correct, event_id % 3 = 0 AS reflected, list_transform(range(10), lambda i: (event_id + i) % 5 + 1) AS answers, event_id FROM ev),
    u AS (SELECT event_type, seconds, correct, reflected, 2.5 * (list_sum(list_transform(range(10), lambda i: CASE WHEN i % 2 = 0 THEN answers[i + 1] - 1 ELSE 5 - answers[i + 1] END))) AS score FROM s)
    SELECT event_type, count(*) AS cases, round(avg(seconds), 4) AS mean_seconds, round(avg(correct::INT), 6) AS correct_rate, round(avg(reflected::INT), 6) AS reflected_rate, round(avg(score), 6) AS usability FROM u GROUP BY 1
""")
def d44_resolution_summary_by_condition(spark, d):
    e = events(spark, d).withColumn("seconds", F.col("t") % 600).withColumn("correct", F.col("value") > 30).withColumn("reflected", F.col("event_id") % 3 == 0)
    e = e.withColumn("answers", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("event_id") + i) % 5 + 1))
    one = L.resolution_summary(e, "event_type", "seconds", "correct", "reflected")
    score = e.groupBy("event_type").agg(r6(F.avg(L.usability_score("answers"))).alias("usability"))
    return one.join(score, "event_type").select("event_type", "cases", F.round("mean_seconds", 4).alias("mean_seconds"), r6("correct_rate").alias("correct_rate"), r6("reflected_rate").alias("reflected_rate"), "usability")


@query(f"""
    WITH {EVENTS}, b AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE t + 60 END AS stop, t, CASE WHEN event_id % 10 = 0 THEN 0.5 ELSE p END AS p, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 10 END AS u FROM ev), h AS (SELECT *, greatest(coalesce(u, 0), 300) AS half FROM b WHERE p <> 0.5)
    SELECT event_id, round(t - half, 6) AS bag_start, round(coalesce(stop, t) + half, 6) AS bag_end, p > 0.5 AS positive, round(greatest(abs(2 * p - 1), 1e-3), 6) AS weight FROM h
""")
def k01_bags(spark, d):
    e = events(spark, d).withColumn("stop", F.when(F.col("event_type") != "view", F.col("t") + 60)).withColumn("p", F.when(F.col("event_id") % 10 == 0, F.lit(0.5)).otherwise(F.col("p"))).withColumn("u", F.when(F.col("event_id") % 3 != 0, F.col("value") * 10))
    out = L.weak_label_bags(e, "p", "t", "stop", "u")
    return out.select("event_id", r6("bag_start").alias("bag_start"), r6("bag_end").alias("bag_end"), "positive", r6("weight").alias("weight"))


@query(f"""
    WITH {CLAIMS}, b AS (SELECT subject AS entity, source % 25 AS place, method AS kind, confidence, line AS tx FROM cl WHERE confidence >= 0.7), n AS (SELECT entity, max(tx) AS tx FROM b GROUP BY 1), w AS (SELECT DISTINCT entity, place, kind FROM b JOIN n USING (entity, tx)),
    cap AS (SELECT n_nationkey AS place, 20 + n_nationkey AS most FROM nation), r AS (SELECT DISTINCT place, kind FROM w WHERE kind IN ('A', 'R')), adj AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey % 2 = 0)
    SELECT entity::VARCHAR AS focus, 'several places' AS message, 'violation' AS severity FROM w GROUP BY entity HAVING count(DISTINCT place) > 1 UNION ALL SELECT place::VARCHAR, 'over capacity', 'violation' FROM w JOIN cap USING (place) GROUP BY place, most HAVING count(DISTINCT entity) > most
    UNION ALL SELECT DISTINCT x.place::VARCHAR, 'hazardous neighbours', 'warning' FROM r x JOIN adj ON x.place IN (a, b) JOIN r y ON y.place = CASE WHEN x.place = a THEN b ELSE a END AND x.kind <> y.kind
""")
def b18_shapes(spark, d):
    c = claims(spark, d).select(F.col("subject").alias("entity"), (F.col("source") % 25).alias("place"), F.col("method").alias("kind"), "confidence", F.col("line").alias("tx"))
    n = table(spark, d, "nation")
    cap = n.select(F.col("n_nationkey").alias("place"), (F.col("n_nationkey") + 20).alias("most"))
    adjacent = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    return L.validate_structure(c, cap, ["A", "R"], adjacent)


@query(f"""
    WITH {EVENTS}, l AS (SELECT value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS x FROM ev), s AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM l WHERE x IS NOT NULL)
    SELECT round(a, 4) AS slope, round(b, 3) AS intercept, count(*) AS n, round(avg((y - a * x - b) ** 2), 3) AS noise, round(sum((y - a * x - b) ** 2) / sum((y - x) ** 2), 4) AS relative_error FROM l, s WHERE x IS NOT NULL GROUP BY a, b
""")
def k06_linear_fit(spark, d):
    """One delay, so that SQL's regression gives the same; the sums are taken on Spark, the result is one row."""
    w, noise, relative, n = L.fit_linear_dynamics(events(spark, d), ["user_id"], ["t", "event_id"], "value", 1, 1e-9)
    row = (round(w[0], 4), round(w[1], 3), n, round(noise, 3), round(relative, 4))
    return spark.createDataFrame([row], "slope double, intercept double, n long, noise double, relative_error double")
