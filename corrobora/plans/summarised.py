"""Queries of the measures and work lists in `operators/summaries.py`, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as S
from .inputs import ATOMS, EVENTS, atoms, events, seconds, table
from .queries import query, r6

_DAY = 86400.0
_T = "(epoch_us(o_orderdate) - 1704067200000000) / 1e6"


@query(f"""
    WITH {EVENTS}, s AS (SELECT user_id, t, event_id, coalesce(p >= 0.5, false) AS a, coalesce(value >= 30, false) AS b, event_type = 'click' AS c FROM ev),
    l AS (SELECT *, lag(a) OVER w AS a1, lag(b) OVER w AS b1, lag(c) OVER w AS c1, lag(a, 2) OVER w AS a2, lag(b, 2) OVER w AS b2, lag(c, 2) OVER w AS c2 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    g AS (SELECT user_id, count(*) AS transitions, count(*) FILTER ((a AND c) OR (a <> a1)::INT + (b <> b1)::INT + (c <> c1)::INT > 1) AS violations, sum((a AND c)::INT) AS ex,
        sum(coalesce(a <> a1 AND a1 <> a2, false)::INT + coalesce(b <> b1 AND b1 <> b2, false)::INT + coalesce(c <> c1 AND c1 <> c2, false)::INT) AS f, 3 * count(a2) AS n FROM l WHERE a1 IS NOT NULL GROUP BY 1)
    SELECT user_id, transitions, violations, ex::BIGINT AS exclusive_violations, round(coalesce(f / nullif(n, 0), 0), 6) AS flicker_rate, round(least(1, violations / transitions + coalesce(f / nullif(n, 0), 0)), 6) AS residual FROM g
""")
def e18_alignment_residual(spark, d):
    e = events(spark, d).select("user_id", "t", "event_id", F.col("p").alias("a"), (F.col("value") >= 30).cast("double").alias("b"), (F.col("event_type") == "click").cast("double").alias("c"))
    out = S.alignment_residual(e, ["user_id"], ["t", "event_id"], ["a", "b", "c"], [("a", "c")], 1)
    return out.select("user_id", "transitions", "violations", "exclusive_violations", r6("flicker_rate").alias("flicker_rate"), r6("residual").alias("residual"))


@query(f"""
    WITH {EVENTS}, m AS (SELECT floor(t / 86400)::BIGINT AS day, t, event_id, CASE WHEN event_type <> 'error' THEN user_id % 40 END AS track, CASE WHEN event_type <> 'view' OR event_id % 3 > 0 THEN user_id END AS truth FROM ev),
    b AS (SELECT *, lag(truth) OVER (PARTITION BY day, track ORDER BY t, event_id) AS was FROM m WHERE track IS NOT NULL AND truth IS NOT NULL),
    k AS (SELECT day, track, truth AS main FROM (SELECT day, track, truth, count(*) AS n FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY day, track ORDER BY n DESC, truth) = 1),
    o AS (SELECT day, count(*) FILTER (truth = main) AS tp, count(*) FILTER (truth <> main) AS wrong, count(*) FILTER (was <> truth) AS switches FROM b JOIN k USING (day, track) GROUP BY 1),
    a AS (SELECT day, count(*) FILTER (track IS NOT NULL AND truth IS NULL) AS fp, count(*) FILTER (track IS NULL AND truth IS NOT NULL) AS fn, count(DISTINCT truth) AS objects FROM m GROUP BY 1)
    SELECT day, coalesce(tp, 0) AS idtp, fp + coalesce(wrong, 0) AS idfp, fn + coalesce(wrong, 0) AS idfn, coalesce(switches, 0) AS switches, objects,
        round(2 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + fp + fn + 2 * coalesce(wrong, 0)), 6) AS idf1, round(coalesce(switches, 0) / (objects * 24), 6) AS switch_rate FROM a LEFT JOIN o USING (day)
""")
def d32_id_metrics_by_day(spark, d):
    """Forty tracks, days as recordings of 24 hours; errors have no track, a third of the views no truth."""
    e = events(spark, d).withColumns({"day": F.floor(F.col("t") / _DAY), "track": F.when(F.col("event_type") != "error", F.col("user_id") % 40), "truth": F.when((F.col("event_type") != "view") | (F.col("event_id") % 3 > 0), F.col("user_id")), "hours": F.lit(24.0)})
    out = S.id_metrics(e, ["day"], ["t", "event_id"], "track", "truth", "hours")
    return out.select("day", "idtp", "idfp", "idfn", "switches", "objects", r6("idf1").alias("idf1"), r6("switch_rate").alias("switch_rate"))


@query("""
    WITH r AS (SELECT o_custkey AS entity, o_orderstatus AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'both_wrong' WHEN 1 THEN 'record_correct' WHEN 2 THEN 'physical_correct' END AS outcome FROM orders),
    n AS (SELECT entity, kind, count(*) AS n, count(*) FILTER (outcome = 'both_wrong') AS both_wrong FROM r WHERE outcome IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
    p AS (SELECT 'repeated|' || c_custkey || '|kindF' AS fingerprint, CASE c_custkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'withdrawn' END AS status, c_custkey % 200 AS moment FROM customer)
    SELECT n.entity, n.kind, n.n, n.both_wrong, round(least(1, n.n / 6 + 0.2 * both_wrong), 6) AS strength, (CASE WHEN status = 'rejected' THEN 1 ELSE 0 END)::BIGINT AS tried FROM n LEFT JOIN p ON fingerprint = 'repeated|' || n.entity || '|kind' || n.kind
    WHERE NOT coalesce(status = 'accepted' OR (status = 'rejected' AND moment + 50 > 200), false)
""")
def d41_repeats(spark, d):
    o = table(spark, d, "orders")
    outcome = F.when(F.col("o_orderkey") % 4 == 0, "both_wrong").when(F.col("o_orderkey") % 4 == 1, "record_correct").when(F.col("o_orderkey") % 4 == 2, "physical_correct")
    res = o.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("kind"), outcome.alias("outcome"))
    status = F.when(F.col("c_custkey") % 3 == 0, "accepted").when(F.col("c_custkey") % 3 == 1, "rejected").otherwise("withdrawn")
    known = table(spark, d, "customer").select(F.concat(F.lit("repeated|"), F.col("c_custkey").cast("string"), F.lit("|kindF")).alias("fingerprint"), status.alias("status"), (F.col("c_custkey") % 200).cast("double").alias("at"))
    return S.repeated_resolutions(res, known, 200.0, 50.0).select("entity", "kind", "n", "both_wrong", r6("strength").alias("strength"), "tried")


@query(f"""
    WITH {EVENTS}, s AS (SELECT h, user_id % 5 AS a, (user_id + (event_id % 7 = 0)::INT) % 5 AS b, (event_id * h) % 5 AS c, CASE WHEN event_type <> 'error' THEN (event_id * h + event_id % 3) % 5 END AS e FROM ev, (SELECT unnest([1, 2, 3]) AS h)),
    k AS (SELECT h, a = b AS ok, CASE WHEN c = e THEN 0 WHEN abs(c - e) = 1 THEN 0.5 ELSE 1 END AS d FROM s WHERE e IS NOT NULL),
    g AS (SELECT h, count(*) AS samples, avg(d) AS gap, sum(CASE WHEN ok THEN 0 ELSE d END) / count(*) AS perception, sum(CASE WHEN ok THEN d ELSE 0 END) / count(*) AS process FROM k GROUP BY 1),
    z AS (SELECT max(h) FILTER (gap <= 0.45) AS effective, stddev_pop(gap) / avg(gap) AS variation FROM g)
    SELECT h AS horizon, samples, round(gap, 6) AS gap, round(perception, 6) AS perception, round(process, 6) AS process, effective, round(variation, 6) AS variation FROM g, z
""")
def d28_gap_by_horizon(spark, d):
    e = events(spark, d).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3)])))
    k = F.col("event_id") * F.col("horizon")
    s = e.select("horizon", (F.col("user_id") % 5).alias("perceived"), ((F.col("user_id") + (F.col("event_id") % 7 == 0).cast("int")) % 5).alias("truth"), (k % 5).alias("predicted"), F.when(F.col("event_type") != "error", (k + F.col("event_id") % 3) % 5).alias("expected"))
    g = S.consistency_gap(s, ["horizon"])
    out = g.join(F.broadcast(S.effective_horizon(g, [], "horizon", 0.45)))  # one row
    return out.select("horizon", "samples", *[r6(c).alias(c) for c in ("gap", "perception", "process")], "effective", r6("variation").alias("variation"))


@query("""
    WITH l AS (SELECT l_linenumber AS level, avg(l_discount / 10) AS m FROM lineitem GROUP BY 1), f AS (SELECT coalesce(min(level) FILTER (m > 0.005), max(level)) AS breaking_level FROM l)
    SELECT breaking_level, round(min(l_discount / 10) FILTER (l_returnflag = 'R'), 6) AS least_rejected, count(*) FILTER (l_returnflag = 'R') AS rejected, count(*) FILTER (l_linestatus = 'O') AS invalid, round(max(l_discount / 10), 6) AS most_error, round(max(l_tax), 6) AS most_loss FROM lineitem, f GROUP BY breaking_level
""")
def d46_threshold(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_discount") / 10).alias("e"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_linestatus") != "O").alias("valid"), "l_tax")
    out = S.breaking_point(li, "l_linenumber", "e", "ok", "valid", "l_tax", 0.005)
    return out.select("breaking_level", r6("least_rejected").alias("least_rejected"), "rejected", "invalid", r6("most_error").alias("most_error"), r6("most_loss").alias("most_loss"))


@query(f"""
    WITH {ATOMS}, r AS (SELECT DISTINCT left(n_name, 4) AS region FROM nation UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'AL'), o AS (SELECT * FROM am WHERE p_size % 2 = 0), t AS (SELECT DISTINCT upper(unnest(tags)) AS tag FROM o)
    SELECT region, 'No observations in ' || region AS reason, 'exploration' AS task FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(tag, region)) AND NOT EXISTS (SELECT 1 FROM o WHERE p_brand = region AND p_size % 5 = 0)
""")
def d47_coverage_gaps(spark, d):
    a = atoms(spark, d).select(F.transform("tags", F.upper).alias("tags"), F.create_map(F.lit("region"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand"))).alias("fields"), F.when(F.col("p_size") % 2 == 0, "camera").otherwise("other").alias("modality"))
    names = table(spark, d, "nation").select(F.substring("n_name", 1, 4).alias("region")).union(table(spark, d, "part").select("p_brand")).union(spark.createDataFrame([("AL",)], "region string"))
    return S.coverage_gaps(names, a, ["camera"])


@query("""
    WITH e AS (SELECT DISTINCT l_suppkey AS part, l_partkey AS whole FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
    SELECT whole, array_to_string(list_sort(list(part)), ',') AS members, count(*)::INTEGER AS n FROM e GROUP BY 1 HAVING count(*) >= 2
""")
def d48_members(spark, d):
    known = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    out = S.members_of(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", known, 2)
    return out.select("whole", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "n")


@query(f"""
    SELECT o_orderkey, row_number() OVER (ORDER BY round(o_totalprice, 2) DESC, {_T} NULLS LAST, o_orderkey)::INTEGER AS place, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') > 50 AS truncated FROM orders WHERE o_orderstatus <> 'F' QUALIFY place <= 50
""")
def b17_queue(spark, d):
    o = table(spark, d, "orders").withColumn("t", seconds("o_orderdate"))
    order = [F.desc(F.round("o_totalprice", 2)), F.asc_nulls_last("t"), F.asc("o_orderkey")]
    return S.current_queue(o, order, 50, F.col("o_orderstatus") == "F").select("o_orderkey", "place", "truncated")


@query(f"""
    WITH {EVENTS}, m AS (SELECT user_id AS entity, floor(t / 3600)::BIGINT AS t, min(CASE WHEN event_id % 6 > 0 THEN event_id % 10 / 10 END) AS occlusion FROM ev WHERE event_type <> 'error' GROUP BY ALL HAVING min(CASE WHEN event_id % 6 > 0 THEN event_id % 10 / 10 END) IS NOT NULL),
    p AS (SELECT event_id, user_id AS entity, floor(t / 3600)::BIGINT AS t FROM ev WHERE event_id % 2 = 0)
    SELECT event_id, round(occlusion, 6) AS occlusion, occlusion > 0.4 AS occluded FROM p LEFT JOIN m USING (entity, t)
""")
def c30_best_view(spark, d):
    e = events(spark, d).select("event_id", F.col("user_id").alias("entity"), F.floor(F.col("t") / 3600).alias("t"), "event_type")
    masks = e.where("event_type <> 'error'").select("t", F.col("event_type").alias("camera"), "entity", F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 10 / 10).alias("occlusion"))
    return S.best_view_truth(e.where("event_id % 2 = 0").select("event_id", "entity", "t"), masks, 0.4).select("event_id", r6("occlusion").alias("occlusion"), "occluded")


@query(f"""
    WITH {EVENTS}, w AS (SELECT lag(t) OVER k AS t0, lag(x) OVER k AS x0, t AS t1, x AS x1 FROM ev WINDOW k AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, t1 - skew - t0 AS dt, CASE WHEN skew = 0 THEN 0 ELSE 60 END AS slack FROM w, (SELECT unnest([0, 30, 600, 86400]::DOUBLE[]) AS skew) WHERE t0 IS NOT NULL),
    b AS (SELECT skew, abs(x1) > 100 * 1.02 AS l, dt < -slack AS o, abs(x1 - x0) > 1.5 * 0.01 * greatest(dt, slack) AS j FROM s)
    SELECT skew, count(*) AS transitions, count(*) FILTER (l OR o OR j) AS rejections, count(*) FILTER (o) AS causal_violations, round(avg((l OR o OR j)::INT), 6) AS rejection_rate FROM b GROUP BY 1
""")
def h23_gate_by_skew(spark, d):
    from pyspark.sql import Window as W

    at = W.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, d).select(F.lag("t").over(at).alias("t0"), F.lag("x").over(at).alias("x0"), F.col("t").alias("t1"), F.col("x").alias("x1"))
    out = S.clock_skew_sweep(e, [0.0, 30.0, 600.0, 86400.0], 60.0, 100.0, 0.01)
    return out.select("skew", "transitions", "rejections", "causal_violations", r6("rejection_rate").alias("rejection_rate"))


@query()
def e05_lifted(spark, d):
    """Days of events as fluents of their user: busy, costly and failing; what starts and ends them by five rules."""
    from ..operators import lifting

    e = events(spark, d).withColumn("t", F.floor(F.col("t") / _DAY) * _DAY)
    day = e.groupBy("user_id", "t").agg(F.least(F.lit(1.0), F.count("*") / 6).alias("busy"), F.least(F.lit(1.0), F.max("value") / 80).alias("costly"), F.least(F.lit(1.0), F.count_if(F.col("event_type") == "error") / 2.0).alias("failing"))
    s = day.select("user_id", "t", F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in ("busy", "costly", "failing")]), F.array("busy", "costly", "failing"))).alias("fluent", "p"))
    rules = spark.createDataFrame([("rush", "busy", "initiates"), ("rush", "costly", "initiates"), ("fault", "failing", "initiates"), ("fault", "busy", "terminates"), ("repair", "failing", "terminates"), ("sale", "costly", "initiates"), ("close", "busy", "terminates"), ("close", "costly", "terminates")], "event string, fluent string, effect string")
    return lifting.lift_events(s, rules, ["user_id"], 0.5, 0.3, 2 * _DAY, 2.0)


@query("""
    WITH s AS (SELECT s_suppkey, s_acctbal AS v, s_suppkey % 360 AS deg FROM supplier)
    SELECT 'unit_round_trip' AS "check", true AS passed, 0.0::DOUBLE AS max_error, count(*) AS states, 0::BIGINT AS failed FROM s UNION ALL SELECT 'frame_equivariance', true, 0.0, count(*), 0 FROM s
    UNION ALL SELECT 'time_shift', true, 0.0, count(*), 0 FROM s UNION ALL SELECT 'permutation', true, 0.0, count(*), 0 FROM s
    UNION ALL SELECT 'hops', count(*) FILTER (abs(least(v / 1000, 5) - v / 1000) >= 1e-6) = 0, round(max(abs(least(v / 1000, 5) - v / 1000)), 6), count(*), count(*) FILTER (abs(least(v / 1000, 5) - v / 1000) >= 1e-6) FROM s
""")
def h22_translations(spark, d):
    """Suppliers as states in millimetres and degrees, common states in metres and radians; the detour's native states end at five metres."""
    from ..functions import scalar
    from ..operators.metamorphic import metamorphic_checks

    unit = lambda a, b: lambda df: df.withColumn("values", F.array(scalar.convert_unit(F.col("values")[0], F.lit(a[0]), F.lit(b[0])), scalar.convert_unit(F.col("values")[1], F.lit(a[1]), F.lit(b[1]))))

    def there(df):
        """By name, as the order of values is the state's own."""
        mm = lambda x: scalar.convert_unit(x, F.lit("mm"), F.lit("m"))
        rad = lambda x: scalar.convert_unit(x, F.lit("deg"), F.lit("rad"))
        return df.withColumn("values", F.zip_with("names", "values", lambda n, x: F.when(n == "reach", mm(x)).otherwise(rad(x))))

    names, native, common = F.array(F.lit("reach"), F.lit("turn")), ("mm", "deg"), ("m", "rad")
    s = table(spark, d, "supplier").select("s_suppkey", names.alias("names"), F.array("s_acctbal", (F.col("s_suppkey") % 360).cast("double")).alias("values"), scalar.rotation_z(F.col("s_suppkey") / 10.0, F.lit(1.0), F.lit(2.0)).alias("pose"), F.col("s_suppkey").cast("double").alias("t"))
    least = lambda df: df.withColumn("values", F.array(F.least(F.col("values")[0], F.lit(5.0)), F.col("values")[1]))
    same = lambda df: df
    out = metamorphic_checks(s, "s_suppkey", there, unit(common, native), same, least, same, scalar.rotation_z(F.lit(0.5), F.lit(3.0), F.lit(4.0)))
    return out.select("check", "passed", r6("max_error").alias("max_error"), "states", "failed")


@query(f"""
    WITH {EVENTS}, i AS (SELECT user_id AS k, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS kind, min(t) AS moment FROM ev WHERE event_type = 'purchase' GROUP BY 1),
    f AS (SELECT CASE WHEN event_id % 10 > 0 THEN user_id END AS k, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS kind, t FROM ev WHERE event_type = 'error'),
    e AS (SELECT i.k, i.kind, min(f.t - i.moment) FILTER (f.t >= i.moment) AS late FROM i LEFT JOIN f ON f.k = i.k AND f.kind = i.kind GROUP BY 1, 2)
    SELECT count(*) AS injected, count(late) AS detected, round(quantile_cont(late, 0.5), 4) AS median_latency, (SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k = f.k AND i.kind = f.kind)) AS false_alarms,
        round(count(late) / count(*), 6) AS detection_rate, round((SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k = f.k AND i.kind = f.kind)) / 30, 6) AS alarms_per_day FROM e
""")
def d33_detections(spark, d):
    """First purchases as injected faults of a kind by user, errors as findings of a kind by id, one in ten of no user."""
    e = events(spark, d)
    kind = lambda c: F.when(F.col(c) % 2 == 0, "a").otherwise("b")
    faults = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("k")).agg(F.min("t").alias("at")).withColumn("kind", kind("k"))
    found = e.where("event_type = 'error'").select(F.when(F.col("event_id") % 10 > 0, F.col("user_id")).alias("k"), kind("event_id").alias("kind"), F.col("t").alias("at"))
    out = S.detection_summary(faults, found, "k", 30.0)
    return out.select("injected", "detected", F.round("median_latency", 4).alias("median_latency"), "false_alarms", r6("detection_rate").alias("detection_rate"), r6("alarms_per_day").alias("alarms_per_day"))


@query(f"""
    WITH {EVENTS}, m AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'joint_1' WHEN 'click' THEN 'joint_2' WHEN 'purchase' THEN 'ee_pose' ELSE 'joint_vel_1' END AS name, value, t, p FROM ev),
    g AS (SELECT user_id, count(*) FILTER (name IN ('joint_1', 'joint_2')) AS n, count(*) FILTER (name = 'ee_pose') AS placed, max(t) AS t, min(p) AS c FROM m GROUP BY 1)
    SELECT user_id, concat_ws('; ', 'Entity ' || chr(39) || user_id || chr(39), CASE WHEN n > 0 THEN 'has ' || n || ' joints' END, CASE WHEN placed > 0 THEN 'placed' END, CASE WHEN c < 0.5 THEN '(low confidence)' END) AS description,
        concat_ws(',', CASE WHEN n > 0 THEN 'movable,controllable' END, CASE WHEN placed > 0 THEN 'reachable' END) AS affordances, round(t, 6) AS t FROM g
""")
def b15_descriptions(spark, d):
    """Events of a user as measurements; numbers in the text are left out here, as both sides round halves their own way."""
    e = events(spark, d)
    name = F.when(F.col("event_type") == "view", "joint_1").when(F.col("event_type") == "click", "joint_2").when(F.col("event_type") == "purchase", "ee_pose").otherwise("joint_vel_1")
    m = e.select("user_id", name.alias("name"), F.array("value", "x", "p").alias("value"), "t", F.col("p").alias("confidence"))
    out = S.level_of_detail(m, "user_id", "semantic", 0.0)
    text = F.regexp_replace(F.regexp_replace("description", r" \(mean pos [^)]*\)", ""), r"EE at \([^)]*\) m", "placed")
    return out.select("user_id", text.alias("description"), F.array_join("affordances", ",").alias("affordances"), r6("t").alias("t"))


@query("""
    WITH o AS (SELECT o_orderkey, o_totalprice / 500000 AS v, CASE o_orderkey % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.9 END AS e, o_orderkey % 4 = 0 AS unseen FROM orders),
    f AS (SELECT *, CASE WHEN NOT unseen THEN exp(-((v - (1 - e)) ** 2) / 0.02) / greatest(exp(-((v - e) ** 2) / 0.02), 1e-12) END AS factor FROM o)
    SELECT o_orderkey, CASE WHEN unseen THEN 'active' WHEN factor < 3 THEN 'fulfilled' ELSE 'violated' END AS status, CASE WHEN NOT unseen THEN factor < 3 END AS symbolic FROM f
""")
def h13_by_bayes_factor(spark, d):
    from ..operators import conditions as K

    o = table(spark, d, "orders")
    exp = o.select(F.col("o_orderkey").alias("expectation"), F.lit(10.0).alias("deadline"))
    e = F.when(F.col("o_orderkey") % 3 == 0, 0.2).when(F.col("o_orderkey") % 3 == 1, 0.5).otherwise(0.9)
    eff = o.select(F.col("o_orderkey").alias("expectation"), F.lit("symbolic").alias("side"), F.col("o_orderkey").alias("entity"), F.lit("price").alias("fluent"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), e.alias("expected"))
    seen = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("entity"), F.lit("price").alias("fluent"), (F.col("o_totalprice") / 500000).alias("value"), F.lit(1.0).alias("t"))
    out = K.verify_expectations(exp, eff, seen, 5.0, "bayes_factor")
    return out.select(F.col("expectation").alias("o_orderkey"), "status", "symbolic")
