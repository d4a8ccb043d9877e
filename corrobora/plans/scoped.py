"""Queries of regrounding, norms, health, density clusters and identities, with SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as K, health as H, identity as N, norms, regrounding as R, retrieval as V
from .inputs import ASSERTIONS, ATOMS, EVENTS, assertions, atoms, events, table
from .queries import query, r6

_DAY = 86400.0


@query(f"""
    WITH {ASSERTIONS}, b AS (SELECT event_id, user_id, state, valid_from, p FROM asr WHERE tx_to IS NULL AND event_id % 11 <> 0),
    old AS (SELECT user_id, state, valid_from, min_by(p, event_id) AS p FROM b WHERE valid_from >= 432000 AND valid_from < 1728000 AND user_id % 2 = 0 AND state IN ('view', 'click') GROUP BY ALL),
    fresh AS (SELECT user_id, state, valid_from, max(least(1, p * CASE WHEN event_id % 3 = 0 THEN 1.5 ELSE 1 END)) AS p FROM asr WHERE event_id % 4 <> 0 AND valid_from >= 432000 AND valid_from < 1728000 AND user_id % 2 = 0 AND state IN ('view', 'click') GROUP BY ALL),
    d AS (SELECT user_id, state, valid_from, old.p AS o, fresh.p AS n FROM old FULL JOIN fresh USING (user_id, state, valid_from) WHERE old.p IS NULL OR fresh.p IS NULL OR abs(old.p - fresh.p) > 1e-9)
    SELECT user_id AS subject, state AS predicate, round(valid_from, 6) AS valid_from, CASE WHEN o IS NULL THEN 'new' WHEN n IS NULL THEN 'gone' ELSE 'changed' END AS change,
        round(o, 6) AS old_p, round(n, 6) AS new_p, round(coalesce(n, 0) - coalesce(o, 0) + 1e-9, 6) AS delta FROM d
""")
def h18_reground(spark, d):
    """Beliefs of two predicates and half the users over fifteen days against fresh ones; the rest of the table stays."""
    a = assertions(spark, d)
    known = a.where("tx_to IS NULL AND event_id % 11 <> 0").select(
        F.col("event_id").cast("string").alias("assertion_id"), F.col("user_id").alias("subject"), F.col("state").alias("predicate"), "valid_from", "p", F.lit("inferred").alias("modality"), F.lit("filter/v1").alias("provenance"), "tx_from", "tx_to"
    )
    p = F.least(F.lit(1.0), F.col("p") * F.when(F.col("event_id") % 3 == 0, 1.5).otherwise(1.0))
    fresh = a.where("event_id % 4 <> 0").select(F.col("user_id").alias("subject"), F.col("state").alias("predicate"), "valid_from", p.alias("p"))
    scope, who = R.Scope(5 * _DAY, 20 * _DAY, ("view", "click")), a.where("user_id % 2 = 0").select(F.col("user_id").alias("subject")).distinct()
    who = who.join(fresh.select("subject").distinct(), "subject", "left_semi")
    diff, _ = R.reground(known, fresh, scope, who, "filter", "p1", 40 * _DAY)
    return diff.select("subject", "predicate", r6("valid_from").alias("valid_from"), "change", r6("old_p").alias("old_p"), r6("new_p").alias("new_p"), r6(F.col("delta") + 1e-9).alias("delta"))


@query()
def h18_replay(spark, d):
    """The filter from the fifteenth day on, begun from its state just before."""
    e = events(spark, d)
    kind = F.when(F.col("event_type") == "purchase", "claim").otherwise("observed")
    e = e.select("user_id", "event_id", "t", kind.alias("kind"), "p", F.when(F.col("event_type") == "purchase", F.concat(F.lit("s"), F.col("event_id") % 3)).alias("source"))
    states = R.states_before(e, ["user_id"], ["t", "event_id"], 15 * _DAY)
    return R.replay(e.where(F.col("t") >= 15 * _DAY), states, ["user_id"], ["t", "event_id"])


@query(f"""
    WITH {EVENTS}, f AS (SELECT event_type AS k, user_id::VARCHAR AS e, floor(t / 86400)::BIGINT AS d, max(p) AS c FROM ev WHERE p > 0 GROUP BY ALL)
    SELECT 'no_access_while_running' AS rule, r.e AS entity, r.d::DOUBLE AS t, round(least(r.c, a.c), 6) AS confidence, 'holds_at(accessible,' || r.e || ',' || r.d || ');holds_at(running,' || r.e || ',' || r.d || ')' AS support, 'critical' AS severity
    FROM f r JOIN f a ON a.e = r.e AND a.d = r.d WHERE r.k = 'click' AND a.k = 'view'
    UNION ALL SELECT 'inspection_before_restart', r.e, r.d::DOUBLE, round(r.c, 6), 'holds_at(running,' || r.e || ',' || r.d || ')', 'important' FROM f r WHERE r.k = 'click'
        AND EXISTS (SELECT 1 FROM f m WHERE m.k = 'error' AND m.e = r.e AND m.d < r.d) AND NOT EXISTS (SELECT 1 FROM f i WHERE i.k = 'purchase' AND i.e = r.e AND i.d = r.d)
""")
def h06_norms(spark, d):
    """Days of users: clicks as running, views as accessible, purchases as inspected, errors as completed maintenance."""
    e = events(spark, d)
    day, user, kind = F.floor(F.col("t") / _DAY).cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    state = F.when(kind == "click", "running").when(kind == "view", "accessible").when(kind == "purchase", "inspected")
    holds = e.where(state.isNotNull()).select(F.lit("holds_at").alias("predicate"), F.array(state, user, day).alias("terms"), F.col("p").alias("confidence"))
    done = e.where(kind == "error").select(F.lit("maintenance_completed").alias("predicate"), F.array(user, day).alias("terms"), F.col("p").alias("confidence"))
    out = norms.norm_violations(holds.unionByName(done))
    return out.select("rule", "entity", "t", r6("confidence").alias("confidence"), F.array_join("support", ";").alias("support"), "severity")


@query("""
    WITH v AS (SELECT label < 4 AS ref, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label < 4 ORDER BY vec_id) - 1 AS n, (SELECT count(*) FROM embeddings) AS total FROM embeddings),
    s AS (SELECT ref, vec_id, v FROM v WHERE n % (CASE WHEN total > 256 THEN total // 256 ELSE 1 END) = 0),
    d AS (SELECT a.ref AS ra, b.ref AS rb, a.vec_id <> b.vec_id AS other, list_distance(a.v, b.v) AS d FROM s a, s b),
    w AS (SELECT median(d) AS w FROM d WHERE d > 0), k AS (SELECT ra, rb, avg(exp(-d * d / (2 * w * w))) AS k FROM d, w GROUP BY ALL),
    shift AS (SELECT greatest(0, sum(CASE WHEN ra = rb THEN k ELSE -k END)) AS shift FROM k),
    c AS (SELECT v, lead(v) OVER (ORDER BY vec_id) AS nxt FROM v WHERE NOT ref), e AS (SELECT sqrt(sum(list_sum(list_transform(list_zip(v, nxt), lambda p: (p[2] - 0.5 * p[1]) ** 2)))) / sqrt(sum(list_sum(list_transform(nxt, lambda x: x * x)))) AS err FROM c WHERE nxt IS NOT NULL)
    SELECT round(shift, 6) AS latent_shift, round(err, 6) AS pred_error, (SELECT count(*) FROM c) AS samples, shift <= 0.05 AND err <= 0.5 AS healthy FROM shift, e
""")
def d49_health(spark, d):
    """Vectors of the first labels as the reference, the others as what comes now, an operator that halves."""
    v = table(spark, d, "embeddings")
    half = [[0.5 if i == j else 0.0 for j in range(64)] for i in range(64)]
    out = H.health(v.where("label < 4"), v.where("label >= 4"), "vec_id", "embedding", half, 0.05, 0.5)
    return out.select(r6("latent_shift").alias("latent_shift"), r6("pred_error").alias("pred_error"), "samples", "healthy")


@query()
def c23_assign_identities(spark, d):
    """Days as episodes and hours as frames: events are slots on a line of values, users the entities where their first event put them."""
    e = events(spark, d).withColumns({"episode": F.floor(F.col("t") / _DAY), "frame": F.floor(F.col("t") / 3600)})
    look = F.array((F.col("user_id") % 7).cast("double"))
    slots = e.where("event_type <> 'error'").select("episode", "frame", F.col("event_id").alias("slot"), (F.col("value") / 10).alias("x"), (F.col("user_id") % 5).cast("double").alias("y"), look.alias("appearance"))
    first = e.groupBy("episode", "user_id").agg(F.min_by("value", "event_id").alias("value"))
    known = first.select("episode", F.col("user_id").alias("entity"), (F.col("value") / 10).alias("x"), (F.col("user_id") % 5).cast("double").alias("y"), look.alias("appearance"))
    anchors = e.where("event_type = 'error'").select("episode", "frame", F.col("user_id").alias("entity"), (F.col("value") / 10).alias("x"), (F.col("user_id") % 5).cast("double").alias("y"))
    return N.assign_identities(slots, known, anchors=anchors)


@query("""
    WITH RECURSIVE c AS (SELECT c_custkey AS id, c_acctbal / 200 AS x, c_nationkey::DOUBLE AS y, (c_custkey % 10) / 10 AS sure FROM customer),
    e AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM c a JOIN c b ON abs(a.y - b.y) <= 0.9 AND abs(a.x - b.x) <= 0.9 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.9),
    core AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) >= 3), g AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)),
    r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b), k AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1),
    m AS (SELECT id, cluster FROM k UNION ALL SELECT a, min({'d': d, 'k': cluster}).k FROM e JOIN k ON k.id = b WHERE a NOT IN (FROM core) GROUP BY 1),
    s AS (SELECT cluster, count(*) AS members, avg(sqrt(x * x + y * y)) AS norm, avg(sure) AS sure FROM m JOIN c USING (id) GROUP BY 1), q AS (SELECT quantile_cont(norm, 0.5) AS cut FROM s)
    SELECT cluster, members, round(norm, 6) AS mean_norm, round(sure, 6) AS mean_confidence, norm >= cut AS high_residual, sure < 0.4137 AS low_confidence FROM s, q WHERE norm >= cut OR sure < 0.4137
""")
def h17_unexplained_clusters(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 200, F.col("c_nationkey").cast("double")).alias("v"), (F.col("c_custkey") % 10 / 10).alias("sure"))
    out = K.unexplained_clusters(c, "c_custkey", "v", "sure", 0.9, 3, known=0.4137)
    return out.select("cluster", "members", r6("mean_norm").alias("mean_norm"), r6("mean_confidence").alias("mean_confidence"), "high_residual", "low_confidence")


@query(f"""
    WITH {ATOMS}, t AS (SELECT DISTINCT atom_id, unnest(tags) AS tag FROM am), n AS (SELECT atom_id, count(*) AS n FROM t GROUP BY 1),
    s AS (SELECT q.atom_id AS query_id, t.atom_id, count(*) AS c FROM t q JOIN t USING (tag) WHERE q.atom_id % 20 = 0 GROUP BY 1, 2)
    SELECT query_id, s.atom_id, round(c / n, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY c DESC, s.atom_id))::INTEGER AS rank FROM s JOIN n ON n.atom_id = query_id QUALIFY rank <= 50
""")
def d01_top_by_tags(spark, d):
    a = atoms(spark, d)
    return V.top_by_tags(a.where("atom_id % 20 = 0"), a, "atom_id", "atom_id", "tags", 50).withColumn("score", r6("score"))
