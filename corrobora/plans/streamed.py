"""Queries of what streams keep: series windows and measures, in their batch form, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import metrics as M, windows as X
from .inputs import EVENTS, events
from .queries import query, r6


@query(f"""
    WITH {EVENTS}, s AS (SELECT user_id, t, max_by(p, event_id::VARCHAR) AS p FROM ev WHERE event_type <> 'purchase' GROUP BY ALL),
    w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC) <= 360),
    g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM w),
    k AS (SELECT user_id, min(t) AS first, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY 1 HAVING count(*) >= 2 AND max(t) - min(t) >= 300),
    r AS (SELECT user_id, t, p, event_id::VARCHAR AS tie FROM ev WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, tie DESC) <= 360),
    near AS (SELECT r.user_id, r.t AS moment, r.tie, r.p, w.t FROM r JOIN k USING (user_id) JOIN w ON w.user_id = r.user_id WHERE r.t >= k.first - gaps[len(gaps) // 2 + 1] / 2
        QUALIFY row_number() OVER (PARTITION BY r.user_id, r.t, r.tie ORDER BY abs(w.t - r.t), w.t) = 1),
    a AS (SELECT user_id, t, p FROM near QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY moment DESC, tie DESC) = 1)
    SELECT w.user_id, round(w.t, 6) AS t, round(w.p, 6) AS observed, round(a.p, 6) AS recorded FROM w JOIN k USING (user_id) LEFT JOIN a ON a.user_id = w.user_id AND a.t = w.t
""")
def i03_window_series(spark, d):
    out = X.series_windows(events(spark, d), "user_id", "t", "p", F.col("event_type") == "purchase", "event_id")
    return out.select("user_id", r6("t").alias("t"), r6("observed").alias("observed"), r6("recorded").alias("recorded"))


@query(f"""
    WITH {EVENTS}, u AS (SELECT event_type AS topic, t AS happened, t + event_id % 5 AS begun, t + event_id % 7 AS done, abs(value) AS o, event_id % 3 AS r, CASE WHEN event_id % 4 = 0 THEN 1.0 END AS pl, least(greatest(p, 0.01), 0.99) AS p FROM ev),
    s AS (SELECT *, o + r + coalesce(pl, 0) AS total FROM u),
    m AS (SELECT topic, done AS moment, unnest(['update_latency', 'event_log_lag', 'contrib_observed', 'contrib_record', 'contrib_plan', 'belief_entropy']) AS name,
        unnest([done - begun, greatest(0, done - happened), CASE WHEN total > 0 THEN o / total END, CASE WHEN total > 0 THEN r / total END, CASE WHEN total > 0 THEN coalesce(pl, 0) / total END, -(p * ln(p) + (1 - p) * ln(1 - p))]) AS value FROM s)
    SELECT floor(moment / 86400) * 86400 AS period, name, topic, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(max({{'moment': moment, 'value': value}}).value, 6) AS last
    FROM m WHERE value IS NOT NULL GROUP BY ALL
""")
def i09_event_metrics(spark, d):
    e = events(spark, d)
    c = F.col
    rows = M.event_metrics(
        e, c("t"), c("t") + c("event_id") % 5, c("t") + c("event_id") % 7, F.abs("value"), (c("event_id") % 3).cast("double"), F.when(c("event_id") % 4 == 0, 1.0), F.least(F.greatest("p", F.lit(0.01)), F.lit(0.99)), [], c("event_type")
    )
    out = M.by_period(rows, 86400.0, "topic")
    return out.select(c("period").cast("double").alias("period"), "name", "topic", "n", F.round("total", 4).alias("total"), *[r6(x).alias(x) for x in ("least", "greatest", "last")])
