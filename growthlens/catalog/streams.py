"""Streams over the landed events, run to the end of what is there."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import jobs, snapshots
from .base import half_even, query
from .changes import CHANGES, HIT, KEYED, I


def _run(t, job, conf=None):
    # the table may be one file or a folder of part files; a pattern is taken for either, a plain path for a folder only
    return jobs.run_bounded(t.spark, f"{t.sf_dir}/events.parque[t]", job, "*.parquet", conf)


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS st FROM events),
       s AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
       SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, no""",
)
def stream_sessions(t):
    return _run(t, jobs.sessions)


@query(
    "stream_daily_counts",
    """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value FROM events GROUP BY 1,2""",
)
def stream_daily_counts(t):
    return _run(t, jobs.daily_counts)


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, props FROM events")
def stream_dedupe(t):
    keys = ["user_id", "event_type", "props"]
    return _run(t, lambda e: jobs.dedupe(e, keys).select(*keys)).filter(~F.col("event_type").eqNullSafe(jobs.END_TYPE))


@query(
    "rt_active_users",
    """SELECT w * 300 AS window_start, page, count(DISTINCT user_id) AS active_users
       FROM (SELECT concat('/page/', event_id % 40) AS page, user_id, unnest(range(epoch_us(ts) // 300000000 - 5, epoch_us(ts) // 300000000 + 1)) AS w FROM events) GROUP BY 1,2""",
)
def rt_active_users(t):
    return _run(t, lambda e: jobs.active_users(e.withColumn("page", F.concat(F.lit("/page/"), F.col("event_id") % 40))))


STEPS = ["view", "click", "signup", "purchase"]
REACHED = """a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
  b AS (SELECT user_id, min(e.ts) AS t FROM events e JOIN a USING (user_id) WHERE event_type = 'click' AND ts > t GROUP BY 1),
  c AS (SELECT user_id, min(e.ts) AS t FROM events e JOIN b USING (user_id) WHERE event_type = 'signup' AND ts > t GROUP BY 1),
  d AS (SELECT user_id, min(e.ts) AS t FROM events e JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > t GROUP BY 1),
  r AS (SELECT user_id, t, 1 AS k FROM a UNION ALL SELECT user_id, t, 2 FROM b UNION ALL SELECT user_id, t, 3 FROM c UNION ALL SELECT user_id, t, 4 FROM d)"""


@query("stream_funnel_users", f"WITH {REACHED} SELECT user_id, CAST(max(k) AS INTEGER) AS steps_done, epoch_us(max(t)) AS last_us FROM r GROUP BY user_id")
def stream_funnel_users(t):
    reached = _run(t, lambda e: jobs.funnel_state(e, STEPS), jobs.ROCKS)
    return reached.groupBy("user_id").agg(F.max("steps_done").alias("steps_done"), F.max("last_us").alias("last_us"))


@query(
    "stream_funnel",
    f"""WITH {REACHED}, n AS (SELECT k, count(*) AS n FROM r GROUP BY k)
        SELECT CAST(n.k AS INTEGER) AS step_no, ['view', 'click', 'signup', 'purchase'][n.k] AS step, n.n AS users,
          CASE WHEN n.k = 1 THEN CAST(1.0 AS DOUBLE) ELSE {half_even('n.n', 'p.n', 4)} END AS step_rate FROM n LEFT JOIN n p ON p.k = n.k - 1""",
)
def stream_funnel(t):
    return jobs.funnel(_run(t, lambda e: jobs.funnel_state(e, STEPS), jobs.ROCKS), STEPS)


def _snapshots(t):
    """Two snapshots that land in six files, three micro-batches, each with rows of both."""
    both = [d.withColumn("snapshot", F.lit(s)) for s, d in (("2026-10-13", t.v_issues_prev), ("2026-10-20", t.v_issues_curr))]
    base = f"{shared_folder(t.spark)}/growthlens/snapshots-{uuid.uuid4().hex}"
    rows = snapshots.with_markers(both[0].unionByName(both[1]))
    rows.repartition(6, "code", "url", "crawl_pos").write.parquet(f"{base}/landed")
    job = snapshots.IssueChanges(t.spark, f"{base}/state")
    job.run(t.spark.readStream.schema(snapshots.ISSUES).option("maxFilesPerTrigger", 2).parquet(f"{base}/landed"), f"{base}/checkpoint")
    return job


@query(
    "stream_issue_changes",
    f"""{CHANGES} SELECT site, '2026-10-20' AS snapshot, '2026-10-13' AS before, n_new, n_resolved, n_persisting, n_new_high, n_current FROM ch
        UNION ALL SELECT site, '2026-10-13', NULL, count(DISTINCT (code, url_key)), 0, 0, count(DISTINCT (code, url_key)) FILTER (WHERE severity = 'high'),
          count(DISTINCT (code, url_key)) FROM p GROUP BY site""",
    I,
)
def stream_issue_changes(t):
    return _snapshots(t).summary()


@query(
    "stream_issue_rows",
    f"""{KEYED}, f AS (SELECT site, 'new' AS change, code, url_key, url, severity, crawl_pos FROM c WHERE NOT EXISTS ({HIT.format(t='p', s='c')})
          UNION ALL SELECT site, 'resolved', code, url_key, url, severity, crawl_pos FROM p WHERE NOT EXISTS ({HIT.format(t='c', s='p')}))
        SELECT site, '2026-10-20' AS snapshot, '2026-10-13' AS before, change, code, url_key, url, severity, crawl_pos FROM f
        UNION ALL SELECT site, '2026-10-13', NULL, 'new', code, url_key, url, severity, crawl_pos FROM p""",
    I,
)
def stream_issue_rows(t):
    return _snapshots(t).changes()
