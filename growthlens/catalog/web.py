"""Web analytics queries."""

from pyspark.sql import functions as F

from ..operators import web
from .base import half_even, query

E = ("v_events",)
SESS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS st FROM v_events),
  se AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no, CAST(ts AS DATE) AS day FROM g),
  st AS (SELECT user_id, session_no, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events, arg_min(page, (ts, event_id)) AS landing_page,
    arg_min(k % 5, (ts, event_id)) AS channel, count(*) FILTER (WHERE event_type='view') AS views, count(*) FILTER (WHERE event_type='purchase') AS conversions,
    CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS duration_s, min(CAST(ts AS DATE)) AS day FROM se GROUP BY 1,2)"""


def _sessioned(t):
    return web.sessionize(t.v_events)


@query(
    "sessions",
    f"{SESS} SELECT user_id, session_no, start_us, end_us, n_events, landing_page, views, conversions, duration_s, duration_s >= 10 AS engaged FROM st",
    E,
)
def sessions(t):
    return web.session_table(_sessioned(t))


@query(
    "top_pages",
    f"""{SESS}, v AS (SELECT page, user_id, session_no, count(*) FILTER (WHERE event_type='view') AS views FROM se GROUP BY 1,2,3)
        SELECT page, count(*) AS sessions, CAST(sum(v.views) AS BIGINT) AS views, count(DISTINCT user_id) AS active_users,
          {half_even('count(*) FILTER (WHERE duration_s >= 10)', 'count(*)', 4)} AS engagement_rate, {half_even('sum(duration_s)', 'count(*)', 2)} AS avg_session_s
        FROM v JOIN st USING (user_id, session_no) GROUP BY page""",
    E,
)
def top_pages(t):
    return web.top_pages(_sessioned(t))


@query(
    "traffic_sources",
    f"""{SESS} SELECT channel, count(*) AS sessions, count(DISTINCT user_id) AS active_users,
          {half_even('count(*) FILTER (WHERE end_us - start_us >= 10000000)', 'count(*)', 4)} AS engagement_rate, CAST(sum(conversions) AS BIGINT) AS conversions FROM st GROUP BY channel""",
    E,
)
def traffic_sources(t):
    return web.traffic_sources(_sessioned(t).withColumn("channel", F.col("k") % 5), ["channel"])


@query(
    "landing_pages",
    f"""{SESS} SELECT landing_page, count(*) AS sessions, count(DISTINCT user_id) AS active_users, {half_even('count(*) FILTER (WHERE duration_s < 10)', 'count(*)', 4)} AS bounce_rate,
          {half_even('count(*) FILTER (WHERE duration_s >= 10)', 'count(*)', 4)} AS engagement_rate, {half_even('sum(duration_s)', 'count(*)', 2)} AS avg_session_s,
          CAST(sum(views) AS BIGINT) AS views, CAST(sum(conversions) AS BIGINT) AS conversions FROM st GROUP BY landing_page""",
    E,
)
def landing_pages(t):
    return web.landing_pages(_sessioned(t))


@query("event_conversions", "SELECT event_type, count(*) AS event_count, count(DISTINCT user_id) AS total_users FROM v_events GROUP BY 1", E)
def event_conversions(t):
    return web.event_conversions(t.v_events)


@query(
    "event_report",
    """SELECT page, event_type, count(*) AS event_count, count(DISTINCT user_id) AS total_users,
       CAST(coalesce(sum(value) FILTER (WHERE event_type='purchase'),0) AS DECIMAL(18,2)) AS revenue FROM v_events GROUP BY 1,2""",
    E,
)
def event_report(t):
    return web.custom_report(t.v_events, ["page", "event_type"], ["event_count", "total_users", "revenue"])


@query(
    "daily_trend",
    f"""{SESS}, f AS (SELECT user_id, min(day) AS day FROM se GROUP BY 1)
        SELECT day, (SELECT count(*) FROM st WHERE st.day = se.day) AS sessions, count(DISTINCT user_id) AS active_users, (SELECT count(*) FROM f WHERE f.day = se.day) AS new_users
        FROM se GROUP BY day""",
    E,
)
def daily_trend(t):
    return web.daily_trend(_sessioned(t))


@query(
    "kpi_cards",
    """WITH e AS (SELECT *, (SELECT max(CAST(ts AS DATE)) FROM v_events) - CAST(ts AS DATE) AS age FROM v_events),
       p AS (SELECT age < 7 AS cur, CAST(count(*) AS DECIMAL(18,2)) AS events, CAST(count(DISTINCT user_id) AS DECIMAL(18,2)) AS users,
         CAST(count(*) FILTER (WHERE event_type='purchase') AS DECIMAL(18,2)) AS purchases, CAST(coalesce(sum(value) FILTER (WHERE event_type='purchase'),0) AS DECIMAL(18,2)) AS revenue
         FROM e WHERE age < 14 GROUP BY 1), l AS (UNPIVOT p ON events, users, purchases, revenue INTO NAME metric VALUE v),
       w AS (SELECT metric, max(v) FILTER (WHERE cur) AS current, max(v) FILTER (WHERE NOT cur) AS previous FROM l GROUP BY metric)
       SELECT metric, current, previous, CAST(round((current - previous) * 100) AS DOUBLE) / nullif(CAST(round(previous * 100) AS DOUBLE), 0) AS change FROM w""",
    E,
)
def kpi_cards(t):
    return web.kpi_cards(t.v_events)


@query(
    "funnel",
    f"""WITH a AS (SELECT user_id, min(ts) AS t1 FROM v_events WHERE event_type='view' GROUP BY 1),
        b AS (SELECT user_id, min(ts) AS t2 FROM v_events JOIN a USING (user_id) WHERE event_type='click' AND ts > t1 GROUP BY 1),
        c AS (SELECT user_id, min(ts) AS t3 FROM v_events JOIN b USING (user_id) WHERE event_type='signup' AND ts > t2 GROUP BY 1),
        d AS (SELECT user_id, min(ts) AS t4 FROM v_events JOIN c USING (user_id) WHERE event_type='purchase' AND ts > t3 GROUP BY 1),
        n AS (SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, (SELECT count(*) FROM c) AS n3, (SELECT count(*) FROM d) AS n4)
        SELECT CAST(1 AS INTEGER) AS step_no, 'view' AS step, n1 AS users, CAST(1.0 AS DOUBLE) AS step_rate FROM n UNION ALL SELECT 2, 'click', n2, {half_even('n2', 'n1', 4)} FROM n
        UNION ALL SELECT 3, 'signup', n3, {half_even('n3', 'n2', 4)} FROM n UNION ALL SELECT 4, 'purchase', n4, {half_even('n4', 'n3', 4)} FROM n""",
    E,
)
def funnel(t):
    return web.funnel(t.v_events, ["view", "click", "signup", "purchase"])


@query(
    "new_vs_returning",
    """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS events FROM v_events GROUP BY 1,2), f AS (SELECT user_id, min(day) AS fd FROM p GROUP BY 1)
       SELECT day, CASE WHEN day = fd THEN 'new' ELSE 'returning' END AS kind, count(*) AS users, CAST(sum(events) AS BIGINT) AS events FROM p JOIN f USING (user_id) GROUP BY 1,2""",
    E,
)
def new_vs_returning(t):
    return web.new_vs_returning(t.v_events)


@query(
    "tracking_plan_audit",
    """WITH plan AS (SELECT * FROM (VALUES ('view','k'),('click','k'),('click','target'),('refund_issued','k')) p(event_type, property)),
       seen AS (SELECT event_type, count(*) AS n FROM v_events GROUP BY 1)
       SELECT event_type, CAST(NULL AS VARCHAR) AS property, 'not_in_plan' AS finding FROM seen WHERE event_type NOT IN (SELECT event_type FROM plan)
       UNION ALL SELECT DISTINCT event_type, NULL, 'never_seen' FROM plan WHERE event_type NOT IN (SELECT event_type FROM seen)
       UNION ALL SELECT event_type, NULL, 'bad_name' FROM (SELECT event_type FROM seen UNION SELECT event_type FROM plan) WHERE NOT regexp_matches(event_type,'^[a-z][a-z0-9]*(_[a-z0-9]+)+$')
       UNION ALL SELECT event_type, property, 'missing_property' FROM plan WHERE event_type IN (SELECT event_type FROM seen) AND property <> 'k'""",
    E,
)
def tracking_plan_audit(t):
    plan = t.spark.createDataFrame(
        [("view", "k"), ("click", "k"), ("click", "target"), ("refund_issued", "k")], "event_type string, property string"
    )
    return web.tracking_plan_audit(t.v_events, plan)


@query(
    "duplicate_events",
    """SELECT event_id, user_id, event_type, gap_us FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS gap_us
       FROM v_events) WHERE gap_us <= 86400000000""",
    E,
)
def duplicate_events(t):
    return web.duplicate_events(t.v_events, 86_400)


@query("conversion_once", f'{SESS} SELECT event_type, count(*) AS "every", count(DISTINCT (user_id, session_no)) AS once_per_session FROM se GROUP BY 1', E)
def conversion_once(t):
    return web.conversion_once(_sessioned(t))


@query(
    "spike_after_post",
    f"""{SESS}, dl AS (SELECT day, count(*) AS s FROM st GROUP BY day), po AS (SELECT content_id, DATE '2024-01-01' + CAST(content_no % 35 AS INTEGER) AS published FROM v_content),
        ef AS (SELECT published, coalesce(sum(s) FILTER (WHERE day >= published),0) AS a, coalesce(sum(s) FILTER (WHERE day < published),0) AS b
          FROM (SELECT DISTINCT published FROM po) JOIN dl ON day BETWEEN published - 3 AND published + 2 GROUP BY 1)
        SELECT content_id, published, CAST(coalesce(a,0) AS BIGINT) AS after, CAST(coalesce(b,0) AS BIGINT) AS before FROM po LEFT JOIN ef USING (published)""",
    ("v_events", "v_content"),
)
def spike_after_post(t):
    posts = t.v_content.select("content_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("content_no") % 35).cast("int")).alias("published"))
    return web.spike_after_post(_sessioned(t), posts)


@query(
    "active_users",
    """SELECT w * 300 AS window_start, page, count(DISTINCT user_id) AS active_users FROM (SELECT page, user_id, unnest(range(epoch_us(ts) // 300000000 - 5, epoch_us(ts) // 300000000 + 1)) AS w FROM v_events) GROUP BY 1,2""",
    E,
)
def active_users(t):
    return web.active_users(t.v_events)


@query("rolling_users", """SELECT day, users, CAST(sum(users) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE) AS mean_users FROM (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users
    FROM v_events GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", E)  # fmt: skip
def rolling_users(t):
    return web.rolling_users(t.v_events)


@query(
    "pii_scan",
    r"""SELECT doc_id, 'email' AS kind FROM documents WHERE regexp_matches(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')
        UNION ALL SELECT doc_id, 'phone' FROM documents WHERE regexp_matches(text,'(^|[^0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-]?[0-9]{4}([^0-9]|$)')""",
)
def pii_scan(t):
    return web.pii_scan(t.documents, "text", ["doc_id"])
