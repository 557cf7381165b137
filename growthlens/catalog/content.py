"""Content performance queries."""

from pyspark.sql import functions as F

from ..operators import content
from .base import half_even, query

C = ("v_content", "v_perf")
RATE = half_even("((likes+comments+shares+saves)*100)", "reach", 4)
BASE = f"""WITH lp AS (SELECT * FROM v_perf QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY date_measured DESC, seq DESC) = 1),
  m AS (SELECT c.*, lp.* EXCLUDE (content_id, seq), {RATE} AS engagement_rate, CAST(round({RATE}*10000) AS BIGINT) AS u FROM v_content c LEFT JOIN lp USING (content_id))"""
AVGS = f"""count(*) AS n, {half_even('sum(reach)', 'count(reach)', 2)} AS avg_reach, {half_even('sum(u)', '(count(u)*10000)', 4)} AS avg_engagement,
  {half_even('sum(saves)', 'count(saves)', 2)} AS avg_saves, {half_even('sum(shares)', 'count(shares)', 2)} AS avg_shares, {half_even('sum(link_clicks)', 'count(link_clicks)', 2)} AS avg_clicks"""


def _measured(t):
    return content.content_performance(t.v_content, t.v_perf)


@query("content_performance", f"{BASE} SELECT content_id, platform, format, date_measured, reach, likes, comments, shares, saves, link_clicks, engagement_rate FROM m", C)
def content_performance(t):
    return _measured(t).select(
        "content_id", "platform", "format", "date_measured", "reach", "likes", "comments", "shares", "saves", "link_clicks", "engagement_rate"
    )


@query(
    "top_performers",
    f"""{BASE} SELECT content_id, platform, format, engagement_rate, reach, 'top' AS side FROM (SELECT * FROM m WHERE engagement_rate IS NOT NULL ORDER BY engagement_rate DESC, reach DESC, content_id LIMIT 10)
        UNION ALL SELECT content_id, platform, format, engagement_rate, reach, 'bottom' FROM (SELECT * FROM m WHERE engagement_rate IS NOT NULL ORDER BY engagement_rate, reach, content_id LIMIT 3)""",
    C,
)
def top_performers(t):
    return content.top_performers(_measured(t))


@query(
    "patterns",
    f"{BASE} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, {AVGS} FROM m GROUP BY {d}" for d in content.DIMS),
    C,
)
def patterns(t):
    return content.patterns(_measured(t))


@query("format_platform_cube", f"{BASE} SELECT format, platform, {AVGS} FROM m GROUP BY CUBE(format, platform)", C)
def format_platform_cube(t):
    return content.format_platform_cube(_measured(t))


@query(
    "underperformers",
    f"""{BASE}, p AS (SELECT date_trunc('month', date_published) AS mo, hook_used, sum(u) AS s, count(*) AS n FROM m WHERE u IS NOT NULL GROUP BY 1,2),
        a AS (SELECT mo, sum(s) AS ts, sum(n) AS tn FROM p GROUP BY 1)
        SELECT hook_used, count(*) AS months, count(*) FILTER (WHERE s*tn < ts*n) AS months_below FROM p JOIN a USING (mo) GROUP BY 1 HAVING count(*) FILTER (WHERE s*tn < ts*n) * 2 > count(*)""",
    C,
)
def underperformers(t):
    return content.underperformers(_measured(t), "hook_used")


@query(
    "performance_score",
    f"""{BASE}, r AS (SELECT * FROM m WHERE engagement_rate IS NOT NULL),
        h AS (SELECT a.content_id, a.platform, a.engagement_rate, count(b.content_id) AS history, count(b.content_id) FILTER (WHERE b.u < a.u) AS less
          FROM r a LEFT JOIN r b ON b.platform = a.platform AND (b.date_published, b.content_no) < (a.date_published, a.content_no) GROUP BY ALL),
        lim AS (SELECT *, CASE platform WHEN 'Instagram' THEN 1 WHEN 'LinkedIn' THEN 2 ELSE 0.5 END AS a, CASE platform WHEN 'Instagram' THEN 3 WHEN 'LinkedIn' THEN 4 ELSE 1 END AS g,
          CASE platform WHEN 'Instagram' THEN 6 WHEN 'LinkedIn' THEN 8 ELSE 3 END AS e FROM h)
        SELECT content_id, platform, engagement_rate, history, CAST(CASE WHEN history = 0 THEN CASE WHEN engagement_rate >= e THEN 9 WHEN engagement_rate >= g THEN 7 WHEN engagement_rate >= a THEN 5 ELSE 2 END
          ELSE least(10, less * 10 // history + 1) END AS INTEGER) AS performance_score FROM lim""",
    C,
)
def performance_score(t):
    return content.performance_score(_measured(t))


@query(
    "whats_working",
    f"""{BASE}, a AS (SELECT *, (SELECT max(date_published) FROM m) - date_published AS age FROM m),
        g AS (SELECT theme_topic, count(u) FILTER (WHERE age < 30) AS n_now, count(u) FILTER (WHERE age >= 30) AS n_before,
          {half_even('sum(u) FILTER (WHERE age < 30)', '(count(u) FILTER (WHERE age < 30)*10000)', 4)} AS now, {half_even('sum(u) FILTER (WHERE age >= 30)', '(count(u) FILTER (WHERE age >= 30)*10000)', 4)} AS before
          FROM a WHERE age < 60 GROUP BY 1)
        SELECT *, CASE WHEN before IS NULL THEN 'emerging' WHEN now IS NULL THEN 'gone' WHEN now > before THEN 'up' WHEN now < before THEN 'down' ELSE 'flat' END AS trend FROM g""",
    C,
)
def whats_working(t):
    return content.whats_working(_measured(t), "theme_topic")


SLOTS = f"""{BASE}, sl AS (SELECT platform, CAST((isodow(date_published) - 1) AS INTEGER) AS weekday, hour_published AS hour, count(*) AS n, {half_even('sum(u)', '(count(*)*10000)', 4)} AS avg_engagement
  FROM m WHERE engagement_rate IS NOT NULL GROUP BY 1,2,3)"""


@query("time_slots", f"{SLOTS} SELECT * FROM sl", C)
def time_slots(t):
    return content.time_slots(_measured(t))


@query("best_times", f"{SLOTS} SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY platform ORDER BY avg_engagement DESC, weekday, hour) <= 3", C)
def best_times(t):
    return content.best_times(_measured(t))


@query(
    "top5_all_time",
    f"""{BASE} SELECT platform, content_id, engagement_rate, reach FROM m WHERE engagement_rate IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY platform ORDER BY engagement_rate DESC, reach DESC, content_id) <= 5""",
    C,
)
def top5_all_time(t):
    return content.top_all_time(_measured(t))


@query(
    "due_for_measurement",
    """SELECT content_id, platform, date_published FROM v_content c WHERE (SELECT max(date_published) FROM v_content) - date_published >= 7
       AND NOT EXISTS (SELECT 1 FROM v_perf p WHERE p.content_id = c.content_id)""",
    C,
)
def due_for_measurement(t):
    c = t.v_content
    today = c.agg(F.max("date_published")).scalar()
    return content.due_for_measurement(c, t.v_perf, today).select("content_id", "platform", "date_published")


@query(
    "goal_progress",
    f"""{BASE} SELECT platform AS kpi, n * 2 AS target, v AS value, n * 2 - v AS gap, {half_even('(v*100)', '(n*2)', 2)} AS pace
        FROM (SELECT platform, count(*) AS n, count(reach) AS v FROM m GROUP BY 1)""",
    C,
)
def goal_progress(t):
    m = _measured(t)
    per = m.groupBy(F.col("platform").alias("kpi")).agg((F.count("*") * 2).alias("target"), F.count("reach").alias("value"))
    return content.goal_progress(per.select("kpi", "target"), per.select("kpi", "value"))


@query(
    "test_readout",
    f"""{BASE} SELECT variant, n, CAST(s AS DOUBLE) / n / 10000.0 AS mean_rate, (CAST(q AS DOUBLE) - CAST(s AS DOUBLE) * (CAST(s AS DOUBLE) / n)) / (n - 1) / 1e8 AS variance
        FROM (SELECT variant, count(*) AS n, sum(CAST(u AS HUGEINT)) AS s, sum(CAST(u AS HUGEINT) * u) AS q FROM m WHERE u IS NOT NULL GROUP BY 1)""",
    C,
)
def test_readout(t):
    return content.test_readout(_measured(t))


@query(
    "idea_score",
    f"""WITH s AS (SELECT idea_id, impact*4+fit*3+search_potential*2+resources AS tenths FROM v_ideas)
        SELECT idea_id, {half_even('tenths', '10', 1)} AS score, rank() OVER (ORDER BY tenths DESC) AS rank FROM s""",
    ("v_ideas",),
)
def idea_score(t):
    return content.idea_score(t.v_ideas)


@query(
    "theme_mentions",
    f"""SELECT theme, count(DISTINCT respondent) AS respondents, {half_even('count(DISTINCT respondent)', '(SELECT count(DISTINCT o_custkey) FROM orders)', 4)} AS share
        FROM (SELECT o_custkey AS respondent, o_orderpriority AS theme FROM orders UNION ALL SELECT o_custkey, o_orderstatus FROM orders) GROUP BY 1
        HAVING {half_even('count(DISTINCT respondent)', '(SELECT count(DISTINCT o_custkey) FROM orders)', 4)} >= 0.3""",
)
def theme_mentions(t):
    o = t.orders
    both = o.select(F.col("o_custkey").alias("respondent"), F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("theme"))
    return content.theme_mentions(both)


MAIL = "CASE event_type WHEN 'view' THEN 'open' WHEN 'error' THEN 'unsubscribe' ELSE event_type END"


def _mail(t):
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "unsubscribe").otherwise(F.col("event_type"))
    return t.v_events.withColumn("event_type", kind).withColumn("send", F.col("k") % 5)


@query(
    "email_metrics",
    f"""WITH p AS (SELECT k % 5 AS send, user_id, bool_or(et='open') AS o, bool_or(et='click') AS c, bool_or(et='signup') AS s, bool_or(et='unsubscribe') AS u,
          sum(value) FILTER (WHERE et='signup') AS r FROM (SELECT *, {MAIL} AS et FROM v_events) GROUP BY 1,2),
        g AS (SELECT send, count(*) AS recipients, {half_even('count(*) FILTER (WHERE o)', 'count(*)', 4)} AS open_rate, {half_even('count(*) FILTER (WHERE c)', 'count(*)', 4)} AS click_rate,
          {half_even('count(*) FILTER (WHERE u)', 'count(*)', 4)} AS unsubscribe_rate, {half_even('count(*) FILTER (WHERE s)', 'count(*)', 4)} AS conversion_rate,
          {half_even('CAST(coalesce(sum(r),0)*100 AS BIGINT)', '(count(*)*100)', 2)} AS revenue_per_email FROM p GROUP BY 1)
        SELECT *, CASE WHEN open_rate < 0.2 THEN 'low' WHEN open_rate > 0.4 THEN 'high' ELSE 'ok' END AS open_band,
          CASE WHEN click_rate < 0.02 THEN 'low' WHEN click_rate > 0.05 THEN 'high' ELSE 'ok' END AS click_band, unsubscribe_rate < 0.005 AS unsubscribe_ok FROM g""",
    ("v_events",),
)
def email_metrics(t):
    return content.email_metrics(_mail(t))


@query(
    "email_segments",
    f"""WITH e AS (SELECT user_id, {MAIL} AS et, CAST(ts AS DATE) AS day FROM v_events),
        g AS (SELECT user_id, bool_or(et='open') AS opener, bool_or(et='click') AS clicker, max(day) FILTER (WHERE et IN ('open','click')) AS last_active FROM e GROUP BY 1)
        SELECT *, CASE WHEN last_active IS NULL THEN 'inactive' WHEN (SELECT max(day) FROM e) - last_active >= 2 THEN 'at-risk' ELSE 'engaged' END AS segment FROM g""",
    ("v_events",),
)
def email_segments(t):
    return content.email_segments(_mail(t), 2)


@query(
    "ab_test",
    """WITH p AS (SELECT user_id % 2 AS arm, user_id, bool_or(event_type='purchase') AS hit FROM v_events GROUP BY 1,2),
       w AS (SELECT CAST(count(*) FILTER (WHERE arm=0) AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE arm=0 AND hit) AS DOUBLE) AS x0,
         CAST(count(*) FILTER (WHERE arm=1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE arm=1 AND hit) AS DOUBLE) AS x1 FROM p),
       z AS (SELECT *, (x1/n1 - x0/n0) / nullif(sqrt(((x0+x1)/(n0+n1)) * (1.0 - (x0+x1)/(n0+n1)) * (1.0/n0 + 1.0/n1)), 0) AS zz FROM w)
       SELECT n0, x0, n1, x1, round(zz, 6) AS z, abs(zz) > 1.96 AS significant FROM z""",
    ("v_events",),
)
def ab_test(t):
    return content.ab_test(t.v_events.withColumn("arm", F.col("user_id") % 2), "arm", "purchase")


@query(
    "tool_scorecard",
    """SELECT idea_id AS tool_id, score, CASE WHEN score >= 25 THEN 'strong' WHEN score >= 15 THEN 'promising' ELSE 'reconsider' END AS verdict FROM
       (SELECT idea_id, CAST(4 * (impact%5+1) + 4 * (fit%5+1) AS INTEGER) AS score FROM v_ideas)""",
    ("v_ideas",),
)
def tool_scorecard(t):
    cols = [((F.col("impact") if i % 2 else F.col("fit")) % 5 + 1).alias(f"f{i}") for i in range(8)]
    return content.tool_scorecard(t.v_ideas.select(F.col("idea_id").alias("tool_id"), *cols), [f"f{i}" for i in range(8)])
