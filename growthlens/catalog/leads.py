"""Leads and attribution queries."""

from pyspark.sql import functions as F

from ..operators import content, leads
from .base import half_even, query
from .content import BASE as CONTENT_BASE

L, T = ("v_leads",), ("v_touch",)
M = f"""count(*) AS leads, count(*) FILTER (WHERE lead_status='Won') AS won, CAST(coalesce(sum(revenue) FILTER (WHERE lead_status='Won'),0) AS DECIMAL(18,2)) AS revenue,
  {half_even("count(*) FILTER (WHERE lead_status='Won')", "count(*) FILTER (WHERE lead_status<>'Disqualified')", 4)} AS close_rate"""
SEG = """WITH d AS (SELECT *, epoch_us(ts) AS us, CAST(sum(CASE WHEN is_conversion THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS done FROM v_touch),
  sg AS (SELECT *, CASE WHEN is_conversion THEN done ELSE done + 1 END AS seq FROM d),
  pa AS (SELECT user_id, seq, max(value) FILTER (WHERE is_conversion) AS value, max(us) FILTER (WHERE is_conversion) AS converted_us, arg_min(channel, (us, event_id)) FILTER (WHERE NOT is_conversion) AS first_touch,
    arg_max(channel, (us, event_id)) FILTER (WHERE NOT is_conversion) AS last_touch, min(us) FILTER (WHERE NOT is_conversion) AS first_us, count(*) FILTER (WHERE NOT is_conversion) AS touches
    FROM sg GROUP BY 1,2 HAVING bool_or(is_conversion))"""


def _segments(t):
    return leads.touch_segments(t.v_touch)


def _paths(t):
    return leads.conversion_paths(_segments(t))


@query("conversion_paths", f"{SEG} SELECT * FROM pa", T)
def conversion_paths(t):
    return _paths(t)


@query("attribution_first", f"{SEG} SELECT first_touch AS channel, count(*) AS conversions, CAST(sum(value) AS DECIMAL(18,2)) AS revenue FROM pa GROUP BY 1", T)
def attribution_first(t):
    return leads.attribution(_paths(t), "first_touch")


@query("attribution_last", f"{SEG} SELECT last_touch AS channel, count(*) AS conversions, CAST(sum(value) AS DECIMAL(18,2)) AS revenue FROM pa GROUP BY 1", T)
def attribution_last(t):
    return leads.attribution(_paths(t), "last_touch")


@query(
    "attribution_linear",
    f"""{SEG}, pc AS (SELECT user_id, seq, channel, count(*) AS n FROM sg WHERE NOT is_conversion GROUP BY 1,2,3),
        j AS (SELECT pc.*, CAST(value * 1000000 AS HUGEINT) AS units, CAST(value * 1000000 AS HUGEINT) * n // touches AS part FROM pc JOIN pa USING (user_id, seq)),
        r AS (SELECT min(channel) AS channel, max(units) - sum(part) AS rest FROM j GROUP BY user_id, seq), rs AS (SELECT channel, sum(rest) AS rest FROM r GROUP BY 1),
        w AS (SELECT channel, CAST(sum(n) AS BIGINT) AS touches, sum(part) AS part FROM j GROUP BY 1)
        SELECT channel, touches, CAST(CAST(part + coalesce(rest,0) AS DECIMAL(26,0)) / 1000000 AS DECIMAL(20,6)) AS revenue FROM w LEFT JOIN rs USING (channel)""",
    T,
)
def attribution_linear(t):
    return leads.attribution_linear(_segments(t))


@query(
    "journeys",
    f"""{SEG}, f AS (SELECT user_id, seq, channel, min((us, event_id)) AS t0 FROM sg WHERE NOT is_conversion GROUP BY 1,2,3),
        p AS (SELECT user_id, seq, string_agg(channel, ' > ' ORDER BY t0) AS journey FROM f JOIN pa USING (user_id, seq) GROUP BY 1,2)
        SELECT journey, count(*) AS conversions FROM p GROUP BY 1""",
    T,
)
def journeys(t):
    return leads.journeys(_segments(t))


@query(
    "time_to_convert",
    f"{SEG} SELECT first_touch, count(*) AS conversions, {half_even('sum((converted_us - first_us) // 1000000)', 'count(*)', 2)} AS avg_seconds FROM pa WHERE touches > 0 GROUP BY 1",
    T,
)
def time_to_convert(t):
    return leads.time_to_convert(_paths(t))


@query(
    "revenue_by",
    f"""SELECT platform, format, {M}, CAST(grouping(platform, format) AS INTEGER) AS level FROM v_leads LEFT JOIN v_content USING (content_id) GROUP BY ROLLUP(platform, format)""",
    ("v_leads", "v_content"),
)
def revenue_by(t):
    return leads.revenue_by(t.v_leads, t.v_content, ["platform", "format"])


@query("close_rate", f"SELECT lead_source, {M} FROM v_leads GROUP BY 1", L)
def close_rate(t):
    return leads.close_rate(t.v_leads, ["lead_source"])


@query(
    "engaged_no_revenue",
    f"{CONTENT_BASE} SELECT content_id, engagement_rate FROM m WHERE engagement_rate >= 3 AND content_id NOT IN (SELECT content_id FROM v_leads WHERE lead_status='Won')",
    ("v_leads", "v_content", "v_perf"),
)
def engaged_no_revenue(t):
    return leads.engaged_no_revenue(content.content_performance(t.v_content, t.v_perf), t.v_leads, 3.0)


@query(
    "time_to_lead",
    f"""SELECT platform, count(*) AS leads, {half_even('sum(lead_date - date_published)', 'count(*)', 2)} AS avg_days FROM v_leads JOIN v_content USING (content_id)
        WHERE lead_date >= date_published GROUP BY 1""",
    ("v_leads", "v_content"),
)
def time_to_lead(t):
    return leads.time_to_lead(t.v_leads, t.v_content)


@query(
    "deal_stages",
    """SELECT lead_status, CASE WHEN lead_status IN ('Won','Lost','Disqualified') THEN 'closed' ELSE 'open' END AS kind, count(*) AS leads,
       CAST(sum(revenue) AS DECIMAL(18,2)) AS value FROM v_leads GROUP BY 1,2""",
    L,
)
def deal_stages(t):
    return leads.pipeline_stages(t.v_leads)


@query(
    "monthly_leads",
    f"""SELECT *, CAST(sum(revenue) OVER (ORDER BY month) AS DECIMAL(18,2)) AS running_revenue FROM (SELECT CAST(date_trunc('month', lead_date) AS DATE) AS month, {M} FROM v_leads GROUP BY 1)""",
    L,
)
def monthly_leads(t):
    return leads.monthly_leads(t.v_leads)


@query("lead_sources", f"SELECT lead_source, count(*) AS leads, {half_even('count(*)', '(SELECT count(*) FROM v_leads)', 4)} AS share FROM v_leads GROUP BY 1", L)
def lead_sources(t):
    return leads.lead_sources(t.v_leads)


@query(
    "triage",
    """SELECT lead_id, 'stale' AS finding FROM v_leads WHERE lead_status NOT IN ('Won','Lost','Disqualified') AND (SELECT max(lead_date) FROM v_leads) - lead_date > 30
       UNION ALL SELECT lead_id, 'no_owner' FROM v_leads WHERE owner IS NULL UNION ALL SELECT lead_id, 'no_content' FROM v_leads WHERE content_id IS NULL""",
    L,
)
def triage(t):
    v = t.v_leads
    return leads.triage(v, v.agg(F.max("lead_date")).scalar())


@query(
    "backward_moves",
    """WITH r AS (SELECT deal_id, changed_on, seq, stage, status, lag(stage) OVER (PARTITION BY deal_id ORDER BY changed_on, seq) AS prev_stage FROM v_stage_history)
       SELECT * FROM r WHERE list_position(['New Lead','Consultation','Estimating','Proposal Presented','Closed Won','Closed Lost','Disqualified'], stage) <
         list_position(['New Lead','Consultation','Estimating','Proposal Presented','Closed Won','Closed Lost','Disqualified'], prev_stage)""",
    ("v_stage_history",),
)
def backward_moves(t):
    return leads.backward_moves(t.v_stage_history)
