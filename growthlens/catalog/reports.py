"""Lab speed and report queries."""

from pyspark.sql import functions as F

from ..operators import audit, changes, content, lab, report, search, web
from . import sqlurl as q
from .audit import ALL_SQL, BASE_SQL, CRAWL
from .base import query
from .web import SESS

L = ("v_lab",)
KEYS = ["url", "form_factor", "snapshot_date"]
MEDIAN = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY url, form_factor, snapshot_date ORDER BY coalesce(performance,-1), run_no) AS rn,
  count(*) OVER (PARTITION BY url, form_factor, snapshot_date) AS n FROM v_lab WHERE error IS NULL),
  md AS (SELECT url, form_factor, snapshot_date, run_no, performance, lcp_ms, cls_thousandths, error FROM r WHERE rn = (n + 1) // 2)"""


@query("lab_median", f"{MEDIAN} SELECT * FROM md", L)
def lab_median(t):
    return lab.median_run(t.v_lab, KEYS).select("url", "form_factor", "snapshot_date", "run_no", "performance", "lcp_ms", "cls_thousandths", "error")


@query(
    "lab_bands",
    """SELECT url, form_factor, CASE WHEN lcp_ms < 2500 AND cls_thousandths / 1000.0 < 0.1 THEN 'good' ELSE 'needs work' END AS band, count(*) AS n FROM v_lab GROUP BY 1,2,3""",
    L,
)
def lab_bands(t):
    return lab.vitals_counts(t.v_lab.withColumn("cls", F.col("cls_thousandths") / 1000.0), ["url", "form_factor"])


@query(
    "lab_delta",
    f"""{MEDIAN}, w AS (SELECT *, lcp_ms - lag(lcp_ms) OVER (PARTITION BY url, form_factor ORDER BY snapshot_date) AS lcp_delta FROM md)
        SELECT url, form_factor, snapshot_date, performance, lcp_ms, lcp_delta, CASE WHEN lcp_delta IS NOT NULL THEN abs(lcp_delta) < 1000 END AS is_noise FROM w""",
    L,
)
def lab_delta(t):
    m = lab.median_run(t.v_lab, KEYS).select("url", "form_factor", "snapshot_date", "performance", "lcp_ms")
    return changes.speed_trend(m)


@query("lab_error_rows", "SELECT DISTINCT url, form_factor, error FROM v_lab WHERE error IS NOT NULL", L)
def lab_error_rows(t):
    return lab.lab_error_rows(t.v_lab)


@query(
    "top_pages_merged",
    f"""{SESS}, w AS (SELECT replace(page, '/page/', 'https://example.com/p/') AS k, count(DISTINCT (user_id, session_no)) AS sessions, count(*) FILTER (WHERE event_type='view') AS views FROM se GROUP BY 1),
        s AS (SELECT {q.url_key('page')} AS k, sum(clicks) AS clicks, sum(impressions) AS impressions FROM v_search GROUP BY 1)
        SELECT k AS url_key, CAST(coalesce(sessions,0) AS BIGINT) AS sessions, CAST(coalesce(views,0) AS BIGINT) AS views, CAST(coalesce(clicks,0) AS BIGINT) AS clicks,
          CAST(coalesce(impressions,0) AS BIGINT) AS impressions FROM w FULL OUTER JOIN s USING (k)""",
    ("v_events", "v_search"),
)
def top_pages_merged(t):
    pages = web.top_pages(web.sessionize(t.v_events)).withColumn("url", F.regexp_replace("page", "^/page/", "https://example.com/p/"))
    return report.top_pages_merged(pages, search.search_report(t.v_search, ["page"]))


@query(
    "audit_report",
    f"""{BASE_SQL} SELECT code, count(*) AS n, arg_min(detail, url) AS example, min(url) AS first_url, max(severity) AS impact,
        CAST(CASE max(severity) WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS INTEGER) AS priority FROM ({ALL_SQL}) GROUP BY code""",
    CRAWL,
)
def audit_report(t):
    return report.audit_report(audit.site_audit(t.v_crawl, t.v_links, t.v_sitemap)).drop("site")


@query("performance_report", None)
def performance_report(t):
    m = content.content_performance(t.v_content, t.v_perf)
    return content.patterns(m)


@query("weekly_report", None)
def weekly_report(t):
    head = changes.headline(changes.issue_changes(t.v_issues_prev, t.v_issues_curr))
    imp = search.page_two(t.v_search, 0).groupBy(search.urls.url_key("page").alias("url_key")).agg(F.sum("impressions").alias("impressions"))
    return report.weekly_report(head, changes.rank_fixes(t.v_issues_curr, imp))
