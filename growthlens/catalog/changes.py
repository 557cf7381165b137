"""Snapshot change queries."""

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import answers, changes, search
from . import sqlurl as q
from .answers import BASE as AN_BASE
from .answers import BRAND, DOMAINS, RATES, RIVALS
from .base import half_even, query
from .search import M

I = ("v_issues_prev", "v_issues_curr")  # noqa: E741
KEYED = f"""WITH p AS (SELECT *, {q.issue_key('url')} AS url_key FROM v_issues_prev), c AS (SELECT *, {q.issue_key('url')} AS url_key FROM v_issues_curr)"""
HIT = "SELECT 1 FROM {t} x WHERE x.code = {s}.code AND x.url_key = {s}.url_key"


@query("issues_new", f"{KEYED} SELECT site, code, url_key, url, severity, crawl_pos FROM c WHERE NOT EXISTS ({HIT.format(t='p', s='c')})", I)
def issues_new(t):
    return changes.issues_new(t.v_issues_prev, t.v_issues_curr)


@query("issues_resolved", f"{KEYED} SELECT site, code, url_key, url, severity, crawl_pos FROM p WHERE NOT EXISTS ({HIT.format(t='c', s='p')})", I)
def issues_resolved(t):
    return changes.issues_resolved(t.v_issues_prev, t.v_issues_curr)


@query(
    "issues_persisting",
    f"""{KEYED} SELECT c.site, c.code, c.url_key, c.url, c.severity, c.crawl_pos, p.severity AS prev_severity, c.severity <> p.severity AS severity_changed
        FROM c JOIN p ON c.code = p.code AND c.url_key = p.url_key""",
    I,
)
def issues_persisting(t):
    return changes.issues_persisting(t.v_issues_prev, t.v_issues_curr)


CHANGES = f"""{KEYED}, ch AS (SELECT 'https://example.com' AS site, count(*) FILTER (WHERE p.code IS NULL) AS n_new, count(*) FILTER (WHERE c.code IS NULL) AS n_resolved,
  count(*) FILTER (WHERE p.code IS NOT NULL AND c.code IS NOT NULL) AS n_persisting, count(*) FILTER (WHERE p.code IS NULL AND c.severity = 'high') AS n_new_high,
  count(c.code) AS n_current FROM p FULL OUTER JOIN c ON c.code = p.code AND c.url_key = p.url_key)"""


@query("issue_changes", f"{CHANGES} SELECT * FROM ch", I)
def issue_changes(t):
    return changes.issue_changes(t.v_issues_prev, t.v_issues_curr)


@query(
    "severity_counts",
    """SELECT site, count(*) FILTER (WHERE severity='high') AS high, count(*) FILTER (WHERE severity='medium') AS medium,
       count(*) FILTER (WHERE severity='low') AS low FROM v_issues_curr GROUP BY site""",
    I,
)
def severity_counts(t):
    return changes.severity_counts(t.v_issues_curr)


@query(
    "baseline_diff",
    f"{KEYED} SELECT site, code, url_key, url, severity, crawl_pos, TRUE AS is_baseline FROM c",
    I,
)
def baseline_diff(t):
    nothing = t.v_issues_prev.filter(F.lit(False))
    return changes.issues_new(nothing, t.v_issues_curr).withColumn("is_baseline", F.lit(True))


def _months(t):
    """Search totals of the last two full months as one-row summaries."""
    rows = t.v_search.withColumn("month", F.trunc("date", "month"))
    last = rows.agg(F.max("month")).scalar()
    pick = lambda back: (
        rows.filter(F.col("month") == F.add_months(last, -back)).agg(*search.measures()).withColumn("site", F.lit("https://example.com"))
    )
    return pick(2), pick(1)


MONTHS = f"""mo AS (SELECT CAST(date_trunc('month',date) AS DATE) AS month, {M} FROM v_search GROUP BY 1),
  last AS (SELECT max(month) AS m FROM mo), cu AS (SELECT mo.* FROM mo, last WHERE month = m - INTERVAL 1 MONTH), pr AS (SELECT mo.* FROM mo, last WHERE month = m - INTERVAL 2 MONTH)"""


@query(
    "search_delta",
    f"""WITH {MONTHS} SELECT 'https://example.com' AS site, 'clicks' AS metric, CAST(cu.clicks AS DOUBLE) AS value, CAST(cu.clicks - pr.clicks AS DOUBLE) AS delta FROM cu, pr
        UNION ALL SELECT 'https://example.com', 'impressions', cu.impressions, cu.impressions - pr.impressions FROM cu, pr
        UNION ALL SELECT 'https://example.com', 'ctr', cu.ctr, cu.ctr - pr.ctr FROM cu, pr
        UNION ALL SELECT 'https://example.com', 'position', cu.position, cu.position - pr.position FROM cu, pr""",
    ("v_search",),
)
def search_delta(t):
    prev, curr = _months(t)
    return changes.search_delta(prev, curr)


@query(
    "headline",
    f"""{AN_BASE}, {KEYED[5:]}, {CHANGES[len(KEYED) + 2:]}, {MONTHS},
        ep AS (SELECT engine, {RATES} FROM s WHERE run < 3 GROUP BY engine), ec AS (SELECT engine, {RATES} FROM s WHERE run >= 3 GROUP BY engine),
        b AS (SELECT 1000 + n_new_high AS w, 0 AS seq, n_new_high || ' new high-severity issues.' AS line FROM ch WHERE n_new_high > 0
          UNION ALL SELECT 500 + n_new + n_resolved, 1, n_new || ' new issues, ' || n_resolved || ' resolved.' FROM ch
          UNION ALL SELECT 200, 2, 'No new high-severity issues.' FROM ch WHERE n_new_high = 0
          UNION ALL SELECT 50, 900, 'No Lighthouse file in the current snapshot.'
          UNION ALL SELECT abs(cu.clicks - pr.clicks), 300, 'Clicks moved from ' || pr.clicks || ' to ' || cu.clicks || '.' FROM cu, pr WHERE cu.clicks <> pr.clicks
          UNION ALL SELECT abs(cu.impressions - pr.impressions) * 0.01, 301, 'Impressions moved from ' || pr.impressions || ' to ' || cu.impressions || '.' FROM cu, pr WHERE cu.impressions <> pr.impressions
          UNION ALL SELECT abs(cu.position - pr.position) * 20, 303, 'Average position moved from ' || printf('%.1f', pr.position) || ' to ' || printf('%.1f', cu.position) || '.' FROM cu, pr WHERE abs(cu.position - pr.position) >= 0.1
          UNION ALL SELECT abs(ec.mention_rate - ep.mention_rate) * 100, 400, ec.engine || ' mention rate moved from ' || printf('%.2f', ep.mention_rate) || ' to ' || printf('%.2f', ec.mention_rate) || '.'
            FROM ec JOIN ep USING (engine) WHERE ec.mention_rate <> ep.mention_rate)
        SELECT 'https://example.com' AS site, CAST(row_number() OVER (ORDER BY w DESC, seq, line) AS INTEGER) AS rank, line FROM b ORDER BY rank LIMIT 5""",
    (*I, "v_search", "v_answers", "v_answer_urls"),
)
def headline(t):
    site = F.lit("https://example.com")
    prev, curr = _months(t)
    j = changes.search_delta(prev, curr).withColumn("prev", F.col("value") - F.col("delta"))
    a = answers.analyze(answers.attach_urls(t.v_answers, t.v_answer_urls), BRAND, RIVALS, DOMAINS)
    before = answers.engine_summary(a.filter("run < 3")).select("engine", F.col("mention_rate").alias("prev_mention_rate"))
    now = answers.engine_summary(a.filter("run >= 3")).select("engine", "mention_rate")
    ai = now.join(before, "engine").withColumn("site", site)
    return changes.headline(changes.issue_changes(t.v_issues_prev, t.v_issues_curr), None, j, ai)


@query(
    "missing_sources",
    """WITH l AS (SELECT DISTINCT concat('site', doc_id % 7) AS site, CASE doc_id % 5 WHEN 0 THEN 'crawl' WHEN 1 THEN 'gsc' WHEN 2 THEN 'ai' ELSE 'crawl' END AS source FROM documents)
       SELECT site, source, source || ' is missing from the current snapshot.' AS note FROM (SELECT DISTINCT site FROM l), (SELECT unnest(['crawl','lighthouse','gsc','ai']) AS source)
       WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.site = l.site AND x.source = source)""".replace("x.site = l.site AND x.source = source", "x.site = w.site AND x.source = w.source").replace(
        "FROM (SELECT DISTINCT site FROM l), (SELECT unnest(['crawl','lighthouse','gsc','ai']) AS source)",
        "FROM (SELECT * FROM (SELECT DISTINCT site FROM l), (SELECT unnest(['crawl','lighthouse','gsc','ai']) AS source)) w",
    ),
)
def missing_sources(t):
    d = F.col("doc_id")
    source = F.when(d % 5 == 0, "crawl").when(d % 5 == 1, "gsc").when(d % 5 == 2, "ai").otherwise("crawl")
    return changes.missing_sources(t.documents.select(F.concat(F.lit("site"), d % 7).alias("site"), source.alias("source")))


@query(
    "rank_fixes",
    f"""WITH imp AS (SELECT {q.url_key('page')} AS k, CAST(sum(impressions) AS BIGINT) AS impressions FROM v_search WHERE position BETWEEN 8 AND 20 GROUP BY 1)
        SELECT site, CASE WHEN code = 'canonical_mismatch' THEN 'a' WHEN impressions > 0 THEN 'b' ELSE 'e' END AS fix_class, code, url, severity, coalesce(impressions,0) AS impressions
        FROM v_issues_curr LEFT JOIN imp ON imp.k = {q.url_key('url')}
        ORDER BY fix_class, coalesce(impressions,0) DESC, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, code, url LIMIT 10""",
    (*I, "v_search"),
)
def rank_fixes(t):
    imp = search.page_two(t.v_search, 0).groupBy(urls.url_key("page").alias("url_key")).agg(F.sum("impressions").alias("impressions"))
    return changes.rank_fixes(t.v_issues_curr, imp)
