"""Search performance queries."""

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import search
from .base import half_even, query

BRAND = ["acme"]
S, R = ("v_search",), ("v_rank",)
CTR = half_even("sum(clicks)", "sum(impressions)", 4)
POS = half_even("sum(CAST(round(position*100) AS BIGINT)*impressions)", "(sum(impressions)*100)", 1)
M = f"CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {CTR} AS ctr, {POS} AS position"


@query("page_two", "SELECT * FROM v_search WHERE position BETWEEN 8 AND 20 AND impressions >= 20", S)
def page_two(t):
    return search.page_two(t.v_search)


@query("search_by_query_page", f"SELECT query, page, {M} FROM v_search GROUP BY ALL", S)
def search_by_query_page(t):
    return search.search_report(t.v_search, ["query", "page"])


@query("search_by_device_country", f"SELECT device, country, {M} FROM v_search GROUP BY ALL", S)
def search_by_device_country(t):
    return search.search_report(t.v_search, ["device", "country"])


@query("search_top_pages", f"SELECT page, {M} FROM v_search GROUP BY ALL", S)
def search_top_pages(t):
    return search.search_report(t.v_search, ["page"])


@query(
    "search_totals",
    f"""SELECT {M} FROM v_search WHERE date BETWEEN (SELECT max(date) FROM v_search) - 30 AND (SELECT max(date) FROM v_search) - 3""",
    S,
)
def search_totals(t):
    rows = t.v_search
    last = rows.agg(F.max("date")).scalar()
    return rows.filter(F.col("date").between(F.date_sub(last, 30), F.date_sub(last, 3))).agg(*search.measures())


@query(
    "search_trend",
    f"""SELECT *, clicks - lag(clicks) OVER (ORDER BY month) AS clicks_delta, impressions - lag(impressions) OVER (ORDER BY month) AS impressions_delta
        FROM (SELECT CAST(date_trunc('month',date) AS DATE) AS month, {M} FROM v_search GROUP BY 1)""",
    S,
)
def search_trend(t):
    return search.monthly_trend(t.v_search)


@query(
    "brand_split",
    f"""SELECT coalesce(segment,'all') AS segment, {M} FROM (SELECT CASE WHEN regexp_matches(query,'(?i)(^|[^a-z0-9_])acme([^a-z0-9_]|$)')
        THEN 'brand' ELSE 'non-brand' END AS segment, * FROM v_search) GROUP BY ROLLUP(segment)""",
    S,
)
def brand_split(t):
    return search.brand_split(t.v_search, BRAND)


@query(
    "cannibalization",
    f"""WITH p AS (SELECT query, page, CAST(sum(impressions) AS BIGINT) AS impressions FROM v_search WHERE impressions > 0 GROUP BY 1,2)
        SELECT query, page, impressions, n_pages, {half_even('impressions', 'total', 4)} AS share FROM p
        JOIN (SELECT query, count(*) AS n_pages, sum(impressions) AS total FROM p GROUP BY 1 HAVING count(*) > 1) USING (query)""",
    S,
)
def cannibalization(t):
    return search.cannibalization(t.v_search)


BUCKET = "CASE WHEN position < 4 THEN '1-3' WHEN position < 11 THEN '4-10' WHEN position < 21 THEN '11-20' WHEN position < 51 THEN '21-50' ELSE '51+' END"


@query(
    "position_buckets",
    f"""SELECT {BUCKET} AS bucket, count(DISTINCT query) AS keywords, CAST(sum(impressions) AS BIGINT) AS impressions,
        CAST(sum(clicks) AS BIGINT) AS clicks FROM v_search GROUP BY 1""",
    S,
)
def position_buckets(t):
    return search.position_buckets(t.v_search)


@query("quick_wins", "SELECT * FROM v_rank WHERE best_position BETWEEN 5 AND 20 AND volume > 100", R)
def quick_wins(t):
    return search.quick_wins(t.v_rank)


@query(
    "content_gap",
    """SELECT keyword, count(DISTINCT domain) AS competitors, max(volume) AS volume, min(best_position) AS best_competitor_position
       FROM v_rank WHERE keyword NOT IN (SELECT keyword FROM v_rank WHERE domain = 'd0') GROUP BY keyword""",
    R,
)
def content_gap(t):
    return search.content_gap(t.v_rank, "d0")


@query(
    "competitor_overlap",
    """WITH c AS (SELECT month, domain, count(DISTINCT keyword) AS common_keywords FROM v_rank a WHERE domain <> 'd0' AND EXISTS
         (SELECT 1 FROM v_rank b WHERE b.domain = 'd0' AND b.month = a.month AND b.keyword = a.keyword) GROUP BY 1,2)
       SELECT month, domain, common_keywords, NOT EXISTS (SELECT 1 FROM c p WHERE p.domain = c.domain AND p.month + INTERVAL 1 MONTH = c.month) AS is_new FROM c""",
    R,
)
def competitor_overlap(t):
    return search.competitor_overlap(t.v_rank, "d0")


@query(
    "position_moves",
    """SELECT domain, keyword, month, position, prev_position, CASE WHEN prev_position IS NULL THEN 'new' WHEN position IS NULL THEN 'lost' ELSE 'kept' END AS change,
         prev_position - position AS gain
       FROM (SELECT domain, keyword, month, best_position AS position FROM v_rank)
       FULL OUTER JOIN (SELECT domain, keyword, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, best_position AS prev_position FROM v_rank)
       USING (domain, keyword, month) WHERE month <= (SELECT max(month) FROM v_rank)""",
    R,
)
def position_moves(t):
    return search.position_moves(t.v_rank)


@query(
    "serp_suppressed",
    f"""SELECT query, {M} FROM v_search WHERE NOT regexp_matches(query,'(?i)(^|[^a-z0-9_])acme([^a-z0-9_]|$)') GROUP BY query
        HAVING {POS} <= 10 AND sum(impressions) >= 1000 AND {CTR} <= 0.001""",
    S,
)
def serp_suppressed(t):
    return search.serp_suppressed(t.v_search, BRAND, 1000, 0.001)


@query(
    "title_lever",
    f"""WITH b AS (SELECT query, page, {M} FROM v_search GROUP BY 1,2), c AS (SELECT *, CAST(floor(position) AS INTEGER) AS band FROM b WHERE position BETWEEN 5 AND 10)
        SELECT band, query, page, clicks, impressions, ctr, position, median_ctr FROM c JOIN (SELECT band, quantile_cont(ctr, 0.5) AS median_ctr FROM c GROUP BY band)
        USING (band) WHERE ctr < median_ctr""",
    S,
)
def title_lever(t):
    return search.title_lever(t.v_search)


@query(
    "demand_without_page",
    f"""SELECT query, impressions, has_page, home_share FROM (SELECT query, CAST(sum(impressions) AS BIGINT) AS impressions,
          bool_or(page IN (SELECT url FROM v_crawl WHERE in_sitemap)) AS has_page,
          {half_even("sum(CASE WHEN page = 'https://example.com/p/0' THEN impressions ELSE 0 END)", 'sum(impressions)', 4)} AS home_share FROM v_search GROUP BY query)
        WHERE NOT has_page OR home_share > 0.03""",
    ("v_search", "v_crawl"),
)
def demand_without_page(t):
    listed = t.v_crawl.filter("in_sitemap").select(urls.url_key("url").alias("url_key"))
    return search.demand_without_page(t.v_search, listed, "https://example.com/p/0", 0.03)


@query("seo_opportunities", f"SELECT query, {M} FROM v_search GROUP BY query HAVING sum(impressions) >= 5000 AND {CTR} <= 0.003", S)
def seo_opportunities(t):
    return search.seo_opportunities(t.v_search, 5000, 0.003)


@query(
    "keyword_map",
    f"""WITH p AS (SELECT query, page, sum(impressions) AS i, sum(CAST(round(position*100) AS BIGINT)*impressions) AS w FROM v_search GROUP BY 1,2),
        g AS (SELECT query, arg_max(page, (i, page)) AS target_page, max(i) AS best, sum(i) AS total, sum(w) AS w FROM p GROUP BY 1),
        h AS (SELECT query, target_page, CAST(total AS BIGINT) AS impressions, {half_even('w', '(total*100)', 1)} AS position, {half_even('best', 'total', 4)} AS target_share FROM g)
        SELECT *, CASE WHEN target_share < 0.6 THEN 'merge' WHEN position < 8 THEN 'keep' WHEN position <= 20 THEN 'improve' ELSE 'build' END AS action,
          CAST(NULL AS VARCHAR) AS stage FROM h""",
    S,
)
def keyword_map(t):
    return search.keyword_map(t.v_search)


@query(
    "buyer_stages",
    """SELECT CASE WHEN keyword LIKE 'best %' THEN 'consideration' WHEN keyword LIKE '% pricing' THEN 'decision' END AS stage,
       count(DISTINCT keyword) AS keywords FROM v_rank GROUP BY 1""",
    R,
)
def buyer_stages(t):
    from ..functions.text import buyer_stage

    k = t.v_rank.select("keyword").distinct()
    return k.groupBy(buyer_stage("keyword").alias("stage")).agg(F.count("*").alias("keywords"))


@query(
    "pattern_demand",
    f"""WITH k AS (SELECT month, keyword, max(volume) AS volume FROM v_rank GROUP BY 1,2),
        p AS (SELECT CASE WHEN keyword LIKE 'best %' THEN 'best' WHEN keyword LIKE '% pricing' THEN 'pricing' ELSE 'other' END AS pattern, month,
          count(*) AS keywords, CAST(sum(volume) AS BIGINT) AS volume, {half_even('sum(CASE WHEN volume >= 2000 THEN volume ELSE 0 END)', 'sum(volume)', 4)} AS head_share FROM k GROUP BY 1,2)
        SELECT *, volume - lag(volume) OVER (PARTITION BY pattern ORDER BY month) AS change FROM p""",
    R,
)
def pattern_demand(t):
    return search.pattern_demand(t.v_rank, {"best": "^best ", "pricing": " pricing$"}, 2000)


@query(
    "capped_rows",
    """SELECT *, (row_number() OVER (PARTITION BY country ORDER BY clicks DESC, impressions DESC, query, page, device, date, position) - 1) // 100 + 1 AS window_no FROM v_search""",
    S,
)
def capped_rows(t):
    order = [F.desc("clicks"), F.desc("impressions"), "query", "page", "device", "date", "position"]
    return search.capped_rows(t.v_search, ["country"], order, 100)


@query(
    "info_sample",
    """SELECT * FROM (SELECT 'https://example.com/' AS page, CAST(-1 AS BIGINT) AS pos UNION ALL SELECT page, min(impressions) FROM v_search GROUP BY page)
       ORDER BY pos, page LIMIT 20""",
    S,
)
def info_sample(t):
    return search.info_sample("https://example.com/", t.v_search.select("page", F.col("impressions").alias("pos")))
