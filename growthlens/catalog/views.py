"""Derived input views, written once and run by both engines over whole tables.

The driver tables hold no crawl records, search rows, ads or leads, so these views derive them
row by row from the given tables. Each text is valid Spark SQL and DuckDB SQL.
"""

from __future__ import annotations

import re

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "v_crawl": """
SELECT 'https://example.com' AS site, page_id AS crawl_pos, concat('https://example.com/p/', page_id) AS url,
  CASE WHEN page_id%17=0 THEN 301 WHEN page_id%17=1 THEN 302 WHEN page_id%13=5 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id%17=0 THEN concat('https://example.com/p/', page_id+1)
       WHEN page_id%34=1 THEN concat('https://example.com/p/', page_id-1)
       WHEN page_id%17=1 THEN concat('https://www.example.com/p/', page_id+1, '/') END AS redirect_location,
  CASE WHEN page_id%29=3 THEN 'application/json' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id%58=3 THEN '<https://example.com/x>; rel="canonical"' END AS link_header,
  CASE WHEN page_id%37=4 THEN 'googlebot: noindex' END AS x_robots_tag,
  CASE WHEN page_id%23=0 THEN NULL
       WHEN page_id%19=0 THEN concat(regexp_extract(html,'(?is)<title>(.*?)</title>',1),' with a longer tail for length')
       ELSE regexp_extract(html,'(?is)<title>(.*?)</title>',1) END AS title,
  CASE page_id%5 WHEN 0 THEN NULL WHEN 1 THEN repeat('x',40) WHEN 2 THEN concat(repeat('y',100),page_id)
       ELSE concat(repeat('z',100),page_id%7) END AS meta_description,
  CASE page_id%9 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS h1_count,
  CASE page_id%7 WHEN 0 THEN NULL WHEN 1 THEN 'https://example.com/other'
       WHEN 2 THEN concat('https://example.com/p/',page_id,'/') ELSE concat('https://example.com/p/',page_id) END AS canonical,
  CASE WHEN page_id%11=0 THEN 'noindex, nofollow' WHEN page_id%11=1 THEN 'max-snippet:-1, index' END AS meta_robots,
  page_id%3<>0 AS in_sitemap,
  CASE WHEN page_id%5<3 THEN '2026-10-20' ELSE concat('2026-10-',10+page_id%9) END AS lastmod,
  page_id%4 AS images_missing_alt
FROM pages""",
    "v_crawl_prev": """
SELECT 'https://example.com' AS site, page_id AS crawl_pos,
  CASE WHEN page_id%2=0 THEN concat('https://www.example.com/p/',page_id,'/') ELSE concat('https://example.com/p/',page_id) END AS url,
  CASE WHEN page_id%31=0 THEN NULL ELSE regexp_extract(html,'(?is)<title>(.*?)</title>',1) END AS title,
  CASE page_id%6 WHEN 0 THEN NULL ELSE concat(repeat('z',100),page_id%7) END AS meta_description,
  CASE page_id%8 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS h1_count
FROM pages""",
    "v_links": """
SELECT 'https://example.com' AS site, src, dst, concat('https://example.com/p/', src) AS src_url,
  CASE WHEN dst%2=0 THEN concat('https://www.example.com/p/', dst, '/') ELSE concat('https://example.com/p/', dst) END AS dst_url
FROM (
  SELECT page_id AS src, CASE WHEN page_id*3+1 < (SELECT count(*) FROM pages) THEN page_id*3+1 ELSE 0 END AS dst FROM pages
  UNION ALL SELECT page_id, CASE WHEN page_id*3+2 < (SELECT count(*) FROM pages) THEN page_id*3+2 ELSE CAST(floor(page_id/4) AS BIGINT) END FROM pages
  UNION ALL SELECT page_id, page_id FROM pages
  UNION ALL SELECT page_id, 0 FROM pages) e""",
    "v_sitemap": """
SELECT site, crawl_pos AS pos, CASE WHEN crawl_pos%4=1 THEN concat(url,'/') ELSE url END AS loc, lastmod FROM v_crawl WHERE in_sitemap
UNION ALL SELECT site, crawl_pos+1000000000000, concat(url,'#again'), lastmod FROM v_crawl WHERE in_sitemap
UNION ALL SELECT site, crawl_pos+2000000000000, concat('https://other.example.org/p/',crawl_pos), lastmod FROM v_crawl WHERE in_sitemap""",
    "v_issues_curr": """
SELECT site, crawl_pos, code, url, severity FROM (
  SELECT site, crawl_pos, 'missing_title' AS code, url, 'high' AS severity FROM v_crawl WHERE title IS NULL
  UNION ALL SELECT site, crawl_pos, 'missing_description', url, 'medium' FROM v_crawl WHERE meta_description IS NULL
  UNION ALL SELECT site, crawl_pos, 'h1_count', url, 'medium' FROM v_crawl WHERE h1_count<>1
  UNION ALL SELECT site, crawl_pos, 'canonical_mismatch', url, 'high' FROM v_crawl WHERE canonical='https://example.com/other'
  UNION ALL SELECT site, crawl_pos, 'img_missing_alt', url, 'low' FROM v_crawl WHERE images_missing_alt>0) i""",
    "v_issues_prev": """
SELECT site, crawl_pos, code, url, severity FROM (
  SELECT site, crawl_pos, 'missing_title' AS code, url, CASE WHEN crawl_pos%2=0 THEN 'high' ELSE 'medium' END AS severity FROM v_crawl_prev WHERE title IS NULL
  UNION ALL SELECT site, crawl_pos, 'missing_description', url, 'medium' FROM v_crawl_prev WHERE meta_description IS NULL
  UNION ALL SELECT site, crawl_pos, 'h1_count', url, 'high' FROM v_crawl_prev WHERE h1_count<>1) i""",
    "v_search": """
SELECT CASE WHEN l_partkey%10=0 THEN concat('acme widgets ',l_partkey%30) ELSE concat('widget q',l_partkey%300) END AS query,
  concat('https://example.com/p/',l_suppkey%40) AS page, CASE l_linestatus WHEN 'O' THEN 'MOBILE' ELSE 'DESKTOP' END AS device,
  l_returnflag AS country, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_partkey%300%7=3 THEN 0 ELSE CAST(floor(CAST(l_quantity AS DECIMAL(12,2))*CAST(l_discount AS DECIMAL(4,2))) AS BIGINT) END AS clicks,
  CAST(floor(l_quantity*10) AS BIGINT) AS impressions,
  CAST((l_partkey%300*7)%40+1+l_linenumber%3 AS DOUBLE)+l_tax AS position FROM lineitem""",
    "v_rank": """
SELECT concat('d',l_suppkey%4) AS domain, CAST(date_trunc('month',l_shipdate) AS DATE) AS month,
  CASE l_partkey%6 WHEN 0 THEN concat('best k',l_partkey%(400+l_suppkey%4*100)) WHEN 1 THEN concat('k',l_partkey%(400+l_suppkey%4*100),' pricing')
    ELSE concat('k',l_partkey%(400+l_suppkey%4*100)) END AS keyword,
  min((l_orderkey*7+l_linenumber*3)%40+1) AS best_position, max((l_partkey%500)*7) AS volume FROM lineitem GROUP BY 1,2,3""",
    "v_lab": """
SELECT concat('https://example.com/p/',l_suppkey%10) AS url, CASE l_linestatus WHEN 'O' THEN 'mobile' ELSE 'desktop' END AS form_factor,
  CAST(date_trunc('month',l_shipdate) AS DATE) AS snapshot_date,
  ((l_orderkey*8+l_linenumber)*10000+l_partkey)*100000+CAST(floor(l_extendedprice) AS BIGINT) AS run_no,
  CASE WHEN l_orderkey%37=0 THEN NULL ELSE (l_orderkey*13+l_linenumber)%100 END AS performance,
  CAST(floor(l_extendedprice/20) AS BIGINT) AS lcp_ms, (l_partkey%300) AS cls_thousandths,
  CASE WHEN l_orderkey%91=5 THEN 'timed out' END AS error FROM lineitem""",
    "v_answers": """
SELECT conv_id*1000+turn AS answer_id, concat('engine',conv_id%3) AS engine, concat('p',conv_id%8) AS prompt_id,
  CASE conv_id%4 WHEN 0 THEN 'branded' WHEN 1 THEN 'category' WHEN 2 THEN 'comparison' ELSE 'cost' END AS kind, turn AS run,
  CASE WHEN (conv_id+turn)%9=0 THEN 'empty answer' END AS error, turn*125+conv_id%10 AS cost_micros,
  concat(CASE conv_id%5 WHEN 0 THEN 'Globex beat Acme, Initech lagged. ' WHEN 1 THEN 'Acme beat Initech. ' WHEN 2 THEN 'Academic Acmecorp note. '
    WHEN 3 THEN 'Initech then Globex. ' ELSE 'ACME is cited. ' END,
    CASE WHEN conv_id%4=0 THEN concat('It charges $',1000+(conv_id%50)*25,'. ') ELSE '' END, text,
    CASE WHEN conv_id%3=0 THEN concat(' Price list: $',200+(conv_id%7)*100,'.50') ELSE '' END) AS answer
FROM conversations WHERE role='assistant'""",
    "v_answer_urls": """
SELECT a.answer_id, 1 AS pos, p.url FROM v_answer_keys a JOIN pages p ON p.page_id=a.k1
UNION ALL SELECT a.answer_id, 2, p.url FROM v_answer_keys a JOIN pages p ON p.page_id=a.k2
UNION ALL SELECT a.answer_id, 3, concat('https://www.example.com/p/',a.k1) FROM v_answer_keys a WHERE a.k2%3=0
UNION ALL SELECT a.answer_id, 4, 'https://vertexaisearch.cloud.google.com/grounding-api-redirect/x' FROM v_answer_keys a WHERE a.k2%4=0""",
    "v_answer_keys": """
SELECT conv_id*1000+turn AS answer_id, (conv_id*7+turn) % (SELECT count(*) FROM pages) AS k1,
  (conv_id*7+turn*2) % (SELECT count(*) FROM pages) AS k2 FROM conversations WHERE role='assistant'""",
    "v_facts": "SELECT DISTINCT concat('$',1000+(c_custkey%25)*50,'.00') AS figure FROM customer",
    "v_prompts": """
SELECT concat('c',conv_id,'t',turn) AS prompt_id, conv_id*1000+turn AS prompt_pos,
  CASE conv_id%4 WHEN 0 THEN 'branded' WHEN 1 THEN 'category' WHEN 2 THEN 'comparison' ELSE 'cost' END AS kind, text
FROM conversations WHERE role='user'""",
    "v_ads": """
SELECT concat('c',l_suppkey%12) AS campaign, CASE WHEN l_suppkey%12=5 THEN 'REMOVED' ELSE 'ENABLED' END AS status,
  CASE l_suppkey%3 WHEN 0 THEN 'SEARCH' ELSE 'DISPLAY' END AS channel, concat('g',l_partkey%40) AS ad_group,
  CASE WHEN l_partkey%40=7 THEN 'REMOVED' ELSE 'ENABLED' END AS ad_group_status,
  concat('widget q',l_partkey%300) AS keyword, CASE l_partkey%3 WHEN 0 THEN 'EXACT' ELSE 'PHRASE' END AS match_type,
  concat('buy widget q',l_partkey%300,' ',l_linenumber%4) AS search_term, CAST(l_shipdate AS DATE) AS date,
  CAST(floor(l_quantity*20) AS BIGINT) AS impressions, CAST(floor(l_quantity) AS BIGINT) AS clicks,
  CAST(floor(l_extendedprice) AS BIGINT)*10000 AS cost_micros, CAST(l_linenumber%3 AS BIGINT) AS conversions FROM lineitem""",
    "v_content": """
SELECT concat('AC-',o_orderkey) AS content_id, o_orderkey AS content_no, CAST(o_orderdate AS DATE) AS date_published, CAST(o_custkey%24 AS INT) AS hour_published,
  CASE o_custkey%3 WHEN 0 THEN 'Instagram' WHEN 1 THEN 'LinkedIn' ELSE 'X' END AS platform,
  CASE o_orderkey%4 WHEN 0 THEN 'Reel 30-45s' WHEN 1 THEN 'Carousel 6-8' WHEN 2 THEN 'Photo' ELSE 'Thread' END AS format, o_orderpriority AS theme_topic,
  concat('hook',o_custkey%6) AS hook_used, o_orderstatus AS cta_type, CASE o_custkey%2 WHEN 0 THEN 'variant' ELSE 'control' END AS variant,
  CASE o_orderkey%11 WHEN 0 THEN NULL WHEN 1 THEN 'Link in bio' WHEN 2 THEN 'Happy 4th of July' WHEN 3 THEN concat('Call 555-01',10+o_orderkey%90,' now')
    ELSE concat('Caption ',o_orderkey%5000) END AS caption,
  CASE o_orderkey%8 WHEN 0 THEN 'concept' WHEN 1 THEN 'pre-production' WHEN 2 THEN 'captured' WHEN 3 THEN 'editing' WHEN 4 THEN 'pre-approval'
    WHEN 5 THEN 'approved' WHEN 6 THEN 'scheduled' ELSE 'published' END AS status FROM orders""",
    "v_perf": """
SELECT concat('AC-',l_orderkey) AS content_id, CAST(l_shipdate AS DATE) AS date_measured,
  (l_linenumber*10000+l_partkey)*1000000+CAST(floor(l_extendedprice) AS BIGINT) AS seq, CAST(floor(l_extendedprice/10) AS BIGINT) AS reach,
  CAST(floor(l_quantity*3) AS BIGINT) AS likes, CAST(l_linenumber AS BIGINT) AS comments, CAST(floor(l_quantity) AS BIGINT) AS shares,
  l_partkey%20 AS saves, l_suppkey%7 AS link_clicks FROM lineitem""",
    "v_leads": """
SELECT o_orderkey AS lead_id, CAST(o_orderdate AS DATE) AS lead_date, c_mktsegment AS lead_source, concat('AC-',(o_orderkey*3)%1000) AS content_id,
  CASE WHEN o_orderpriority='5-LOW' THEN 'Disqualified' WHEN o_orderstatus='F' THEN 'Won' WHEN o_orderstatus='O' THEN 'Lost' ELSE 'New' END AS lead_status,
  CASE WHEN o_orderstatus<>'P' THEN CAST(o_orderdate AS DATE) + CAST(o_custkey%60 AS INT) END AS close_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS revenue, CASE WHEN o_custkey%13=0 THEN NULL ELSE c_name END AS owner
FROM orders JOIN customer ON o_custkey=c_custkey""",
    "v_events": """
SELECT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS value, CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k,
  concat('/page/',event_id%40) AS page, props FROM events""",
    "v_touch": """
SELECT event_id, user_id, ts, event_type='purchase' AS is_conversion, concat('ch',event_id%5) AS channel, CAST(value AS DECIMAL(18,2)) AS value FROM events""",
    "v_stage_history": """
SELECT l_orderkey AS deal_id, CAST(l_shipdate AS DATE) AS changed_on, (l_linenumber*10000+l_partkey)*1000000+CAST(floor(l_extendedprice) AS BIGINT) AS seq,
  CASE l_linenumber%7 WHEN 0 THEN 'New Lead' WHEN 1 THEN 'Consultation' WHEN 2 THEN 'Estimating' WHEN 3 THEN 'Proposal Presented' WHEN 4 THEN 'Closed Won'
    WHEN 5 THEN 'Closed Lost' ELSE 'Disqualified' END AS stage,
  CASE (l_linenumber+l_suppkey%3)%8 WHEN 0 THEN 'concept' WHEN 1 THEN 'pre-production' WHEN 2 THEN 'captured' WHEN 3 THEN 'editing' WHEN 4 THEN 'pre-approval'
    WHEN 5 THEN 'approved' WHEN 6 THEN 'scheduled' ELSE 'published' END AS status FROM lineitem""",
    "v_ideas": """
SELECT p_partkey AS idea_id, CAST(p_size%10+1 AS INT) AS impact, CAST(p_partkey%10+1 AS INT) AS fit, CAST((p_partkey*7)%10+1 AS INT) AS search_potential,
  CAST((p_size*3)%10+1 AS INT) AS resources, p_brand AS theme FROM part""",
    "v_records": """
SELECT o_orderkey AS record_id, concat('directory',o_orderkey%5) AS directory,
  CASE WHEN o_orderkey%7<>0 THEN concat(CASE WHEN o_orderkey%2=0 THEN 'Studio ' ELSE 'STUDIO-' END,CAST(floor(o_custkey/4) AS BIGINT),CASE WHEN o_orderkey%3=0 THEN '.' ELSE '' END) END AS name,
  CASE WHEN o_orderkey%5<>0 THEN concat(CASE WHEN o_orderkey%2=0 THEN '+1 (555) ' ELSE '555-' END,1000000+CAST(floor(o_custkey/6) AS BIGINT)) END AS phone,
  concat(o_custkey%50,' Main Street') AS address, o_orderpriority AS category,
  concat('https://directory',o_orderkey%5,'.example.com/',o_orderkey) AS url,
  CASE WHEN o_orderkey%9=0 THEN concat('https://profiles.example.com/',CAST(floor(o_custkey/10) AS BIGINT),'/') END AS same_url
FROM orders""",
    "v_quoting": """
SELECT d.doc_id, s.doc_id AS source_id, concat('They said ',chr(34),CASE d.doc_id%4 WHEN 0 THEN upper(regexp_extract(replace(s.text,chr(34),''),'[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]+',0))
    WHEN 1 THEN substr(replace(s.text,chr(34),''),CAST(d.doc_id%50+1 AS INT),60) WHEN 2 THEN regexp_extract(s.text,'[A-Za-z]+ [A-Za-z]+',0) ELSE 'we never said it' END,
  chr(34),' and ',chr(34),substr(replace(d.text,chr(34),' '),1,30),chr(34),'.') AS text
FROM documents d JOIN documents s ON s.doc_id=(d.doc_id*7+3)%(SELECT count(*) FROM documents)""",
    "v_copy": """
SELECT doc_id, concat(
  CASE WHEN doc_id%6=0 THEN concat('---',chr(10),'title: robust delve',chr(10),'---',chr(10)) ELSE '' END,
  CASE WHEN doc_id%5=0 THEN concat('## Caption one',chr(10)) ELSE '' END,
  CASE doc_id%7 WHEN 0 THEN concat('We delve into a robust plan.',chr(10)) WHEN 1 THEN concat('Not only fast but also vital, ensuring calm.',chr(10))
    WHEN 2 THEN concat('Owner: "Hi there" and moreover a myriad of things',chr(10)) WHEN 3 THEN concat('> quoted delve',chr(10),'#remodel #kitchen',chr(10))
    WHEN 4 THEN concat('Whether you wait or act, it is crucial ','—',' truly.',chr(10)) WHEN 5 THEN concat('https://example.com/delve',chr(10),'[seamless](http://x.y)',chr(10))
    ELSE concat('The landscape lighting is holistic; the landscape shifts.',chr(10)) END,
  CASE WHEN doc_id%10=0 THEN concat('## Revision history',chr(10),'pivotal paramount',chr(10),'```',chr(10),'seamless',chr(10),'```',chr(10),'## Notes',chr(10)) ELSE '' END,
  text) AS text FROM documents""",
}


def _names(sql: str, pool) -> list[str]:
    return [n for n in pool if re.search(rf"\b{n}\b", sql)]


def with_clause(*views: str) -> tuple[str, list[str]]:
    """WITH clause that defines ``views`` after everything they use, and the tables they read."""
    ordered: list[str] = []
    tables: set[str] = set()

    def visit(view: str) -> None:
        if view in ordered:
            return
        for dep in _names(VIEWS[view], VIEWS):
            if dep != view:
                visit(dep)
        tables.update(_names(VIEWS[view], TABLES))
        ordered.append(view)

    for view in views:
        visit(view)
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in ordered), sorted(tables)
