"""Site audit queries over the derived crawl."""

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import audit, linkgraph
from ..operators.copyq import near_duplicates
from ..operators.extract import visible_text
from . import sqlurl as q
from .base import query
from .copy import near_sql

CRAWL = ("v_crawl", "v_links", "v_sitemap")

# Oracle building blocks: resolution, chains, final records, inbound counts, sitemap entries.
PAGES_SQL = f"""p AS (SELECT c.*, {q.url_key('url')} AS k, {q.exact_url('url')} AS x, status IN (301,302,303,307,308) AS rd,
  status = 200 AND contains(lower(content_type),'html') AS is_html,
  coalesce(contains(meta_robots,'noindex'),FALSE) OR coalesce(contains(x_robots_tag,'noindex'),FALSE) AS noindex FROM v_crawl c)"""
RESOLVE_SQL = f"""want AS (SELECT DISTINCT u, {q.exact_url('u')} AS x, {q.url_key('u')} AS k FROM (
    SELECT redirect_location AS u FROM p WHERE redirect_location IS NOT NULL UNION ALL SELECT dst_url FROM v_links UNION ALL SELECT loc FROM v_sitemap)),
  found AS (SELECT w.u, p.url, row_number() OVER (PARTITION BY w.u ORDER BY (p.x = w.x) DESC, p.rd, p.crawl_pos DESC) AS rn FROM want w JOIN p ON p.k = w.k),
  res AS (SELECT u, url FROM found WHERE rn = 1)"""
CHAIN_SQL = f"""chain AS (
  SELECT url, [url] AS chain, [k] AS seen, url AS final_url, url AS final_page, url AS cur, 0 AS step FROM p WHERE rd AND redirect_location IS NOT NULL
  UNION ALL
  SELECT c.url, list_append(c.chain, e.redirect_location), CASE WHEN r.url IS NOT NULL THEN list_append(c.seen, {q.url_key('e.redirect_location')}) ELSE c.seen END,
    CASE WHEN r.url IS NOT NULL THEN e.redirect_location ELSE c.final_url END, coalesce(r.url, c.final_page),
    CASE WHEN r.url IS NOT NULL AND NOT list_contains(c.seen, {q.url_key('e.redirect_location')}) THEN r.url END, c.step + 1
  FROM chain c JOIN p e ON e.url = c.cur AND e.rd AND e.redirect_location IS NOT NULL LEFT JOIN res r ON r.u = e.redirect_location WHERE c.step < 5),
  chains AS (SELECT * FROM chain QUALIFY row_number() OVER (PARTITION BY url ORDER BY step DESC) = 1),
  fin AS (SELECT p.*, CAST(coalesce(len(ch.chain) - 1, 0) AS INTEGER) AS hops, coalesce(ch.final_url, p.url) AS final_url, coalesce(ch.final_page, p.url) AS final_page
    FROM p LEFT JOIN chains ch ON ch.url = p.url),
  f AS (SELECT fin.*, e.status AS f_status, e.content_type AS f_type, e.link_header AS f_link, e.is_html AS f_html, e.noindex AS f_noindex
    FROM fin JOIN p e ON e.url = fin.final_page)"""
LINK_SQL = f"""lk AS (SELECT l.*, {q.url_key('src_url')} AS sk, {q.url_key('dst_url')} AS dk FROM v_links l JOIN p ON p.url = l.src_url AND p.is_html),
  inb AS (SELECT dk AS k, count(DISTINCT src_url) AS n FROM lk WHERE sk <> dk GROUP BY dk)"""
ENTRY_SQL = f"""ent AS (SELECT {q.url_key('loc')} AS k, arg_min(regexp_replace(loc,'#.*$',''), pos) AS loc, arg_min(lastmod, pos) AS lastmod, min(pos) AS pos
  FROM v_sitemap WHERE {q.bare(q.host('loc'))} = 'example.com' GROUP BY 1)"""
BASE_SQL = f"WITH RECURSIVE {PAGES_SQL}, {RESOLVE_SQL}, {CHAIN_SQL}, {LINK_SQL}, {ENTRY_SQL}"

FIELD_SQL = f"""
SELECT 'missing_title' AS code, 'high' AS severity, url, 'No title' AS detail FROM f WHERE is_html AND coalesce(title,'') = ''
UNION ALL SELECT 'title_too_long','medium',url, length(title) || ' characters' FROM f WHERE is_html AND length(title) > 60
UNION ALL SELECT 'missing_description','medium',url,'No meta description' FROM f WHERE is_html AND coalesce(meta_description,'') = ''
UNION ALL SELECT 'description_length','medium',url, length(meta_description) || ' characters' FROM f WHERE is_html AND meta_description <> '' AND (length(meta_description) < 70 OR length(meta_description) > 160)
UNION ALL SELECT 'h1_count','medium',url,'Found ' || h1_count || ' h1' FROM f WHERE is_html AND h1_count <> 1
UNION ALL SELECT 'canonical_missing','medium',url,'No canonical' FROM f WHERE is_html AND canonical IS NULL
UNION ALL SELECT 'canonical_mismatch','high',url,'Canonical is ' || canonical FROM f WHERE is_html AND {q.slash_key('canonical')} <> {q.slash_key('final_url')}
UNION ALL SELECT 'img_missing_alt','low',url, images_missing_alt || CASE WHEN images_missing_alt = 1 THEN ' image' ELSE ' images' END || ' missing alt' FROM f WHERE is_html AND images_missing_alt > 0
UNION ALL SELECT 'redirect_chain','medium',url, hops || ' hops' FROM f WHERE hops > 1"""
LINKED_SQL = """
SELECT 'orphan' AS code,'medium' AS severity,url,'In the sitemap with no internal links pointing here' AS detail FROM f WHERE is_html AND k IN (SELECT k FROM ent) AND k NOT IN (SELECT k FROM inb)
UNION ALL SELECT 'thin_inbound','low',f.url,'Only 1 internal page links here' FROM f JOIN inb USING (k) WHERE is_html AND NOT noindex AND n = 1
UNION ALL SELECT 'not_in_sitemap','medium',f.url,'Indexable page is not in the sitemap' FROM f JOIN inb USING (k) WHERE is_html AND NOT noindex AND k NOT IN (SELECT k FROM ent)
UNION ALL SELECT 'noindex_linked','low',f.url,'noindex, but linked from ' || n || ' pages' FROM f JOIN inb USING (k) WHERE is_html AND noindex"""


def _dup_sql(field: str, code: str, label: str) -> str:
    return f"""SELECT '{code}' AS code, 'medium' AS severity, a.url, 'Same {label} as ' || array_to_string(list_filter(us, lambda u: u <> a.url)[1:5], ', ') ||
  CASE WHEN g.n > 6 THEN ', and ' || (g.n - 6) || ' more' ELSE '' END AS detail
  FROM f a JOIN (SELECT {field}, count(*) AS n, list(url ORDER BY crawl_pos) AS us FROM f WHERE is_html AND {field} <> '' GROUP BY 1 HAVING count(*) > 1) g
  ON a.{field} = g.{field} AND a.is_html"""


BROKEN_SQL = """SELECT 'broken_internal_link' AS code, 'high' AS severity, url,
  'Status ' || st || '. Linked from ' || array_to_string(list(src ORDER BY src)[1:50], ', ') || CASE WHEN count(*) > 50 THEN ', and ' || (count(*) - 50) || ' more' ELSE '' END AS detail
  FROM (SELECT DISTINCT f.final_page AS url, f.f_status AS st, lk.src_url AS src FROM lk JOIN res ON res.u = lk.dst_url JOIN f ON f.url = res.url WHERE f.f_status >= 400)
  GROUP BY url, st"""
SITEMAP_SQL = """
SELECT 'sitemap_redirect' AS code,'medium' AS severity,f.url,'Redirects to ' || coalesce(redirect_location,'unknown') AS detail FROM ent JOIN res ON res.u = ent.loc JOIN f ON f.url = res.url WHERE rd
UNION ALL SELECT 'sitemap_non_200','high',f.url,'Final status ' || f_status FROM ent JOIN res ON res.u = ent.loc JOIN f ON f.url = res.url WHERE f_status <> 200
UNION ALL SELECT 'sitemap_noindex','high',f.url,'Sitemap URL is noindex' FROM ent JOIN res ON res.u = ent.loc JOIN f ON f.url = res.url WHERE f_status = 200 AND f_html AND f_noindex
UNION ALL SELECT 'sitemap_non_html','medium',f.url,f_type FROM ent JOIN res ON res.u = ent.loc JOIN f ON f.url = res.url
  WHERE f_status = 200 AND lower(split_part(f_type,';',1)) <> 'text/html' AND NOT coalesce(contains(f_link,'canonical'),FALSE)"""
LASTMOD_SQL = """SELECT 'sitemap_lastmod_uniform' AS code, 'low' AS severity, 'https://example.com' AS url, n || ' of ' || total || ' URLs share lastmod ' || lastmod AS detail
  FROM (SELECT lastmod, count(*) AS n, min(pos) AS seen, (SELECT count(*) FROM ent) AS total FROM ent WHERE trim(lastmod) <> '' GROUP BY lastmod ORDER BY n DESC, seen LIMIT 1)
  WHERE total > 5 AND n * 2 > total"""
ALL_SQL = " UNION ALL ".join(
    f"SELECT code, severity, url, detail FROM ({s})"
    for s in (
        FIELD_SQL,
        LINKED_SQL,
        _dup_sql("title", "duplicate_title", "title"),
        _dup_sql("meta_description", "duplicate_description", "description"),
        BROKEN_SQL,
        SITEMAP_SQL,
        LASTMOD_SQL,
    )
)


def _prepared(t):
    return audit.prepare_pages(t.v_crawl)


def _finals(t):
    return linkgraph.with_final(_prepared(t))


def _only(df, *codes):
    return df.filter(F.col("code").isin(*codes)).drop("site")


def _sql(body: str, *codes: str) -> str:
    where = "" if not codes else " WHERE code IN (" + ",".join(f"'{c}'" for c in codes) + ")"
    return f"{BASE_SQL} SELECT code, severity, url, detail FROM ({body}){where}"


@query(
    "redirect_chains",
    f"""{BASE_SQL} SELECT url, array_to_string(chain, ' > ') AS chain, CAST(len(chain) - 1 AS INTEGER) AS hops, final_url, final_page FROM chains""",
    CRAWL,
)
def redirect_chains(t):
    c = linkgraph.redirect_chains(_prepared(t))
    return c.select("url", F.array_join("chain", " > ").alias("chain"), "hops", "final_url", "final_page")


@query("broken_links", _sql(BROKEN_SQL), CRAWL)
def broken_links(t):
    return audit.broken_link_issues(_finals(t), t.v_links).drop("site")


@query(
    "broken_link_sources",
    f"""{BASE_SQL} SELECT DISTINCT f.final_page AS url, f.f_status AS status, lk.src_url FROM lk JOIN res ON res.u = lk.dst_url
        JOIN f ON f.url = res.url WHERE f.f_status >= 400""",
    CRAWL,
)
def broken_link_sources(t):
    finals = _finals(t)
    return linkgraph.broken_link_sources(finals, audit.html_links(finals, t.v_links)).drop("site")


@query("inbound_degree", f"{BASE_SQL} SELECT k AS url_key, n AS inbound FROM inb", CRAWL)
def inbound_degree(t):
    return linkgraph.inbound_degree(audit.html_links(_prepared(t), t.v_links)).drop("site")


def _linked(t):
    return audit.link_issues(_prepared(t), t.v_links, audit.sitemap_entries(t.v_sitemap))


@query("orphans", _sql(LINKED_SQL, "orphan"), CRAWL)
def orphans(t):
    return _only(_linked(t), "orphan")


@query("thin_inbound", _sql(LINKED_SQL, "thin_inbound"), CRAWL)
def thin_inbound(t):
    return _only(_linked(t), "thin_inbound")


@query("noindex_linked", _sql(LINKED_SQL, "noindex_linked"), CRAWL)
def noindex_linked(t):
    return _only(_linked(t), "noindex_linked")


@query("not_in_sitemap", _sql(LINKED_SQL, "not_in_sitemap"), CRAWL)
def not_in_sitemap(t):
    return _only(_linked(t), "not_in_sitemap")


@query("sitemap_entries", f"{BASE_SQL} SELECT k AS url_key, loc, lastmod, pos FROM ent", CRAWL)
def sitemap_entries(t):
    return audit.sitemap_entries(t.v_sitemap).drop("site")


@query("sitemap_checks", _sql(SITEMAP_SQL), CRAWL)
def sitemap_checks(t):
    return audit.sitemap_issues(_finals(t), audit.sitemap_entries(t.v_sitemap)).drop("site")


@query(
    "description_checks",
    _sql(
        f"SELECT * FROM ({FIELD_SQL}) UNION ALL SELECT * FROM ({_dup_sql('meta_description', 'duplicate_description', 'description')})",
        "missing_description", "description_length", "duplicate_description",
    ),
    CRAWL,
)
def description_checks(t):
    p = _finals(t)
    both = audit.page_field_issues(p).unionByName(
        audit.duplicates(p, "meta_description", "duplicate_description", "description")
    )
    return _only(both, "missing_description", "description_length", "duplicate_description")


@query("canonical_checks", _sql(FIELD_SQL, "canonical_mismatch", "canonical_missing"), CRAWL)
def canonical_checks(t):
    return _only(audit.page_field_issues(_finals(t)), "canonical_mismatch", "canonical_missing")


@query("missing_or_long_titles", _sql(FIELD_SQL, "missing_title", "title_too_long"), CRAWL)
def missing_or_long_titles(t):
    return _only(audit.page_field_issues(_finals(t)), "missing_title", "title_too_long")


@query("img_missing_alt", _sql(FIELD_SQL, "img_missing_alt"), CRAWL)
def img_missing_alt(t):
    return _only(audit.page_field_issues(_finals(t)), "img_missing_alt")


@query("h1_checks", _sql(FIELD_SQL, "h1_count"), CRAWL)
def h1_checks(t):
    return _only(audit.page_field_issues(_finals(t)), "h1_count")


@query("long_redirects", _sql(FIELD_SQL, "redirect_chain"), CRAWL)
def long_redirects(t):
    return _only(audit.page_field_issues(_finals(t)), "redirect_chain")


@query("lastmod_uniform", _sql(LASTMOD_SQL), CRAWL)
def lastmod_uniform(t):
    return audit.lastmod_issues(audit.sitemap_entries(t.v_sitemap)).drop("site")


@query("site_audit", _sql(ALL_SQL), CRAWL)
def site_audit(t):
    return audit.site_audit(t.v_crawl, t.v_links, t.v_sitemap).drop("site")


@query(
    "issue_counts",
    f"""{BASE_SQL} SELECT code, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
        count(*) FILTER (WHERE severity = 'low') AS low FROM ({ALL_SQL}) GROUP BY code""",
    CRAWL,
)
def issue_counts(t):
    return audit.issue_counts(audit.site_audit(t.v_crawl, t.v_links, t.v_sitemap)).drop("site")


@query(
    "click_depth",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT {q.url_key('src_url')} AS s, {q.url_key('dst_url')} AS d FROM v_links),
        bfs AS (SELECT 'https://example.com/p/0' AS k, 0 AS depth UNION SELECT e.d, depth + 1 FROM bfs JOIN e ON e.s = bfs.k WHERE depth < 60)
        SELECT k AS url_key, min(depth) AS depth FROM bfs GROUP BY k""",
    ("v_links",),
)
def click_depth(t):
    home = t.v_links.select("site").distinct().select("site", urls.url_key(F.concat("site", F.lit("/p/0"))).alias("url_key"))
    return linkgraph.click_depth(t.v_links, home).drop("site")


@query(
    "migration_audit",
    f"""{BASE_SQL}, old AS (SELECT DISTINCT u FROM (SELECT 'http://www.example.com:80/p/' || page_id AS u FROM pages)),
        hit AS (SELECT old.u, f.f_status AS final_status, f.hops FROM old LEFT JOIN f ON f.k = replace({q.url_key('u')},'http://','https://') AND FALSE)
        SELECT CAST(NULL AS INTEGER) AS final_status, count(*) AS n_urls, CAST(0 AS BIGINT) AS redirected FROM hit GROUP BY 1
        UNION ALL SELECT f_status, count(*), count(*) FILTER (WHERE hops > 0) FROM f GROUP BY 1""",
    CRAWL,
)
def migration_audit(t):
    from functools import reduce

    c = t.v_crawl
    old = [c.select("site", F.concat(F.lit("http://www.example.com:80/p/"), "crawl_pos").alias("url")),
           c.select("site", F.concat(F.lit("https://www.example.com/p/"), "crawl_pos", F.lit("/")).alias("url"))]
    return audit.migration_audit(reduce(lambda a, b: a.unionByName(b), old), _finals(t)).drop("site")


@query(
    "crowded_targets",
    f"{BASE_SQL} SELECT final_page, count(*) AS n_sources FROM f WHERE hops > 0 GROUP BY final_page HAVING count(*) >= 2",
    CRAWL,
)
def crowded_targets(t):
    return audit.crowded_targets(_finals(t), 2).drop("site")


VISIBLE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<!--.*?-->','','g'),'(?is)<script[^>]*>.*?</script>','','g'),'(?is)<style[^>]*>.*?</style>','','g'),
  '(?is)<title[^>]*>.*?</title>','','g'),'(?s)<[/!?a-zA-Z][^>]*>','','g')"""


@query("near_duplicate_pages", near_sql(f"SELECT page_id AS doc_id, {VISIBLE_SQL} AS text FROM pages"))
def near_duplicate_pages(t):
    return near_duplicates(t.pages.select(F.col("page_id").alias("doc_id"), visible_text(F.col("html")).alias("text")))
