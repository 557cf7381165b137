"""Queries over raw pages: identities, extraction, links, hygiene."""

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import audit, extract
from ..session import cut_lineage
from . import sqlurl as q
from .base import query

TITLE_SQL = "trim(regexp_replace(replace(regexp_extract(html,'(?is)<title>(.*?)</title>',1),'&amp;','&'),'\\s+',' ','g'))"
HREFS_SQL = """(SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(regexp_replace(html,'(?is)<!--.*?-->','','g'),
  '(?is)<script[^>]*>.*?</script>','','g'),'(?i)<a href="([^"]+)"',1)) AS href FROM pages)"""


@query(
    "url_identity",
    f"""SELECT page_id, {q.url_key('url')} AS url_key, {q.exact_url('url')} AS exact_url, {q.slash_key('url')} AS slash_key,
        {q.issue_key('url')} AS issue_key, {q.bare(q.host('url'))} AS site_host FROM pages""",
)
def url_identity(t):
    return t.pages.select(
        "page_id",
        urls.url_key("url").alias("url_key"),
        urls.exact_url("url").alias("exact_url"),
        urls.slash_key("url").alias("slash_key"),
        urls.issue_url_key("url").alias("issue_key"),
        urls.bare_host(urls.url_host("url")).alias("site_host"),
    )


@query(
    "utm_audit",
    """SELECT source, count(*) AS n_urls, CAST(count(*) FILTER (WHERE source = lower(source)) AS BIGINT) AS lower_case,
       CAST(count(*) FILTER (WHERE medium IS NULL) AS BIGINT) AS without_medium FROM (
         SELECT nullif(regexp_extract(u,'[?&]utm_source=([^&#]*)',1),'') AS source, nullif(regexp_extract(u,'[?&]utm_medium=([^&#]*)',1),'') AS medium
         FROM (SELECT url || CASE WHEN contains(url,'?') THEN '&' ELSE '?' END || 'utm_source=' ||
           CASE WHEN page_id%3=0 THEN 'Instagram' ELSE 'linkedin' END || CASE WHEN page_id%4=0 THEN '' ELSE '&utm_medium=social' END AS u
           FROM (SELECT page_id, regexp_replace(url,'#.*$','') AS url FROM pages))) GROUP BY source""",
)
def utm_audit(t):
    from ..operators.web import utm_audit as job

    tagged = F.concat(
        urls.drop_fragment("url"),
        F.when(F.contains(urls.drop_fragment("url"), F.lit("?")), "&").otherwise("?"),
        F.lit("utm_source="),
        F.when(F.col("page_id") % 3 == 0, "Instagram").otherwise("linkedin"),
        F.when(F.col("page_id") % 4 == 0, "").otherwise("&utm_medium=social"),
    )
    return job(t.pages.select(tagged.alias("url")))


@query("page_titles", f"SELECT page_id, {TITLE_SQL} AS title, length({TITLE_SQL}) AS title_length FROM pages")
def page_titles(t):
    e = extract.extract_pages(t.pages)
    return e.select("page_id", "title", F.length("title").cast("bigint").alias("title_length"))


@query(
    "duplicate_titles",
    f"""WITH p AS (SELECT page_id, url, {TITLE_SQL} AS title FROM pages),
        g AS (SELECT title, count(*) AS n, list(url ORDER BY page_id) AS us FROM p GROUP BY title HAVING count(*) > 1)
        SELECT p.url, 'duplicate_title' AS code, 'Same title as ' ||
          array_to_string(list_filter(us, lambda u: u <> p.url)[1:5], ', ') ||
          CASE WHEN n > 6 THEN ', and ' || (n-6) || ' more' ELSE '' END AS detail
        FROM p JOIN g USING (title)""",
)
def duplicate_titles(t):
    e = extract.extract_pages(t.pages.withColumn("site", F.lit("all"))).select(
        "site", "url", F.col("page_id").alias("crawl_pos"), "title", F.lit(True).alias("is_html")
    )
    # extracted once: the duplicate check reads the titles three times
    return audit.duplicates(cut_lineage(e), "title", "duplicate_title", "title").select("url", "code", "detail")


@query(
    "h1_and_canonical",
    r"""SELECT page_id, CAST(len(regexp_extract_all(html,'(?is)<h1\b[^>]*>.*?</h1>')) AS INTEGER) AS h1_count,
        contains(html,'rel="canonical"') AS has_canonical, contains(html,'name="description"') AS has_description,
        CAST(len(regexp_extract_all(html,'(?i)<img\b')) AS INTEGER) AS images_missing_alt FROM pages""",
)
def h1_and_canonical(t):
    e = extract.extract_pages(t.pages)
    return e.select(
        "page_id",
        F.col("h1_count").cast("int").alias("h1_count"),
        F.col("canonical").isNotNull().alias("has_canonical"),
        F.col("meta_description").isNotNull().alias("has_description"),
        F.col("images_missing_alt").cast("int").alias("images_missing_alt"),
    )


def _resolved(t):
    return extract.resolve_links(extract.raw_hrefs(t.pages, ("page_id", "url")))


LINKS_SQL = f"""l AS (SELECT page_id, {q.part('url', 1)} || '://' || {q.part('url', 2)} || href AS dst FROM {HREFS_SQL} WHERE href LIKE '/%')"""


@query("page_links", f"WITH {LINKS_SQL} SELECT DISTINCT page_id, {q.url_key('dst')} AS dst_key FROM l")
def page_links(t):
    return extract.page_links(_resolved(t), "page_id").select("page_id", "dst_key")


@query(
    "link_targets",
    f"WITH {LINKS_SQL} SELECT dst_key, count(*) AS inbound FROM (SELECT DISTINCT page_id, {q.url_key('dst')} AS dst_key FROM l) GROUP BY dst_key",
)
def link_targets(t):
    links = extract.page_links(_resolved(t), "page_id")
    return links.groupBy("dst_key").agg(F.count("*").alias("inbound"))


@query(
    "link_counts",
    f"""WITH {LINKS_SQL} SELECT page_id, count(DISTINCT {q.url_key('dst')}) AS internal_links, CAST(0 AS BIGINT) AS external_link_count
        FROM l GROUP BY page_id""",
)
def link_counts(t):
    return extract.link_counts(_resolved(t), "page_id")


@query(
    "word_counts",
    r"""SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<!--.*?-->','','g'),'(?is)<script[^>]*>.*?</script>','','g'),'(?is)<style[^>]*>.*?</style>','','g'),
        '(?is)<title[^>]*>.*?</title>','','g'),'(?s)<[/!?a-zA-Z][^>]*>','','g'),'[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS INTEGER) AS word_count FROM pages""",
)
def word_counts(t):
    return t.pages.select("page_id", extract.word_count(F.col("html")).cast("int").alias("word_count"))


@query(
    "script_only_text",
    """SELECT page_id, phrase FROM pages, (VALUES ('track('),('article')) v(phrase)
       WHERE contains(html, phrase) AND NOT contains(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<!--.*?-->','','g'),
         '(?is)<script[^>]*>.*?</script>','','g'),'(?is)<title[^>]*>.*?</title>','','g'),'(?s)<[/!?a-zA-Z][^>]*>','','g'), phrase)""",
)
def script_only_text(t):
    return extract.only_in_script(t.pages, ["track(", "article"])


@query(
    "url_hygiene",
    f"""SELECT url, lower({q.part('url', 1)}) AS scheme, {q.host('url')} AS host, {q.path('url')} = lower({q.path('url')}) AS lower_case,
        contains({q.path('url')}, '_') AS has_underscore,
        CAST(CASE WHEN {q.query('url')} = '' THEN 0 ELSE len(regexp_extract_all({q.query('url')}, '&')) + 1 END AS INTEGER) AS n_params,
        {q.frag('url')} <> '' AS has_fragment FROM pages""",
)
def url_hygiene(t):
    return audit.url_hygiene(t.pages)


@query(
    "host_rollup",
    f"""SELECT {q.bare(q.host('url'))} AS site_host, count(*) AS n_urls, count(*) FILTER (WHERE lower({q.part('url', 1)}) = 'http') AS plain_http,
        count(*) FILTER (WHERE {q.host('url')} LIKE 'www.%') AS with_www,
        count(*) FILTER (WHERE {q.path('url')} <> lower({q.path('url')})) AS mixed_case,
        count(*) FILTER (WHERE {q.query('url')} <> '') AS with_params FROM pages GROUP BY 1""",
)
def host_rollup(t):
    return audit.host_rollup(audit.url_hygiene(t.pages))


@query(
    "text_functions",
    f"""SELECT content_id, regexp_full_match(content_id,'AC-[0-9]+') AS prefixed, split_part(format,' ',1) AS family,
        regexp_matches(status,'^[a-z][a-z0-9]*(_[a-z0-9]+)+$') AS event_name_ok, FALSE AS id_ok,
        trim(regexp_replace(regexp_replace(lower(theme_topic || ' ' || format),'[^a-z0-9]+','-','g'),'-+$',''),'-') AS slug,
        coalesce(contains(lower(caption), 'bio'), FALSE) AS mentions_bio FROM v_content""",
    ("v_content",),
)
def text_functions(t):
    c = t.v_content
    return c.select(
        "content_id",
        F.col("content_id").rlike("^AC-[0-9]+$").alias("prefixed"),
        text.format_family("format").alias("family"),
        text.event_name_ok("status").alias("event_name_ok"),
        text.content_id_ok("content_id").alias("id_ok"),
        text.slugify(F.concat("theme_topic", F.lit(" "), "format")).alias("slug"),
        text.mentions("caption", F.lit("bio")).alias("mentions_bio"),
    )


@query(
    "submission_list",
    f"""SELECT DISTINCT url FROM pages WHERE {q.host('url')} = (SELECT {q.host('url')} FROM pages ORDER BY url LIMIT 1)""",
)
def submission_list(t):
    from ..operators.search import submission_list as job

    first = t.pages.agg(F.min("url")).scalar()
    return job(t.pages.withColumn("site", first))
