"""Readers for landed exports: typed schemas, permissive parsing, no inference in jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..functions.text import ms_date

CORRUPT = "_corrupt_record"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages; a missing status counts as 200. Columns nobody asks for are not read."""
    pages = spark.read.parquet(path)
    return pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))


ISSUE = "struct<code:string,severity:string,url:string,detail:string>"
PAGE = (
    "struct<url:string,status:int,redirect_location:string,final_url:string,content_type:string,link_header:string,"
    "x_robots_tag:string,error:string,in_sitemap:boolean,title:string,meta_description:string,meta_robots:string,"
    "meta_googlebot:string,canonical:string,h1:array<string>,internal_links:array<string>,images_missing_alt:int,"
    "word_count:int,json_ld_errors:array<string>>"
)
CRAWL = (
    f"generated_at string, site string, issues array<{ISSUE}>, pages map<string,{PAGE}>,"
    " robots struct<url:string,status:int,blocks:map<string,boolean>>, llms_txt struct<url:string,status:int,error:string>,"
    f" counts struct<pages:int,html_pages:int>, {CORRUPT} string"
)


def read_crawl_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Crawl documents with the snapshot date taken from their folder or file name."""
    docs = spark.read.schema(CRAWL).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1)
    return docs.select("*", F.col("_metadata.file_path").alias("file_path"), F.try_to_date(F.nullif(day, F.lit(""))).alias("snapshot_date"))


def crawl_issues(docs: DataFrame) -> DataFrame:
    return docs.select("site", "snapshot_date", F.posexplode_outer("issues").alias("pos", "i")).filter("i IS NOT NULL").select(
        "site", "snapshot_date", F.col("pos").cast("bigint").alias("crawl_pos"), "i.*"
    )


def crawl_pages(docs: DataFrame) -> DataFrame:
    return docs.select("site", "snapshot_date", F.explode_outer("pages").alias("key", "p")).filter("p IS NOT NULL").select(
        "site", "snapshot_date", F.coalesce("p.url", "key").alias("url"), *[f"p.{c}" for c in (
            "status", "redirect_location", "content_type", "link_header", "x_robots_tag", "error", "title", "meta_description",
            "meta_robots", "meta_googlebot", "canonical", "images_missing_alt", "json_ld_errors", "internal_links")],
        F.size(F.coalesce("p.h1", F.array().cast("array<string>"))).alias("h1_count"),
        F.col("p.h1").isNotNull().alias("parsed_as_html"),
    )


def crawl_robots(docs: DataFrame) -> DataFrame:
    return docs.select("site", F.col("robots.url").alias("robots_url"), F.explode_outer("robots.blocks").alias("bot", "blocked")).filter("bot IS NOT NULL")


def crawl_site_files(docs: DataFrame) -> DataFrame:
    return docs.filter(f"{CORRUPT} IS NULL").select("site", "llms_txt.url", "llms_txt.status", "llms_txt.error")


def ingest_notes(docs: DataFrame) -> DataFrame:
    """One line per file that is not valid JSON; the run goes on with the others."""
    name = F.element_at(F.split("file_path", "/"), -1)
    note = F.concat(name, F.lit(" is not valid JSON and was skipped.")).alias("note")
    return docs.filter(F.col(CORRUPT).isNotNull()).select("site", note).distinct()


SEARCH = "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"


def _whole(c) -> Column:
    return F.coalesce(F.floor(c).cast("bigint"), F.lit(0).cast("bigint"))


def read_search_rows(raw: DataFrame, column: str = "value", dims=("query", "page")) -> DataFrame:
    """Search payloads to rows; counters default to 0, the raw position is kept."""
    r = raw.select(F.explode_outer(F.from_json(column, SEARCH)["rows"]).alias("r")).filter("r IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return r.select(
        *[F.try_element_at("r.keys", F.lit(i)).alias(d) for i, d in enumerate(dims, start=1)],
        _whole(F.col("r.clicks")).alias("clicks"),
        _whole(F.col("r.impressions")).alias("impressions"),
        F.bround(zero("r.ctr"), 4).alias("ctr"),
        zero("r.position").alias("position"),
        F.bround(zero("r.position"), 1).alias("shown_position"),
    )


def read_search_totals(raw: DataFrame, column: str = "value") -> DataFrame:
    """The single totals row of each payload; zeros when it is empty."""
    first = F.try_element_at(F.from_json(column, SEARCH)["rows"], F.lit(1))
    zero = lambda f: F.coalesce(F.col(f"r.{f}"), F.lit(0.0))
    return raw.select(first.alias("r")).select(
        _whole(F.col("r.clicks")).alias("clicks"), _whole(F.col("r.impressions")).alias("impressions"),
        F.bround(zero("ctr"), 4).alias("ctr"), F.bround(zero("position"), 1).alias("position"),
    )


INSPECT = (
    "inspectionResult struct<indexStatusResult:struct<verdict:string,coverageState:string,indexingState:string,"
    "robotsTxtState:string,pageFetchState:string,lastCrawlTime:string,googleCanonical:string,userCanonical:string>>"
)


def read_index_status(raw: DataFrame, column: str = "value") -> DataFrame:
    """``url, value[, error]``: index fields; a canonical missing on one side is no mismatch."""
    error = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    s = raw.select("url", error.alias("error"), F.from_json(column, INSPECT)["inspectionResult"]["indexStatusResult"].alias("s"))
    g, u = F.nullif("s.googleCanonical", F.lit("")), F.nullif("s.userCanonical", F.lit(""))
    return s.select(
        "url", F.col("s.verdict").alias("verdict"), F.col("s.coverageState").alias("coverage_state"),
        F.col("s.indexingState").alias("indexing_state"), F.col("s.robotsTxtState").alias("robots_state"),
        F.col("s.pageFetchState").alias("fetch_state"), F.col("s.lastCrawlTime").alias("last_crawl"),
        g.alias("google_canonical"), u.alias("user_canonical"),
        F.coalesce(g != u, F.lit(False)).alias("canonical_mismatch"), "error",
    )


STAT = "Query:string,Url:string,Clicks:bigint,Impressions:bigint,AvgClickPosition:double,AvgImpressionPosition:double,Date:string"
CRAWL_ISSUE = "Url:string,HttpCode:int,Issues:string,InLinks:bigint"
URL_INFO = (
    "Url:string,AnchorCount:bigint,DiscoveryDate:string,DocumentSize:bigint,HttpStatus:int,IsPage:boolean,"
    "LastCrawledDate:string,TotalChildUrlCount:bigint"
)


def engine2_rows(raw: DataFrame, fields: str, column: str = "value") -> DataFrame:
    """Rows of ``d``, which may be a list, one object or null."""
    many = F.from_json(column, f"d array<struct<{fields}>>")["d"]
    one = F.from_json(column, f"d struct<{fields}>")["d"]
    is_list = F.get_json_object(column, "$.d").startswith("[")
    rows = F.when(is_list, many).when(one.isNotNull(), F.array(one))
    return raw.select(F.posexplode_outer(rows).alias("pos", "r")).filter("r IS NOT NULL").select("pos", "r.*")


def _iso(column: str) -> Column:
    """ISO text of a millisecond date, other values unchanged."""
    return F.coalesce(F.date_format(ms_date(column), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.col(column))


def read_engine2_stats(raw: DataFrame, label: str = "query", column: str = "value") -> DataFrame:
    """Query statistics, or page statistics (``label='page'``), which reuse the query field."""
    name = F.col("Query") if label == "query" else F.coalesce(F.nullif("Query", F.lit("")), "Url")
    return engine2_rows(raw, STAT, column).select(
        name.alias(label), F.col("Clicks").alias("clicks"), F.col("Impressions").alias("impressions"),
        F.col("AvgClickPosition").alias("avg_click_position"), F.col("AvgImpressionPosition").alias("avg_impression_position"),
        _iso("Date").alias("date"), "pos",
    )


def read_engine2_crawl_issues(raw: DataFrame, column: str = "value") -> DataFrame:
    return engine2_rows(raw, CRAWL_ISSUE, column).select(
        F.col("Url").alias("url"), F.col("HttpCode").alias("http_code"), F.col("Issues").alias("issues"), F.col("InLinks").alias("in_links")
    )


def read_url_info(raw: DataFrame, column: str = "value") -> DataFrame:
    return engine2_rows(raw, URL_INFO, column).select(
        F.col("Url").alias("url"), F.col("AnchorCount").alias("anchor_count"), _iso("DiscoveryDate").alias("discovery_date"),
        F.col("DocumentSize").alias("document_size"), F.col("HttpStatus").alias("http_status"), F.col("IsPage").alias("is_page"),
        _iso("LastCrawledDate").alias("last_crawled"), F.col("TotalChildUrlCount").alias("child_urls"),
    )


def read_analytics_rows(raw: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Text cells to declared types; ``metrics``: column -> bigint or double (four decimals)."""
    typed = raw
    for name, kind in metrics.items():
        value = F.col(name).try_cast(kind)
        typed = typed.withColumn(name, F.bround(value, 4) if kind == "double" else value)
    return typed


def read_ads_rows(raw: DataFrame, nested: dict[str, list[str]]) -> DataFrame:
    """Flatten one level (``a.b`` -> ``a_b``); micros to units with two decimals, lists joined."""
    out = []
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    for top, fields in nested.items():
        for f in fields:
            c, kind = F.col(f"{top}.{f}"), kinds[top][f].dataType.typeName()
            if "micros" in f or f in ("average_cpc", "cost_per_conversion"):
                out.append(F.bround(c.cast("double") / 1_000_000, 2).alias(f"{top}_{f.replace('_micros', '')}"))
            elif kind == "array":
                out.append(F.array_join(c, ", ").alias(f"{top}_{f}"))
            else:
                out.append(c.alias(f"{top}_{f}"))
    return raw.select(*out)


MEDIA = (
    "id string, caption string, media_type string, media_product_type string, permalink string, timestamp string,"
    " like_count bigint, comments_count bigint, insights array<struct<name:string,values:array<struct<value:double>>>>"
)


def read_social_media(raw: DataFrame, column: str = "value") -> DataFrame:
    """Posts with their insights turned into columns."""
    m = raw.select(F.from_json(column, MEDIA).alias("m")).select("m.*")
    pick = F.map_from_entries(
        F.transform(F.coalesce("insights", F.array().cast("array<struct<name:string,values:array<struct<value:double>>>>")),
                    lambda i: F.struct(i["name"], F.try_element_at(i["values"], F.lit(1))["value"]))
    )
    p = m.withColumn("x", pick)
    whole = lambda k: F.col("x")[k].cast("bigint").alias(k)
    watch = F.nullif(F.col("x")["ig_reels_avg_watch_time"], F.lit(0.0))
    return p.select(
        F.left("timestamp", F.lit(10)).alias("date"),
        F.coalesce(F.nullif("media_product_type", F.lit("")), "media_type").alias("type"),
        F.left(F.regexp_replace(F.coalesce("caption", F.lit("")), "\n", " "), F.lit(80)).alias("caption"),
        whole("reach"), whole("views"), F.col("like_count").alias("likes"), F.col("comments_count").alias("comments"),
        F.col("x")["saved"].cast("bigint").alias("saves"), whole("shares"), whole("total_interactions"),
        F.bround(watch / 1000, 1).alias("avg_watch_s"), "permalink",
    )


CONTENT_LOG = (
    "content_id string, date_published date, platform string, format string, title_description string, content_url string,"
    " theme_topic string, hook_used string, cta_type string, created_by string, status string, notes string"
)
PERFORMANCE = (
    "content_id string, date_measured date, views bigint, reach bigint, likes bigint, comments bigint, shares bigint,"
    " saves bigint, link_clicks bigint, follows bigint, engagement_rate double, performance_score int, notes string"
)
REVENUE = (
    "lead_id string, lead_date date, lead_name string, lead_source string, platform string, content_id string,"
    " first_touch string, last_touch string, lead_status string, close_date date, project_type string,"
    " revenue decimal(18,2), notes string"
)
KW_RANK = "domain string, date date, keyword string, best_position int, volume bigint, sum_traffic double, keyword_difficulty int"
KW_COMPETITOR = "competitor_domain string, domain_rating double, keywords_common bigint, traffic double"
REF_DOMAINS = "page string, domain string, domain_rating double, backlinks bigint, first_seen date, last_visited date"
KW_OVERVIEW = "keyword string, volume bigint, difficulty int, cpc decimal(18,4), traffic_potential bigint, global_volume bigint"
DEALS = "deal_id string, dealname string, dealstage string, amount decimal(18,2), closedate date, pipeline string, last_activity date"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tracking CSV with header and declared types; a bad cell becomes NULL."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_copy_docs(spark: SparkSession, path: str) -> DataFrame:
    """Copy files, one row per file; documentation and templates are left out."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    name = F.col("_metadata.file_name")
    keep = name.rlike(r"\.(md|html)$") & ~name.rlike("^(_template|README|TEMPLATE)")
    return docs.select(F.col("_metadata.file_path").alias("doc_id"), name.alias("file_name"), F.col("value").alias("text")).filter(keep)


ENTRY = "loc:string,lastmod:string"


def read_sitemaps(files: DataFrame, column: str = "xml") -> DataFrame:
    """``site, url, xml`` -> ``site, url, kind, pos, loc, lastmod``; bad XML yields no rows.

    Locations are resolved against the sitemap file; an index passes no lastmod to its children.
    """
    body = F.regexp_replace(F.regexp_replace(column, "^﻿", ""), r"<(/?)[A-Za-z0-9_-]+:", "<$1")
    parsed = F.from_xml(body, f"url array<struct<{ENTRY}>>, sitemap array<struct<{ENTRY}>>", {"mode": "PERMISSIVE"})
    f = files.select("site", "url", body.rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), parsed.alias("x"))
    rows = f.select(
        "site", "url", F.when(F.col("is_index"), "index").otherwise("urlset").alias("kind"),
        F.posexplode_outer(F.when(F.col("is_index"), F.col("x.sitemap")).otherwise(F.col("x.url"))).alias("pos", "e"),
    )
    loc = urls.strip_blanks("e.loc")
    return rows.filter(F.coalesce(loc, F.lit("")) != "").select(
        "site", "url", "kind", F.col("pos").cast("bigint").alias("pos"), urls.join_url("url", "e.loc").alias("loc"),
        F.nullif(urls.strip_blanks("e.lastmod"), F.lit("")).alias("lastmod"),
    )


def sitemap_pages(entries: DataFrame) -> DataFrame:
    """Page entries only, in the form the audit takes."""
    return entries.filter("kind = 'urlset'").select("site", "pos", "loc", "lastmod")


LAB = (
    "finalUrl string, categories map<string,struct<score:double>>, audits map<string,struct<id:string,title:string,score:double,"
    "numericValue:double,metricSavings:map<string,double>,details:struct<type:string,overallSavingsMs:double,metricSavings:map<string,double>>>>"
)


def read_lab_reports(raw: DataFrame, column: str = "value") -> DataFrame:
    """Raw reports to scores (x100), metrics, first snippet of the largest element, opportunities.

    Input columns besides ``value`` (url, form_factor, run_no, error) are kept.
    """
    kept = [c for c in raw.columns if c != column]
    r = raw.select(*kept, F.col(column).alias("__raw"), F.from_json(column, LAB).alias("r"))
    scores = [
        F.bround(F.col("r.categories")[c]["score"] * 100, 0).cast("int").alias(c.replace("-", "_")) for c in fixed.LAB_CATEGORIES
    ]
    metrics = [
        (F.bround(v, 3) if k == "cls" else F.bround(v, 0).cast("bigint")).alias(k)
        for k, v in ((k, F.col("r.audits")[a]["numericValue"]) for k, a in fixed.LAB_METRICS.items())
    ]
    return r.select(*kept, *scores, *metrics, lcp_snippet(F.col("__raw")).alias("lcp_element"), F.col("r.audits").alias("audits"))


def lcp_snippet(raw: Column) -> Column:
    """First non-blank snippet in the details of the old audit, else of the new one."""
    def first(audit: str) -> Column:
        details = F.get_json_object(raw, f"$.audits['{audit}'].details")
        found = F.regexp_extract_all(details, F.lit(r'"snippet"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
        hit = F.try_element_at(F.filter(found, lambda s: F.trim(s) != ""), F.lit(1))
        return F.get_json_object(F.concat(F.lit('{"s":"'), hit, F.lit('"}')), "$.s")

    return F.coalesce(first("largest-contentful-paint-element"), first("lcp-breakdown-insight"))


AI_LOG = (
    "ts timestamp, engine string, model string, prompt_id string, kind string, run int, answer string, cited_urls array<string>,"
    " retrieved_urls array<string>, error string, cost_usd decimal(18,8), usage string"
)


def read_ai_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only answer log, one JSON object per line; usage stays raw JSON."""
    log = spark.read.schema(AI_LOG).json(path)
    return log.withColumn("cost_micros", F.col("cost_usd") * 1_000_000)


def stream_ai_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same log as a stream. A backlog is read in one trigger, as with a limit rows may come behind the watermark."""
    reader = spark.readStream.schema(AI_LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    log = reader.json(path)
    return log.withColumn("cost_micros", F.col("cost_usd") * 1_000_000)
