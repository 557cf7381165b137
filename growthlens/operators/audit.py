"""Site audit: every issue code as ``site, code, severity, url, detail``.

Page-level codes come from ONE enriched pass (page flags joined once, issues built as an array
of structs and exploded), not from one scan per code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..functions.text import has_canonical_link, is_html_200, is_noindex, is_text_html
from ..plans.groups import listed, stitched_list, unroll
from ..session import cut_lineage
from .linkgraph import broken_link_sources, inbound_degree, resolve, with_final, with_page_keys

ISSUE_COLUMNS = ("site", "code", "severity", "url", "detail")
# Longest source list written into one detail text; the full list is its own table.
LISTED_SOURCES = 50
LISTED_TWINS = 5

_OPTIONAL = {
    "error": "string",
    "meta_googlebot": "string",
    "x_robots_tag": "string",
    "link_header": "string",
    "json_ld_errors": "array<string>",
    "parsed_as_html": "boolean",
}


def prepare_pages(pages: DataFrame) -> DataFrame:
    """Fill optional columns and add ``is_html, noindex``."""
    for name, kind in _OPTIONAL.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    noindex = is_noindex("meta_robots") | is_noindex("meta_googlebot") | is_noindex("x_robots_tag")
    parsed = F.coalesce("parsed_as_html", F.lit(False)) & (F.col("status") == 200)
    return pages.withColumn("is_html", is_html_200("status", "content_type") | parsed).withColumn("noindex", noindex)


def sitemap_entries(sitemap: DataFrame) -> DataFrame:
    """On-site entries, first spelling per page key: ``site, url_key, loc, lastmod, pos`` (A19)."""
    on_site = sitemap.filter(urls.same_site("loc", "site")).select(
        "site", urls.url_key("loc").alias("url_key"), urls.drop_fragment("loc").alias("loc"), "lastmod", "pos"
    )
    first = on_site.groupBy("site", "url_key").agg(F.min_by(F.struct("loc", "lastmod", "pos"), "pos").alias("f"))
    return first.select("site", "url_key", "f.loc", "f.lastmod", "f.pos")


def _issue(code: str, when: Column, detail: Column, severity: Column | None = None) -> Column:
    sev = F.lit(fixed.ISSUE_SEVERITY[code]) if severity is None else severity
    return F.when(when, F.struct(F.lit(code).alias("code"), sev.alias("severity"), detail.alias("detail")))


def _unroll(rows: DataFrame, issues: list[Column], url: str = "url") -> DataFrame:
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return unroll(rows, ["site", F.col(url).alias("url")], found, "i").select(
        "site", "i.code", "i.severity", "url", "i.detail"
    )


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def page_field_issues(finals: DataFrame) -> DataFrame:
    """Codes that need nothing but the page row itself (no shuffle)."""
    html = F.col("is_html")
    title, desc = F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit(""))
    canonical, h1 = F.coalesce("canonical", F.lit("")), F.coalesce("h1_count", F.lit(0))
    alts, hops = F.coalesce("images_missing_alt", F.lit(0)), F.col("hops")
    noun = F.when(alts == 1, "image").otherwise("images")
    return _unroll(
        finals,
        [
            _issue("missing_title", html & (title == ""), F.lit("No title")),
            _issue("title_too_long", html & (F.length(title) > 60), _text(F.length(title).cast("string"), " characters")),
            _issue("missing_description", html & (desc == ""), F.lit("No meta description")),
            _issue(
                "description_length",
                html & (desc != "") & ((F.length(desc) < 70) | (F.length(desc) > 160)),
                _text(F.length(desc).cast("string"), " characters"),
            ),
            _issue("h1_count", html & (h1 != 1), _text("Found ", h1.cast("string"), " h1")),
            _issue("canonical_missing", html & (canonical == ""), F.lit("No canonical")),
            _issue(
                "canonical_mismatch",
                html & (canonical != "") & (urls.slash_key(canonical) != urls.slash_key("final_url")),
                _text("Canonical is ", canonical),
            ),
            _issue(
                "jsonld_parse_error",
                html & (F.coalesce(F.size("json_ld_errors"), F.lit(0)) > 0),
                F.array_join("json_ld_errors", "; "),
            ),
            _issue("img_missing_alt", html & (alts > 0), _text(alts.cast("string"), " ", noun, " missing alt")),
            _issue("redirect_chain", hops > 1, _text(hops.cast("string"), " hops")),
        ],
    )


def html_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose source page is a live HTML page."""
    sources = pages.filter("is_html").select("site", F.col("url").alias("src_url"))
    return links.join(sources, ["site", "src_url"], "left_semi")


def link_issues(pages: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """orphan, thin_inbound, not_in_sitemap, noindex_linked in one pass over the pages."""
    inbound = inbound_degree(html_links(pages, links))
    listed_keys = entries.select("site", "url_key", F.lit(True).alias("listed"))
    rows = (
        pages.filter("is_html")
        .withColumn("url_key", urls.url_key("url"))
        .join(inbound, ["site", "url_key"], "left")
        .join(listed_keys, ["site", "url_key"], "left")
        .withColumn("n", F.coalesce("inbound", F.lit(0)))
        .withColumn("listed", F.coalesce("listed", F.lit(False)))
    )
    n, in_map, indexable = F.col("n"), F.col("listed"), ~F.col("noindex")
    return _unroll(
        rows,
        [
            _issue("orphan", in_map & (n == 0), F.lit("In the sitemap with no internal links pointing here")),
            _issue("thin_inbound", indexable & (n == 1), F.lit("Only 1 internal page links here")),
            _issue("not_in_sitemap", indexable & ~in_map & (n > 0), F.lit("Indexable page is not in the sitemap")),
            _issue(
                "noindex_linked", ~indexable & (n > 0), _text("noindex, but linked from ", n.cast("string"), " pages")
            ),
        ],
    )


def duplicates(pages: DataFrame, field: str, code: str, label: str) -> DataFrame:
    """Pages that share a text with another page; the detail names the first five others.

    Groups are never gathered: the count and the first six URLs per text are bounded
    aggregates, joined back to the pages (AQE splits a text that holds much of the data).
    """
    rows = pages.filter(F.col("is_html") & (F.coalesce(field, F.lit("")) != "")).select(
        "site", "url", "crawl_pos", F.col(field).alias("value")
    )
    shared = rows.groupBy("site", "value").agg(F.count("*").alias("n")).filter("n > 1")
    several = rows.join(shared, ["site", "value"], "inner")
    heads = listed(several, ["site", "value"], ["crawl_pos"], "url", LISTED_TWINS + 1, "first_urls")
    others = F.filter("first_urls", lambda u: u != F.col("url"))
    text = _text(f"Same {label} as ", stitched_list(others, F.col("n") - 1, LISTED_TWINS))
    return several.join(heads, ["site", "value"], "inner").select(
        "site", F.lit(code).alias("code"), F.lit(fixed.ISSUE_SEVERITY[code]).alias("severity"), "url", text.alias("detail")
    )


def broken_link_issues(finals: DataFrame, links: DataFrame) -> DataFrame:
    """One row per failing target. Long source lists are cut in the text, not in
    ``broken_link_sources``, which holds every source as a row."""
    sources = broken_link_sources(finals, html_links(finals, links))
    keys = ["site", "url", "status"]
    totals = sources.groupBy(*keys).agg(F.count("*").alias("n"))
    heads = listed(sources, keys, ["src_url"], "src_url", LISTED_SOURCES, "first_sources")
    detail = _text(
        "Status ", F.col("status").cast("string"), ". Linked from ",
        stitched_list(F.col("first_sources"), F.col("n"), LISTED_SOURCES),
    )
    code = "broken_internal_link"
    return totals.join(heads, keys).select(
        "site", F.lit(code).alias("code"), F.lit(fixed.ISSUE_SEVERITY[code]).alias("severity"), "url", detail.alias("detail")
    )


def sitemap_issues(finals: DataFrame, entries: DataFrame) -> DataFrame:
    """Checks of what each listed URL really leads to."""
    keyed = with_page_keys(finals)
    found = resolve(entries.select("site", "loc"), keyed, "loc", "url").filter(F.col("url").isNotNull())
    rows = found.join(
        finals.select(
            "site", "url", "status", "redirect_location", "final_status", "final_content_type", "final_link_header",
            "final_is_html", "final_noindex", "final_error",
        ),
        ["site", "url"],
    )
    fs = F.coalesce("final_status", F.lit(0))
    error = F.when(F.coalesce("final_error", F.lit("")) != "", F.concat(F.lit(". "), "final_error")).otherwise("")
    return _unroll(
        rows,
        [
            _issue(
                "sitemap_redirect",
                F.coalesce(F.col("status").isin(*fixed.REDIRECT_STATUSES), F.lit(False)),
                _text("Redirects to ", F.coalesce("redirect_location", F.lit("unknown"))),
            ),
            _issue("sitemap_non_200", fs != 200, _text("Final status ", fs.cast("string"), error)),
            _issue(
                "sitemap_noindex",
                (fs == 200) & F.col("final_is_html") & F.col("final_noindex"),
                F.lit("Sitemap URL is noindex"),
            ),
            _issue(
                "sitemap_non_html",
                (fs == 200) & ~is_text_html("final_content_type") & ~has_canonical_link("final_link_header"),
                F.coalesce(F.nullif("final_content_type", F.lit("")), F.lit("(missing)")),
            ),
        ],
    )


def lastmod_issues(entries: DataFrame) -> DataFrame:
    """A sitemap of more than five URLs where one lastmod covers more than half of them."""
    stamp = F.nullif(F.trim("lastmod"), F.lit(""))
    total = entries.groupBy("site").agg(F.count("*").alias("total"))
    per = (
        entries.withColumn("stamp", stamp)
        .filter(F.col("stamp").isNotNull())
        .groupBy("site", "stamp")
        .agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    )
    mode = per.groupBy("site").agg(F.max_by(F.struct("stamp", "n"), F.struct("n", -F.col("seen"))).alias("m"))
    code = "sitemap_lastmod_uniform"
    return (
        mode.join(total, "site")
        .filter((F.col("total") > 5) & (F.col("m.n") * 2 > F.col("total")))
        .select(
            "site",
            F.lit(code).alias("code"),
            F.lit(fixed.ISSUE_SEVERITY[code]).alias("severity"),
            F.col("site").alias("url"),
            _text(
                F.col("m.n").cast("string"), " of ", F.col("total").cast("string"), " URLs share lastmod ", F.col("m.stamp")
            ).alias("detail"),
        )
    )


def robots_issues(robots_bots: DataFrame) -> DataFrame:
    """``robots_bots``: site, robots_url, bot, blocked. One issue per blocked bot."""
    code = "robots_blocks_ai_bot"
    severity = F.when(F.col("bot").isin(*fixed.SEARCH_BOTS), "high").otherwise(fixed.ISSUE_SEVERITY[code])
    return robots_bots.filter("blocked").select(
        "site",
        F.lit(code).alias("code"),
        severity.alias("severity"),
        F.concat("robots_url", F.lit("#"), "bot").alias("url"),
        F.concat("bot", F.lit(" is blocked")).alias("detail"),
    )


def site_file_issues(site_files: DataFrame) -> DataFrame:
    """``site_files``: site, url, status, error of the machine-readable guide file."""
    code = "llms_txt_missing"
    error = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit(". "), "error")).otherwise("")
    bad = ~F.col("status").eqNullSafe(F.lit(200))
    return site_files.filter(bad).select(
        "site",
        F.lit(code).alias("code"),
        F.lit(fixed.ISSUE_SEVERITY[code]).alias("severity"),
        "url",
        _text("Status ", F.coalesce(F.col("status").cast("string"), F.lit("None")), error).alias("detail"),
    )


def site_audit(
    pages: DataFrame,
    links: DataFrame,
    sitemap: DataFrame,
    robots_bots: DataFrame | None = None,
    site_files: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """All issues of a crawl. ``entities`` is the output of ``entity_issues``.

    The prepared pages and the sitemap are written once to the shared folder: about ten checks
    read them, each only the columns it needs, instead of deriving them ten times.
    """
    finals = cut_lineage(with_final(prepare_pages(pages)))
    entries = cut_lineage(sitemap_entries(sitemap))
    parts = [
        page_field_issues(finals),
        link_issues(finals, links, entries),
        duplicates(finals, "title", "duplicate_title", "title"),
        duplicates(finals, "meta_description", "duplicate_description", "description"),
        broken_link_issues(finals, links),
        sitemap_issues(finals, entries),
        lastmod_issues(entries),
    ]
    if robots_bots is not None:
        parts.append(robots_issues(robots_bots))
    if site_files is not None:
        parts.append(site_file_issues(site_files))
    if entities is not None:
        parts.append(entities)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def severity_rank(severity) -> Column:
    rank = F.lit(9)
    for name, value in fixed.SEVERITY_RANK.items():
        rank = F.when(F.col(severity) == name, value).otherwise(rank)
    return rank


def in_report_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_rank("severity"), "code", "url")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues per site, code and severity level."""
    return issues.groupBy("site", "code").agg(
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(F.col("severity") == "low").alias("low"),
    )


def migration_audit(old_urls: DataFrame, finals: DataFrame) -> DataFrame:
    """Old URL inventory against the crawl: URLs per final status (NULL = never crawled)."""
    hit = resolve(old_urls.select("site", "url").distinct(), with_page_keys(finals), "url", "page_url")
    ends = finals.select("site", F.col("url").alias("page_url"), "final_status", "hops")
    return (
        hit.join(ends, ["site", "page_url"], "left")
        .groupBy("site", "final_status")
        .agg(F.count("*").alias("n_urls"), F.count_if(F.col("hops") > 0).alias("redirected"))
    )


def crowded_targets(finals: DataFrame, min_sources: int) -> DataFrame:
    """Redirect targets that swallow many URLs (soft-404 pattern)."""
    return (
        finals.filter("hops > 0")
        .groupBy("site", "final_page")
        .agg(F.count("*").alias("n_sources"))
        .filter(F.col("n_sources") >= min_sources)
    )


def url_hygiene(df: DataFrame, url: str = "url") -> DataFrame:
    """Per-URL naming checks (D33)."""
    path, query = urls.url_path(url), urls.url_query(url)
    return df.select(
        url,
        urls.url_scheme(url).alias("scheme"),
        urls.url_host(url).alias("host"),
        (path == F.lower(path)).alias("lower_case"),
        F.contains(path, F.lit("_")).alias("has_underscore"),
        F.when(query == "", 0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1).alias("n_params"),
        (urls.url_fragment(url) != "").alias("has_fragment"),
    )


def host_rollup(hygiene: DataFrame) -> DataFrame:
    return hygiene.groupBy(urls.bare_host("host").alias("site_host")).agg(
        F.count("*").alias("n_urls"),
        F.count_if(F.col("scheme") == "http").alias("plain_http"),
        F.count_if(F.col("host").startswith("www.")).alias("with_www"),
        F.count_if(~F.col("lower_case")).alias("mixed_case"),
        F.count_if(F.col("n_params") > 0).alias("with_params"),
    )
