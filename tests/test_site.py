"""A small site with one page per rule."""

import pytest
from pyspark.sql import functions as F

from growthlens.operators import audit, entities, extract, linkgraph

SITE = "https://example.com"
DESC = "A description that is long enough to pass the lower limit of seventy characters, easily."
PAGE = (
    "site string, crawl_pos bigint, url string, status int, redirect_location string, content_type string, link_header string,"
    " title string, meta_description string, h1_count int, canonical string, meta_robots string, images_missing_alt int, json_ld_errors array<string>"
)


def page(pos, path, status=200, to=None, ctype="text/html", title="", desc="", h1=1, canonical="", robots=None, alts=0, errors=None):
    url = SITE + path
    return (
        SITE, pos, url, status, to and (SITE + to), ctype, None, title if title != "" else f"Title of {path}",
        desc if desc != "" else f"{DESC} {path}", h1, canonical if canonical != "" else url, robots, alts, errors,
    )


PAGES = [
    page(0, "/", desc="short", alts=2),
    page(1, "/about", title="T" * 70, desc=None, canonical=None, h1=0),
    page(2, "/missing", status=404),
    page(3, "/hidden", robots="noindex, nofollow"),
    page(4, "/twin", title="Shared", desc=DESC),
    page(5, "/twin2", title="Shared", desc=DESC),
    page(6, "/alone"),
    page(7, "/extra"),
    page(8, "/old", status=301, to="/mid", ctype=None),
    page(9, "/mid", status=302, to="/new", ctype=None),
    page(10, "/new"),
    page(11, "/bad", errors=["JSON-LD parse error: x"]),
    page(12, "/canon", canonical=SITE + "/other"),
    page(13, "/slash", canonical=SITE + "/slash/"),
    page(14, "/secret", robots="noindex"),
    page(15, "/notitle", title=None),
    page(16, "/feed", ctype="application/json"),
    page(17, "/loop", status=301, to="/loop2", ctype=None),
    page(18, "/loop2", status=301, to="/loop", ctype=None),
    page(19, "/gone", status=301, to="/missing", ctype=None),
]
LINKS = [("/", p) for p in ("/about", "/missing", "/hidden", "/twin", "/extra", "/new", "/bad", "/canon", "/slash/", "/secret", "/notitle", "/", "/gone")]
LINKS += [("/about", "/"), ("/twin", "/twin2"), ("/twin2", "/twin"), ("/extra", "/"), ("/new", "/missing#x")]
LISTED = ["/", "/about", "/missing", "/alone", "/old", "/new", "/bad", "/canon", "/slash", "/secret", "/notitle", "/twin", "/twin2", "/feed"]


@pytest.fixture(scope="module")
def frames(spark):
    pages = spark.createDataFrame(PAGES, PAGE)
    links = spark.createDataFrame([(SITE, SITE + a, SITE + b) for a, b in LINKS], "site string, src_url string, dst_url string")
    sitemap = spark.createDataFrame([(SITE, i, SITE + p, "2026-10-20" if i else None) for i, p in enumerate(LISTED)], "site string, pos bigint, loc string, lastmod string")
    return pages, links, sitemap


def test_every_rule(spark, frames):
    bots = spark.createDataFrame([(SITE, SITE + "/robots.txt", "GPTBot", True), (SITE, SITE + "/robots.txt", "Googlebot", True), (SITE, SITE + "/robots.txt", "Bingbot", False)], "site string, robots_url string, bot string, blocked boolean")
    files = spark.createDataFrame([(SITE, SITE + "/llms.txt", 404, None)], "site string, url string, status int, error string")
    found = audit.site_audit(*frames, bots, files).collect()
    pairs = {(r.code, r.url.removeprefix(SITE)) for r in found}
    expected = {
        ("description_length", "/"), ("img_missing_alt", "/"), ("title_too_long", "/about"), ("missing_description", "/about"),
        ("canonical_missing", "/about"), ("h1_count", "/about"), ("thin_inbound", "/about"), ("broken_internal_link", "/missing"),
        ("sitemap_non_200", "/missing"), ("noindex_linked", "/hidden"), ("duplicate_title", "/twin"), ("duplicate_title", "/twin2"),
        ("duplicate_description", "/twin"), ("duplicate_description", "/twin2"), ("orphan", "/alone"), ("not_in_sitemap", "/extra"),
        ("thin_inbound", "/extra"), ("sitemap_redirect", "/old"), ("redirect_chain", "/old"), ("jsonld_parse_error", "/bad"),
        ("canonical_mismatch", "/canon"), ("missing_title", "/notitle"), ("sitemap_noindex", "/secret"), ("noindex_linked", "/secret"),
        ("robots_blocks_ai_bot", "/robots.txt#GPTBot"), ("llms_txt_missing", "/llms.txt"), ("sitemap_non_html", "/feed"),
        ("sitemap_lastmod_uniform", ""), ("redirect_chain", "/loop"),
    }
    assert expected <= pairs
    assert ("canonical_mismatch", "/slash") not in pairs and ("title_too_long", "/notitle") not in pairs
    assert ("orphan", "/feed") not in pairs and ("broken_internal_link", "/loop") not in pairs
    by = {(r.code, r.url.removeprefix(SITE)): r for r in found}
    assert by["broken_internal_link", "/missing"].detail == f"Status 404. Linked from {SITE}/, {SITE}/new"
    assert by["robots_blocks_ai_bot", "/robots.txt#Googlebot"].severity == "high"
    assert by["sitemap_lastmod_uniform", ""].detail == "13 of 14 URLs share lastmod 2026-10-20"
    assert by["llms_txt_missing", "/llms.txt"].detail == "Status 404"
    assert len(found) == len({(r.code, r.url) for r in found})


def test_chains_and_depth(spark, frames):
    pages, links, _ = frames
    c = {r.url.removeprefix(SITE): r for r in linkgraph.redirect_chains(pages).collect()}
    short = lambda xs: [x.removeprefix(SITE) for x in xs]
    assert short(c["/old"].chain) == ["/old", "/mid", "/new"] and c["/old"].final_url == SITE + "/new"
    assert short(c["/loop"].chain) == ["/loop", "/loop2", "/loop"] and c["/loop"].hops == 2
    home = spark.createDataFrame([(SITE, SITE + "/")], "site string, url_key string")
    depth = {r.url_key.removeprefix(SITE): r.depth for r in linkgraph.click_depth(links, home).collect()}
    assert depth["/"] == 0 and depth["/about"] == 1 and depth["/twin2"] == 2 and "/alone" not in depth


def test_long_chain_stops_after_five_hops(spark):
    pages = spark.createDataFrame([page(i, f"/r{i}", status=301, to=f"/r{i + 1}", ctype=None) for i in range(8)] + [page(8, "/r8")], PAGE)
    c = {r.url: r for r in linkgraph.redirect_chains(pages).collect()}
    assert c[SITE + "/r0"].hops == 5 and c[SITE + "/r0"].final_url == SITE + "/r5"


def test_duplicate_details_are_bounded(spark):
    pages = spark.createDataFrame([page(i, f"/p{i}", title="Same") for i in range(9)], PAGE).withColumn("is_html", F.lit(True))
    got = {r.url: r.detail for r in audit.duplicates(pages, "title", "duplicate_title", "title").collect()}
    assert got[SITE + "/p8"] == "Same title as " + ", ".join(f"{SITE}/p{i}" for i in range(5)) + ", and 3 more"
    assert got[SITE + "/p0"].startswith(f"Same title as {SITE}/p1")


HTML = """<html><head><base href="/docs/"><title> A &amp; <b>B</b></title><meta name=description content="one &quot;x&quot;">
<meta name="description" content="two"><meta property="og:title" content='O > T'><link rel="canonical" href="old"><link rel="alternate canonical" href="new#f">
<script type="application/ld+json">{"@context": "x", "@graph": [{"@type": "https://schema.org/Organization", "@id": "#org", "url": ["/"], "logo": "l",
 "founder": {"@type": "Person"}}]}</script><script type="application/ld+json">{bad</script></head>
<body><!-- <h1>no</h1> --><svg><title>icon</title></svg><h1>Hi <i>there</i></h1><h1></h1><h2>x</h2><p>a</p><p>b&nbsp;c</p>
<a href="guide?x=1#y">g</a><a href='guide?x=1'>g2</a><a href="https://www.example.com/z">z</a><a href="https://o.com">o</a><a href="https://o.com">o</a><a href="mailto:x">m</a><a name="n">n</a>
<img src=a><img alt src=b><img src="c" alt=""><script>var h = "<h1>script</h1>"</script></body></html>"""


def test_extraction(spark):
    raw = spark.createDataFrame([("https://example.com/in/page", HTML)], "url string, html string")
    p = extract.extract_pages(raw).first()
    assert p.title == "A & B" or p.title == "A & <b>B</b>"
    assert (p.meta_description, p.og_title, p.canonical) == ('one "x"', "O > T", "https://example.com/docs/new")
    assert (p.h1, p.h1_count, p.h2_count, p.images_missing_alt) == (["Hi there", ""], 2, 1, 1)
    assert [(n.type, n.id) for n in p.json_ld] == [("https://schema.org/Organization", "#org"), ("Person", None)]
    assert p.json_ld[0].org_props == ["url", "logo", "founder"] and p.json_ld_errors[0].startswith("JSON-LD parse error")
    links = extract.resolve_links(extract.extract_pages(raw).select("url", "base_url", F.posexplode("hrefs").alias("pos", "href")), base="base_url")
    got = sorted(r.dst_url for r in extract.page_links(links).collect())
    assert got == ["https://example.com/docs/guide?x=1", "https://www.example.com/z"]
    c = extract.link_counts(links).first()
    assert (c.internal_links, c.external_link_count) == (2, 2)
    assert spark.createDataFrame([("<title>t x</title><p>a</p><p>b c</p><style>s</style>",)], "html string").select(extract.word_count(F.col("html"))).first()[0] == 2


def test_entities(spark):
    node = "array<struct<type string, id string, is_org boolean, org_props array<string>, urls array<string>>>"
    org = lambda i, props, urls: ("Organization", i, True, props, urls)
    rows = [
        (SITE, SITE + "/", [org("#org", ["url", "logo"], ["/"]), ("Person", None, False, [], [])]),
        (SITE, SITE + "/a", [org(SITE + "/#org", ["sameAs"], []), org(None, [], []), org("https://client.com/#o", [], ["https://client.com"])]),
        (SITE, SITE + "/b", [org(SITE + "/b#other", [], [])]),
    ]
    pages = spark.createDataFrame(rows, f"site string, url string, json_ld {node}")
    got = {r.code: (r.url, r.detail) for r in entities.entity_issues(pages).collect()}
    assert got["jsonld_entity_no_id"] == (SITE + "/a", "No @id on Organization")
    assert got["jsonld_entity_ids_differ"] == (SITE, f"Distinct @id values: {SITE}/#org, {SITE}/b#other")
    assert "jsonld_org_incomplete" not in got


ROBOTS = """User-agent: GPTBot
User-agent: claudebot # two agents
Disallow: /
Allow: /$
User-agent: *
Sitemap: https://example.com/s.xml
Disallow: /*
User-agent: Perplexity
Disallow:
User-agent: Googlebot
Disallow: /private
"""


def test_robots(spark):
    r = spark.createDataFrame([(SITE, SITE + "/robots.txt", ROBOTS)], "site string, robots_url string, text string")
    got = {x.bot: x.blocked for x in entities.robots_bots(r).collect()}
    assert got == {
        "GPTBot": False, "ClaudeBot": False, "OAI-SearchBot": True, "Google-Extended": True, "Bingbot": True,
        "PerplexityBot": False, "Googlebot": False,
    }
    assert entities.lists_sitemap(r).first().lists_sitemap is True
