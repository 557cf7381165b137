import datetime as dt

import pytest
from pyspark.sql import functions as F

from growthlens.functions import numbers, text, urls


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "url, key, exact, slash, issue",
    [
        ("https://WWW.Acme.com/a/?x=1#f", "https://acme.com/a?x=1", "https://www.acme.com/a/?x=1", "https://www.acme.com/a?x=1", "https://acme.com/a?x=1#f"),
        ("http://u:p@acme.com:8080", "http://acme.com/", "http://acme.com:8080/", "http://acme.com/", "http://acme.com/"),
        ("https://acme.com:443/A;v=1", "https://acme.com/A", "https://acme.com/A", "https://acme.com/A", "https://acme.com/A"),
        ("  /only/path#x ", "/only/path", "/only/path", "/only/path", "/only/path#x"),
        ("https://acme.com/a b?", "https://acme.com/a b", "https://acme.com/a b", "https://acme.com/a b", "https://acme.com/a b"),
        ("https://acme.com./x//", "https://acme.com/x", "https://acme.com./x//", "https://acme.com./x", "https://acme.com/x"),
    ],
)
def test_url_identities(spark, url, key, exact, slash, issue):
    r = spark.range(1).select(F.lit(url).alias("u")).select(
        urls.url_key("u").alias("k"), urls.exact_url("u").alias("e"), urls.slash_key("u").alias("s"), urls.issue_url_key("u").alias("i")
    ).first()
    assert (r.k, r.e, r.s, r.i) == (key, exact, slash, issue)


@pytest.mark.parametrize(
    "href, expected",
    [
        ("../c/./d?x=1#y", "https://a.com/c/d?x=1"), ("//b.com/p", "https://b.com/p"), ("?q=2", "https://a.com/b/page?q=2"),
        ("sub/", "https://a.com/b/sub/"), ("#top", None), ("MAILTO:x@y.z", None), ("ftp://a.com/", None), ("/r", "https://a.com/r"),
    ],
)
def test_resolve_link(spark, href, expected):
    assert one(spark, urls.resolve_link("h", "b"), h=href, b="https://a.com/b/page") == expected


def test_hosts(spark):
    own = F.array(F.lit("www.acme.com"), F.lit("x.org"))
    assert one(spark, urls.host_in("h", own), h="blog.acme.com") is True
    assert one(spark, urls.host_in("h", own), h="notacme.com") is False
    assert one(spark, urls.on_exact_host("u", "s"), u="https://www.a.com/x", s="a.com") is False
    assert one(spark, urls.same_site("u", "s"), u="https://www.a.com/x", s="http://a.com") is True
    assert one(spark, urls.entity_key("i", "u"), i="#org", u="https://www.a.com/x/") == "https://a.com/x#org"
    assert one(spark, urls.skip_url("u", F.array(F.lit(""), F.lit("cart"))), u="https://a.com/cart/1") is True


@pytest.mark.parametrize(
    "value, hit",
    [("index, NoIndex", True), ("googlebot: none", True), ("max-snippet: none", False), ("unavailable_after: 1 Jan", False), (None, False), ("noindexed", False)],
)
def test_noindex(spark, value, hit):
    assert one(spark, text.is_noindex(F.lit(value).cast("string"))) is hit


@pytest.mark.parametrize(
    "header, hit",
    [('<https://a.com/x>; rel="canonical"', True), ("<a>; rel=preload, <b>; rel='next canonical'", True), ("<https://a/?rel=canonical>; rel=next", False), (None, False)],
)
def test_canonical_header(spark, header, hit):
    assert one(spark, text.has_canonical_link(F.lit(header).cast("string"))) is hit


def test_money_and_mentions(spark):
    assert one(spark, text.money_figures("t"), t="from $ 1,200.50 to $30 or 5$") == ["$1,200.50", "$30"]
    assert one(spark, text.money_key("t"), t="$1,200.00") == one(spark, text.money_key("t"), t="$1200") == "1200"
    assert one(spark, text.money_key("t"), t="$0.50") == "0.5"
    assert one(spark, text.mentions("t", F.lit("A+ Co.")), t="we like a+ co. most") is True
    assert one(spark, text.mentions("t", F.lit("Acme")), t="Acmecorp éAcme") is False


def test_ratio_is_exact(spark):
    assert one(spark, numbers.ratio(F.lit(1), F.lit(32), 4)) == 0.0312
    assert one(spark, numbers.ratio(F.lit(3), F.lit(32), 4)) == 0.0938
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0), 4)) is None
    assert one(spark, numbers.ratio(F.lit(2), F.lit(3), 2)) == 0.67


def test_small_rules(spark):
    assert one(spark, text.ms_date("d"), d="/Date(1316156400000-0700)/") == dt.datetime(2011, 9, 16, 7, 0)
    assert one(spark, text.ms_date("d"), d="2011-09-16") is None
    assert one(spark, text.content_id_ok("c"), c="AB-20260415-01") is True
    assert one(spark, text.content_id_ok("c"), c="AB-20261315-01") is False
    assert one(spark, text.lead_id_ok("c"), c="AB-L-20260215-01") is True
    assert one(spark, text.slugify("t"), t="Kitchen: Final Reveal!") == "kitchen-final-reveal"
    assert one(spark, text.hyphenate("t"), t="a—b–c") == "a-b-c"
    assert one(spark, text.buyer_stage("k"), k="how to use a widget") == "implementation"
    assert one(spark, text.buyer_stage("k"), k="How to fix it") == "awareness"
    assert one(spark, text.benchmark_band("p", F.col("r")), p="X", r=1.0) == "good"
    assert one(spark, text.event_name_ok("e"), e="signup_completed") is True
