"""Nested sitemaps: levels, cycles, redirects, repeated rows, problems."""

from growthlens.sources import sitemaps

FILE = "site string, url string, status int, location string, xml string"
SITE = "https://a.com"


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc><lastmod>2020-01-01</lastmod></sitemap>" for x in locs) + "</sitemapindex>"


def pages(*locs):
    return "<x:urlset xmlns:x='u'>" + "".join(f"<x:url><x:loc>{x}</x:loc></x:url>" for x in locs) + "</x:urlset>"


def run(spark, files, *roots):
    rows = spark.createDataFrame([(SITE, f"{SITE}/{u}" if u else None, s, to, xml) for u, s, to, xml in files], FILE)
    entries, problems = sitemaps.follow_sitemaps(rows, spark.createDataFrame([(SITE, f"{SITE}/{r}") for r in roots], "site string, url string"))
    told = {(r.sitemap.rpartition("/")[2], r.depth, r.loc.rpartition("/")[2]): r.lastmod for r in entries.collect()}
    return told, {(r.sitemap.rpartition("/")[2], r.depth, r.problem) for r in problems.collect()}


def test_cycles_redirects_and_problems(spark):
    files = [
        ("root", 200, None, index("b", "/c/", "https://www.a.com/d#x", "gone", "away")), ("b", 200, None, index("root", "b", "c", "e")),
        ("c", 200, None, pages("/p1", "", "/p2")), ("c", 200, None, pages("/p1", "", "/p2")), ("d", 302, "/e", None), ("e", 301, "https://A.com/f", None),
        ("f", 302, "/d", None), ("away", 301, "https://other.org/s", None), ("unreached", 200, None, pages("/p9")), (None, 200, None, pages("/p8")),
    ]
    told, problems = run(spark, files, "root", "root")
    assert set(told) == {("c", 1, "p1"), ("c", 1, "p2")} and set(told.values()) == {None}
    assert problems == {("gone", 1, "missing"), ("away", 1, "bad status")}


def test_levels_and_shortest_way(spark):
    chain = [(f"i{k}", 200, None, index(f"i{k + 1}")) for k in range(7)] + [("i5b", 200, None, pages("/x")), ("x", 200, None, pages("/in")), ("i7", 200, None, pages("/out"))]
    chain[4] = ("i4", 200, None, index("i5", "x"))
    chain[0] = ("i0", 200, None, index("i1", "r1"))
    chain += [("r1", 301, "/r2", None), ("r2", 301, "/r3", None), ("r3", 200, None, index("i3"))]
    told, problems = run(spark, chain, "i0")
    # i3 is two levels down by the redirect and three by the chain: x lies at four, and i7 at six is out
    assert set(told) == {("x", 4, "in")} and problems == set()


def test_broken_and_empty(spark):
    told, problems = run(spark, [("root", 200, None, "<urlset><url><loc>a"), ("empty", 200, None, None), ("ok", 200, None, "﻿" + pages("/p"))], "root", "empty", "ok")
    assert set(told) == {("ok", 0, "p")} and problems == {("root", 0, "bad xml"), ("empty", 0, "bad xml")}
    assert run(spark, [], "root") == ({}, {("root", 0, "missing")})
