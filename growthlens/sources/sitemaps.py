"""Nested sitemaps: from landed sitemap files to the page entries that a site's roots reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..session import cut_lineage
from .landed import read_sitemaps

#: Levels below a root that are still read.
MAX_DEPTH = 5
PROBLEMS = ("missing", "bad status", "bad xml")


def reached_files(files: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``site, key, depth``: landed or missing files that the roots reach, at their least depth.

    ``files``: site, url, status, location, xml, one row per fetched file; ``roots``: site, url. Index entries lead one
    level down, a redirect within the site stays on its level. Rounds go on until no file is reached at a smaller depth than
    before, so cycles end; a round joins the files that are new in it with the edges of their site.
    """
    known = files.withColumn("key", urls.url_key("url"))
    moved = F.col("status").isin(*fixed.REDIRECT_STATUSES)
    down = read_sitemaps(known.filter("status = 200")).filter("kind = 'index'")
    down = down.select("site", urls.url_key("url").alias("key"), urls.url_key("loc").alias("to"), F.lit(1).alias("step"))
    target = urls.join_url("url", "location")
    aside = known.filter(moved & F.col("location").isNotNull() & urls.same_site(target, F.col("site")))
    aside = aside.select("site", "key", urls.url_key(target).alias("to"), F.lit(0).alias("step"))
    edges = cut_lineage(down.unionByName(aside).groupBy("site", "key", "to").agg(F.min("step").alias("step")))
    seen = cut_lineage(roots.select("site", urls.url_key("url").alias("key"), F.lit(0).alias("depth")).distinct())
    new = seen
    while True:
        found = new.join(edges, ["site", "key"]).select("site", F.col("to").alias("key"), (F.col("depth") + F.col("step")).alias("depth"))
        found = found.filter(F.col("depth") <= max_depth).groupBy("site", "key").agg(F.min("depth").alias("depth"))
        before = seen.withColumnRenamed("depth", "before")
        new = cut_lineage(found.join(before, ["site", "key"], "left").filter("before IS NULL OR depth < before").drop("before"))
        if new.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(new).groupBy("site", "key").agg(F.min("depth").alias("depth")))


def follow_sitemaps(files: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Page entries and problems of all files that the roots reach.

    Entries: ``site, sitemap, depth, pos, loc, lastmod``; a file counts once however many indexes name it, and an index
    passes no date to its children. Problems: ``site, sitemap, depth, problem`` for files that were not landed, answered with
    another status than 200 (redirects within the site are followed instead), or are no XML. Repeated rows of one file
    count as one, the one that sorts last; NULL urls reach nothing.
    """
    last = files.filter("url IS NOT NULL").withColumn("key", urls.url_key("url"))
    last = last.groupBy("site", "key").agg(F.max(F.struct("url", "status", "location", "xml")).alias("f"))
    files = cut_lineage(last.select("site", "key", "f.*"))
    reached = cut_lineage(reached_files(files.drop("key"), roots.filter("url IS NOT NULL"), max_depth))
    mine = reached.join(files, ["site", "key"], "left")
    pages = read_sitemaps(mine.filter("status = 200").select("site", "url", "xml")).filter("kind = 'urlset'")
    depth = reached.select("site", F.col("key").alias("__key"), "depth")
    pages = pages.withColumn("__key", urls.url_key("url")).join(depth, ["site", "__key"])
    entries = pages.select("site", F.col("url").alias("sitemap"), "depth", "pos", "loc", "lastmod")

    followed = F.col("status").isin(*fixed.REDIRECT_STATUSES) & urls.same_site(urls.join_url("url", "location"), F.col("site"))
    whole = F.regexp_replace("xml", "^﻿", "")
    broken = F.from_xml(whole, "`__bad` string", {"columnNameOfCorruptRecord": "__bad"})["__bad"].isNotNull() | (F.trim(F.coalesce(whole, F.lit(""))) == "")
    problem = (
        F.when(F.col("url").isNull(), PROBLEMS[0])
        .when(F.coalesce(followed, F.lit(False)), F.lit(None))
        .when(F.coalesce(F.col("status") != 200, F.lit(True)), PROBLEMS[1])
        .when(broken, PROBLEMS[2])
    )
    named = mine.select("site", F.coalesce("url", "key").alias("sitemap"), "depth", problem.alias("problem"))
    return entries, named.filter("problem IS NOT NULL")
