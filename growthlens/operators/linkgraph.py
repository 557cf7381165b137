"""URL resolution, redirect chains, inbound links and click depth over the page graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..session import cut_lineage


def with_page_keys(pages: DataFrame) -> DataFrame:
    """Add the two identities and the flags that resolution needs (narrow, no shuffle)."""
    return (
        pages.withColumn("exact", urls.exact_url("url"))
        .withColumn("url_key", urls.url_key("url"))
        .withColumn("is_redirect", F.col("status").isin(*fixed.REDIRECT_STATUSES))
    )


def page_index(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two unique lookups: by exact identity, and by page identity preferring live records.

    Both are map-side combined aggregates; no group of records is gathered.
    """
    rec = F.struct("exact", "url", "status", "is_redirect")
    by_exact = keyed.groupBy("site", "exact").agg(F.min_by("url", "crawl_pos").alias("hit_url"))
    by_key = keyed.groupBy("site", "url_key").agg(
        F.max_by(rec, "crawl_pos").alias("last"),
        F.min_by(F.when(~F.col("is_redirect"), rec), F.when(~F.col("is_redirect"), F.col("crawl_pos"))).alias("live"),
    )
    pick = F.when(~F.col("last.is_redirect"), F.col("last.url")).otherwise(F.coalesce("live.url", "last.url"))
    return by_exact, by_key.select("site", "url_key", pick.alias("key_url"))


def resolve(requests: DataFrame, keyed: DataFrame, url: str, out: str = "page_url") -> DataFrame:
    """Find the record a URL leads to: exact identity first, then page identity; NULL if unknown."""
    by_exact, by_key = page_index(keyed)
    asked = requests.withColumn("__e", urls.exact_url(url)).withColumn("__k", urls.url_key(url))
    return (
        asked.join(by_exact.withColumnRenamed("exact", "__e"), ["site", "__e"], "left")
        .join(by_key.withColumnRenamed("url_key", "__k"), ["site", "__k"], "left")
        .withColumn(out, F.coalesce("hit_url", "key_url"))
        .drop("__e", "__k", "hit_url", "key_url")
    )


def redirect_chains(pages: DataFrame) -> DataFrame:
    """``site, url, chain, hops, final_url, final_page`` for every redirecting page.

    Every hop is resolved once and checkpointed; the walk then self-joins the redirect rows only
    (a small part of a crawl), at most ``MAX_HOPS`` times. Pages that do not redirect are their
    own end and never enter the walk.
    """
    keyed = with_page_keys(pages)
    heads = keyed.filter(F.col("is_redirect") & F.col("redirect_location").isNotNull()).select(
        "site", "url", F.col("redirect_location").alias("loc")
    )
    edges = cut_lineage(resolve(heads, keyed, "loc", "next_page").withColumn("loc_key", urls.url_key("loc")))
    heads = edges.select("site", "url", "loc")
    hop = edges.select(
        "site",
        F.col("url").alias("cur"),
        F.col("loc").alias("h_loc"),
        F.col("loc_key").alias("h_key"),
        F.col("next_page").alias("h_next"),
    )
    walk = heads.select(
        "site",
        "url",
        F.array("url").alias("chain"),
        F.array(urls.url_key("url")).alias("seen"),
        F.col("url").alias("final_url"),
        F.col("url").alias("final_page"),
        F.col("url").alias("cur"),
    )
    for _ in range(fixed.MAX_HOPS):
        step = walk.join(hop, ["site", "cur"], "left")
        moved, known = F.col("h_loc").isNotNull(), F.col("h_next").isNotNull()
        again = F.array_contains("seen", F.col("h_key"))
        walk = step.select(
            "site",
            "url",
            F.when(moved, F.array_append("chain", F.col("h_loc"))).otherwise(F.col("chain")).alias("chain"),
            F.when(moved & known & ~again, F.array_append("seen", F.col("h_key"))).otherwise(F.col("seen")).alias("seen"),
            F.when(moved & known, F.col("h_loc")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(moved & known, F.col("h_next")).otherwise(F.col("final_page")).alias("final_page"),
            F.when(moved & known & ~again, F.col("h_next")).alias("cur"),
        )
    return cut_lineage(
        walk.select("site", "url", "chain", (F.size("chain") - 1).alias("hops"), "final_url", "final_page")
    )


FINAL_FIELDS = ("status", "content_type", "link_header", "is_html", "noindex", "error")


def with_final(pages: DataFrame) -> DataFrame:
    """Pages plus ``hops, final_url, final_page`` and the final record's status fields.

    Only redirecting pages have a chain row; everything else ends at itself.
    """
    chains = redirect_chains(pages).select("site", "url", "hops", "final_url", "final_page")
    ends = pages.select(
        "site", F.col("url").alias("final_page"), F.struct(*FINAL_FIELDS).alias("end")
    )
    ended = cut_lineage(ends.join(chains, ["site", "final_page"]).select("site", "url", "hops", "final_url", "final_page", "end"))
    own = F.struct(*FINAL_FIELDS)
    return (
        pages.withColumn("own", own)
        .join(ended, ["site", "url"], "left")
        .withColumn("hops", F.coalesce("hops", F.lit(0)))
        .withColumn("final_url", F.coalesce("final_url", "url"))
        .withColumn("final_page", F.coalesce("final_page", "url"))
        .withColumn("end", F.coalesce("end", "own"))
        .select("*", *[F.col(f"end.{c}").alias(f"final_{c}") for c in FINAL_FIELDS])
        .drop("own", "end")
    )


def inbound_degree(links: DataFrame) -> DataFrame:
    """Distinct linking pages per target key, self links excluded.

    ``links``: site, src_url, dst_url of HTML pages. The distinct runs on (target, source), so a
    page that everybody links to is spread over all tasks; only its counts meet.
    """
    return (
        links.select("site", "src_url", urls.url_key("dst_url").alias("url_key"), urls.url_key("src_url").alias("sk"))
        .filter("url_key <> sk")
        .select("site", "url_key", "src_url")
        .distinct()
        .groupBy("site", "url_key")
        .agg(F.count("*").alias("inbound"))
    )


def broken_link_sources(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``site, url, status, src_url``: every page that links (also via redirects) to an error page.

    ``pages`` must carry the final fields. Links are cut to the keys of failing records before
    any resolution, so the edge table is not shuffled as a whole.
    """
    keyed = with_page_keys(pages)
    failing = cut_lineage(
        keyed.filter(F.col("final_status") >= 400).select("site", "url", "url_key", "final_page", "final_status")
    )
    keys = failing.select("site", F.col("url_key").alias("dst_key")).distinct()
    suspects = (
        links.select("site", "src_url", "dst_url", urls.url_key("dst_url").alias("dst_key"))
        .join(keys, ["site", "dst_key"], "left_semi")
        .drop("dst_key")
        .distinct()
    )
    # only records that share a key with a failing one can be the answer
    near = keyed.join(keys.withColumnRenamed("dst_key", "url_key"), ["site", "url_key"], "left_semi")
    hits = resolve(suspects, near, "dst_url", "page_url")
    ends = failing.select(
        "site", F.col("url").alias("page_url"), F.col("final_page").alias("target"), F.col("final_status").alias("status")
    )
    return (
        hits.join(ends, ["site", "page_url"], "inner")
        .select("site", F.col("target").alias("url"), "status", "src_url")
        .distinct()
    )


def click_depth(links: DataFrame, home: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Fewest clicks from the home page per reachable key: ``site, url_key, depth``.

    Frontier search with joins: each round touches the edges of the last frontier only. Lineage
    is cut with a reliable checkpoint every round, which also feeds the stop test.
    ``home``: site, url_key. A graph deeper than ``max_rounds`` raises instead of being cut.
    """
    edges = (
        links.select("site", urls.url_key("src_url").alias("url_key"), urls.url_key("dst_url").alias("next_key"))
        .filter("url_key <> next_key")
        .distinct()
    )
    edges = cut_lineage(edges)
    frontier = home.select("site", "url_key").withColumn("depth", F.lit(0))
    reached = frontier
    for depth in range(1, max_rounds + 1):
        found = (
            edges.join(frontier.select("site", "url_key"), ["site", "url_key"], "left_semi")
            .select("site", F.col("next_key").alias("url_key"))
            .distinct()
            .join(reached, ["site", "url_key"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier.select(*[F.col(c).alias(c) for c in reached.columns]))
        if depth % 20 == 0:
            reached = cut_lineage(reached)
    raise ValueError(f"link graph deeper than {max_rounds} clicks")
