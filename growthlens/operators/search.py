"""Search performance: reports, opportunity lists, rank gaps and submission lists.

Input ``search_perf``: query, page, device, country, date, clicks, impressions, position (raw).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from ..functions.numbers import ratio, weighted_position
from ..plans.ranges import numbered

WINDOW_DAYS, WINDOW_LAG = 28, 3
ROW_CAP, INFO_CAP = 25_000, 20


def measures() -> list[Column]:
    """Aggregates of search rows: totals, click rate, impression-weighted position."""
    return [
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        ratio(F.sum("clicks"), F.sum("impressions"), 4).alias("ctr"),
        weighted_position("position", "impressions", 1).alias("position"),
    ]


def search_window(today: dt.date) -> tuple[dt.date, dt.date]:
    """Inclusive window of 28 days that ends three days before ``today``."""
    end = today - dt.timedelta(days=WINDOW_LAG)
    return end - dt.timedelta(days=WINDOW_DAYS - 1), end


def trailing_window(today: dt.date, days: int) -> tuple[dt.date, dt.date]:
    """Report window of the analytics pullers: ``days + 1`` inclusive days up to today."""
    return today - dt.timedelta(days=days), today


def within(df: DataFrame, period: tuple[dt.date, dt.date], day: str = "date") -> DataFrame:
    return df.filter(F.col(day).between(F.lit(period[0]), F.lit(period[1])))


def page_two(rows: DataFrame, min_impressions: int = 20) -> DataFrame:
    """Rows at raw position 8 to 20 with enough impressions."""
    return rows.filter(F.col("position").between(8, 20) & (F.col("impressions") >= min_impressions))


def page_two_report(rows: DataFrame, min_impressions: int = 20) -> DataFrame:
    return page_two(rows, min_impressions).orderBy(F.desc("impressions"), "query", "page")


def search_report(rows: DataFrame, dims: list[str], top: int | None = None) -> DataFrame:
    """Totals per any of query, page, device, country, date; optionally the top rows by clicks."""
    out = rows.groupBy(*dims).agg(*measures())
    return out if top is None else out.orderBy(F.desc("clicks"), F.desc("impressions"), *dims).limit(top)


def search_summary(totals: DataFrame, inspections: DataFrame) -> DataFrame:
    """One row: totals plus indexed and not indexed pages."""
    seen = inspections.agg(
        F.count_if(F.col("verdict") == "PASS").alias("indexed"),
        F.count_if(~F.col("verdict").eqNullSafe("PASS")).alias("not_indexed"),
    )
    return totals.withColumn("__j", F.lit(1)).join(seen.withColumn("__j", F.lit(1)), "__j").drop("__j")


def canonical_disagreement(inspections: DataFrame) -> DataFrame:
    return (
        inspections.filter("canonical_mismatch").groupBy("coverage_state").agg(F.count("*").alias("n_urls"))
    )


def monthly_trend(rows: DataFrame) -> DataFrame:
    """Month totals and their change against the month before."""
    m = rows.groupBy(F.trunc("date", "month").alias("month")).agg(*measures())
    w = Window.orderBy("month")  # one row per month
    out = m
    for c in ("clicks", "impressions"):
        out = out.withColumn(f"{c}_delta", F.col(c) - F.lag(c).over(w))
    return out


def brand_split(rows: DataFrame, names: list[str]) -> DataFrame:
    """Brand, non-brand and combined measures (grouping sets)."""
    is_brand = F.lit(False)
    for n in names:
        is_brand = is_brand | F.regexp_like("query", F.lit(text.mention_regex(n)))
    # measures are sums, so the flag is pre-aggregated before the totals are formed
    flagged = rows.select(F.when(is_brand, "brand").otherwise("non-brand").alias("segment"), "clicks", "impressions", "position")
    return flagged.rollup("segment").agg(*measures()).withColumn("segment", F.coalesce("segment", F.lit("all")))


def cannibalization(rows: DataFrame) -> DataFrame:
    """Queries that two or more pages get impressions for, with every page's share."""
    per_page = rows.filter("impressions > 0").groupBy("query", "page").agg(F.sum("impressions").alias("impressions"))
    per_query = per_page.groupBy("query").agg(F.count("*").alias("n_pages"), F.sum("impressions").alias("total")).filter("n_pages > 1")
    joined = per_page.join(per_query, "query")
    return joined.select("query", "page", "impressions", "n_pages", ratio("impressions", "total", 4).alias("share"))


def position_bucket(position) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return (
        F.when(p < 4, "1-3").when(p < 11, "4-10").when(p < 21, "11-20").when(p < 51, "21-50").otherwise("51+")
    )


def position_buckets(rows: DataFrame) -> DataFrame:
    """Distinct keywords, impressions and clicks per position bucket."""
    return (
        rows.groupBy(position_bucket("position").alias("bucket"), "query")
        .agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
        .groupBy("bucket")
        .agg(F.count("*").alias("keywords"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    )


def quick_wins(rank: DataFrame, min_volume: int = 100) -> DataFrame:
    return rank.filter(F.col("best_position").between(5, 20) & (F.col("volume") > min_volume))


def content_gap(rank: DataFrame, ours: str) -> DataFrame:
    """Keywords that competitors rank for and we do not; one aggregation, no self join."""
    per = rank.groupBy("keyword").agg(
        F.bool_or(F.col("domain") == ours).alias("we_rank"),
        F.countDistinct("domain").alias("competitors"),
        F.max("volume").alias("volume"),
        F.min("best_position").alias("best_competitor_position"),
    )
    return per.filter(~F.col("we_rank")).drop("we_rank")


def competitor_overlap(rank: DataFrame, ours: str) -> DataFrame:
    """Common keywords per competitor and month; new when the month before had none."""
    mine = rank.filter(F.col("domain") == ours).select("month", "keyword")
    common = (
        rank.filter(F.col("domain") != ours)
        .join(mine, ["month", "keyword"], "left_semi")
        .groupBy("month", "domain")
        .agg(F.countDistinct("keyword").alias("common_keywords"))
    )
    before = common.select(F.add_months("month", 1).alias("month"), "domain", F.lit(False).alias("is_new"))
    return common.join(before, ["month", "domain"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))


def position_moves(rank: DataFrame) -> DataFrame:
    """Every month against the month before: moved, new and lost keywords per domain."""
    last = rank.agg(F.max("month")).scalar()
    curr = rank.select("domain", "keyword", "month", F.col("best_position").alias("position"))
    prev = rank.select("domain", "keyword", F.add_months("month", 1).alias("month"), F.col("best_position").alias("prev_position"))
    both = curr.join(prev, ["domain", "keyword", "month"], "full_outer").filter(F.col("month") <= last)
    change = F.when(F.col("prev_position").isNull(), "new").when(F.col("position").isNull(), "lost").otherwise("kept")
    return both.withColumn("change", change).withColumn("gain", F.col("prev_position") - F.col("position"))


def query_totals(rows: DataFrame, names: list[str]) -> DataFrame:
    is_brand = F.lit(False)
    for n in names:
        is_brand = is_brand | F.regexp_like("query", F.lit(text.mention_regex(n)))
    return rows.groupBy("query").agg(*measures()).withColumn("is_brand", is_brand)


def serp_suppressed(rows: DataFrame, names: list[str], min_impressions: int = 1000, max_ctr: float = 0.005) -> DataFrame:
    """Non-brand queries on page one that nobody clicks (search features push them down)."""
    q = query_totals(rows, names)
    return q.filter(~F.col("is_brand") & (F.col("position") <= 10) & (F.col("impressions") >= min_impressions) & (F.col("ctr") <= max_ctr)).drop("is_brand")


def title_lever(rows: DataFrame) -> DataFrame:
    """Query-page pairs at position 5-10 whose click rate is below their band's median.

    The median comes from a histogram of rates with four decimals (at most 10,001 rows per
    band), so no band is gathered in one task.
    """
    pairs = rows.groupBy("query", "page").agg(*measures()).filter(F.col("position").between(5, 10))
    banded = pairs.withColumn("band", F.floor("position").cast("int"))
    counts = banded.groupBy("band", "ctr").agg(F.count("*").alias("n"))
    medians = counts.groupBy("band").agg(F.percentile("ctr", F.lit(0.5), F.col("n")).alias("median_ctr"))
    return banded.join(medians, "band").filter(F.col("ctr") < F.col("median_ctr"))


def demand_without_page(rows: DataFrame, sitemap_keys: DataFrame, home_key: str, home_over: float = 0.5) -> DataFrame:
    """Queries none of whose pages is listed, or that the home page absorbs.

    ``sitemap_keys``: url_key.
    """
    # keys are formed after the first aggregation, on far fewer rows
    per_page = rows.groupBy("query", "page").agg(F.sum("impressions").alias("impressions")).withColumn("url_key", urls.url_key("page"))
    known = sitemap_keys.select("url_key").distinct().withColumn("listed", F.lit(True))
    per = (
        per_page.join(known, "url_key", "left")
        .groupBy("query")
        .agg(
            F.sum("impressions").alias("impressions"),
            F.coalesce(F.bool_or("listed"), F.lit(False)).alias("has_page"),
            ratio(F.sum(F.when(F.col("url_key") == home_key, F.col("impressions")).otherwise(0)), F.sum("impressions"), 4).alias("home_share"),
        )
    )
    return per.filter(~F.col("has_page") | (F.col("home_share") > home_over))


def seo_opportunities(rows: DataFrame, min_impressions: int, max_ctr: float, top: int | None = None) -> DataFrame:
    q = rows.groupBy("query").agg(*measures()).filter((F.col("impressions") >= min_impressions) & (F.col("ctr") <= max_ctr))
    return q if top is None else q.orderBy(F.desc("impressions"), "query").limit(top)


def keyword_map(rows: DataFrame, stages: bool = True) -> DataFrame:
    """Target page, position, impressions and next action per search (our action rule).

    merge: the best page holds less than 60% of the impressions; keep: position below 8;
    improve: up to 20; build: beyond.
    """
    pages = rows.groupBy("query", "page").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum(F.round(F.col("position") * 100, 0).cast("bigint") * F.col("impressions")).alias("w"),
    )
    g = pages.groupBy("query").agg(
        F.max_by("page", F.struct("impressions", "page")).alias("target_page"),
        F.max("impressions").alias("best"),
        F.sum("impressions").alias("impressions"),
        ratio(F.sum("w"), F.sum("impressions") * 100, 1).alias("position"),
    )
    share = ratio("best", "impressions", 4)
    action = (
        F.when(share < 0.6, "merge").when(F.col("position") < 8, "keep").when(F.col("position") <= 20, "improve").otherwise("build")
    )
    out = g.select("query", "target_page", "impressions", "position", share.alias("target_share"), action.alias("action"))
    return out.withColumn("stage", text.buyer_stage("query")) if stages else out


def pattern_demand(rank: DataFrame, patterns: dict[str, str], head_volume: int) -> DataFrame:
    """Volume per keyword pattern and month, head share and month-over-month change."""
    name = F.lit("other")
    for label, regex in reversed(list(patterns.items())):
        name = F.when(F.col("keyword").rlike(regex), label).otherwise(name)
    kw = rank.groupBy("month", "keyword").agg(F.max("volume").alias("volume"))
    per = kw.groupBy(name.alias("pattern"), "month").agg(
        F.count("*").alias("keywords"),
        F.sum("volume").alias("volume"),
        ratio(F.sum(F.when(F.col("volume") >= head_volume, F.col("volume")).otherwise(0)), F.sum("volume"), 4).alias("head_share"),
    )
    w = Window.partitionBy("pattern").orderBy("month")  # one row per month
    return per.withColumn("change", F.col("volume") - F.lag("volume").over(w))


def ref_domain_gap(ref_domains: DataFrame, ours: str) -> DataFrame:
    """Referring domains per target page, share of strong ones (rating 50+), gap to our page.

    ``ref_domains``: page, domain, domain_rating, first_seen.
    """
    one = ref_domains.groupBy("page", "domain").agg(F.max("domain_rating").alias("rating"))
    per = one.groupBy("page").agg(
        F.count("*").alias("domains"), ratio(F.count_if(F.col("rating") >= 50), F.count("*"), 4).alias("strong_share")
    )
    mine = per.filter(F.col("page") == ours).select(F.col("domains").alias("our_domains")).agg(F.max("our_domains")).scalar()
    return per.withColumn("gap", F.col("domains") - F.coalesce(mine, F.lit(0)))


def new_domains_by_month(ref_domains: DataFrame) -> DataFrame:
    first = ref_domains.groupBy("page", "domain").agg(F.min("first_seen").alias("first_seen"))
    return first.groupBy("page", F.trunc("first_seen", "month").alias("month")).agg(F.count("*").alias("new_domains"))


def capped_rows(rows: DataFrame, keys: list[str], order: list, cap: int = ROW_CAP) -> DataFrame:
    """All rows with ``window_no`` (from 1): the API row window of ``cap`` rows per property, in a fixed order, that holds them."""
    found = numbered(rows, keys, order, "window_no")
    return found.withColumn("window_no", F.expr(f"(window_no - 1) div {cap} + 1"))


def info_sample(site: str, pages: DataFrame, cap: int = INFO_CAP) -> DataFrame:
    """The site first, then distinct pages in order of appearance, up to ``cap`` (a report limit).

    ``pages``: page, pos.
    """
    firsts = pages.filter("page IS NOT NULL AND page <> ''").groupBy("page").agg(F.min("pos").alias("pos"))
    head = pages.sparkSession.range(1).select(F.lit(site).alias("page"), F.lit(-1).cast("bigint").alias("pos"))
    both = head.unionByName(firsts.filter(F.col("page") != site))
    return both.orderBy("pos", "page").limit(cap)


def engine2_summary(queries: DataFrame) -> DataFrame:
    return queries.agg(
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions")
    )


def attach_url_info(pages: DataFrame, infos: DataFrame) -> DataFrame:
    """Page rows with their URL info; failed lookups that match no page are appended.

    ``infos``: url, pos, error, ...; the last info per URL (trailing slash ignored) wins.
    """
    trimmed = lambda c: F.regexp_replace(F.trim(c), r"/+$", "")
    rest = [c for c in infos.columns if c != "pos"]
    last = (
        infos.filter("url IS NOT NULL AND url <> ''")
        .groupBy(trimmed("url").alias("k"))
        .agg(F.max_by(F.struct(*rest), "pos").alias("url_info"))
    )
    joined = pages.withColumn("k", trimmed(F.coalesce("page", F.lit("")))).join(last, "k", "left")
    keys = pages.select(trimmed(F.coalesce("page", F.lit(""))).alias("k")).distinct()
    failed = infos.filter("error IS NOT NULL").withColumn("k", trimmed(F.coalesce("url", F.lit(""))))
    orphaned = (
        failed.groupBy("k").agg(F.min_by(F.struct(*rest), "pos").alias("url_info")).join(keys, "k", "left_anti")
    )
    return joined.unionByName(orphaned.withColumn("page", F.col("url_info.url")), allowMissingColumns=True).drop("k")


def submission_list(candidates: DataFrame) -> DataFrame:
    """All distinct URLs on exactly the site's host."""
    return candidates.filter(urls.on_exact_host("url", "site")).select("url").distinct()


def changed_urls(prev: DataFrame, curr: DataFrame, content: list[str]) -> DataFrame:
    """URLs that are new or whose content fields differ between two snapshots."""
    mark = lambda df, name: df.groupBy("site", "url").agg(F.max(F.xxhash64(*content)).alias(name))
    both = mark(curr, "c").join(mark(prev, "p"), ["site", "url"], "left")
    return both.filter(~F.col("c").eqNullSafe(F.col("p"))).select("site", "url")


def rejected_urls(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~urls.on_exact_host("url", "site"))


def paid_organic(ads_terms: DataFrame, rows: DataFrame, max_position: float = 10.0) -> DataFrame:
    """Paid keywords that already rank organically: cost next to organic position."""
    organic = rows.groupBy("query").agg(*measures()).filter(F.col("position") <= max_position)
    return ads_terms.join(
        organic.select(
            F.col("query").alias("keyword"),
            F.col("clicks").alias("organic_clicks"),
            F.col("position").alias("organic_position"),
        ),
        "keyword",
    )
