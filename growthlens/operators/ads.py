"""Paid search reports: ratios of sums, removed objects left out unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio

MICROS = 1_000_000


def measures() -> list[Column]:
    clicks, cost, conv = F.sum("clicks"), F.sum("cost_micros"), F.sum("conversions")
    return [
        F.sum("impressions").alias("impressions"),
        clicks.alias("clicks"),
        ratio(clicks, F.sum("impressions"), 4).alias("ctr"),
        ratio(cost, clicks * MICROS, 2).alias("average_cpc"),
        ratio(cost, F.lit(MICROS), 2).alias("cost"),
        conv.alias("conversions"),
        ratio(cost, conv * MICROS, 2).alias("cost_per_conversion"),
    ]


def report(ads: DataFrame, dims: list[str], statuses: tuple[str, ...] = ("status",), include_removed: bool = False, order: str = "cost", top: int | None = None) -> DataFrame:
    """Totals per dimensions; ``top`` rows by ``order`` when given."""
    if not include_removed:
        for s in statuses:
            ads = ads.filter(F.col(s) != "REMOVED")
    out = ads.groupBy(*dims).agg(*measures())
    return out if top is None else out.orderBy(F.desc(order), *dims).limit(top)


def campaigns(ads: DataFrame, **kw) -> DataFrame:
    return report(ads, ["campaign", "status", "channel"], **kw)


def ad_groups(ads: DataFrame, **kw) -> DataFrame:
    return report(ads, ["campaign", "ad_group"], statuses=("status", "ad_group_status"), **kw)


def keywords(ads: DataFrame, **kw) -> DataFrame:
    return report(ads, ["keyword", "match_type"], statuses=("status", "ad_group_status"), order="impressions", **kw)


def search_terms(ads: DataFrame, **kw) -> DataFrame:
    return report(ads, ["search_term"], order="impressions", **kw)


def ads_by_creative(ads: DataFrame, **kw) -> DataFrame:
    """``final_urls`` is an array; it is shown joined by a comma."""
    return report(ads.withColumn("final_urls", F.array_join("final_urls", ", ")), ["ad_type", "final_urls"], **kw)


def free_report(ads: DataFrame, sql: str) -> DataFrame:
    """Any Spark SQL over the ads rows, which the text names ``{ads_perf}``."""
    return ads.sparkSession.sql(sql, ads_perf=ads)
