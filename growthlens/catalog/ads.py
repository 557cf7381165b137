"""Paid search queries."""

from ..operators import ads, search
from .base import half_even, query
from .search import POS

A = ("v_ads",)
M = f"""CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, {half_even('sum(clicks)', 'sum(impressions)', 4)} AS ctr,
  {half_even('sum(cost_micros)', '(sum(clicks)*1000000)', 2)} AS average_cpc, {half_even('sum(cost_micros)', '1000000', 2)} AS cost, CAST(sum(conversions) AS BIGINT) AS conversions,
  {half_even('sum(cost_micros)', '(sum(conversions)*1000000)', 2)} AS cost_per_conversion"""
LIVE = "status <> 'REMOVED' AND ad_group_status <> 'REMOVED'"


@query("ads_campaigns", f"SELECT campaign, status, channel, {M} FROM v_ads WHERE status <> 'REMOVED' GROUP BY 1,2,3", A)
def ads_campaigns(t):
    return ads.campaigns(t.v_ads)


@query("ads_campaigns_all", f"SELECT campaign, status, channel, {M} FROM v_ads GROUP BY 1,2,3", A)
def ads_campaigns_all(t):
    return ads.campaigns(t.v_ads, include_removed=True)


@query("ads_ad_groups", f"SELECT campaign, ad_group, {M} FROM v_ads WHERE {LIVE} GROUP BY 1,2", A)
def ads_ad_groups(t):
    return ads.ad_groups(t.v_ads)


@query("ads_keywords", f"SELECT keyword, match_type, {M} FROM v_ads WHERE {LIVE} GROUP BY 1,2", A)
def ads_keywords(t):
    return ads.keywords(t.v_ads)


@query("ads_search_terms", f"SELECT search_term, {M} FROM v_ads WHERE status <> 'REMOVED' GROUP BY 1", A)
def ads_search_terms(t):
    return ads.search_terms(t.v_ads, top=None)


@query("ads_report", "SELECT date, channel, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM v_ads GROUP BY date, channel", A)
def ads_report(t):
    return ads.free_report(
        t.v_ads, "SELECT date, channel, sum(clicks) AS clicks, sum(cost_micros) AS cost_micros FROM {ads_perf} GROUP BY date, channel"
    )


@query(
    "paid_organic",
    f"""WITH k AS (SELECT keyword, match_type, {M} FROM v_ads WHERE {LIVE} GROUP BY 1,2), o AS (SELECT query, CAST(sum(clicks) AS BIGINT) AS organic_clicks, {POS} AS organic_position FROM v_search GROUP BY 1)
        SELECT k.*, organic_clicks, organic_position FROM k JOIN o ON o.query = k.keyword WHERE organic_position <= 10""",
    ("v_ads", "v_search"),
)
def paid_organic(t):
    return search.paid_organic(ads.keywords(t.v_ads), t.v_search)
