"""Report tables put together from the other jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls


def top_pages_merged(web_pages: DataFrame, search_pages: DataFrame) -> DataFrame:
    """Sessions and organic clicks side by side; a page known to one side only stays in.

    ``web_pages``: url, sessions, views; ``search_pages``: page, clicks, impressions.
    """
    w = web_pages.groupBy(urls.url_key("url").alias("url_key")).agg(F.sum("sessions").alias("sessions"), F.sum("views").alias("views"))
    s = search_pages.groupBy(urls.url_key("page").alias("url_key")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return w.join(s, "url_key", "full_outer").na.fill(0, ["sessions", "views", "clicks", "impressions"])


def audit_report(issues: DataFrame) -> DataFrame:
    """Issue, impact, evidence and priority per code (the catalogue is joined as a literal map)."""
    impact = F.create_map(*[F.lit(x) for pair in fixed.ISSUE_SEVERITY.items() for x in pair])
    g = issues.groupBy("site", "code").agg(F.count("*").alias("n"), F.min_by("detail", "url").alias("example"), F.min("url").alias("first_url"))
    rank = F.create_map(*[F.lit(x) for pair in fixed.SEVERITY_RANK.items() for x in pair])
    return g.withColumn("impact", impact[F.col("code")]).withColumn("priority", rank[F.col("impact")] + 1)


def weekly_report(headline: DataFrame, fixes: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Headline, ranked fixes and open notes as rows of one report per site."""
    h = headline.select("site", F.lit("headline").alias("section"), F.col("rank").cast("int").alias("rank"), "line")
    text = F.concat("fix_class", F.lit(": "), "severity", F.lit(" "), "code", F.lit(" on "), "url")
    f = fixes.select("site", F.lit("fixes").alias("section"), F.lit(None).cast("int").alias("rank"), text.alias("line"))
    out = h.unionByName(f)
    if notes is not None:
        out = out.unionByName(notes.select("site", F.lit("needs_a_person").alias("section"), F.lit(None).cast("int").alias("rank"), F.col("note").alias("line")))
    return out


def report_text(rows: DataFrame) -> DataFrame:
    """Sections as text (a report of bounded size per site)."""
    return rows.groupBy("site", "section").agg(F.listagg("line", F.lit("\n")).alias("text"))
