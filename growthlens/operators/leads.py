"""Leads, revenue attribution and pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.numbers import ratio
from ..plans import timeline
from ..plans.groups import unroll
from .web import with_micros

MONEY = "decimal(18,2)"
CLOSED = ("Won", "Lost", "Disqualified")


def _hour() -> Column:
    return F.floor(F.col("us") / F.lit(3_600_000_000)).cast("bigint")


def touch_segments(touches: DataFrame) -> DataFrame:
    """Number the stretch of touches that leads to each conversion of a user.

    A conversion closes its stretch (``seq`` = conversions so far, itself included); a touch
    belongs to the next conversion. Runs in hourly buckets, safe for very busy users.
    """
    order = ["us", "event_id"]
    t = with_micros(touches)
    run = timeline.running_sum(t, ["user_id"], order, _hour(), F.col("is_conversion").cast("int"), "done")
    return run.withColumn("seq", F.when(F.col("is_conversion"), F.col("done")).otherwise(F.col("done") + 1))


def conversion_paths(segments: DataFrame) -> DataFrame:
    """One row per conversion: value, first and last touch channel, number of touches."""
    touch = ~F.col("is_conversion")
    at = F.when(touch, F.struct("us", "event_id"))
    return (
        segments.groupBy("user_id", "seq")
        .agg(
            F.max(F.when(F.col("is_conversion"), F.col("value"))).alias("value"),
            F.max(F.when(F.col("is_conversion"), F.col("us"))).alias("converted_us"),
            F.min_by(F.when(touch, F.col("channel")), at).alias("first_touch"),
            F.max_by(F.when(touch, F.col("channel")), at).alias("last_touch"),
            F.min(F.when(touch, F.col("us"))).alias("first_us"),
            F.count_if(touch).alias("touches"),
        )
        .filter("value IS NOT NULL")
    )


def attribution(paths: DataFrame, touch: str) -> DataFrame:
    """Revenue and conversions credited to ``first_touch`` or ``last_touch``."""
    return paths.groupBy(F.col(touch).alias("channel")).agg(
        F.count("*").alias("conversions"), F.sum("value").cast(MONEY).alias("revenue")
    )


def attribution_linear(segments: DataFrame) -> DataFrame:
    """Equal credit to every touch of a conversion's stretch (our choice of weights).

    Credit is counted in millionths and split by whole division; the remainder goes to
    the alphabetically first channel of the stretch, so that the credits add up to the revenue.
    """
    paths = conversion_paths(segments).filter("touches > 0").select("user_id", "seq", "value", "touches")
    per = segments.filter(~F.col("is_conversion")).groupBy("user_id", "seq", "channel").agg(F.count("*").alias("n"))
    units = F.round(F.col("value") * 1_000_000, 0).cast("decimal(28,0)")
    share = F.call_function("div", units * F.col("n").cast("decimal(10,0)"), F.col("touches").cast("decimal(10,0)"))
    j = per.join(paths, ["user_id", "seq"]).withColumn("units", units.cast("bigint")).withColumn("part", share.cast("bigint"))
    whole = j.groupBy("channel").agg(F.sum("n").alias("touches"), F.sum("part").cast("decimal(28,0)").alias("part"))
    rest = (
        j.groupBy("user_id", "seq")
        .agg(F.min("channel").alias("channel"), (F.max("units") - F.sum("part")).alias("rest"))
        .groupBy("channel")
        .agg(F.sum("rest").cast("decimal(28,0)").alias("rest"))
    )
    total = F.col("part") + F.coalesce(F.col("rest"), F.lit(0).cast("decimal(28,0)"))
    return whole.join(rest, "channel", "left").select(
        "channel", "touches", (total / F.lit(1_000_000).cast("decimal(9,0)")).cast("decimal(20,6)").alias("revenue")
    )


def journeys(segments: DataFrame, top: int | None = None) -> DataFrame:
    """Most common orders in which channels first appear before a conversion.

    A path holds each channel once, so its length is bounded by the number of channels and no
    list of touches is ever gathered.
    """
    conv = segments.filter("is_conversion").select("user_id", "seq")
    first = (
        segments.filter(~F.col("is_conversion"))
        .groupBy("user_id", "seq", "channel")
        .agg(F.min(F.struct("us", "event_id")).alias("at"))
        .join(conv, ["user_id", "seq"], "left_semi")
    )
    path = first.groupBy("user_id", "seq").agg(F.array_sort(F.collect_list(F.struct("at", "channel"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["channel"]), " > ")
    out = path.groupBy(text.alias("journey")).agg(F.count("*").alias("conversions"))
    return out if top is None else out.orderBy(F.desc("conversions"), "journey").limit(top)


def time_to_convert(paths: DataFrame) -> DataFrame:
    """Mean seconds from first touch to conversion per first-touch channel."""
    s = F.floor((F.col("converted_us") - F.col("first_us")) / F.lit(1_000_000)).cast("bigint")
    return paths.filter("touches > 0").groupBy("first_touch").agg(
        F.count("*").alias("conversions"), ratio(F.sum(s), F.count("*"), 2).alias("avg_seconds")
    )


def _won() -> Column:
    return F.col("lead_status") == "Won"


def lead_measures() -> list[Column]:
    valid = F.count_if(F.col("lead_status") != "Disqualified")
    return [
        F.count("*").alias("leads"),
        F.count_if(_won()).alias("won"),
        F.coalesce(F.sum(F.when(_won(), F.col("revenue"))), F.lit(0)).cast(MONEY).alias("revenue"),
        ratio(F.count_if(_won()), valid, 4).alias("close_rate"),
    ]


def revenue_by(leads: DataFrame, content: DataFrame, dims: list[str]) -> DataFrame:
    """Leads, wins, revenue and close rate rolled up over content dimensions."""
    c = content.select("content_id", *dims)
    return leads.join(c, "content_id", "left").rollup(*dims).agg(*lead_measures(), F.grouping_id().cast("int").alias("level"))


def close_rate(leads: DataFrame, dims: list[str]) -> DataFrame:
    """Won over all leads that are not disqualified."""
    return leads.groupBy(*dims).agg(*lead_measures())


def engaged_no_revenue(measured: DataFrame, leads: DataFrame, min_rate: float) -> DataFrame:
    """Well-engaging content without a won lead."""
    won = leads.filter(_won()).select("content_id").distinct()
    return measured.filter(F.col("engagement_rate") >= min_rate).join(won, "content_id", "left_anti").select("content_id", "engagement_rate")


def time_to_lead(leads: DataFrame, content: DataFrame) -> DataFrame:
    """Mean days from publishing to the lead per platform (leads after publishing)."""
    j = leads.join(content.select("content_id", "platform", "date_published"), "content_id")
    days = F.date_diff("lead_date", "date_published")
    return j.filter(days >= 0).groupBy("platform").agg(F.count("*").alias("leads"), ratio(F.sum(days), F.count("*"), 2).alias("avg_days"))


def pipeline_stages(leads: DataFrame) -> DataFrame:
    kind = F.when(F.col("lead_status").isin(*CLOSED), "closed").otherwise("open")
    return leads.groupBy("lead_status", kind.alias("kind")).agg(F.count("*").alias("leads"), F.sum("revenue").cast(MONEY).alias("value"))


def monthly_leads(leads: DataFrame) -> DataFrame:
    """Leads, wins, revenue per month and the running revenue."""
    m = leads.groupBy(F.trunc("lead_date", "month").alias("month")).agg(*lead_measures())
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return m.withColumn("running_revenue", F.sum("revenue").over(w).cast(MONEY))


def lead_sources(leads: DataFrame) -> DataFrame:
    per = leads.groupBy("lead_source").agg(F.count("*").alias("leads"))
    return per.withColumn("share", ratio("leads", leads.agg(F.count("*")).scalar(), 4))


def triage(leads: DataFrame, today, stale_days: int = 30) -> DataFrame:
    """Open leads without activity for long, and leads with missing fields."""
    is_open = ~F.col("lead_status").isin(*CLOSED)
    found = F.filter(
        F.array(
            F.when(is_open & F.col("old"), "stale"),
            F.when(F.col("owner").isNull(), "no_owner"),
            F.when(F.col("content_id").isNull(), "no_content"),
        ),
        lambda x: x.isNotNull(),
    )
    aged = leads.withColumn("old", F.date_diff(today, F.col("lead_date")) > stale_days)
    return unroll(aged, ["lead_id"], found, "finding")


def stage_moves(history: DataFrame) -> DataFrame:
    """Stage changes with the stage before (``deal_id, changed_on, seq, stage``)."""
    bucket = F.trunc("changed_on", "month")
    return timeline.previous(history, ["deal_id"], ["changed_on", "seq"], bucket, {"prev_stage": "stage"})


def backward_moves(history: DataFrame) -> DataFrame:
    """Moves to an earlier pipeline stage."""
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in fixed.DEAL_STAGES]), F.col(c))
    return stage_moves(history).filter(rank("stage") < rank("prev_stage"))
