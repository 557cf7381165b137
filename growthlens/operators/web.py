"""Web analytics over events: sessions, reports, funnels, audits, interval effects.

Input ``events``: event_id, user_id, ts, event_type, value, page, plus any dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from ..functions.numbers import ratio
from ..plans import timeline
from ..plans.groups import unroll

SESSION_GAP_S, ENGAGED_S = 30 * 60, 10
REPORT_ROWS = 25

# Metric registry: name -> aggregate over sessionised events (Q5).
METRICS: dict[str, Callable[[], Column]] = {
    "event_count": lambda: F.count("*"),
    "total_users": lambda: F.countDistinct("user_id"),
    "sessions": lambda: F.countDistinct("user_id", "session_no"),
    "views": lambda: F.count_if(F.col("event_type") == "view"),
    "conversions": lambda: F.count_if(F.col("event_type") == "purchase"),
    "revenue": lambda: F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0)).cast("decimal(18,2)"),
}


def with_micros(events: DataFrame) -> DataFrame:
    """Add ``us`` (UTC microseconds) and ``day``; accepts both timestamp types."""
    return events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("day", F.to_date("ts"))


def _hour() -> Column:
    return F.floor(F.col("us") / F.lit(3_600_000_000)).cast("bigint")


def sessionize(events: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """Number the sessions of every user (1, 2, ...); a longer pause than the gap starts one.

    Runs in hourly buckets per user, so one very busy user does not fill a single task.
    """
    order = ["us", "event_id"]
    e = timeline.previous(with_micros(events), ["user_id"], order, _hour(), {"prev_us": "us"})
    starts = F.col("prev_us").isNull() | (F.col("us") - F.col("prev_us") >= gap_s * 1_000_000)
    return timeline.running_sum(e, ["user_id"], order, _hour(), starts.cast("int"), "session_no").drop("prev_us")


def session_table(sessioned: DataFrame) -> DataFrame:
    """One row per session: bounds, landing page, counts, engagement."""
    first = F.struct("us", "event_id")
    s = sessioned.groupBy("user_id", "session_no").agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.count("*").alias("n_events"),
        F.min_by("page", first).alias("landing_page"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "purchase").alias("conversions"),
    )
    dur = ((F.col("end_us") - F.col("start_us")) / 1_000_000).cast("bigint")
    return s.withColumn("duration_s", F.floor(dur)).withColumn("engaged", F.col("duration_s") >= ENGAGED_S)


def top_pages(sessioned: DataFrame, top: int | None = None) -> DataFrame:
    """Per page: sessions, views, users, engagement rate, mean session seconds."""
    s = session_table(sessioned).select("user_id", "session_no", "engaged", "duration_s")
    visits = sessioned.groupBy("page", "user_id", "session_no").agg(F.count_if(F.col("event_type") == "view").alias("views"))
    per_user = (
        visits.join(s, ["user_id", "session_no"])
        .groupBy("page", "user_id")
        .agg(
            F.count("*").alias("n"), F.sum("views").alias("views"), F.count_if("engaged").alias("e"), F.sum("duration_s").alias("d")
        )
    )
    out = per_user.groupBy("page").agg(
        F.sum("n").alias("sessions"),
        F.sum("views").alias("views"),
        F.count("*").alias("active_users"),
        ratio(F.sum("e"), F.sum("n"), 4).alias("engagement_rate"),
        ratio(F.sum("d"), F.sum("n"), 2).alias("avg_session_s"),
    )
    return out if top is None else out.orderBy(F.desc("sessions"), "page").limit(top)


def traffic_sources(sessioned: DataFrame, dims: list[str]) -> DataFrame:
    """Sessions, users, engagement and conversions by the source of a session's first event."""
    first = F.struct("us", "event_id")
    s = sessioned.groupBy("user_id", "session_no").agg(
        *[F.min_by(d, first).alias(d) for d in dims],
        F.min("us").alias("a"),
        F.max("us").alias("b"),
        F.count_if(F.col("event_type") == "purchase").alias("conversions"),
    )
    engaged = (F.col("b") - F.col("a")) >= ENGAGED_S * 1_000_000
    per_user = s.groupBy(*dims, "user_id").agg(
        F.count("*").alias("n"), F.count_if(engaged).alias("e"), F.sum("conversions").alias("c")
    )
    return per_user.groupBy(*dims).agg(
        F.sum("n").alias("sessions"),
        F.count("*").alias("active_users"),
        ratio(F.sum("e"), F.sum("n"), 4).alias("engagement_rate"),
        F.sum("c").alias("conversions"),
    )


def landing_pages(sessioned: DataFrame) -> DataFrame:
    s = session_table(sessioned)
    per_user = s.groupBy("landing_page", "user_id").agg(
        F.count("*").alias("n"), F.count_if("engaged").alias("e"), F.sum("duration_s").alias("d"),
        F.sum("views").alias("v"), F.sum("conversions").alias("c"),
    )
    n = F.sum("n")
    return per_user.groupBy("landing_page").agg(
        n.alias("sessions"),
        F.count("*").alias("active_users"),
        ratio(n - F.sum("e"), n, 4).alias("bounce_rate"),
        ratio(F.sum("e"), n, 4).alias("engagement_rate"),
        ratio(F.sum("d"), n, 2).alias("avg_session_s"),
        F.sum("v").alias("views"),
        F.sum("c").alias("conversions"),
    )


def event_conversions(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("event_count"), F.countDistinct("user_id").alias("total_users"))


def custom_report(events: DataFrame, dims: list[str], metrics: list[str], top: int | None = None) -> DataFrame:
    """Any dimensions with metrics of the registry; ordered by the first metric when cut."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    out = events.groupBy(*dims).agg(*[METRICS[m]().alias(m) for m in metrics])
    return out if top is None else out.orderBy(F.desc(metrics[0]), *dims).limit(top)


def daily_trend(sessioned: DataFrame) -> DataFrame:
    """Per day: sessions started, active users, users seen for the first time."""
    per_user_day = sessioned.groupBy("day", "user_id").agg(F.count("*").alias("n"))
    active = per_user_day.groupBy("day").agg(F.count("*").alias("active_users"))
    fresh = per_user_day.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("new_users"))
    starts = sessioned.groupBy("user_id", "session_no").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("sessions"))
    return (
        active.join(starts, "day", "left")
        .join(fresh, "day", "left")
        .select("day", F.coalesce("sessions", F.lit(0)).alias("sessions"), "active_users", F.coalesce("new_users", F.lit(0)).alias("new_users"))
    )


def kpi_cards(events: DataFrame, days: int = 7) -> DataFrame:
    """Last ``days`` days against the equal period before, one row per metric."""
    e = events.withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day")).scalar()
    age = F.date_diff(last, F.col("day"))
    period = F.when(age < days, "current").when(age < 2 * days, "previous")
    buy = F.col("event_type") == "purchase"
    tagged = e.withColumn("period", period).filter(F.col("period").isNotNull())
    # users are made distinct first, so no distinct set grows inside one aggregate
    per_user = tagged.groupBy("period", "user_id").agg(
        F.count("*").alias("n"), F.count_if(buy).alias("p"), F.sum(F.when(buy, F.col("value"))).alias("r")
    )
    per = per_user.groupBy("period").agg(
        F.sum("n").cast("decimal(18,2)").alias("events"),
        F.count("*").cast("decimal(18,2)").alias("users"),
        F.sum("p").cast("decimal(18,2)").alias("purchases"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("decimal(18,2)").alias("revenue"),
    )
    long = per.select("period", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("events", "users", "purchases", "revenue")])))
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("period") == "current", F.col("v"))).alias("current"),
        F.max(F.when(F.col("period") == "previous", F.col("v"))).alias("previous"),
    )
    cents = lambda c: F.round(F.col(c) * 100, 0)
    return wide.withColumn("change", F.try_divide((cents("current") - cents("previous")).cast("double"), cents("previous").cast("double")))


def funnel_times(events: DataFrame, steps: list[str]) -> DataFrame:
    """First time of every step per user, each strictly after the step before.

    One map-side combined minimum and one join per step; a very busy user is split by AQE.
    """
    e = with_micros(events).filter(F.col("event_type").isin(*steps)).select("user_id", "event_type", "us")
    reached = e.filter(F.col("event_type") == steps[0]).groupBy("user_id").agg(F.min("us").alias("t1"))
    for i, step in enumerate(steps[1:], start=2):
        nxt = (
            e.filter(F.col("event_type") == step)
            .join(reached.select("user_id", F.col(f"t{i - 1}").alias("after")).filter("after IS NOT NULL"), "user_id")
            .filter("us > after")
            .groupBy("user_id")
            .agg(F.min("us").alias(f"t{i}"))
        )
        reached = reached.join(nxt, "user_id", "left")
    return reached


def funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """Users per step and the rate against the step before."""
    t = funnel_times(events, steps)
    counts = t.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(1, len(steps) + 1)])
    return funnel_rates(counts, steps)


def funnel_rates(counts: DataFrame, steps: list[str]) -> DataFrame:
    """One row of counts ``n1, n2, ...`` as one row per step."""
    rows = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(s).alias("step"),
            F.col(f"n{i}").alias("users"),
            (ratio(f"n{i}", f"n{i - 1}", 4) if i > 1 else F.lit(1.0)).alias("step_rate"),
        )
        for i, s in enumerate(steps, start=1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def new_vs_returning(events: DataFrame) -> DataFrame:
    """Users per day, split into first day and later days."""
    per = events.withColumn("day", F.to_date("ts")).groupBy("user_id", "day").agg(F.count("*").alias("events"))
    firsts = per.groupBy("user_id").agg(F.min("day").alias("first_day"))
    kind = F.when(F.col("day") == F.col("first_day"), "new").otherwise("returning")
    return per.join(firsts, "user_id").groupBy("day", kind.alias("kind")).agg(F.count("*").alias("users"), F.sum("events").alias("events"))


def geo_share(visits: DataFrame, local: list[str]) -> DataFrame:
    """Share of visits from the service area. ``visits``: site, region, sessions."""
    here = F.when(F.col("region").isin(*local), F.col("sessions")).otherwise(0)
    return visits.groupBy("site").agg(F.sum("sessions").alias("sessions"), ratio(F.sum(here), F.sum("sessions"), 4).alias("local_share"))


def observed_properties(events: DataFrame) -> DataFrame:
    """Events and how often each property appears on them."""
    keys = events.select("event_type", F.explode_outer(F.json_object_keys("props")).alias("property"))
    return keys.groupBy("event_type", "property").agg(F.count("*").alias("n"))


def tracking_plan_audit(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Observed events against the plan (event_type, property): one row per finding."""
    seen = observed_properties(events)
    seen_events = seen.groupBy("event_type").agg(F.sum("n").alias("n"))
    planned_events = plan.select("event_type").distinct().withColumn("planned", F.lit(True))
    both = seen_events.join(planned_events, "event_type", "full_outer")
    event_findings = both.select(
        "event_type",
        F.lit(None).cast("string").alias("property"),
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("planned").isNull(), "not_in_plan"),
                    F.when(F.col("n").isNull(), "never_seen"),
                    F.when(~text.event_name_ok("event_type"), "bad_name"),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("finding"),
    )
    missing = (
        plan.filter("property IS NOT NULL")
        .join(seen_events.select("event_type"), "event_type", "left_semi")
        .join(seen.filter("property IS NOT NULL").select("event_type", "property"), ["event_type", "property"], "left_anti")
        .select("event_type", "property", F.lit("missing_property").alias("finding"))
    )
    return event_findings.unionByName(missing)


def duplicate_events(events: DataFrame, within_s: int = 60) -> DataFrame:
    """Events that repeat the same user, type and properties within a short gap."""
    e = timeline.previous(
        with_micros(events), ["user_id", "event_type", "props"], ["us", "event_id"], _hour(), {"prev_us": "us"}
    )
    gap = F.col("us") - F.col("prev_us")
    return e.filter(gap <= within_s * 1_000_000).select("event_id", "user_id", "event_type", gap.alias("gap_us"))


PII = {  # fixed values: what personal data looks like in a property
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]?\d{4}(?!\d)",
}


def pii_scan(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """Rows whose text holds values that look like personal data, and of which kind."""
    kinds = F.filter(F.array(*[F.when(F.col(body).rlike(p), F.lit(k)) for k, p in PII.items()]), lambda x: x.isNotNull())
    return unroll(df, keys, kinds, "kind")


def utm_audit(df: DataFrame, url: str = "url") -> DataFrame:
    """Tagged URLs per source: convention (lower case) and missing medium."""
    tagged = df.select(urls.utm_param(url, "source").alias("source"), urls.utm_param(url, "medium").alias("medium"))
    return tagged.groupBy("source").agg(
        F.count("*").alias("n_urls"),
        F.count_if(F.col("source") == F.lower("source")).alias("lower_case"),
        F.count_if(F.col("medium").isNull()).alias("without_medium"),
    )


def campaign_table(df: DataFrame, url: str = "url") -> DataFrame:
    names = ("source", "medium", "campaign", "content", "term")
    return df.groupBy(*[urls.utm_param(url, n).alias(n) for n in names]).agg(F.count("*").alias("n_urls"))


def conversion_once(sessioned: DataFrame) -> DataFrame:
    """Per event type: every occurrence against at most one per session."""
    per = sessioned.groupBy("event_type", "user_id", "session_no").agg(F.count("*").alias("n"))
    return per.groupBy("event_type").agg(F.sum("n").alias("every"), F.count("*").alias("once_per_session"))


def spike_after_post(sessioned: DataFrame, posts: DataFrame, days: int = 3) -> DataFrame:
    """Sessions in the ``days`` days from a publish date against the same span before.

    The interval becomes an equi join: every post is expanded to its 2 x ``days`` dates, and the
    daily session counts (one row per day) are looked up. ``posts``: content_id, published.
    """
    daily = sessioned.groupBy("user_id", "session_no").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("sessions"))
    span = F.sequence(F.lit(-days), F.lit(days - 1))
    slots = posts.groupBy("published").agg(F.count("*").alias("n_posts")).select("published", F.explode(span).alias("offset"))
    hit = slots.withColumn("day", F.date_add("published", F.col("offset"))).join(daily, "day")
    effect = hit.groupBy("published").agg(
        F.coalesce(F.sum(F.when(F.col("offset") >= 0, F.col("sessions"))), F.lit(0)).alias("after"),
        F.coalesce(F.sum(F.when(F.col("offset") < 0, F.col("sessions"))), F.lit(0)).alias("before"),
    )
    return posts.join(effect, "published", "left").select(
        "content_id", "published", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("before", F.lit(0)).alias("before")
    )


def social_to_site(landings: DataFrame, posts: DataFrame) -> DataFrame:
    """Sessions by post. ``landings``: url; ``posts``: content_id, platform; tag utm_content."""
    tagged = landings.groupBy(urls.utm_param("url", "content").alias("content_id")).agg(F.count("*").alias("sessions"))
    return posts.join(tagged, "content_id", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def instrument_break(periods: DataFrame, tool_changes: DataFrame) -> DataFrame:
    """Flag period pairs that straddle a tool change. ``periods``: metric, prev_start, end;
    ``tool_changes``: metric, changed_on. Change dates per metric are few; periods are joined by metric."""
    hit = periods.join(tool_changes, "metric").filter(F.col("changed_on").between(F.col("prev_start"), F.col("end")))
    flagged = hit.groupBy("metric", "prev_start", "end").agg(F.min("changed_on").alias("changed_on"))
    return periods.join(flagged, ["metric", "prev_start", "end"], "left").withColumn("broken", F.col("changed_on").isNotNull())


def active_users(events: DataFrame, minutes: int = 30, slide: int = 5) -> DataFrame:
    """Exact distinct users by page in sliding windows (batch twin of the realtime report)."""
    e = events.withColumn("t", F.col("ts").cast("timestamp"))
    w = F.window("t", f"{minutes} minutes", f"{slide} minutes")
    per_user = e.groupBy(w.alias("w"), "page", "user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("w", "page").agg(F.count("*").alias("active_users")).select(
        F.unix_seconds("w.start").alias("window_start"), "page", "active_users"
    )


def channel_engagement(sessioned: DataFrame, channel: str) -> DataFrame:
    return traffic_sources(sessioned, [channel])


def rolling_users(events: DataFrame, days: int = 7) -> DataFrame:
    """Users per day with a trailing mean over the daily rows."""
    per = events.withColumn("day", F.to_date("ts")).groupBy("day").agg(F.countDistinct("user_id").alias("users"))
    w = Window.orderBy("day").rowsBetween(-(days - 1), 0)  # one row per day
    return per.withColumn("mean_users", F.try_divide(F.sum("users").over(w).cast("double"), F.count("*").over(w).cast("double")))
