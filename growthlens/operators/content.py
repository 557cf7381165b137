"""Content performance: latest measurements, patterns, scores, tests, ideas, e-mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio
from ..functions.text import benchmark_band
from ..plans import ranges, timeline
from ..plans.groups import first_n, latest

DIMS = ("format", "hook_used", "theme_topic", "cta_type", "platform")


def interactions() -> Column:
    return F.col("likes") + F.col("comments") + F.col("shares") + F.col("saves")


def engagement_rate() -> Column:
    """Interactions per reach in percent, four decimals; NULL without reach."""
    return ratio(interactions() * 100, F.col("reach"), 4)


def content_performance(content: DataFrame, perf: DataFrame) -> DataFrame:
    """Every logged piece with its latest measurement and engagement rate."""
    last = latest(perf, ["content_id"], ["date_measured", "seq"]).drop("seq")
    return content.join(last.withColumn("engagement_rate", engagement_rate()), "content_id", "left")


def top_performers(measured: DataFrame, n: int = 10, bottom: int = 3) -> DataFrame:
    """Best ``n`` and worst ``bottom`` pieces by engagement (a report limit)."""
    m = measured.filter("engagement_rate IS NOT NULL").select("content_id", "platform", "format", "engagement_rate", "reach")
    best = m.orderBy(F.desc("engagement_rate"), F.desc("reach"), "content_id").limit(n).withColumn("side", F.lit("top"))
    worst = m.orderBy("engagement_rate", "reach", "content_id").limit(bottom).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def _rate_units() -> Column:
    """Rate in ten-thousandths of a percent: whole numbers add up exactly on any cluster."""
    return F.round(F.col("engagement_rate") * 10_000, 0).cast("bigint")


def averages() -> list[Column]:
    n = F.count("engagement_rate")
    return [
        F.count("*").alias("n"),
        ratio(F.sum("reach"), F.count("reach"), 2).alias("avg_reach"),
        ratio(F.sum(_rate_units()), n * 10_000, 4).alias("avg_engagement"),
        ratio(F.sum("saves"), F.count("saves"), 2).alias("avg_saves"),
        ratio(F.sum("shares"), F.count("shares"), 2).alias("avg_shares"),
        ratio(F.sum("link_clicks"), F.count("link_clicks"), 2).alias("avg_clicks"),
    ]


def patterns(measured: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Averages for every value of every dimension in one pass (grouping sets)."""
    cols = [F.col(d) for d in dims]
    g = measured.groupingSets([[c] for c in cols], *cols).agg(*averages(), F.grouping_id().alias("__g"))
    dim = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        mask = (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i))
        dim = F.when(F.col("__g") == mask, F.lit(d)).otherwise(dim)
    return g.select(dim.alias("dimension"), F.coalesce(*dims).alias("value"), "n", "avg_reach", "avg_engagement", "avg_saves", "avg_shares", "avg_clicks")


def format_platform_cube(measured: DataFrame) -> DataFrame:
    return measured.cube("format", "platform").agg(*averages())


def underperformers(measured: DataFrame, dim: str) -> DataFrame:
    """Values below the overall average in more than half of their months."""
    m = measured.filter("engagement_rate IS NOT NULL").withColumn("month", F.trunc("date_published", "month"))
    per = m.groupBy("month", dim).agg(F.sum(_rate_units()).alias("s"), F.count("*").alias("n"))
    all_ = per.groupBy("month").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    # s/n < ts/tn without division
    low = F.col("s") * F.col("tn") < F.col("ts") * F.col("n")
    j = per.join(all_, "month").groupBy(dim).agg(F.count("*").alias("months"), F.count_if(low).alias("months_below"))
    return j.filter(F.col("months_below") * 2 > F.col("months"))


def performance_score(measured: DataFrame, client: str = "platform") -> DataFrame:
    """1 to 10: the decile that a piece's rate takes among the client's earlier pieces.

    1 when none of them is below it, 10 when nine tenths are. The first piece of a client has nothing before it, and the
    platform's benchmark band decides. Earlier pieces are ranked in a tree over the running numbers, so one client,
    month or rate with all pieces is many tasks.
    """
    m = measured.filter("engagement_rate IS NOT NULL").withColumn("__u", _rate_units())
    m = m.select("content_id", "content_no", "date_published", "platform", client, "engagement_rate", "__u") if client != "platform" else m
    run = ranges.prefix_ranks(m, client, ["date_published", "content_no"], "__u", "__less", "__n")
    n = F.col("__n") - 1
    decile = F.least(F.lit(10), F.call_function("div", F.col("__less") * 10, F.nullif(n, F.lit(0))) + 1)
    band = benchmark_band("platform", "engagement_rate")
    by_band = F.when(band == "excellent", 9).when(band == "good", 7).when(band == "average", 5).otherwise(2)
    score = F.when(n == 0, by_band).otherwise(decile)
    return run.select("content_id", client, "engagement_rate", n.alias("history"), score.cast("int").alias("performance_score"))


def whats_working(measured: DataFrame, dim: str, days: int = 30) -> DataFrame:
    """Last ``days`` days against the ``days`` before, per value of a dimension."""
    last = measured.agg(F.max("date_published")).scalar()
    age = F.date_diff(last, F.col("date_published"))
    u = F.when(F.col("engagement_rate").isNotNull(), _rate_units())
    now, old = age < days, (age >= days) & (age < 2 * days)
    g = measured.filter(age < 2 * days).groupBy(dim).agg(
        F.count(F.when(now, u)).alias("n_now"),
        F.count(F.when(old, u)).alias("n_before"),
        ratio(F.sum(F.when(now, u)), F.count(F.when(now, u)) * 10_000, 4).alias("now"),
        ratio(F.sum(F.when(old, u)), F.count(F.when(old, u)) * 10_000, 4).alias("before"),
    )
    trend = (
        F.when(F.col("before").isNull(), "emerging")
        .when(F.col("now").isNull(), "gone")
        .when(F.col("now") > F.col("before"), "up")
        .when(F.col("now") < F.col("before"), "down")
        .otherwise("flat")
    )
    return g.withColumn("trend", trend)


def time_slots(measured: DataFrame) -> DataFrame:
    """Engagement per platform, weekday and hour."""
    return measured.filter("engagement_rate IS NOT NULL").groupBy(
        "platform", F.weekday("date_published").alias("weekday"), F.col("hour_published").alias("hour")
    ).agg(F.count("*").alias("n"), ratio(F.sum(_rate_units()), F.count("*") * 10_000, 4).alias("avg_engagement"))


def best_times(measured: DataFrame, top: int = 3) -> DataFrame:
    """Best slots per platform (at most 168 slots each)."""
    return first_n(time_slots(measured), ["platform"], [F.desc("avg_engagement"), "weekday", "hour"], top)


def top_all_time(measured: DataFrame, client: str = "platform", n: int = 5) -> DataFrame:
    m = measured.filter("engagement_rate IS NOT NULL").select(client, "content_id", "engagement_rate", "reach")
    return first_n(m, [client], [F.desc("engagement_rate"), F.desc("reach"), "content_id"], n)


def due_for_measurement(content: DataFrame, perf: DataFrame, today, days: int = 7, timely_days: int = 2) -> DataFrame:
    """Published long enough ago, never measured. ``is_timely`` pieces are due earlier."""
    wait = F.lit(days)
    if "is_timely" in content.columns:
        wait = F.when(F.col("is_timely"), timely_days).otherwise(days)
    due = content.filter(F.date_diff(today, F.col("date_published")) >= wait)
    return due.join(perf.select("content_id").distinct(), "content_id", "left_anti")


def goal_progress(goals: DataFrame, actuals: DataFrame) -> DataFrame:
    """``goals``: kpi, target; ``actuals``: kpi, value. Gap and pace in percent."""
    j = goals.join(actuals, "kpi", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return j.select("kpi", "target", "value", (F.col("target") - F.col("value")).alias("gap"), ratio(F.col("value") * 100, F.col("target"), 2).alias("pace"))


def test_readout(measured: DataFrame, arm: str = "variant") -> DataFrame:
    """Per arm: size, mean and variance of the rate from exact moments (no per-row state)."""
    u = _rate_units().cast("decimal(20,0)")
    g = measured.filter("engagement_rate IS NOT NULL").groupBy(arm).agg(
        F.count("*").alias("n"), F.sum(u).alias("s"), F.sum(u * u).alias("q")
    )
    n, s, q = F.col("n").cast("double"), F.col("s").cast("double"), F.col("q").cast("double")
    mean = F.try_divide(s, n)
    return g.select(
        arm, "n", F.try_divide(mean, F.lit(10000.0)).alias("mean_rate"),
        F.try_divide(F.try_divide(q - s * mean, n - 1), F.lit(1e8)).alias("variance"),
    )


def welch_t(readout: DataFrame, variant: str, control: str, arm: str = "variant") -> DataFrame:
    """Welch's t of two arms of a readout (two rows in, one row out)."""
    pick = lambda name, c: F.max(F.when(F.col(arm) == name, F.col(c)))
    g = readout.agg(*[pick(a, c).alias(f"{k}_{c}") for a, k in ((variant, "a"), (control, "b")) for c in ("n", "mean_rate", "variance")])
    se = F.sqrt(F.col("a_variance") / F.col("a_n") + F.col("b_variance") / F.col("b_n"))
    return g.select(
        (F.col("a_mean_rate") - F.col("b_mean_rate")).alias("difference"),
        F.try_divide(F.col("a_mean_rate") - F.col("b_mean_rate"), se).alias("t"),
    )


def idea_score(ideas: DataFrame) -> DataFrame:
    """Weighted score 40/30/20/10 and its rank.

    Ranks come from the histogram of scores (at most 91 values), not from one global window.
    """
    tenths = F.col("impact") * 4 + F.col("fit") * 3 + F.col("search_potential") * 2 + F.col("resources")
    scored = ideas.withColumn("tenths", tenths)
    hist = scored.groupBy("tenths").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("tenths")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.select("tenths", (F.coalesce(F.sum("n").over(w), F.lit(0)) + 1).alias("rank"))
    return scored.join(F.broadcast(ranks), "tenths").select("idea_id", ratio("tenths", F.lit(10), 1).alias("score"), "rank")


def theme_mentions(answers: DataFrame, min_share: float = 0.3) -> DataFrame:
    """Themes named by at least 30% of the respondents. ``answers``: respondent, theme."""
    pairs = answers.select("respondent", "theme").distinct()
    total = answers.select("respondent").distinct().agg(F.count("*")).scalar()
    per = pairs.groupBy("theme").agg(F.count("*").alias("respondents"))
    return per.withColumn("share", ratio("respondents", total, 4)).filter(F.col("share") >= min_share)


def email_metrics(events: DataFrame, send: str = "send") -> DataFrame:
    """Rates per send over distinct recipients, with benchmark flags.

    ``events``: send, user_id, event_type in open / click / signup / unsubscribe, value.
    """
    is_ = lambda t: F.col("event_type") == t
    per_user = events.groupBy(send, "user_id").agg(
        F.bool_or(is_("open")).alias("o"), F.bool_or(is_("click")).alias("c"), F.bool_or(is_("signup")).alias("s"),
        F.bool_or(is_("unsubscribe")).alias("u"), F.sum(F.when(is_("signup"), F.col("value"))).alias("r"),
    )
    n = F.count("*")
    g = per_user.groupBy(send).agg(
        n.alias("recipients"),
        ratio(F.count_if("o"), n, 4).alias("open_rate"),
        ratio(F.count_if("c"), n, 4).alias("click_rate"),
        ratio(F.count_if("u"), n, 4).alias("unsubscribe_rate"),
        ratio(F.count_if("s"), n, 4).alias("conversion_rate"),
        ratio(F.round(F.coalesce(F.sum("r"), F.lit(0)) * 100, 0).cast("bigint"), n * 100, 2).alias("revenue_per_email"),
    )
    band = lambda c, lo, hi: F.when(F.col(c) < lo, "low").when(F.col(c) > hi, "high").otherwise("ok")
    return (
        g.withColumn("open_band", band("open_rate", 0.2, 0.4))
        .withColumn("click_band", band("click_rate", 0.02, 0.05))
        .withColumn("unsubscribe_ok", F.col("unsubscribe_rate") < 0.005)
    )


def email_segments(events: DataFrame, at_risk_days: int = 14) -> DataFrame:
    """Per recipient: opener, clicker, engaged / at-risk by the last opening or click."""
    e = events.withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day")).scalar()
    act = F.col("event_type").isin("open", "click")
    g = e.groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "open").alias("opener"),
        F.bool_or(F.col("event_type") == "click").alias("clicker"),
        F.max(F.when(act, F.col("day"))).alias("last_active"),
    )
    idle = F.date_diff(last, F.col("last_active"))
    segment = F.when(F.col("last_active").isNull(), "inactive").when(idle >= at_risk_days, "at-risk").otherwise("engaged")
    return g.withColumn("segment", segment)


def ab_test(events: DataFrame, arm: str, goal: str) -> DataFrame:
    """Two arms: recipients, conversions and the two-proportion z (our choice of test)."""
    per_user = events.groupBy(arm, "user_id").agg(F.bool_or(F.col("event_type") == goal).alias("hit"))
    g = per_user.groupBy(arm).agg(F.count("*").alias("n"), F.count_if("hit").alias("x"))
    pick = lambda k, c: F.max(F.when(F.col(arm) == k, F.col(c))).cast("double")
    w = g.agg(pick(0, "n").alias("n0"), pick(0, "x").alias("x0"), pick(1, "n").alias("n1"), pick(1, "x").alias("x1"))
    p0, p1 = F.try_divide("x0", "n0"), F.try_divide("x1", "n1")
    pool = F.try_divide(F.col("x0") + F.col("x1"), F.col("n0") + F.col("n1"))
    se = F.sqrt(pool * (F.lit(1.0) - pool) * (F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1"))))
    z = F.try_divide(p1 - p0, se)
    return w.select("n0", "x0", "n1", "x1", F.round(z, 6).alias("z"), (F.abs(z) > 1.96).alias("significant"))


def tool_scorecard(tools: DataFrame, factors: list[str], key: str = "tool_id") -> DataFrame:
    """Eight factors of 1 to 5 added up: 25+ strong, 15-24 promising, below reconsider."""
    total = F.lit(0)
    for f in factors:
        total = total + F.col(f)
    verdict = F.when(F.col("score") >= 25, "strong").when(F.col("score") >= 15, "promising").otherwise("reconsider")
    return tools.select(key, total.cast("int").alias("score")).withColumn("verdict", verdict)


def account_report(insights: DataFrame) -> DataFrame:
    """``insights``: username, metric, value (period totals) -> one row per account."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    names = ("followers_count", "media_count", "reach", "profile_views", "website_clicks")
    return insights.groupBy("username").agg(*[pick(m) for m in names])
