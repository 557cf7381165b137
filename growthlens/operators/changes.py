"""Snapshot-to-snapshot changes: issues, speed, search, answers, headline, ranked fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, urls
from ..plans.groups import first_n, unroll
from .audit import severity_rank

SOURCES = ("crawl", "lighthouse", "gsc", "ai")  # fixed values: snapshot sources
LCP_NOISE_MS = 1000
KEY = ["site", "code", "url_key"]


def keyed_issues(issues: DataFrame, pos: str = "crawl_pos") -> DataFrame:
    """One row per (site, code, page identity); the last duplicate wins."""
    kept = [c for c in issues.columns if c not in ("site", "code")]
    k = issues.withColumn("url_key", urls.issue_url_key("url"))
    last = k.groupBy(*KEY).agg(F.max_by(F.struct(*kept), pos).alias("i"))
    return last.select(*KEY, *[F.col(f"i.{c}").alias(c) for c in kept])


def issues_new(prev: DataFrame, curr: DataFrame, pos: str = "crawl_pos") -> DataFrame:
    """With an empty ``prev`` (first snapshot) every current issue comes back."""
    return keyed_issues(curr, pos).join(keyed_issues(prev, pos).select(*KEY), KEY, "left_anti")


def issues_resolved(prev: DataFrame, curr: DataFrame, pos: str = "crawl_pos") -> DataFrame:
    return issues_new(curr, prev, pos)


def issues_persisting(prev: DataFrame, curr: DataFrame, pos: str = "crawl_pos") -> DataFrame:
    before = keyed_issues(prev, pos).select(*KEY, F.col("severity").alias("prev_severity"))
    both = keyed_issues(curr, pos).join(before, KEY)
    return both.withColumn("severity_changed", ~F.col("severity").eqNullSafe(F.col("prev_severity")))


def issue_changes(prev: DataFrame, curr: DataFrame, pos: str = "crawl_pos") -> DataFrame:
    """new, resolved and persisting counts per site in one full outer join."""
    a = keyed_issues(prev, pos).select(*KEY, F.col("severity").alias("ps"))
    b = keyed_issues(curr, pos).select(*KEY, F.col("severity").alias("cs"))
    j = a.join(b, KEY, "full_outer")
    return j.groupBy("site").agg(
        F.count_if(F.col("ps").isNull()).alias("n_new"),
        F.count_if(F.col("cs").isNull()).alias("n_resolved"),
        F.count_if(F.col("ps").isNotNull() & F.col("cs").isNotNull()).alias("n_persisting"),
        F.count_if(F.col("ps").isNull() & (F.col("cs") == "high")).alias("n_new_high"),
        F.count_if(F.col("cs").isNotNull()).alias("n_current"),
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """Current issues per site by severity (other severities are not counted)."""
    return issues.groupBy("site").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITY_RANK])


def speed_delta(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """``url, form_factor, performance, lcp_ms, cls`` now, before and changed."""
    fields = ("performance", "lcp_ms", "cls")
    before = prev.select(
        urls.slash_key("url").alias("k"), "form_factor", *[F.col(c).alias(f"prev_{c}") for c in fields], F.lit(True).alias("has_prev")
    )
    j = curr.withColumn("k", urls.slash_key("url")).join(before, ["k", "form_factor"], "left")
    return j.select(
        "url", "form_factor", *fields, *[f"prev_{c}" for c in fields],
        *[(F.col(c) - F.col(f"prev_{c}")).alias(f"{c}_delta") for c in fields],
        F.coalesce("has_prev", F.lit(False)).alias("has_prev"),
    )


def speed_trend(runs: DataFrame) -> DataFrame:
    """Any number of snapshots: change against the one before; small LCP moves are noise."""
    w = Window.partitionBy("url", "form_factor").orderBy("snapshot_date")  # one row per snapshot
    delta = F.col("lcp_ms") - F.lag("lcp_ms").over(w)
    return runs.withColumn("lcp_delta", delta).withColumn(
        "is_noise", F.when(F.col("lcp_delta").isNotNull(), F.abs("lcp_delta") < LCP_NOISE_MS)
    )


def search_delta(prev: DataFrame, curr: DataFrame, metrics=("clicks", "impressions", "ctr", "position")) -> DataFrame:
    """Two one-row-per-site summaries as ``site, metric, value, delta``."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics]
        return df.select("site", F.inline(F.array(*pairs)))

    j = long(curr, "value").join(long(prev, "prev"), ["site", "metric"], "left")
    return j.select("site", "metric", "value", (F.col("value") - F.col("prev")).alias("delta"))


def delta_text(value, prev, digits: int) -> Column:
    """``value (+d)``; an unchanged value shows ``(0)`` up to three digits."""
    v, p = (F.col(x) if isinstance(x, str) else x for x in (value, prev))

    def shown(x, signed=False):
        body = F.format_string(f"%{'+' if signed else ''}.{digits}f", F.bround(x.cast("double"), digits))
        return body

    d = shown(v - p, signed=True)
    if digits <= 3:
        d = F.when(d.rlike(r"^[+-]0(\.0+)?$"), "0").otherwise(d)
    return F.when(v.isNull(), "n/a").when(p.isNull(), shown(v)).otherwise(F.concat(shown(v), F.lit(" ("), d, F.lit(")")))


def _whole(c) -> Column:
    return F.bround(c.cast("double"), 0).cast("bigint").cast("string")


def _bullets(df: DataFrame, seq: int, *pairs) -> DataFrame:
    """Rows of candidate lines from (condition, weight, text) triples."""
    items = [
        F.when(cond, F.struct(weight.cast("double").alias("weight"), F.lit(seq + i).alias("seq"), line.alias("line")))
        for i, (cond, weight, line) in enumerate(pairs)
    ]
    return unroll(df, ["site"], F.filter(F.array(*items), lambda x: x.isNotNull()), "b").select("site", "b.*")


def headline(changes: DataFrame, speed: DataFrame | None = None, search: DataFrame | None = None, ai: DataFrame | None = None, top: int = 5) -> DataFrame:
    """The strongest five lines per site; quiet weeks are filled up to three lines.

    ``changes``: output of ``issue_changes``; ``speed``: site + ``speed_delta`` rows;
    ``search``: site, metric, value, prev; ``ai``: site, engine, mention_rate, prev_mention_rate.
    """
    c = F.col
    n = lambda x: c(x).cast("string")
    parts = [
        _bullets(
            changes, 0,
            (c("n_new_high") > 0, 1000 + c("n_new_high"), F.concat(n("n_new_high"), F.lit(" new high-severity issues."))),
            (F.lit(True), 500 + c("n_new") + c("n_resolved"), F.concat(n("n_new"), F.lit(" new issues, "), n("n_resolved"), F.lit(" resolved."))),
            (c("n_new_high") == 0, F.lit(200), F.lit("No new high-severity issues.")),
            (F.lit(True), F.lit(-1), F.concat(F.lit("Current issue count is "), n("n_current"), F.lit("."))),
            (F.lit(True), F.lit(-2), F.lit("Speed section has the page scores.")),
            (F.lit(True), F.lit(-3), F.lit("Search and AI sections note any missing files.")),
        )
    ]
    if speed is None:
        parts.append(_bullets(changes, 900, (F.lit(True), F.lit(50), F.lit("No Lighthouse file in the current snapshot."))))
    else:
        where = F.concat("url", F.lit(" ("), "form_factor", F.lit(")"))
        parts.append(
            _bullets(
                speed, 100,
                (
                    c("has_prev") & c("performance_delta").isNotNull(), F.abs("performance_delta") * 10,
                    F.concat(F.lit("Performance on "), where, F.lit(" moved from "), _whole(c("prev_performance")), F.lit(" to "), _whole(c("performance")), F.lit(".")),
                ),
                (
                    c("has_prev") & (F.abs("lcp_ms_delta") >= 100), F.abs("lcp_ms_delta") / 50,
                    F.concat(F.lit("LCP on "), where, F.when(c("lcp_ms_delta") < 0, " is down ").otherwise(" is up "), _whole(F.abs("lcp_ms_delta")), F.lit(" ms.")),
                ),
            )
        )
    if search is None:
        parts.append(_bullets(changes, 910, (F.lit(True), F.lit(40), F.lit("No Search Console file in these snapshots."))))
    else:
        moved = c("value").isNotNull() & c("prev").isNotNull() & (c("value") != c("prev"))
        size = F.abs(c("value") - c("prev"))
        triples = [
            (moved & (c("metric") == m), size * w, F.concat(F.lit(f"{label} moved from "), _whole(c("prev")), F.lit(" to "), _whole(c("value")), F.lit(".")))
            for m, w, label in (("clicks", 1.0, "Clicks"), ("impressions", 0.01, "Impressions"), ("indexed", 5.0, "Indexed"))
        ]
        one = lambda x: F.format_string("%.1f", c(x))
        triples.append(
            ((c("metric") == "position") & (size >= 0.1), size * 20, F.concat(F.lit("Average position moved from "), one("prev"), F.lit(" to "), one("value"), F.lit(".")))
        )
        parts.append(_bullets(search, 300, *triples))
    if ai is None:
        parts.append(_bullets(changes, 920, (F.lit(True), F.lit(30), F.lit("No AI answer file in these snapshots."))))
    else:
        two = lambda x: F.format_string("%.2f", c(x))
        parts.append(
            _bullets(
                ai, 400,
                (
                    c("mention_rate") != c("prev_mention_rate"), F.abs(c("mention_rate") - c("prev_mention_rate")) * 100,
                    F.concat("engine", F.lit(" mention rate moved from "), two("prev_mention_rate"), F.lit(" to "), two("mention_rate"), F.lit(".")),
                ),
            )
        )
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    distinct = lines.groupBy("site", "line").agg(F.max_by(F.struct("weight", "seq"), F.struct("weight", -c("seq"))).alias("w"))
    order = [F.desc("weight"), "seq", "line"]
    ranked = first_n(distinct.select("site", "line", "w.weight", "w.seq"), ["site"], order, top)
    out = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    return out.filter((c("weight") >= 0) | (c("rank") <= 3)).select("site", "rank", "line")


def missing_sources(landed: DataFrame, expected=SOURCES) -> DataFrame:
    """``landed``: site, source. One note per expected source that has not landed."""
    want = landed.select("site").distinct().select("site", F.explode(F.array(*[F.lit(s) for s in expected])).alias("source"))
    gone = want.join(landed.select("site", "source").distinct(), ["site", "source"], "left_anti")
    return gone.withColumn("note", F.concat("source", F.lit(" is missing from the current snapshot.")))


def rank_fixes(issues: DataFrame, page_impressions: DataFrame, slow_pages: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Ten fixes per site: blocks indexing, loses an earning page, slow money page, entities, rest.

    ``page_impressions``: url_key, impressions; ``slow_pages``: site, code, url, severity.
    """
    rows = issues.select("site", "code", "url", "severity", F.lit(False).alias("slow"))
    if slow_pages is not None:
        rows = rows.unionByName(slow_pages.select("site", "code", "url", "severity", F.lit(True).alias("slow")))
    j = rows.withColumn("url_key", urls.url_key("url")).join(page_impressions, "url_key", "left")
    j = j.withColumn("impressions", F.coalesce("impressions", F.lit(0)))
    cls = (
        F.when(F.col("code").isin(*fixed.FIX_CLASS["a"]), "a")
        .when(F.col("slow"), "c")
        .when(F.col("impressions") > 0, "b")
        .when(F.col("code").isin(*fixed.FIX_CLASS["d"]), "d")
        .otherwise("e")
    )
    order = ["fix_class", F.desc("impressions"), severity_rank("severity"), "code", "url"]
    kept = j.select("site", cls.alias("fix_class"), "code", "url", "severity", "impressions")
    return first_n(kept, ["site"], order, top)
