"""Lab speed: median runs, opportunities, vitals bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.groups import first_n


def median_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The run whose performance is the lower middle; a missing score counts lowest.

    Failed runs (``error``) are left out. Runs are counted per score first (at most 102 scores
    per group); only the runs that share the middle score are then ordered by ``run_no``.
    """
    ok = runs.filter("error IS NULL") if "error" in runs.columns else runs
    scored = ok.withColumn("__p", F.coalesce(F.col("performance"), F.lit(-1)))
    hist = scored.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select("*", F.sum("__n").over(upto).alias("__cum"), F.sum("__n").over(w).alias("__all"))
    target = F.call_function("div", F.col("__all") + 1, F.lit(2))
    middle = h.filter((F.col("__cum") >= target) & (F.col("__cum") - F.col("__n") < target)).select(
        *keys, "__p", (target - (F.col("__cum") - F.col("__n"))).alias("__k")
    )
    tied = scored.join(middle, [*keys, "__p"])
    order = Window.partitionBy(*keys, "__p").orderBy("run_no")
    return tied.withColumn("__rn", F.row_number().over(order)).filter("__rn = __k").drop("__rn", "__k", "__p")


def vitals_band(lcp_ms="lcp_ms", cls="cls", inp_ms: str | None = None) -> Column:
    """good when every vital is under its limit: LCP 2.5 s, CLS 0.1, INP 200 ms."""
    good = (F.col(lcp_ms) < 2500) & (F.col(cls) < 0.1)
    if inp_ms:
        good = good & (F.col(inp_ms) < 200)
    return F.when(good, "good").otherwise("needs work")


def vitals_counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys, vitals_band().alias("band")).agg(F.count("*").alias("n"))


def savings_ms(audit: Column) -> Column:
    direct = F.nullif(audit["details"]["overallSavingsMs"], F.lit(0.0))
    listed = F.coalesce(audit["details"]["metricSavings"], audit["metricSavings"])
    most = F.array_max(F.map_values(listed))
    return F.bround(F.coalesce(direct, most, F.lit(0.0)), 0).cast("bigint")


def top_opportunities(reports: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Failing opportunities and insights with savings, largest first."""
    e = reports.select(*keys, F.explode_outer(F.map_entries("audits")).alias("e")).filter("e IS NOT NULL")
    a = F.col("e.value")
    rows = e.select(
        *keys, F.coalesce(a["id"], F.col("e.key")).alias("id"), F.coalesce(a["title"], F.col("e.key")).alias("title"),
        a["score"].alias("score"), a["details"]["type"].alias("type"), savings_ms(a).alias("savings_ms"),
    )
    plain = (F.col("type") == "opportunity") & (F.col("score") < 1)
    insight = (
        ~F.coalesce(F.col("type") == "opportunity", F.lit(False))
        & F.col("id").endswith("-insight") & (F.col("score").isNull() | (F.col("score") < 1)) & (F.col("savings_ms") > 0)
    )
    kept = rows.filter(F.coalesce(plain, F.lit(False)) | F.coalesce(insight, F.lit(False)))
    return first_n(kept.select(*keys, "id", "title", "savings_ms"), keys, [F.desc("savings_ms"), "id"], limit)


def lab_error_rows(runs: DataFrame) -> DataFrame:
    """Pages and form factors that failed; they stay visible but out of the medians."""
    return runs.filter("error IS NOT NULL").select("url", "form_factor", "error").distinct()
