"""Answer-engine visibility: mentions, positions, citations, unverified money figures, summaries.

Input ``answers``: engine, prompt_id, kind, run, answer, error, cited_urls, retrieved_urls,
cost_micros (or cost_usd). Names and domains are lists, unrolled into literal patterns so that
every pattern is compiled once per task.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from ..functions.numbers import ratio
from ..plans import ranges
from ..plans.groups import unroll

NEAR_CHARS = 300


def attach_urls(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Put the URL rows of an answer (answer_id, pos, url) into ``cited_urls`` in order."""
    packed = cited.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("u"))
    return (
        answers.join(packed, "answer_id", "left")
        .withColumn("cited_urls", F.coalesce(F.transform("u", lambda x: x["url"]), F.array().cast("array<string>")))
        .drop("u")
    )


def first_start(body: Column, names: list[str]) -> Column:
    """Smallest 1-based start of a whole-word mention of any name, NULL when none."""
    starts = [F.nullif(F.regexp_instr(body, F.lit(text.mention_regex(n))), F.lit(0)) for n in names if n.strip()]
    if not starts:
        return F.lit(None).cast("int")
    return F.least(*starts) if len(starts) > 1 else starts[0]


def domain_list(cited: Column) -> Column:
    """Distinct bare hosts in order, without the grounding proxy."""
    hosts = F.transform(cited, lambda u: urls.bare_host(urls.url_host(u)))
    return F.array_distinct(F.filter(hosts, lambda h: (h != "") & (h != fixed.PROXY_HOST)))


def any_ours(cited: Column, domains: list[str]) -> Column:
    own = F.array(*[F.lit(d) for d in domains])
    hit = F.exists(cited, lambda u: (urls.url_host(u) != "") & urls.host_in(urls.bare_host(urls.url_host(u)), own))
    return F.coalesce(hit, F.lit(False))


def analyze(answers: DataFrame, brand: list[str], competitors: list[str], domains: list[str]) -> DataFrame:
    """Add mention, position and citation columns. Narrow: no shuffle."""
    body = F.coalesce("answer", F.lit(""))
    if "retrieved_urls" not in answers.columns:
        answers = answers.withColumn("retrieved_urls", F.array().cast("array<string>"))
    seen = answers.withColumn("__b", first_start(body, brand))
    rivals = [(n, f"__c{i}") for i, n in enumerate(competitors)]
    for name, column in rivals:
        seen = seen.withColumn(column, first_start(body, [name]))
    ahead = F.lit(0)
    for _, column in rivals:
        ahead = ahead + F.coalesce((F.col(column) < F.col("__b")).cast("int"), F.lit(0))
    found = F.filter(
        F.array(*[F.struct(F.col(c).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(rivals)])
        if rivals
        else F.array().cast("array<struct<at:int,i:int,n:string>>"),
        lambda x: x["at"].isNotNull(),
    )
    return (
        seen.withColumn("brand_mentioned", F.col("__b").isNotNull())
        .withColumn("brand_position", F.when(F.col("__b").isNotNull(), ahead + 1))
        .withColumn("competitors_mentioned", F.transform(F.array_sort(found), lambda x: x["n"]))
        .withColumn("our_url_cited", any_ours(F.col("cited_urls"), domains))
        .withColumn("our_url_retrieved", any_ours(F.col("retrieved_urls"), domains))
        .withColumn("cited_domains", domain_list(F.col("cited_urls")))
        .drop("__b", *[c for _, c in rivals])
    )


def near_figures(body: Column, names: Column) -> Column:
    """Distinct money figures at most NEAR_CHARS away from a mention of any name, in order.

    The helper is built on call and holds no module state, so it travels by value: executors
    need no copy of this package.
    """
    money_regex, window = text.MONEY_PATTERN, NEAR_CHARS

    @F.pandas_udf("array<string>")
    def near(bodies: pd.Series, all_names: pd.Series) -> pd.Series:
        money = re.compile(money_regex)

        @functools.lru_cache(maxsize=1024)
        def patterns(group):
            return [re.compile(rf"(?<!\w){re.escape(n.strip())}(?!\w)", re.IGNORECASE) for n in group if n and n.strip()]

        def figures(body, group):
            spans = sorted(m.span() for p in patterns(group) for m in p.finditer(body))
            if not spans:
                return []
            starts = [s for s, _ in spans]
            reach = list(itertools.accumulate((e for _, e in spans), max))
            found = {}
            for m in money.finditer(body):
                i = bisect_right(starts, m.end())
                gaps = [starts[i] - m.end()] if i < len(starts) else []
                if i:
                    gaps.append(m.start() - reach[i - 1])
                if min(gaps) <= window:
                    found[m.group().replace(" ", "")] = None
            return list(found)

        return pd.Series([figures(b or "", tuple(n)) for b, n in zip(bodies, all_names)])

    return near(body, names)


def unverified_figures(answers: DataFrame, brand: list[str], facts: DataFrame, keys: list[str]) -> DataFrame:
    """Figures near a brand mention that the facts do not back: ``keys..., figure, note``.

    Texts without a dollar sign never reach the Python helper. ``facts``: figure.
    """
    names = F.array(*[F.lit(n) for n in brand])
    # offsets need a regex engine with spans; everything after it is relational
    priced = answers.filter(F.contains("answer", F.lit("$")))
    near = unroll(priced, keys, near_figures("answer", names), "figure").withColumn("money_key", text.money_key("figure"))
    known = facts.select(text.money_key("figure").alias("money_key")).distinct()
    return near.join(known, "money_key", "left_anti").select(*keys, "figure", F.lit("check by hand").alias("note"))


def mention_spans(answers: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """``keys..., name, start, end`` of every whole-word mention (Q2)."""

    @F.pandas_udf("array<struct<name:string,start:int,end:int>>")
    def spans(bodies: pd.Series) -> pd.Series:
        patterns = [(n, re.compile(rf"(?<!\w){re.escape(n.strip())}(?!\w)", re.IGNORECASE)) for n in names]
        return bodies.map(
            lambda b: [{"name": n, "start": m.start(), "end": m.end()} for n, p in patterns for m in p.finditer(b or "")]
        )

    return unroll(answers, keys, spans("answer"), "s").select(*keys, "s.*")


def _rates() -> list[Column]:
    ok = F.col("error").isNull()
    n_ok = F.count_if(ok)
    pos = F.when(ok, F.col("brand_position"))
    return [
        F.count("*").alias("calls"),
        F.count_if(~ok).alias("failed"),
        ratio(F.count_if(ok & F.col("brand_mentioned")), n_ok, 4).alias("mention_rate"),
        ratio(F.count_if(ok & F.col("our_url_cited")), n_ok, 4).alias("citation_rate"),
        ratio(F.sum(pos), F.count(pos), 2).alias("avg_position"),
    ]


def cost_usd() -> Column:
    """Exact cost, failed calls included; 0 when nothing was billed."""
    return F.coalesce(F.sum(F.col("cost_micros").cast("decimal(18,6)") / F.lit(1000000).cast("decimal(7,0)")), F.lit(0)).cast("decimal(18,6)")


def engine_summary(analyzed: DataFrame) -> DataFrame:
    return analyzed.groupBy("engine").agg(*_rates(), cost_usd().alias("cost_usd"))


def prompt_summary(analyzed: DataFrame, first_by: str = "answer_id") -> DataFrame:
    """Per question; its kind is the one seen first."""
    return analyzed.groupBy("prompt_id").agg(F.min_by("kind", first_by).alias("kind"), *_rates()).drop("failed")


def answer_cube(analyzed: DataFrame) -> DataFrame:
    """Engine, question and kind in every combination (cube)."""
    return analyzed.cube("engine", "prompt_id", "kind").agg(*_rates())


def top_cited(analyzed: DataFrame) -> DataFrame:
    good = unroll(analyzed.filter("error IS NULL"), [], F.col("cited_domains"), "domain")
    return good.groupBy("domain").agg(F.count("*").alias("answers"))


def offsite_gap(analyzed: DataFrame, domains: list[str]) -> DataFrame:
    """Cited domains that are not ours and never appear in an answer naming the brand."""
    own = F.array(*[F.lit(d) for d in domains])
    rows = unroll(analyzed.filter("error IS NULL"), ["brand_mentioned"], F.col("cited_domains"), "domain")
    per = rows.groupBy("domain").agg(F.count("*").alias("answers"), F.bool_or("brand_mentioned").alias("named"))
    return per.filter(~F.col("named") & ~urls.host_in("domain", own)).drop("named")


def run_variance(analyzed: DataFrame) -> DataFrame:
    """How far the runs of one question agree."""
    ok = analyzed.filter("error IS NULL")
    hits = F.count_if("brand_mentioned")
    return ok.groupBy("engine", "prompt_id").agg(
        F.count("*").alias("runs"),
        hits.alias("mentions"),
        ratio(F.greatest(hits, F.count("*") - hits), F.count("*"), 4).alias("agreement"),
        F.min("brand_position").alias("best_position"),
        F.max("brand_position").alias("worst_position"),
    )


def cost_report(answers: DataFrame) -> DataFrame:
    return answers.groupBy("engine", "kind").agg(F.count("*").alias("calls"), cost_usd().alias("cost_usd"))


def share_of_voice(analyzed: DataFrame, brand: str) -> DataFrame:
    """Mentions of the brand and of every competitor, with shares."""
    named = F.concat(
        F.when(F.col("brand_mentioned"), F.array(F.lit(brand))).otherwise(F.array().cast("array<string>")),
        F.col("competitors_mentioned"),
    )
    per = unroll(analyzed.filter("error IS NULL"), [], named, "name").groupBy("name").agg(F.count("*").alias("mentions"))
    return per.withColumn("share", ratio("mentions", per.agg(F.sum("mentions")).scalar(), 4))


def figures_to_check(figures: DataFrame) -> DataFrame:
    """Flat list for a person: engine, prompt_id, run, figure (failed rows included)."""
    return figures.select("engine", "prompt_id", "run", "figure", "note")


def call_plan(prompts: DataFrame, engines: list[str], runs: int, max_calls: int) -> DataFrame:
    """All planned questions, numbered in the order prompt, run, engine; ``in_budget`` marks those that the call budget pays for.

    Prompts are numbered before they are multiplied, in ranges of the data.
    """
    first = ranges.numbered(prompts.select("prompt_id", "prompt_pos", "kind"), [], ["prompt_pos", "prompt_id"], "__no")
    calls = first.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).select(
        "*", F.posexplode(F.array(*[F.lit(e) for e in engines])).alias("engine_no", "engine")
    )
    number = ((F.col("__no") - 1) * runs + F.col("run") - 1) * len(engines) + F.col("engine_no") + 1
    return calls.withColumn("call_no", number.cast("bigint")).withColumn("in_budget", F.col("call_no") <= max_calls).drop("__no")


def ai_delta(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Rates per engine of the current summary and their change (engines of curr only)."""
    before = prev.select("engine", F.col("mention_rate").alias("pm"), F.col("citation_rate").alias("pc"))
    return curr.join(before, "engine", "left").select(
        "engine",
        "mention_rate",
        "citation_rate",
        (F.col("mention_rate") - F.col("pm")).alias("mention_delta"),
        (F.col("citation_rate") - F.col("pc")).alias("citation_delta"),
    )
