"""Content operations: board, transitions, note checks, backfill planning, cadence, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import format_family
from ..plans import ranges, timeline
from ..plans.groups import unroll
from .web import PII

SEED, JITTER_MIN, SLOTS_PER_DAY = 17, 20, 2


def status_rank(status) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return F.array_position(F.array(*[F.lit(s) for s in fixed.STATUS_ORDER]), c)


def pipeline_board(notes: DataFrame) -> DataFrame:
    """Pieces per status in workflow order, with the next date to work on."""
    g = notes.groupBy("status").agg(F.count("*").alias("n"), F.min("date_published").alias("next_date"))
    return g.withColumn("position", status_rank("status").cast("int"))


def board_order(notes: DataFrame) -> DataFrame:
    """Within a status by shoot date, pieces without one last by post date."""
    return notes.orderBy(status_rank("status"), F.col("shoot_date").asc_nulls_last(), "post_date", "content_id")


def board_filter(notes: DataFrame, platform: str | None = None, family: str | None = None, **equal) -> DataFrame:
    """Filter by platform (text or array column), format family and any equal fields."""
    if platform is not None:
        is_array = dict(notes.dtypes)["platform"].startswith("array")
        notes = notes.filter(F.array_contains("platform", platform) if is_array else F.col("platform") == platform)
    if family is not None:
        notes = notes.filter(format_family("format") == family)
    for name, value in equal.items():
        notes = notes.filter(F.col(name) == value)
    return notes


def invalid_transitions(history: DataFrame, key: str = "content_id") -> DataFrame:
    """Status changes that are neither the next step nor the one allowed way back."""
    moves = timeline.previous(history, [key], ["changed_on", "seq"], F.trunc("changed_on", "month"), {"prev_status": "status"})
    step = status_rank("status") - status_rank("prev_status")
    back = F.lit(False)
    for a, b in fixed.STATUS_BACK:
        back = back | ((F.col("prev_status") == a) & (F.col("status") == b))
    return moves.filter(F.col("prev_status").isNotNull() & ~((step == 1) | back))


def note_validation(notes: DataFrame, required=fixed.NOTE_REQUIRED) -> DataFrame:
    """Violations per note: missing required fields, id against file name, captured without footage."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    checks = [F.when(blank(c), F.lit(f"missing {c}")) for c in required if c in notes.columns]
    if "file_name" in notes.columns:
        stem = F.regexp_extract("file_name", r"^(\d{4})-(\d{2})-(\d{2})-([A-Z]+-\d+)-", 0)
        day = F.regexp_replace(F.left("file_name", F.lit(10)), "-", "")
        prefix, no = F.split_part("file_name", F.lit("-"), F.lit(4)), F.split_part("file_name", F.lit("-"), F.lit(5))
        built = F.concat(prefix, F.lit("-"), day, F.lit("-"), no)
        checks.append(F.when((stem == "") | ~F.col("content_id").eqNullSafe(built), F.lit("id does not match file name")))
    if "source_footage" in notes.columns:
        checks.append(F.when((F.col("status") == "captured") & blank("source_footage"), F.lit("captured without footage")))
    return unroll(notes, ["content_id"], F.filter(F.array(*checks), lambda x: x.isNotNull()), "violation")


def backfill_gap(catalogue: DataFrame, target: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """Catalogue items newer than the target's last post, per ``keys`` and year. Column ``posted`` is a date.

    What the target never posted about is a gap from the first item on.
    """
    last = target.groupBy(*keys).agg(F.max("posted").alias("__last"))
    items = catalogue.join(last, list(keys), "left") if keys else catalogue.withColumn("__last", last.select("__last").scalar())
    newer = items.filter("__last IS NULL OR posted > __last")
    return newer.groupBy(*keys, F.year("posted").alias("year")).agg(F.count("*").alias("items"))


# Caption patterns of the exclusion passes.
DATED = r"(?i)\b(happy|merry)\b.*\b(4th of july|christmas|new year|thanksgiving|easter|halloween)\b"
PURE_CTA = r"(?i)^\s*link in bio[.!]?\s*$"
CTA_SENTENCE = r"(?i)\s*[^.!?\n]*\blink in bio\b[^.!?\n]*[.!?]?"


def backfill_exclude(items: DataFrame, blocklist: list[str], order: list[str]) -> DataFrame:
    """All reasons per item and the resulting action (keep / hold / exclude).

    Of items with one caption the first in ``order`` is kept. Captions are compared through a
    map-side combined minimum; the shared captions alone are joined back.
    """
    cap = F.trim(F.coalesce("caption", F.lit("")))
    rows = items.withColumn("__cap", cap)
    first = (
        rows.filter("__cap <> ''")
        .groupBy("__cap")
        .agg(F.min_by("content_id", F.struct(*order)).alias("__first"), F.count("*").alias("__n"))
        .filter("__n > 1")
    )
    j = rows.join(first, "__cap", "left")
    blocked = F.lit(False)
    for pattern in blocklist:
        blocked = blocked | F.col("__cap").rlike(pattern)
    pii = F.lit(False)
    for pattern in (*PII.values(), r"(?<!\d)\d{3}-\d{4}(?!\d)"):
        pii = pii | F.col("__cap").rlike(pattern)
    reasons = [
        F.when(blocked, "blocklist"),
        F.when(pii, "pii"),
        F.when(F.col("__cap").rlike(DATED), "dated"),
        F.when(F.col("__cap").rlike(PURE_CTA), "pure_cta"),
        F.when(F.col("__first").isNotNull() & (F.col("__first") != F.col("content_id")), "duplicate"),
        F.when(F.col("__cap") == "", "no_caption"),
    ]
    if "media_url" in items.columns:
        reasons.append(F.when(F.coalesce("media_url", F.lit("")) == "", "no_media"))
    out = j.withColumn("reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    action = (
        F.when(F.size("reasons") == 0, "keep")
        .when((F.size("reasons") == 1) & F.array_contains("reasons", "no_caption"), "hold")
        .otherwise("exclude")
    )
    return out.withColumn("action", action).drop("__cap", "__first", "__n")


def strip_cta(items: DataFrame) -> DataFrame:
    """Drop a "link in bio" sentence from kept captions and flag the change."""
    clean = F.trim(F.regexp_replace("caption", CTA_SENTENCE, ""))
    return items.withColumn("caption_modified", F.coalesce(F.col("caption").rlike(r"(?i)link in bio"), F.lit(False))).withColumn("caption", clean)


def backfill_schedule(items: DataFrame, taken: DataFrame, number: str = "content_no", seed: int = SEED) -> DataFrame:
    """Oldest first, two slots a day, seeded jitter of up to 20 minutes, taken slots skipped.

    ``taken``: slot_index (day * 2 + slot). Items are numbered in ranges of the data, so a month, or a day, that holds all of
    them is many tasks. The n-th item gets the n-th free slot: a taken slot t (the j-th taken) shifts every item from
    t - j on, which is a running count over items and breaks.
    """
    numbered = ranges.numbered(items.select("content_id", "date_published", F.col(number).alias("no")), [], ["date_published", "no", "content_id"], "n")
    pos = numbered.select("content_id", "no", (F.col("n") - 1).alias("pos"), F.lit(1).alias("kind"))
    slots = ranges.numbered(taken.select("slot_index").filter("slot_index IS NOT NULL").distinct(), [], ["slot_index"], "j")
    breaks = slots.select(
        F.lit(None).cast("string").alias("content_id"),
        F.lit(None).cast("bigint").alias("no"),
        (F.col("slot_index") - (F.col("j") - 1)).cast("bigint").alias("pos"),
        F.lit(0).alias("kind"),
    )
    both = pos.withColumn("pos", F.col("pos").cast("bigint")).unionByName(breaks)
    shifted = ranges.running(both, [], ["pos", "kind", "no", "content_id"], {"shift": (F.col("kind") == 0).cast("int")})
    index = F.col("pos") + F.col("shift")
    jitter = F.pmod(F.col("no") * 7919 + seed, F.lit(2 * JITTER_MIN + 1)) - JITTER_MIN
    return shifted.filter("kind = 1").select(
        "content_id",
        F.call_function("div", index, F.lit(SLOTS_PER_DAY)).cast("bigint").alias("day"),
        F.pmod(index, F.lit(SLOTS_PER_DAY)).cast("int").alias("slot"),
        jitter.cast("int").alias("jitter_min"),
    )


def backfill_verify(manifest: DataFrame, scheduled: DataFrame, key: str = "content_id") -> DataFrame:
    """Manifest against what is scheduled: matched, missing, unexpected."""
    a = manifest.select(key).distinct().withColumn("a", F.lit(True))
    b = scheduled.select(key).distinct().withColumn("b", F.lit(True))
    j = a.join(b, key, "full_outer")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").otherwise("matched")
    return j.groupBy(kind.alias("state")).agg(F.count("*").alias("n"))


def cadence_gaps(posts: DataFrame, keys: tuple[str, ...] = ("platform",)) -> DataFrame:
    """Days without a post per ``keys`` between the first and last post of the same."""
    days = posts.groupBy(*keys, F.col("date_published").alias("day")).agg(F.count("*").alias("n"))
    span = days.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(days, [*keys, "day"], "left_anti")


def cadence(posts: DataFrame, planned_per_week: int) -> DataFrame:
    """Published against planned posts per platform and week."""
    w = posts.groupBy("platform", F.trunc("date_published", "week").alias("week")).agg(F.count("*").alias("published"))
    return w.withColumn("short_by", F.greatest(F.lit(planned_per_week) - F.col("published"), F.lit(0)))


def kpi_checkpoints(readings: DataFrame, targets: DataFrame) -> DataFrame:
    """Latest reading at or before each checkpoint day against its target.

    ``readings``: kpi, day_no, value; ``targets``: kpi, checkpoint, target (a few per kpi). One
    aggregate with a condition per row, no as-of window.
    """
    j = readings.join(targets, "kpi").filter(F.col("day_no") <= F.col("checkpoint"))
    last = j.groupBy("kpi", "checkpoint", "target").agg(F.max_by("value", "day_no").alias("value"))
    return last.withColumn("reached", F.col("value") >= F.col("target"))


def stale_facts(facts: DataFrame, today, quick=("pricing", "features"), quick_days: int = 91, slow_days: int = 365) -> DataFrame:
    """Facts older than a quarter (pricing, features) or a year (anything)."""
    age = F.date_diff(today, F.col("checked_on"))
    return facts.withColumn("age_days", age).filter(
        (F.col("age_days") > slow_days) | (F.col("kind").isin(*quick) & (F.col("age_days") > quick_days))
    )


def status_throughput(history: DataFrame) -> DataFrame:
    """Pieces that entered each status per month with the running total."""
    m = history.groupBy("status", F.trunc("changed_on", "month").alias("month")).agg(F.count("*").alias("entered"))
    w = Window.partitionBy("status").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return m.withColumn("running", F.sum("entered").over(w))
