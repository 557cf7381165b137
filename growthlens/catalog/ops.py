"""Content operation queries."""

from pyspark.sql import functions as F

from ..operators import ops
from .base import query

C = ("v_content",)
ORDER = "['concept','pre-production','captured','editing','pre-approval','approved','scheduled','published']"


@query("status_board", f"SELECT status, count(*) AS n, min(date_published) AS next_date, CAST(list_position({ORDER}, status) AS INTEGER) AS position FROM v_content GROUP BY 1", C)
def status_board(t):
    return ops.pipeline_board(t.v_content)


@query("board_filter", "SELECT content_id, status FROM v_content WHERE platform = 'Instagram' AND format LIKE 'Reel%' AND variant = 'control'", C)
def board_filter(t):
    return ops.board_filter(t.v_content, platform="Instagram", family="Reel", variant="control").select("content_id", "status")


@query(
    "invalid_transitions",
    f"""WITH r AS (SELECT deal_id, changed_on, seq, stage, status, lag(status) OVER (PARTITION BY deal_id ORDER BY changed_on, seq) AS prev_status FROM v_stage_history)
        SELECT * FROM r WHERE prev_status IS NOT NULL AND NOT (list_position({ORDER}, status) - list_position({ORDER}, prev_status) = 1 OR (prev_status = 'pre-approval' AND status = 'editing'))""",
    ("v_stage_history",),
)
def invalid_transitions(t):
    return ops.invalid_transitions(t.v_stage_history, "deal_id")


@query(
    "note_validation",
    """WITH n AS (SELECT content_id, CASE WHEN content_no%9=0 THEN '' ELSE platform END AS platform, status, format, CASE WHEN content_no%5=0 THEN NULL ELSE 'clip.mp4' END AS source_footage FROM v_content)
       SELECT content_id, 'missing platform' AS violation FROM n WHERE platform = '' UNION ALL SELECT content_id, 'captured without footage' FROM n WHERE status='captured' AND source_footage IS NULL""",
    C,
)
def note_validation(t):
    c = t.v_content
    notes = c.select(
        "content_id",
        F.when(F.col("content_no") % 9 == 0, "").otherwise(F.col("platform")).alias("platform"),
        "status",
        "format",
        F.when(F.col("content_no") % 5 != 0, "clip.mp4").alias("source_footage"),
    )
    return ops.note_validation(notes)


@query(
    "backfill_gap",
    """SELECT c.theme_topic, c.format, CAST(year(date_published) AS INTEGER) AS year, count(*) AS items FROM v_content c
       LEFT JOIN (SELECT theme_topic, format, max(date_published) AS last FROM v_content WHERE platform='X' GROUP BY 1,2) x ON x.theme_topic = c.theme_topic AND x.format = c.format
       WHERE platform='Instagram' AND (last IS NULL OR date_published > last) GROUP BY 1,2,3""",
    C,
)
def backfill_gap(t):
    c = t.v_content.withColumn("posted", F.col("date_published"))
    return ops.backfill_gap(c.filter("platform = 'Instagram'"), c.filter("platform = 'X'"), ("theme_topic", "format"))


EXCLUDE = r"""WITH f AS (SELECT trim(caption) AS cap, arg_min(content_id, (date_published, content_no)) AS first, count(*) AS n FROM v_content WHERE trim(coalesce(caption,'')) <> '' GROUP BY 1 HAVING count(*) > 1),
  r AS (SELECT c.*, list_filter([CASE WHEN regexp_matches(coalesce(caption,''),'Caption 66') THEN 'blocklist' END, CASE WHEN regexp_matches(coalesce(caption,''),'(^|[^0-9])[0-9]{3}-[0-9]{4}([^0-9]|$)') THEN 'pii' END,
    CASE WHEN regexp_matches(coalesce(caption,''),'(?i)happy.*4th of july') THEN 'dated' END, CASE WHEN lower(trim(coalesce(caption,''))) = 'link in bio' THEN 'pure_cta' END,
    CASE WHEN f.first IS NOT NULL AND f.first <> content_id THEN 'duplicate' END, CASE WHEN trim(coalesce(caption,'')) = '' THEN 'no_caption' END], lambda x: x IS NOT NULL) AS reasons
    FROM v_content c LEFT JOIN f ON f.cap = trim(c.caption)),
  a AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'keep' WHEN len(reasons) = 1 AND reasons[1] = 'no_caption' THEN 'hold' ELSE 'exclude' END AS action FROM r)"""


def _excluded(t):
    return ops.backfill_exclude(t.v_content, ["Caption 66"], ["date_published", "content_no"])


@query("backfill_exclude", f"{EXCLUDE} SELECT content_id, array_to_string(reasons, ',') AS reasons, action FROM a", C)
def backfill_exclude(t):
    return _excluded(t).select("content_id", F.array_join("reasons", ",").alias("reasons"), "action")


@query(
    "backfill_schedule",
    f"""{EXCLUDE}, k AS (SELECT content_id, content_no, row_number() OVER (ORDER BY date_published, content_no) AS n FROM a WHERE action = 'keep'),
        tk AS (SELECT DISTINCT content_no AS s FROM v_content WHERE status = 'scheduled'),
        fr AS (SELECT s, row_number() OVER (ORDER BY s) AS n FROM (SELECT unnest(range(0, (SELECT count(*) FROM v_content) * 2)) AS s) WHERE s NOT IN (SELECT s FROM tk))
        SELECT content_id, CAST(s // 2 AS BIGINT) AS day, CAST(s % 2 AS INTEGER) AS slot, CAST((content_no*7919+17) % 41 - 20 AS INTEGER) AS jitter_min FROM k JOIN fr USING (n)""",
    C,
)
def backfill_schedule(t):
    taken = t.v_content.filter("status = 'scheduled'").select(F.col("content_no").alias("slot_index"))
    return ops.backfill_schedule(_excluded(t).filter("action = 'keep'"), taken)


@query(
    "backfill_verify",
    f"""{EXCLUDE} SELECT CASE WHEN b.content_id IS NULL THEN 'missing' WHEN k.content_id IS NULL THEN 'unexpected' ELSE 'matched' END AS state, count(*) AS n
       FROM (SELECT content_id FROM a WHERE action = 'keep') k FULL OUTER JOIN (SELECT content_id FROM v_content WHERE status IN ('scheduled', 'published')) b ON k.content_id = b.content_id GROUP BY 1""",
    C,
)
def backfill_verify(t):
    return ops.backfill_verify(_excluded(t).filter("action = 'keep'"), t.v_content.filter("status IN ('scheduled', 'published')"))


@query(
    "cadence_gaps",
    """SELECT platform, theme_topic, CAST(d AS DATE) AS day FROM (SELECT platform, theme_topic, unnest(generate_series(min(date_published), max(date_published), INTERVAL 1 DAY)) AS d FROM v_content GROUP BY 1,2) s
       WHERE NOT EXISTS (SELECT 1 FROM v_content c WHERE c.platform = s.platform AND c.date_published = s.d AND c.theme_topic = s.theme_topic)""",
    C,
)
def cadence_gaps(t):
    return ops.cadence_gaps(t.v_content, ("platform", "theme_topic"))


@query(
    "cadence",
    """SELECT platform, CAST(date_trunc('week', date_published) AS DATE) AS week, count(*) AS published, greatest(20 - count(*), 0) AS short_by FROM v_content GROUP BY 1,2""",
    C,
)
def cadence(t):
    return ops.cadence(t.v_content, 20)


@query(
    "kpi_checkpoints",
    """WITH r AS (SELECT event_type AS kpi, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS day_no, count(*) AS value FROM v_events GROUP BY 1,2),
       t AS (SELECT event_type AS kpi, unnest([10, 25]) AS checkpoint, unnest([60, 100]) AS target FROM (SELECT DISTINCT event_type FROM v_events))
       SELECT kpi, checkpoint, target, arg_max(value, day_no) AS value, arg_max(value, day_no) >= target AS reached FROM r JOIN t USING (kpi) WHERE day_no <= checkpoint GROUP BY 1,2,3""",
    ("v_events",),
)
def kpi_checkpoints(t):
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    readings = t.v_events.groupBy(F.col("event_type").alias("kpi"), day.alias("day_no")).agg(F.count("*").alias("value"))
    marks = F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.lit(g).alias("target")) for c, g in ((10, 60), (25, 100))])
    targets = t.v_events.select(F.col("event_type").alias("kpi")).distinct().select("kpi", F.inline(marks))
    return ops.kpi_checkpoints(readings, targets)


@query(
    "stale_facts",
    """SELECT lead_id, kind, checked_on, CAST(age AS INTEGER) AS age_days FROM (SELECT lead_id, CASE lead_id%3 WHEN 0 THEN 'pricing' WHEN 1 THEN 'features' ELSE 'positioning' END AS kind, lead_date AS checked_on,
       (SELECT max(lead_date) FROM v_leads) - lead_date AS age FROM v_leads) WHERE age > 365 OR (kind IN ('pricing','features') AND age > 91)""",
    ("v_leads",),
)
def stale_facts(t):
    v = t.v_leads
    kind = F.when(F.col("lead_id") % 3 == 0, "pricing").when(F.col("lead_id") % 3 == 1, "features").otherwise("positioning")
    facts = v.select("lead_id", kind.alias("kind"), F.col("lead_date").alias("checked_on"))
    return ops.stale_facts(facts, v.agg(F.max("lead_date")).scalar())


@query(
    "status_throughput",
    """SELECT *, CAST(sum(entered) OVER (PARTITION BY status ORDER BY month) AS BIGINT) AS running FROM (SELECT status, CAST(date_trunc('month', changed_on) AS DATE) AS month, count(*) AS entered FROM v_stage_history GROUP BY 1,2)""",
    ("v_stage_history",),
)
def status_throughput(t):
    return ops.status_throughput(t.v_stage_history)
