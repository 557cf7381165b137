"""Text, naming and band helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money figures, robots directives that carry a value, id and date patterns.
MONEY_PATTERN = r"\$\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
VALUED_DIRECTIVES = ("max-image-preview", "max-snippet", "max-video-preview", "unavailable_after")
CONTENT_ID_PATTERN = r"^[A-Z]+-(\d{8})-\d{2}$"
LEAD_ID_PATTERN = r"^[A-Z]+-L-(\d{8})-\d+$"
MS_DATE_PATTERN = r"^/Date\((-?\d+)([+-]\d{4})?\)/$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def mention_pattern(name: Column) -> Column:
    """Whole-word, case-insensitive pattern for a name column."""
    quoted = F.regexp_replace(F.trim(name), r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    return F.concat(F.lit(r"(?iuU)(?<!\w)"), quoted, F.lit(r"(?!\w)"))


def mention_regex(name: str) -> str:
    return r"(?iuU)(?<!\w)" + re.sub(r"([\\.\[\]{}()*+?^$|-])", r"\\\1", name.strip()) + r"(?!\w)"


def mentions(text, name: Column) -> Column:
    return (F.trim(name) != "") & F.regexp_like(F.coalesce(_c(text), F.lit("")), mention_pattern(name))


def money_figures(text) -> Column:
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(MONEY_PATTERN), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")))


def money_key(figure) -> Column:
    """``$1,200.00`` and ``$1200`` share the key ``1200``."""
    digits = F.regexp_replace(_c(figure), r"[$,\s]", "")
    digits = F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    return F.nullif(F.regexp_replace(digits, r"^0+(?=\d)", ""), F.lit(""))


def is_noindex(value) -> Column:
    """A robots value that carries ``noindex`` or ``none``, with or without a bot prefix."""

    def directive(token: Column) -> Column:
        t = F.lower(F.trim(token))
        left = F.trim(F.split_part(t, F.lit(":"), F.lit(1)))
        right = F.trim(F.regexp_replace(t, r"^[^:]*:", ""))
        return (
            F.when(~F.contains(t, F.lit(":")), t)
            .when(left.isin(*VALUED_DIRECTIVES), left)
            .when(right == "", left)
            .otherwise(right)
        )

    return F.coalesce(
        F.exists(F.split(_c(value), ","), lambda t: directive(t).isin("noindex", "none")), F.lit(False)
    )


def has_canonical_link(header) -> Column:
    """A Link header value whose own rel tokens include canonical.

    Quoted strings and ``<URI>`` parts are blanked first, so only parameters are looked at.
    """
    h = F.coalesce(_c(header), F.lit(""))
    params = F.regexp_replace(h, r"<[^>]*>", "<>")
    rels = F.regexp_extract_all(
        params, F.lit(r"""(?i)\brel\s*=\s*("[^"]*"|'[^']*'|[^\s;,"']+)"""), F.lit(1)
    )
    return F.exists(
        rels, lambda r: F.array_contains(F.split(F.lower(F.regexp_replace(r, "[\"']", "")), r"\s+"), "canonical")
    )


def is_text_html(content_type) -> Column:
    media = F.lower(F.trim(F.split_part(_c(content_type), F.lit(";"), F.lit(1))))
    return F.coalesce(media == "text/html", F.lit(False))


def is_html_200(status, content_type) -> Column:
    return F.coalesce((_c(status) == 200) & F.contains(F.lower(_c(content_type)), F.lit("html")), F.lit(False))


def event_name_ok(name) -> Column:
    return F.coalesce(_c(name).rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), F.lit(False))


def _dated_id_ok(col, pattern: str) -> Column:
    day = F.try_to_date(F.nullif(F.regexp_extract(_c(col), pattern, 1), F.lit("")), "yyyyMMdd")
    return day.isNotNull()


def content_id_ok(col) -> Column:
    return _dated_id_ok(col, CONTENT_ID_PATTERN)


def lead_id_ok(col) -> Column:
    return _dated_id_ok(col, LEAD_ID_PATTERN)


def format_family(fmt) -> Column:
    return F.split_part(_c(fmt), F.lit(" "), F.lit(1))


def slugify(title, limit: int = 40) -> Column:
    s = F.regexp_replace(F.lower(_c(title)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(s, r"^-+|-+$", ""), F.lit(limit)), r"-+$", "")


def hyphenate(text) -> Column:
    return F.translate(_c(text), "—–", "--")


def ms_date(value) -> Column:
    """``/Date(ms+hhmm)/`` to a UTC timestamp, NULL for any other text (the offset is ignored)."""
    ms = F.nullif(F.regexp_extract(_c(value), MS_DATE_PATTERN, 1), F.lit(""))
    return F.timestamp_millis(ms.cast("bigint"))


# Search modifiers per buyer stage.
STAGE_MODIFIERS = {
    "awareness": ("what is", "how to", "guide to", "introduction to"),
    "consideration": ("best", "top", "vs", "alternatives", "comparison"),
    "decision": ("pricing", "reviews", "demo", "trial", "buy"),
    "implementation": ("templates", "examples", "tutorial", "how to use", "setup"),
}


def buyer_stage(keyword) -> Column:
    """Stage of the longest modifier found as whole words (our rule for overlaps)."""
    pairs = [(m, s) for s, ms in STAGE_MODIFIERS.items() for m in ms]
    pairs.sort(key=lambda p: (-len(p[0]), p[0]))
    k = F.lower(_c(keyword))
    out = F.lit(None).cast("string")
    for modifier, stage in reversed(pairs):
        out = F.when(k.rlike(rf"(^|[^a-z0-9]){modifier}([^a-z0-9]|$)"), F.lit(stage)).otherwise(out)
    return out


# Engagement bands per platform, lower bounds of average, good and excellent.
ENGAGEMENT_BANDS = {"Instagram": (1.0, 3.0, 6.0), "LinkedIn": (2.0, 4.0, 8.0), "X": (0.5, 1.0, 3.0)}


def benchmark_band(platform, rate) -> Column:
    """below / average / good / excellent; every band is ``[low, high)``."""
    out = F.lit(None).cast("string")
    r = _c(rate)
    for name, (avg_lo, good_lo, top_lo) in ENGAGEMENT_BANDS.items():
        band = (
            F.when(r >= top_lo, "excellent").when(r >= good_lo, "good").when(r >= avg_lo, "average").otherwise("below")
        )
        out = F.when((_c(platform) == name) & r.isNotNull(), band).otherwise(out)
    return out
