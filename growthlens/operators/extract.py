"""Page extraction: raw HTML to one wide row per page, and the link table.

Markup is cut with regular expressions inside the JVM (whole-stage code generation, no Python
per page). Only two small vectorised helpers run in Python: entity decoding of short fields
and the walk over structured-data blobs.
"""

from __future__ import annotations

import html as html_lib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..functions.text import collapse_ws
from ..plans.groups import unroll, unroll_with_pos

COMMENT = r"(?s)<!--.*?(?:-->|$)"
SCRIPT = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)"
STYLE = r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)"
SVG = r"(?is)<svg\b[^>]*>.*?(?:</svg\s*>|\z)"
TITLE = r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"
JSON_LD = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
TAG = r"""(?s)<[/!?a-zA-Z](?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
BLANK_ENTITY = r"(?i)&(?:nbsp|ensp|emsp|thinsp|#160|#xa0);"


def open_tags(body: Column, name: str) -> Column:
    pattern = rf"""(?is)<{name}(?=[\s/>])(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag: '' for a bare attribute, NULL when absent."""
    head = rf"""(?is)^<[^\s>]+(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*?\s+{name}"""
    raw = F.regexp_extract(tag, head + r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    bare = tag.rlike(head + r"""(?=[\s/>=])""")
    return F.when(raw != "", F.regexp_replace(raw, r"""^["']|["']$""", "")).when(bare, F.lit(""))


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, COMMENT, ""), SCRIPT, ""), STYLE, "")


def visible_text(html: Column) -> Column:
    """Text outside title, scripts and styles, joined without separators."""
    no_title = F.regexp_replace(visible(html), TITLE, "")
    return F.regexp_replace(F.regexp_replace(no_title, TAG, ""), BLANK_ENTITY, " ")


def word_count(html: Column) -> Column:
    return F.size(F.regexp_extract_all(visible_text(html), F.lit(r"(?U)\S+"), F.lit(0)))


def decode_entities(values: Column) -> Column:
    """Resolve character references in an array of short texts."""

    @F.pandas_udf("array<string>")
    def decode(rows: pd.Series) -> pd.Series:
        return rows.map(lambda xs: None if xs is None else [None if x is None else html_lib.unescape(x) for x in xs])

    return decode(values)


NODE = "struct<type string, id string, is_org boolean, org_props array<string>, urls array<string>>"


def json_ld_nodes(blobs: Column) -> Column:
    """Every nested object with @type or @id, in document order, and parse errors."""
    org_types, org_props = frozenset(fixed.ORG_TYPES), fixed.ORG_PROPS

    def type_names(kind):
        items = kind if isinstance(kind, list) else str("" if kind is None else kind).split(",")
        return {re.split(r"[/#:]", str(i).strip())[-1] for i in items}

    def texts(value):
        """Non-blank strings of a url-like value given as text, list or node."""
        if isinstance(value, dict):
            named = [value[k] for k in ("url", "@id") if isinstance(value.get(k), str) and value[k].strip()]
            value = named[:1]
        items = value if isinstance(value, list) else [value]
        return [i.strip() for i in items if isinstance(i, str) and i.strip()]

    def filled(value):
        if isinstance(value, str):
            return bool(value.strip())
        return len(value) > 0 if isinstance(value, (list, dict)) else value is not None

    def entity(node):
        kind, node_id = node.get("@type"), node.get("@id")
        is_org = not org_types.isdisjoint(type_names(kind))
        shown = ", ".join(map(str, kind)) if isinstance(kind, list) else kind
        return {
            "type": None if shown is None else str(shown),
            "id": node_id if isinstance(node_id, str) else None,
            "is_org": is_org,
            "org_props": [p for p in org_props if is_org and filled(node.get(p))],
            "urls": texts(node.get("url")) if is_org else [],
        }

    def nodes_of(blob):
        found, pending = [], [json.loads(blob)]
        while pending:
            node = pending.pop()
            if isinstance(node, dict):
                if "@type" in node or "@id" in node:
                    found.append(entity(node))
                node = [v for k, v in node.items() if k != "@context"]
            if isinstance(node, list):
                pending.extend(v for v in reversed(node) if isinstance(v, (dict, list)))
        return found

    @F.pandas_udf(f"struct<nodes array<{NODE}>, errors array<string>>")
    def walk(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            nodes, errors = [], []
            for blob in (b.strip() for b in ([] if row is None else row) if b and b.strip()):
                try:
                    nodes += nodes_of(blob)
                except json.JSONDecodeError as exc:
                    errors.append(f"JSON-LD parse error: {exc.msg}")
            out.append({"nodes": nodes, "errors": errors})
        return pd.DataFrame(out, columns=["nodes", "errors"])

    return walk(blobs)


def _meta(tags: Column, key: str, value: str) -> Column:
    """First matching meta content; '' when the tag has no content."""
    hit = F.try_element_at(F.filter(tags, lambda t: F.lower(attribute(t, key)) == value), F.lit(1))
    return F.when(hit.isNotNull(), F.coalesce(attribute(hit, "content"), F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Wide row per page from ``url, html`` (all other input columns are kept, html is dropped)."""
    kept = [c for c in pages.columns if c != "html"]
    cut = pages.select(
        *kept,
        F.col("html").alias("__html"),
        visible(F.col("html")).alias("__body"),
        F.regexp_extract_all(F.regexp_replace("html", COMMENT, ""), F.lit(JSON_LD), F.lit(1)).alias("__blobs"),
    )
    tagged = cut.select(
        *kept,
        "__body",
        "__blobs",
        F.regexp_extract(F.regexp_replace("__body", SVG, ""), TITLE, 1).alias("__title"),
        F.regexp_extract_all("__body", F.lit(r"(?is)<h1\b[^>]*>(.*?)(?:</h1\s*>|\z)"), F.lit(1)).alias("__h1"),
        F.size(open_tags(F.col("__body"), "h2")).alias("h2_count"),
        open_tags(F.col("__body"), "meta").alias("__metas"),
        open_tags(F.col("__body"), "link").alias("__links"),
        open_tags(F.col("__body"), "a").alias("__anchors"),
        open_tags(F.col("__body"), "base").alias("__bases"),
        F.size(F.filter(open_tags(F.col("__body"), "img"), lambda t: attribute(t, "alt").isNull())).alias(
            "images_missing_alt"
        ),
        word_count(F.col("__html")).alias("word_count"),
    )
    canon = F.filter(
        "__links",
        lambda t: F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical")
        & (F.coalesce(attribute(t, "href"), F.lit("")) != ""),
    )
    base_hrefs = F.filter(F.transform("__bases", lambda t: attribute(t, "href")), lambda h: h != "")
    m = F.col("__metas")
    short = F.array(
        F.col("__title"),
        _meta(m, "name", "description"),
        _meta(m, "name", "robots"),
        _meta(m, "name", "googlebot"),
        _meta(m, "property", "og:title"),
        _meta(m, "property", "og:image"),
        attribute(F.try_element_at(canon, F.lit(-1)), "href"),
        F.try_element_at(base_hrefs, F.lit(-1)),
    )
    hrefs = F.filter(F.transform("__anchors", lambda t: attribute(t, "href")), lambda h: h != "")
    decoded = tagged.select(
        *kept,
        "h2_count",
        "images_missing_alt",
        "word_count",
        decode_entities(short).alias("__s"),
        decode_entities(F.transform("__h1", lambda x: F.regexp_replace(x, TAG, ""))).alias("__h1"),
        decode_entities(hrefs).alias("hrefs"),
        json_ld_nodes("__blobs").alias("__ld"),
    )
    s = F.col("__s")
    base = F.when(s[7].isNotNull(), urls.join_url(F.col("url"), s[7])).otherwise(F.col("url"))
    return decoded.select(
        *kept,
        F.nullif(collapse_ws(s[0]), F.lit("")).alias("title"),
        F.nullif(collapse_ws(s[1]), F.lit("")).alias("meta_description"),
        s[2].alias("meta_robots"),
        s[3].alias("meta_googlebot"),
        s[4].alias("og_title"),
        s[5].alias("og_image"),
        F.when(s[6].isNotNull(), urls.drop_fragment(urls.join_url(base, s[6]))).alias("canonical"),
        F.transform("__h1", collapse_ws).alias("h1"),
        F.size("__h1").alias("h1_count"),
        "h2_count",
        "images_missing_alt",
        "word_count",
        base.alias("base_url"),
        "hrefs",
        F.col("__ld.nodes").alias("json_ld"),
        F.col("__ld.errors").alias("json_ld_errors"),
    )


def raw_hrefs(pages: DataFrame, keep=("url",)) -> DataFrame:
    """``keep..., pos, href`` for every anchor, straight from the markup (no Python at all)."""
    tags = open_tags(visible(F.col("html")), "a")
    hrefs = F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h != "")
    return unroll_with_pos(pages, keep, hrefs, "pos", "href")


def resolve_links(anchors: DataFrame, base: str = "url", site: str = "url") -> DataFrame:
    """Add ``dst_url, dst_key, is_internal``; anchors that lead to no page are dropped."""
    return (
        anchors.withColumn("dst_url", urls.resolve_link("href", base))
        .filter(F.col("dst_url").isNotNull())
        .withColumn("dst_key", urls.url_key("dst_url"))
        .withColumn("is_internal", urls.same_site("dst_url", site))
    )


def page_links(resolved: DataFrame, src: str = "url") -> DataFrame:
    """Internal link table: one row per (source, target key), first spelling kept."""
    internal = resolved.filter("is_internal")
    return internal.groupBy(src, "dst_key").agg(F.min_by("dst_url", "pos").alias("dst_url"))


def link_counts(resolved: DataFrame, src: str = "url") -> DataFrame:
    """Distinct internal targets and external links (duplicates counted) per page."""
    per_target = resolved.groupBy(src, "is_internal", "dst_key").agg(F.count("*").alias("n"))
    return per_target.groupBy(src).agg(
        F.count_if("is_internal").alias("internal_links"),
        F.coalesce(F.sum(F.when(~F.col("is_internal"), F.col("n"))), F.lit(0)).alias("external_link_count"),
    )


def only_in_script(pages: DataFrame, phrases: list[str], key: str = "page_id") -> DataFrame:
    """Phrases present in the raw markup but absent from the visible text (C8)."""
    text = visible_text(F.col("html"))
    hits = [
        F.when(F.contains("html", F.lit(p)) & ~F.contains("__text", F.lit(p)), F.lit(p)) for p in phrases
    ]
    found = F.filter(F.array(*hits), lambda p: p.isNotNull())
    return unroll(pages.withColumn("__text", text), [key], found, "phrase")


def unbacked_numbers(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Figures in a site's machine-readable file that no page of the site renders (C9).

    ``files``: site, text; ``pages``: site, html.
    """
    from ..functions.text import money_figures, money_key

    claimed = unroll(files, ["site"], F.array_distinct(money_figures("text")), "figure").withColumn(
        "money_key", money_key("figure")
    )
    rendered = (
        unroll(pages, ["site"], money_figures(visible_text(F.col("html"))), "f")
        .select("site", money_key("f").alias("money_key"))
        .distinct()
    )
    return claimed.join(rendered, ["site", "money_key"], "left_anti").select("site", "figure")
