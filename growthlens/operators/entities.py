"""Structured-data entities and robots verdicts (relational, per site)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, urls
from ..plans.components import components
from ..plans.groups import listed, stitched_list, unroll
from ..session import cut_lineage

LISTED_IDS = 50


def organisation_nodes(pages: DataFrame) -> DataFrame:
    """Own-organisation nodes: ``site, page_url, type, id, org_props``.

    ``pages``: site, url, json_ld. A node is foreign when a url of it lies on another host; with
    neither url nor @id it counts as ours.
    """
    n = pages.select("site", F.col("url").alias("page_url"), F.posexplode("json_ld").alias("pos", "n")).filter("n.is_org")
    n = n.select("site", "page_url", "pos", "n.type", F.nullif(F.trim("n.id"), F.lit("")).alias("id"), "n.org_props", "n.urls")

    def kind(value):
        absolute = urls.join_url("page_url", value)
        return (
            F.when(urls.url_host(absolute) == "", F.lit("none"))
            .when(urls.same_site(absolute, "site"), F.lit("ours"))
            .otherwise(F.lit("foreign"))
        )

    kinds = F.transform(F.coalesce("urls", F.array().cast("array<string>")), kind)
    no_urls = F.size(kinds) == 0
    ours = (
        F.when(no_urls & F.col("id").isNull(), True)
        .when(F.array_contains(kinds, "foreign"), False)
        .when(F.array_contains(kinds, "ours"), True)
        .otherwise(F.col("id").isNotNull() & (kind(F.col("id")) == "ours"))
    )
    return n.filter(ours).select("site", "page_url", "pos", "type", "id", "org_props")


def entity_issues(pages: DataFrame) -> DataFrame:
    """jsonld_entity_no_id, jsonld_entity_ids_differ, jsonld_org_incomplete."""
    nodes = organisation_nodes(pages)

    def out(df: DataFrame, code: str, url, detail) -> DataFrame:
        return df.select(
            "site", F.lit(code).alias("code"), F.lit(fixed.ISSUE_SEVERITY[code]).alias("severity"),
            url.alias("url"), detail.alias("detail"),
        )

    # nodes of one page: bounded by the page size
    anonymous = (
        nodes.filter("id IS NULL")
        .groupBy("site", "page_url")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("type", F.lit("Organization")).alias("t")))).alias("ts"))
    )
    no_id = out(
        anonymous, "jsonld_entity_no_id", F.col("page_url"),
        F.concat(F.lit("No @id on "), F.array_join(F.transform("ts", lambda x: x["t"]), ", ")),
    )
    named = nodes.filter("id IS NOT NULL").withColumn("entity", urls.entity_key("id", "page_url"))
    ids = named.select("site", "entity").distinct()
    counted = ids.groupBy("site").agg(F.count("*").alias("n")).filter("n > 1")
    heads = listed(ids.join(counted, "site", "left_semi"), ["site"], ["entity"], "entity", LISTED_IDS, "first_ids")
    differ = out(
        counted.join(heads, "site"), "jsonld_entity_ids_differ", F.col("site"),
        F.concat(F.lit("Distinct @id values: "), stitched_list(F.col("first_ids"), F.col("n"), LISTED_IDS)),
    )
    pages_of = named.select("site", "entity", "page_url").distinct().groupBy("site", "entity").agg(F.count("*").alias("n"))
    # most pages wins, ties by name: smallest of (-n, entity)
    winner = pages_of.groupBy("site").agg(F.min(F.struct((-F.col("n")).alias("m"), "entity"))["entity"].alias("entity"))
    props = (
        named.join(winner, ["site", "entity"])
        .groupBy("site", "entity")
        .agg(*[F.bool_or(F.array_contains("org_props", p)).alias(p) for p in fixed.ORG_REQUIRED])
    )
    lacking = F.filter(F.array(*[F.when(~F.col(p), F.lit(p)) for p in fixed.ORG_REQUIRED]), lambda x: x.isNotNull())
    incomplete = out(
        props.withColumn("lacking", lacking).filter(F.size("lacking") > 0), "jsonld_org_incomplete", F.col("site"),
        F.concat("entity", F.lit(" lacks "), F.array_join("lacking", ", ")),
    )
    return no_id.unionByName(differ).unionByName(incomplete)


def robots_rules(robots: DataFrame) -> DataFrame:
    """``site, robots_url, text`` -> ``site, robots_url, group_no, agents, kind, pattern``.

    The window runs inside one robots file, whose size is bounded by what crawlers read.
    """
    lines = robots.select("site", "robots_url", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "raw"))
    clean = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    keyed = (
        lines.withColumn("line", clean)
        .filter(F.contains("line", F.lit(":")))
        .select(
            "site",
            "robots_url",
            "line_no",
            F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("kind"),
            F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"),
        )
    )
    w = Window.partitionBy("site", "robots_url").orderBy("line_no")
    is_agent = F.col("kind") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag("kind").over(w) == "user-agent", F.lit(False))
    flagged = keyed.withColumn("starts", starts.cast("int"))
    grouped = flagged.withColumn("group_no", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.filter("group_no > 0 AND kind IN ('user-agent', 'allow', 'disallow')").select(
        "site", "robots_url", "group_no", "kind", "value"
    )


def robots_bots(robots: DataFrame, bots=fixed.BOTS) -> DataFrame:
    """``site, robots_url, bot, blocked``: is the root blocked for each watched bot."""
    rules = robots_rules(robots)
    bot = F.explode(F.array(*[F.lit(b) for b in bots])).alias("bot")
    agents = rules.filter("kind = 'user-agent'").select("site", "robots_url", "group_no", F.lower("value").alias("agent"), bot)
    fits = F.when(F.col("agent") == "*", F.lit(-1)).when(F.lower("bot").startswith(F.col("agent")), F.length("agent"))
    matched = agents.withColumn("fit", fits).filter("fit IS NOT NULL")
    best = matched.groupBy("site", "robots_url", "bot").agg(F.max("fit").alias("fit"))
    groups = matched.join(best, ["site", "robots_url", "bot", "fit"]).select("site", "robots_url", "bot", "group_no").distinct()
    # patterns that cover the path "/": wildcards and at most one slash
    root = F.col("value").rlike(r"^(\*+|\**/\**)\$?$")
    verdicts = (
        groups.join(rules.filter("kind <> 'user-agent'"), ["site", "robots_url", "group_no"])
        .filter(root)
        .groupBy("site", "robots_url", "bot")
        .agg(
            F.max(F.when(F.col("kind") == "disallow", F.length("value"))).alias("d"),
            F.max(F.when(F.col("kind") == "allow", F.length("value"))).alias("a"),
        )
    )
    asked = robots.select("site", "robots_url").distinct().select("site", "robots_url", bot)
    blocked = F.coalesce(F.col("d") > F.coalesce("a", F.lit(-1)), F.lit(False))
    return asked.join(verdicts, ["site", "robots_url", "bot"], "left").select(
        "site", "robots_url", "bot", blocked.alias("blocked")
    )


def lists_sitemap(robots: DataFrame) -> DataFrame:
    return robots.select("site", F.col("text").rlike(r"(?im)^\s*sitemap\s*:\s*[^\s#]").alias("lists_sitemap"))


#: Facts of a public record that should agree in all directories.
RECORD_FACTS = ("name", "phone", "address", "category")


def plain_name(name) -> Column:
    """A business name for comparison: lower case, letters and digits only; NULL when nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def plain_phone(phone) -> Column:
    """The last ten digits; NULL below seven, which name no line."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(10)))


def record_entities(records: DataFrame) -> DataFrame:
    """``record_id, entity_id``: public records of one business, named by the smallest record id.

    ``records``: record_id, directory, name, phone, address, category, url, same_as (array of urls). Two records
    are of one business when they share a plain name, a phone, or a url that one is at or links to as sameAs, over any
    number of steps. A shared key links its records to the smallest of them, so a key that a third of all records
    share brings one edge a record. Records without any key are businesses of their own; NULL ids take no part.
    """
    rows = records.filter("record_id IS NOT NULL")
    linked = F.transform(F.concat(F.array("url"), F.coalesce("same_as", F.array().cast("array<string>"))), urls.url_key)
    keys = F.array_distinct(F.array_compact(F.concat(
        F.array(F.concat(F.lit("n:"), plain_name(F.col("name"))), F.concat(F.lit("p:"), plain_phone(F.col("phone")))),
        F.transform(F.filter(linked, lambda u: u.isNotNull() & (u != "")), lambda u: F.concat(F.lit("u:"), u)),
    )))
    held = cut_lineage(unroll(rows, ["record_id"], keys, "k"))
    first = held.groupBy("k").agg(F.min("record_id").alias("b"))
    roots = components(held.join(first, "k").select(F.col("record_id").alias("a"), "b"))
    ids = rows.select("record_id").distinct().join(roots.withColumnRenamed("id", "record_id"), "record_id", "left")
    return ids.select("record_id", F.coalesce("root", "record_id").alias("entity_id"))


def entity_conflicts(records: DataFrame) -> DataFrame:
    """Businesses whose records disagree: ``entity_id, records, directories, names, phones, addresses, categories, conflicts``.

    Records as in ``record_entities``. Names and phones are compared in their plain form, addresses and categories in lower
    case without outer blanks; a missing fact is no conflict. ``conflicts`` lists the facts with more than one value.
    """
    plain = {"name": plain_name(F.col("name")), "phone": plain_phone(F.col("phone"))}
    plain |= {c: F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in ("address", "category")}
    facts = records.select("record_id", "directory", *[plain[c].alias(c) for c in RECORD_FACTS]).join(record_entities(records), "record_id")
    # one row per value first, so a business with very many records is counted map side
    values = F.array(F.struct(F.lit("record").alias("f"), F.col("record_id").cast("string").alias("v")),
                     *[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in ("directory", *RECORD_FACTS)])
    each = facts.select("entity_id", F.inline(values)).filter("v IS NOT NULL").distinct()
    names = {"record": "records", "directory": "directories", "name": "names", "phone": "phones", "address": "addresses", "category": "categories"}
    per = each.groupBy("entity_id").agg(*[F.count_if(F.col("f") == c).alias(n) for c, n in names.items()])
    conflicts = F.array_compact(F.array(*[F.when(F.col(names[c]) > 1, F.lit(c)) for c in RECORD_FACTS]))
    return per.withColumn("conflicts", F.array_join(conflicts, ",")).filter("conflicts <> ''")


def missing_same_as(profiles: DataFrame, same_as: DataFrame) -> DataFrame:
    """Profiles (site, url) that the site's structured data does not link to."""
    linked = same_as.select("site", urls.url_key("url").alias("k")).distinct()
    return profiles.withColumn("k", urls.url_key("url")).join(linked, ["site", "k"], "left_anti").drop("k")
