"""Nested sitemaps over files derived from the given pages: a site is 1,000 pages."""

from pyspark.sql import functions as F

from ..sources import sitemaps
from .base import query

# pages of a leaf, leaves of a middle index; which middle indexes a root names; the others hang on the one before them
LEAF, MID = 10, 2


def _files(t):
    """Root, middle and leaf files with redirects, missing and broken ones, and a way back up."""
    p = t.pages.select("page_id", F.expr("page_id div 1000").alias("s"), F.expr(f"page_id % 1000 div {LEAF}").alias("l"))
    p = p.withColumn("m", F.expr(f"l div {MID}")).withColumn("site", F.concat(F.lit("https://s"), "s", F.lit(".example.com")))

    def listing(rows, keys, entry, order, tag):
        return rows.groupBy("site", *keys).agg(F.concat(
            F.lit(f'<?xml version="1.0"?>\n<{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, entry.alias("e")))), lambda x: x["e"]), ""), F.lit(f"</{tag}>"),
        ).alias("xml"))

    date = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<lastmod> 2026-10-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise("")
    leaf = listing(p, ["l"], F.concat(F.lit("<url><loc> /p/"), "page_id", F.lit(" </loc>"), date, F.lit("</url>")), "page_id", "urlset")
    moved = F.col("l") % 13 == 5
    leaf = leaf.select(
        "site", F.concat("site", F.lit("/leaf-"), "l", F.when(moved, "-moved").otherwise(""), F.lit(".xml")).alias("url"),
        F.when(F.col("l") % 11 == 4, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("location"),
        F.when(F.col("l") % 7 == 6, F.concat(F.lit("<urlset><url>"), F.col("xml"))).otherwise(F.col("xml")).alias("xml"), "l",
    )
    away = p.filter(moved).select("site", "l").distinct().select(
        "site", F.concat("site", F.lit("/leaf-"), "l", F.lit(".xml")).alias("url"), F.lit(301).alias("status"),
        F.concat(F.lit("/leaf-"), "l", F.lit("-moved.xml")).alias("location"), F.lit(None).cast("string").alias("xml"), "l",
    )
    leaves = leaf.unionByName(away).filter(F.col("l") % 17 != 8).drop("l")
    mids = p.select("site", "m", "l").distinct()
    named = mids.select("site", "m", F.concat(F.lit("leaf-"), "l", F.lit(".xml")).alias("to"))
    links = mids.select("site", "m").distinct()
    named = named.unionByName(links.select("site", "m", F.concat(F.lit("mid-"), F.col("m") + 1, F.lit(".xml")).alias("to")))
    named = named.unionByName(links.select("site", "m", F.lit("/root.xml").alias("to")))
    child = F.concat(F.lit("<sitemap><loc>"), "to", F.lit("</loc><lastmod>2020-01-01</lastmod></sitemap>"))
    mid = listing(named, ["m"], child, "to", "sitemapindex")
    root = listing(links.filter("m % 7 < 2").withColumn("to", F.concat(F.lit("mid-"), "m", F.lit(".xml"))), [], child, "to", "sitemapindex")
    rest = [F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), "xml"]
    files = leaves.unionByName(mid.select("site", F.concat("site", F.lit("/mid-"), "m", F.lit(".xml")).alias("url"), *rest))
    files = files.unionByName(root.select("site", F.concat("site", F.lit("/root.xml")).alias("url"), *rest))
    return files, root.select("site", F.concat("site", F.lit("/root.xml")).alias("url"))


TREE = f"""WITH RECURSIVE p AS (SELECT page_id, page_id // 1000 AS s, (page_id % 1000) // {LEAF} AS l FROM pages),
  mids AS (SELECT DISTINCT s, l // {MID} AS m FROM p),
  walk(s, m, d) AS (SELECT s, m, 1 FROM mids WHERE m % 7 < 2 UNION SELECT w.s, w.m + 1, w.d + 1 FROM walk w JOIN mids USING (s, m) WHERE w.d < 5),
  near AS (SELECT s, m, min(d) AS d FROM walk GROUP BY s, m),
  leaf AS (SELECT s, l, near.d + 1 AS d FROM (SELECT DISTINCT s, l, l // {MID} AS m FROM p) JOIN near USING (s, m) WHERE near.d < 5),
  site AS (SELECT DISTINCT s, 'https://s' || s || '.example.com' AS site FROM p)"""


@query(
    "sitemap_tree",
    f"""{TREE} SELECT site, site || '/leaf-' || l || CASE WHEN l % 13 = 5 THEN '-moved' ELSE '' END || '.xml' AS sitemap, CAST(leaf.d AS INTEGER) AS depth,
          row_number() OVER (PARTITION BY s, l ORDER BY page_id) - 1 AS pos, site || '/p/' || page_id AS loc,
          CASE WHEN page_id % 3 = 0 THEN '2026-10-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod
        FROM p JOIN leaf USING (s, l) JOIN site USING (s) WHERE l % 11 <> 4 AND l % 7 <> 6 AND l % 17 <> 8""",
)
def sitemap_tree(t):
    return sitemaps.follow_sitemaps(*_files(t))[0]


@query(
    "sitemap_problems",
    f"""{TREE} SELECT site, site || '/mid-' || m || '.xml' AS sitemap, CAST(near.d AS INTEGER) AS depth, 'missing' AS problem
          FROM near JOIN site USING (s) WHERE NOT EXISTS (SELECT 1 FROM mids WHERE mids.s = near.s AND mids.m = near.m)
        UNION ALL SELECT site, site || '/leaf-' || l || CASE WHEN l % 13 = 5 AND l % 17 <> 8 THEN '-moved' ELSE '' END || '.xml', CAST(leaf.d AS INTEGER),
          CASE WHEN l % 17 = 8 THEN 'missing' WHEN l % 11 = 4 THEN 'bad status' ELSE 'bad xml' END
          FROM leaf JOIN site USING (s) WHERE l % 17 = 8 OR l % 11 = 4 OR l % 7 = 6""",
)
def sitemap_problems(t):
    return sitemaps.follow_sitemaps(*_files(t))[1]
