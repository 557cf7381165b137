"""Public records of businesses in several directories."""

from pyspark.sql import functions as F

from ..operators import entities
from .base import query

V = ("v_records",)
PLAIN = """WITH RECURSIVE r AS (SELECT record_id, directory, nullif(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g'), '') AS name, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone,
    lower(trim(address)) AS address, lower(trim(category)) AS category, url, same_url FROM v_records)"""
#: Keys that share a record reach each other; every key then knows the smallest record.
ENTITIES = f"""{PLAIN},
  k AS (SELECT record_id, 'n:' || name AS k FROM r WHERE name IS NOT NULL UNION ALL SELECT record_id, 'p:' || phone FROM r WHERE length(phone) >= 7 UNION ALL SELECT record_id, 'u:' || same_url FROM r WHERE same_url IS NOT NULL),
  e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM k x JOIN k y USING (record_id)),
  reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
  low AS (SELECT reach.a AS k, min(record_id) AS entity_id FROM reach JOIN k ON k.k = reach.b GROUP BY 1),
  ent AS (SELECT r.record_id, coalesce(min(entity_id), r.record_id) AS entity_id FROM r LEFT JOIN k USING (record_id) LEFT JOIN low USING (k) GROUP BY r.record_id)"""


def _records(t):
    return t.v_records.withColumn("same_as", F.array_compact(F.array("same_url")))


@query("record_entities", f"{ENTITIES} SELECT record_id, entity_id FROM ent", V)
def record_entities(t):
    return entities.record_entities(_records(t))


@query(
    "entity_conflicts",
    f"""{ENTITIES}, c AS (SELECT entity_id, count(DISTINCT record_id) AS records, count(DISTINCT directory) AS directories, count(DISTINCT name) AS names,
          count(DISTINCT CASE WHEN length(phone) >= 7 THEN phone END) AS phones, count(DISTINCT address) AS addresses, count(DISTINCT category) AS categories FROM r JOIN ent USING (record_id) GROUP BY 1)
        SELECT *, array_to_string(list_filter([CASE WHEN names > 1 THEN 'name' END, CASE WHEN phones > 1 THEN 'phone' END, CASE WHEN addresses > 1 THEN 'address' END,
          CASE WHEN categories > 1 THEN 'category' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM c WHERE names > 1 OR phones > 1 OR addresses > 1 OR categories > 1""",
    V,
)
def entity_conflicts(t):
    return entities.entity_conflicts(_records(t))


@query(
    "missing_same_as",
    """SELECT DISTINCT record_id, directory AS site, url FROM v_records r WHERE NOT EXISTS (SELECT 1 FROM v_records s WHERE s.directory = r.directory AND s.record_id % 3 = 0 AND s.url = r.url)""",
    V,
)
def missing_same_as(t):
    rows = t.v_records.withColumnRenamed("directory", "site")
    return entities.missing_same_as(rows.select("record_id", "site", "url"), rows.filter("record_id % 3 = 0").select("site", "url"))
