"""Registered queries of the training-data operators, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, jaccard, linechunks, mixing, neural, pii, quotes, toxicity, trie, warc, whitening
from .common import remainder, table

#: Public byte-level vocabulary; a path that every executor can read.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Target weights of the given sources: unequal, and 210 in all.
TARGET_WEIGHTS = {f"src{i}": 20 - i for i in range(20)}

#: A-Z to lower case and nothing else; words between 0x20 and 0x09-0x0D.
SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(quotes.as_mail(table(spark, sf_dir, "conversations")))


OP1_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id * 1000000 + turn AS m, conv_id, turn, min(coalesce(text, '')) AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
pp AS (SELECT m, conv_id, turn, list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: trim(x) <> '') AS xs FROM t),
p AS (SELECT m, conv_id, turn, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS h FROM (SELECT m, conv_id, turn, unnest(xs) AS x FROM pp)),
o AS (SELECT h, min(m) AS o FROM p GROUP BY h),
q AS (SELECT t.m, t.turn - p.turn AS lvl, p.h FROM t JOIN p ON p.conv_id = t.conv_id AND t.turn - p.turn IN (1, 2)),
l AS (SELECT q.m, lvl, CASE WHEN o.o < q.m THEN o.o END AS o FROM q LEFT JOIN o ON o.h = q.h),
b AS (SELECT m, count(*) AS n_quoted, count(o) AS n_linked, min(CASE WHEN o IS NOT NULL THEN lvl END) AS lvl FROM l GROUP BY m),
r AS (SELECT b.m, any_value(n_quoted) AS n_quoted, any_value(n_linked) AS n_linked, max(l.o) AS reply_to
      FROM b LEFT JOIN l ON l.m = b.m AND l.lvl = b.lvl GROUP BY b.m),
up(m, node, depth) AS (
  SELECT t.m, t.m, 0 FROM t UNION ALL
  SELECT up.m, r.reply_to, up.depth + 1 FROM up JOIN r ON r.m = up.node WHERE r.reply_to IS NOT NULL),
top AS (SELECT m, max(depth) AS depth, arg_max(node, depth) AS root FROM up GROUP BY m)
SELECT pp.m AS message_id, r.reply_to, top.root, CAST(top.depth AS BIGINT) AS depth, coalesce(r.n_quoted, 0) AS n_quoted,
       coalesce(r.n_linked, 0) AS n_linked, array_to_string(pp.xs, chr(10) || chr(10)) AS body
FROM pp JOIN top ON top.m = pp.m LEFT JOIN r ON r.m = pp.m
"""


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, ["doc_id"], with_ids=False)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, r) AS (
  SELECT a, b FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.r, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linechunks.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural.score(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), TARGET_WEIGHTS)


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal id, bit by bit.
SQL_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
  lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295))"""
OP11_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS p FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS b, {SQL_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT h.conv_id, o.p AS d, o.role, o.text FROM h JOIN o ON o.conv_id = h.b WHERE o.p <= h.h
  UNION ALL
  SELECT o.conv_id, o.p - h.h + least(h.h, (SELECT count(*) FROM o AS f WHERE f.conv_id = h.b)), o.role, o.text
  FROM h JOIN o ON o.conv_id = h.conv_id WHERE o.p > h.h),
k AS (
  SELECT conv_id, d, string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path,
         len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM h),
e AS (SELECT conv_id, max(d) AS d FROM k GROUP BY conv_id),
n AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, count(e_id) AS n_ends,
         string_agg(CAST(e_id AS VARCHAR), ',' ORDER BY e_id) AS ends
  FROM (SELECT k.*, e.conv_id AS e_id FROM k LEFT JOIN e ON e.conv_id = k.conv_id AND e.d = k.d) GROUP BY d, path),
up AS (SELECT c.d, c.path, min(p.conv_id) AS parent FROM k JOIN n AS c ON c.conv_id = k.conv_id AND c.d = k.d + 1 AND starts_with(c.path, k.path)
       JOIN n AS p ON p.d = k.d AND p.path = k.path GROUP BY c.d, c.path),
below AS (SELECT k.d, k.path, sum(CASE WHEN n.n_ends = n.n_convs THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
          FROM n JOIN k ON k.conv_id = n.conv_id AND k.d <= n.d GROUP BY k.d, k.path),
kids AS (SELECT k.d, k.path, count(*) AS n_children FROM n JOIN k ON k.conv_id = n.conv_id AND k.d = n.d - 1 GROUP BY k.d, k.path)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.parent AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
       CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN up ON up.d = n.d AND up.path = n.path LEFT JOIN kids ON kids.d = n.d AND kids.path = n.path
JOIN below ON below.d = n.d AND below.path = n.path
"""


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, encode(h) AS b, sha1(h) AS payload_digest FROM p),
k AS (SELECT b, max(page_id) AS kept FROM q WHERE octet_length(b) >= 1000 GROUP BY b HAVING count(*) > 1)
SELECT page_id, octet_length(q.b) AS payload_bytes, payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM q LEFT JOIN k ON k.b = q.b
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quote_linking, op2_toxicity_ftrl, op3_bpe_chunks, op4_ngram_jaccard, op5_line_chunks, op6_log_bilinear,
        op7_personal_data, op8_pfair_mixing, op9_scaled_sketch, op10_permutation_index, op11_prefix_trie, op12_warc_archive, op13_whitening,
    )
}  # fmt: skip
#: The others have no SQL twin: learned models, hashes that SQL lacks, a tokenizer, a schedule. Tests hold them
#: against brute force.
SQL: dict[str, str] = {
    "op1_quote_linking": OP1_SQL, "op4_ngram_jaccard": OP4_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc_archive": OP12_SQL,
}  # fmt: skip
