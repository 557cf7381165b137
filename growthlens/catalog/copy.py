"""Copy quality queries."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import copyq
from .base import half_even, query

V = ("v_copy",)
INTERNAL = " OR ".join(f"contains(low, '{w}')" for w in fixed.INTERNAL_HEADINGS)
COPY = " OR ".join(f"contains(low, '{w}')" for w in fixed.COPY_HEADINGS)
WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
LINES = f"""WITH raw AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS ls FROM v_copy),
  l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM raw), b AS (SELECT *, trim(line, {WS}) AS x, lower(trim(line, {WS})) AS low FROM l),
  fm AS (SELECT doc_id, bool_or(line_no = 1 AND x = '---') AS has_fm, min(line_no) FILTER (WHERE line_no > 1 AND x = '---') AS fm_end, bool_or(x LIKE '##%' AND ({COPY})) AS explicit FROM b GROUP BY 1),
  m AS (SELECT b.*, explicit, CASE WHEN x LIKE '#%' THEN CASE WHEN {INTERNAL} THEN 0 WHEN {COPY} THEN 1 WHEN explicit THEN 0 END END AS sw FROM b JOIN fm USING (doc_id)
    WHERE NOT has_fm OR (fm_end IS NOT NULL AND line_no > fm_end)),
  st AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CASE WHEN explicit THEN 0 ELSE 1 END) AS on_ FROM m),
  cl AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM st WHERE on_ = 1 AND NOT starts_with(x, '```') AND NOT starts_with(x, '>') AND NOT starts_with(x, '**Hashtags:**')
    AND NOT regexp_matches(x, '^#[A-Za-z0-9_]+(\\s+#[A-Za-z0-9_]+)*\\s*$') AND NOT starts_with(x, 'http://') AND NOT starts_with(x, 'https://') AND NOT (starts_with(x, '[') AND contains(x, '](http')))"""


@query("copy_lines", f"{LINES} SELECT doc_id, line_no, line FROM cl", V)
def copy_lines(t):
    return copyq.copy_lines(t.v_copy)


def _sql_pattern(name: str, pattern: str, sensitive: bool) -> str:
    quoted = pattern.replace("'", "''")
    if name == "landscape":
        return r"regexp_matches(regexp_replace(line, '(?i)landscape\s+(lighting|design|architect|contractor)', '', 'g'), '(?i)\blandscape\b')"
    return f"regexp_matches(line, '{'' if sensitive else '(?i)'}{quoted}')"


HITS = f"{LINES}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, line_no, '{n}' AS pattern FROM cl WHERE {_sql_pattern(n, p, s)}" for n, p, s in fixed.LINT_PATTERNS) + ")"


def _hits(t):
    return copyq.lint_hits(copyq.copy_lines(t.v_copy))


@query("lint_hits", f"{HITS} SELECT * FROM h", V)
def lint_hits(t):
    return _hits(t)


@query(
    "lint_summary",
    f"""{HITS} SELECT doc_id, count(pattern) AS hits, count(DISTINCT pattern) AS patterns, count(pattern) = 0 AS clean FROM v_copy LEFT JOIN h USING (doc_id) GROUP BY 1""",
    V,
)
def lint_summary(t):
    return copyq.lint_summary(t.v_copy, _hits(t))


@query("lint_totals", f"""{HITS}, s AS (SELECT doc_id, count(pattern) AS hits FROM v_copy LEFT JOIN h USING (doc_id) GROUP BY 1)
    SELECT count(*) FILTER (WHERE hits = 0) AS clean_files, count(*) FILTER (WHERE hits > 0) AS dirty_files, CAST(sum(hits) AS BIGINT) AS total_hits FROM s""", V)  # fmt: skip
def lint_totals(t):
    return copyq.lint_totals(copyq.lint_summary(t.v_copy, _hits(t)))


def _alt(words) -> str:
    return "(?i)\\b(?:" + "|".join(w.replace("'", "''") for w in sorted(words, key=lambda w: (-len(w), w))) + ")\\b"


_KINDS = {**fixed.AVOID_WORDS, "phrase": fixed.AVOID_PHRASES}
_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, '{_alt(ws)}')) AS INTEGER) AS {kind}" for kind, ws in _KINDS.items())
_SUM = "+".join(_KINDS)


@query(
    "word_rates",
    f"""WITH c AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words, {_COUNTS} FROM v_copy)
        SELECT *, {half_even(f'(({_SUM})*1000)', 'words', 2)} AS per_1000 FROM c""",
    V,
)
def word_rates(t):
    return copyq.word_rates(t.v_copy)


@query(
    "avoided_words",
    " UNION ALL ".join(f"SELECT '{k}' AS kind, word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_alt(ws)}')) AS word FROM v_copy) GROUP BY 2" for k, ws in _KINDS.items()),
    V,
)
def avoided_words(t):
    return copyq.avoided_words(t.v_copy)


@query(
    "exact_duplicates",
    """SELECT min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS n FROM documents) GROUP BY n HAVING count(*) > 1""",
)
def exact_duplicates(t):
    return copyq.exact_duplicates(t.documents)


WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+')"


def near_sql(source: str) -> str:
    """Exact pairs by a join on shingles; ``source`` has doc_id and text."""
    return f"""WITH src AS ({source}), f AS (SELECT min(doc_id) AS doc_id FROM src GROUP BY sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))))),
      w AS (SELECT doc_id, {WORDS} AS w FROM src WHERE doc_id IN (SELECT doc_id FROM f)),
      s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS g FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      k AS (SELECT a.doc_id, b.doc_id AS first_id, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND b.doc_id < a.doc_id GROUP BY 1, 2),
      j AS (SELECT k.*, x.n + y.n - k AS u FROM k JOIN n x ON x.doc_id = k.doc_id JOIN n y ON y.doc_id = k.first_id)
      SELECT doc_id, min(first_id) AS first_id, arg_min(CAST(k AS DOUBLE) / u, first_id) AS jaccard FROM j WHERE 100 * k >= 80 * u GROUP BY doc_id"""


@query("near_duplicates", near_sql("SELECT doc_id, text FROM documents"))
def near_duplicates(t):
    return copyq.near_duplicates(t.documents)


@query(
    "shared_words",
    f"""WITH w AS (SELECT doc_id, source, unnest(list_distinct({WORDS})) AS w FROM documents), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
        k AS (SELECT a.source, a.doc_id, b.doc_id AS partner_id, count(*) AS k FROM w a JOIN w b ON a.source = b.source AND a.w = b.w AND a.doc_id <> b.doc_id GROUP BY ALL),
        j AS (SELECT k.*, x.n + y.n - k AS u FROM k JOIN n x USING (doc_id) JOIN n y ON y.doc_id = partner_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(k AS DOUBLE) / u DESC, partner_id) AS no FROM j WHERE 100 * k >= 80 * u)
        SELECT source AS template, doc_id, partner_id, k AS shared_words, {half_even('k', 'u', 4)} AS shared_share FROM r WHERE no = 1""",
)
def shared_words(t):
    return copyq.shared_words(t.documents.withColumnRenamed("source", "template"), 80, "doc_id")


@query(
    "anonymised",
    """SELECT doc_id, regexp_replace(text, '(?i)\\b(remodel|owner)\\b', '[name]', 'g') AS text FROM v_copy""",
    V,
)
def anonymised(t):
    return copyq.anonymise(t.v_copy, ["remodel", "owner"])


@query(
    "unique_word_share",
    f"""WITH w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+'))) AS w FROM documents),
        a AS (SELECT source, w, count(*) AS n, min(doc_id) AS doc_id FROM w GROUP BY 1,2 HAVING count(*) = 1), o AS (SELECT doc_id, count(*) AS own FROM a GROUP BY 1),
        d AS (SELECT source AS template, doc_id, count(*) AS distinct_words FROM w GROUP BY 1,2)
        SELECT template, doc_id, distinct_words, {half_even('coalesce(own,0)', 'distinct_words', 4)} AS unique_share FROM d LEFT JOIN o USING (doc_id)""",
)
def unique_word_share(t):
    return copyq.unique_word_share(t.documents.withColumnRenamed("source", "template"), "doc_id")


QUOTED = r"""[“"]([^“”"]+)[”"]"""


def _plain(text: str) -> str:
    return f"""' ' || array_to_string(regexp_extract_all(lower(regexp_replace({text}, '[“”"‘’'']', '', 'g')), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+'), ' ') || ' '"""


@query(
    "untraced_quotes",
    f"""WITH q AS (SELECT doc_id, source_id, regexp_extract_all(text, '{QUOTED}', 1) AS qs FROM v_quoting),
        u AS (SELECT doc_id, source_id, unnest(qs) AS quote, CAST(generate_subscripts(qs, 1) - 1 AS INTEGER) AS quote_no FROM q),
        n AS (SELECT u.*, {_plain('quote')} AS plain, {_plain('d.text')} AS said FROM u JOIN documents d ON d.doc_id = u.source_id)
        SELECT doc_id, source_id, quote_no, quote FROM n WHERE trim(plain) <> '' AND NOT contains(said, plain)""",
    ("v_quoting",),
)
def untraced_quotes(t):
    return copyq.quote_traceability(t.v_quoting, t.documents.select(F.col("doc_id").alias("source_id"), "text"))
