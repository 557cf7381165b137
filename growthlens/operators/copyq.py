"""Copy corpus quality: checked lines, lint hits, word rates, quotes, duplicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import ratio
from ..functions.text import collapse_ws
from ..functions.urls import strip_blanks
from ..plans import setjoin
from ..plans.groups import first_n, unroll, unroll_with_pos
from ..session import cut_lineage

# Lines that are never copy.
SKIPPED = r"^\s*(?:```|>|\*\*Hashtags:\*\*|https?://)"
HASHTAGS = r"^\s*#[A-Za-z0-9_]+(?:\s+#[A-Za-z0-9_]+)*\s*$"


def _any_of(line: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(line, F.lit(w))
    return hit


def copy_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, line_no, line`` of every line that counts as copy.

    Front matter, fences, quotes, hashtag and link lines are out; headings switch sections on
    and off. All of it happens inside the row: headings cut the line array into stretches, and
    only stretches that are on are exploded. Nothing is shuffled, a text is never cut short.
    """
    text = F.regexp_replace("text", r"(\r\n|\r|\n)$", "")
    d = docs.select(key, F.split(text, r"\r\n|\r|\n").alias("lines"))
    d = d.withColumn("n", F.size("lines")).withColumn("bare", F.transform("lines", strip_blanks))
    closing = F.array_position(F.slice(F.col("bare"), F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), "---")
    start = F.when(F.col("bare")[0] != "---", 0).when(closing == 0, F.col("n")).otherwise(closing.cast("int") + 1)
    explicit = F.exists("bare", lambda x: x.startswith("##") & _any_of(F.lower(x), fixed.COPY_HEADINGS))
    d = d.withColumn("start", start).withColumn("explicit", explicit)

    def switch(x: Column, i: Column) -> Column:
        low = F.lower(x)
        state = (
            F.when(_any_of(low, fixed.INTERNAL_HEADINGS), False)
            .when(_any_of(low, fixed.COPY_HEADINGS), True)
            .when(F.col("explicit"), False)
        )
        return F.when(x.startswith("#") & (i >= F.col("start")), F.struct(i.alias("at"), state.alias("on")))

    marks = F.filter(F.transform("bare", switch), lambda m: m["on"].isNotNull())
    first = F.array(F.struct(F.col("start").alias("at"), (~F.col("explicit")).alias("on")))
    d = d.withColumn("marks", F.concat(first, marks))
    spans = F.transform(
        "marks",
        lambda m, k: F.struct(m["at"].alias("a"), F.coalesce(F.get("marks", k + 1)["at"], F.col("n")).alias("b"), m["on"].alias("on")),
    )
    on = unroll(d, [key, "lines"], F.filter(spans, lambda s: s["on"] & (s["b"] > s["a"])), "s")
    stretch = F.slice("lines", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    rows = unroll_with_pos(on, [key, "s.a"], stretch, "p", "line")
    # one anchored pattern per rule; a trimmed copy of the line would be rebuilt for every test
    skipped = F.col("line").rlike(SKIPPED) | F.col("line").rlike(HASHTAGS) | (
        F.col("line").rlike(r"^\s*\[") & F.contains("line", F.lit("](http"))
    )
    return rows.filter(~skipped).select(key, (F.col("a") + F.col("p") + 1).alias("line_no"), "line")


def _java(pattern: str, sensitive: bool) -> str:
    return ("(?U)" if sensitive else "(?iuU)") + pattern


def lint_hits(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per line and pattern it hits.

    The patterns are literals in one projection, each compiled once; there is no join with a
    pattern table. A cheap scan for the words' stems skips most lines first.
    """
    hits = F.filter(
        F.array(*[F.when(F.col("line").rlike(_java(p, cs)), F.lit(name)) for name, p, cs in fixed.LINT_PATTERNS]),
        lambda h: h.isNotNull(),
    )
    # the generator output is a real column: a plain alias would be inlined into all 38 searches
    low = unroll(lines, [key, "line_no", "line"], F.array(F.lower("line")), "low")
    likely = _any_of(F.col("low"), STEMS) | (F.contains("low", F.lit('"')) & F.col("low").rlike(LOOSE_TAG))
    return unroll(low.filter(likely), [key, "line_no"], hits, "pattern")


# Every lint pattern needs one of these texts in the lower-cased line (plain byte search).
STEMS = (
    "—", ': "', ':"', ":\t\"", "this month:", "here is ", "that's the whole", "whether", "not only", "underscor",
    "highlighting", "ensuring", "reflecting", "symbolizing", "foster", "how much?", "planning a", "delv", "testament",
    "pivotal", "crucial", "vital", "robust", "seamless", "landscape", "tapestry", "holistic", "bolster", "moreover",
    "plethora", "furthermore", "myriad", "paramount", "transformative", "groundbreaking", "cutting-edge",
    "comprehensive", "navigating",
)
# White space other than one blank may stand between the colon and the quote of a dialogue tag.
LOOSE_TAG = r':\s+"'


def lint_summary(docs: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits per document; clean documents stay in with 0."""
    per = hits.groupBy(key).agg(F.count("*").alias("hits"), F.countDistinct("pattern").alias("patterns"))
    j = docs.select(key).join(per, key, "left")
    n = F.coalesce("hits", F.lit(0))
    return j.select(key, n.alias("hits"), F.coalesce("patterns", F.lit(0)).alias("patterns"), (n == 0).alias("clean"))


def lint_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if("clean").alias("clean_files"), F.count_if(~F.col("clean")).alias("dirty_files"), F.sum("hits").alias("total_hits")
    )


def _words_pattern(words) -> str:
    return r"(?U)\b(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")\b"


def word_rates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Avoid-list words and phrases per document and per 1,000 words, by kind. Row-local."""
    low = docs.select(key, F.lower(F.col("text")).alias("low"))
    kinds = {**fixed.AVOID_WORDS, "phrase": fixed.AVOID_PHRASES}
    words = F.size(F.regexp_extract_all("low", F.lit(r"(?U)\S+"), F.lit(0)))
    count = lambda ws: F.regexp_count("low", F.lit(_words_pattern(ws)))
    c = low.select(key, words.alias("words"), *[count(ws).alias(kind) for kind, ws in kinds.items()])
    total = F.lit(0)
    for kind in kinds:
        total = total + F.col(kind)
    return c.withColumn("per_1000", ratio(total * 1000, F.col("words"), 2))


def avoided_words(docs: DataFrame) -> DataFrame:
    """Corpus counts per avoided word: only matches are exploded, never all tokens."""
    def tagged(found: Column, kind: str) -> Column:
        return F.transform(found, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))

    out = None
    for kind, ws in {**fixed.AVOID_WORDS, "phrase": fixed.AVOID_PHRASES}.items():
        found = F.regexp_extract_all(F.lower(F.col("text")), F.lit(_words_pattern(ws)), F.lit(0))
        part = tagged(found, kind)
        out = part if out is None else F.concat(out, part)
    return unroll(docs, [], out, "w").groupBy("w.kind", "w.word").agg(F.count("*").alias("n"))


PARALLEL = r"(?iU)\b(?:not|isn't|aren't|wasn't)\b[^.!?\n]{1,80}?(?:,|;|\.|—)\s*(?:it's|it is|they're|but)\b"


def parallelism_count(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """"Not X, it's Y" turns per caption; more than one breaks the rule."""
    n = F.regexp_count("text", F.lit(PARALLEL))
    return docs.select(key, n.alias("n"), (n <= 1).alias("ok"))


#: Quotes of one source that meet a transcript under one key; the quotes of a source that has more are dealt out.
QUOTE_GROUP = 1000


def _plain_words(text) -> Column:
    bare = F.regexp_replace(text, "[“”\"‘’']", "")
    return F.coalesce(F.regexp_extract_all(F.lower(bare), F.lit(r"(?U)\w+"), F.lit(0)), F.array().cast("array<string>"))


def _in_a_row(words) -> Column:
    """The words as one string with a blank before and after each."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def quote_traceability(copies: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Quotes of a copy whose words do not stand in a row in its source transcript: ``doc_id, source_id, quote_no, quote``.

    ``copies``: doc_id, source_id, text; ``transcripts``: source_id, text (any number of texts of one source). Case,
    punctuation and quote marks do not count. A quote of any length is traced, but for one without words.

    A transcript is moved once, as one row, to the quotes of its source, and once more for every further ``QUOTE_GROUP`` of
    them, so neither words nor quotes multiply in the shuffle and a source that everybody quotes is many tasks.
    NULL sources have no transcript.
    """
    found = unroll_with_pos(copies, ["doc_id", "source_id"], F.regexp_extract_all("text", F.lit('[“"]([^“”"]+)[”"]'), F.lit(1)), "quote_no", "quote")
    worded = found.withColumn("w", _plain_words(F.col("quote"))).filter("size(w) > 0").withColumn("plain", _in_a_row("w")).drop("w")
    quotes = cut_lineage(worded.withColumn("q", F.monotonically_increasing_id()))
    asked = quotes.filter("source_id IS NOT NULL").select("q", "source_id", "plain")
    groups = F.ceil(F.count("*") / QUOTE_GROUP).cast("int").alias("groups")
    often = cut_lineage(asked.groupBy("source_id").agg(groups).filter("groups > 1"))
    dealt = asked.join(often, "source_id", "left").withColumn("part", F.pmod(F.xxhash64("q"), F.coalesce("groups", F.lit(1))).cast("int"))
    said = transcripts.filter("source_id IS NOT NULL").select("source_id", _in_a_row(_plain_words(F.col("text"))).alias("said"))
    parts = F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)
    said = said.join(often, "source_id", "left").select("source_id", "said", F.explode(parts).alias("part"))
    traced = dealt.join(said, ["source_id", "part"]).filter(F.contains("said", F.col("plain"))).select("q").distinct()
    return quotes.join(traced, "q", "left_anti").select("doc_id", "source_id", "quote_no", "quote")


def anonymise(docs: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """Names become ``[name]``; amounts keep two digits and lose their cents."""
    text = F.col("text")
    if names:
        text = F.regexp_replace(text, r"(?iU)\b(?:" + "|".join(_quote(n) for n in names) + r")\b", "[name]")
    text = F.regexp_replace(text, r"(?<=\$[0-9,]{1,15})\.[0-9]+", "")
    return docs.select(key, F.regexp_replace(text, r"(?<=\$[0-9][0-9,]{1,14})[0-9]", "0").alias("text"))


def _quote(name: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|-])", r"\\\1", name)


def normalised(text) -> Column:
    return F.lower(collapse_ws(text))


def exact_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Groups of equal normalised texts: first document and number of copies.

    Only hashes are shuffled, and they are combined map side.
    """
    h = docs.select(key, F.sha2(normalised("text"), 256).alias("h"))
    return h.groupBy("h").agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("h")


BINS = 16


def shingle_sets(docs: DataFrame, key: str = "doc_id", width: int = 5) -> DataFrame:
    """``key, s``: distinct hashes of the ``width``-word shingles of each whole text.

    A text of fewer words is one shingle; a text without words, or none, has no shingles. The word array is a column of
    its own: inside the lambda it is looked up, not rebuilt.
    """
    words = docs.select(key, F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?U)\w+"), F.lit(0)).alias("w"))
    last = F.greatest(F.size("w") - width, F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(width)]))
    none = F.array().cast("array<bigint>")
    return words.select(key, F.when(F.size("w") > 0, F.array_distinct(grams)).otherwise(none).alias("s"))


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """``key, first_id, jaccard``: documents close to an earlier one, with the earliest that is as close.

    Exact Jaccard over all shingles, and no pair is lost: see ``plans.setjoin``. Of equal texts only the first document takes
    part (``exact_duplicates`` lists the others), and of repeated ids the smallest text. NULL ids take no part.
    """
    hashes = docs.filter(F.col(key).isNotNull()).select(key, F.sha2(normalised("text"), 256).alias("h"))
    firsts = hashes.groupBy("h").agg(F.min(key).alias(key)).select(key).distinct()
    one = docs.join(firsts, key, "left_semi").groupBy(key).agg(F.min("text").alias("text"))
    found = setjoin.first_similar(shingle_sets(one, key).withColumnRenamed(key, "id"), percent)
    jaccard = F.try_divide(F.col("both").cast("double"), F.col("either").cast("double"))
    return found.select(F.col("id").alias(key), F.col("other").alias("first_id"), jaccard.alias("jaccard"))


def shared_words(pages: DataFrame, percent: int = 80, key: str = "page_id", group: str = "template") -> DataFrame:
    """``group, key, partner_id, shared_words, shared_share``: per page the page of its template that shares most of the words of both.

    Shares are of the distinct words of the two pages together, and pages without a partner that shares ``percent`` of
    them are left out; equal shares go to the smaller id. Words of different templates never meet. NULL keys take
    no part; of repeated keys the smallest text counts.
    """
    one = pages.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(group).alias("g"), F.col("text").alias("t"))).alias("p")).select(key, "p.g", "p.t")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("t")), F.lit(r"(?U)\w+"), F.lit(0)))
    named = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(F.col("g"), w))
    sets = cut_lineage(one.select(F.col(key).alias("id"), "g", F.array_distinct(named).alias("s")))
    found = setjoin.best_similar(sets.select("id", "s"), percent)
    found = found.select(F.col("id").alias(key), F.col("other").alias("partner_id"), F.col("both").alias("shared_words"), ratio("both", "either", 4).alias("shared_share"))
    return sets.select(F.col("g").alias(group), F.col("id").alias(key)).join(found, key).select(group, key, "partner_id", "shared_words", "shared_share")


def unique_word_share(pages: DataFrame, key: str = "page_id", group: str = "template") -> DataFrame:
    """Distinct words per page, and the share of them no other page of its template uses.

    Words are counted per template with map-side combination; a word that a third of the pages
    share is one row, and only the words of exactly one page are joined back.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?U)\w+"), F.lit(0)))
    exploded = unroll(pages, [group, key], words, "w")
    alone = exploded.groupBy(group, "w").agg(F.count("*").alias("n"), F.min(key).alias(key)).filter("n = 1")
    own = alone.groupBy(group, key).agg(F.count("*").alias("own"))
    return (
        pages.select(group, key, F.size(words).cast("bigint").alias("distinct_words"))
        .join(own, [group, key], "left")
        .select(group, key, "distinct_words", ratio(F.coalesce("own", F.lit(0)), F.col("distinct_words"), 4).alias("unique_share"))
    )


def sample_hits(hits: DataFrame, per_pattern: int = 3, key: str = "doc_id") -> DataFrame:
    """The first hits per pattern for a report (a report limit)."""
    return first_n(hits, ["pattern"], [key, "line_no"], per_pattern)
