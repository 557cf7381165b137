"""Line dedup: DataFrame functions only.

``remove_repeated_passages`` moves a rolling hash over the hashes of every two neighbouring lines, so a passage of two lines or
more is found whole, whatever stands around it. Where a passage begins and ends hangs on its content alone: as far as the
hashes agree with one earlier place. Passages are compared with that place byte by byte; the first occurrence stays, the others go.

``remove_repeated_chunks`` is the coarser form: a rolling hash over the hashes of neighbouring lines
decides where a chunk of lines ends. Chunks of several lines that occur more than once anywhere are compared
byte by byte. The edges of a shared passage, and most passages of a few lines, stay with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.groups import unroll, unroll_with_pos
from ..session import cut_lineage

#: Lines under the rolling hash, its modulus (mean lines of a chunk), least lines and least words
#: of a chunk that may go.
WINDOW, MODULUS, LEAST_LINES, LEAST_WORDS = 2, 3, 2, 5
#: Marks the start of a chunk while a text is one string; it is no text character.
_MARK = "﷐"


def chunked(docs: DataFrame, window: int = WINDOW, modulus: int = MODULUS) -> DataFrame:
    """Add ``_chunks``: the text's chunks, whose concatenation with newlines is the text.

    Texts are cut at ``\\n``. A chunk ends after line i when the rolling hash over lines i-window+1..i
    is 0 modulo ``modulus`` and the one before is not, so only a one-line text is a chunk of one line. A NULL
    text has no chunks.
    """
    lines = docs.withColumn("_l", F.split("text", "\n")).withColumn("_h", F.transform("_l", lambda x: F.xxhash64(x)))

    def ends(i: Column) -> Column:
        rolled = F.lit(0).cast("bigint")
        for back in range(window):
            # products stay far below 2**63: each hash counts modulo 2**30
            term = F.coalesce(F.pmod(F.get("_h", i - back), F.lit(1 << 30)), F.lit(0)) * F.lit(31**back)
            rolled = rolled + term
        return F.pmod(F.xxhash64(rolled), F.lit(modulus)) == 0

    marked = F.transform("_l", lambda x, i: F.when((i > 1) & (i < F.size("_l") - 1) & ends(i - 1) & ~ends(i - 2), F.concat(F.lit(_MARK), x)).otherwise(x))
    cut = F.split(F.array_join(marked, "\n"), "\n" + _MARK)
    # a text that holds the mark itself stays in one piece
    return lines.withColumn("_chunks", F.when(F.contains("text", F.lit(_MARK)), F.array("text")).otherwise(cut)).drop("_l", "_h")


def remove_repeated_chunks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, modulus: int = MODULUS,
    least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``docs`` with ``text`` freed of repeated chunks, plus ``n_lines``, ``n_removed`` (lines).

    A chunk counts as repeated when an equal one of at least ``least_lines`` lines and ``least_words``
    words stands elsewhere; the one of the smallest (key, position) stays. Rows keep all other columns.
    Repeated rows (equal key and text) count once and are treated alike. NULL texts stay NULL with 0
    lines; a text that goes entirely becomes empty; rows with a NULL key keep their text but
    count as no occurrence. Only hashes are shuffled for the count; the texts of chunks that occur
    twice are compared, and one more shuffle brings the lists of removed chunks to their texts. Both joins
    are asked to shuffle, so the plan is one and the same at every size.
    """
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    parts = unroll_with_pos(
        chunked(src.filter("k IS NOT NULL"), window, modulus).withColumn("th", F.xxhash64("text")), ["k", "th"], F.col("_chunks"), "pos", "c"
    )
    parts = parts.filter(
        (F.length("c") - F.length(F.replace("c", F.lit("\n"))) >= least_lines - 1) & (F.size(F.split(F.trim("c"), r"\s+")) >= least_words)
    ).withColumn("h", F.xxhash64("c"))
    # hashes that occur at two places, counted with map-side combination
    place = F.struct("k", "th", "pos")
    seen = parts.select("h", place.alias("p")).groupBy("h").agg(F.min("p").alias("p0"), F.max("p").alias("p1"))
    twice = cut_lineage(seen.filter("p0 <> p1").select("h"))
    again = cut_lineage(parts.join(twice.hint("merge"), "h", "left_semi").select("h", "k", "th", "pos", "c"))
    # equal bytes, not only equal hashes; one row per chunk
    first = cut_lineage(again.groupBy("h", "c").agg(F.min(place).alias("first")))
    gone = again.join(first, ["h", "c"]).filter(place != F.col("first"))
    lists = cut_lineage(gone.select("k", "th", "pos").distinct().groupBy("k", "th").agg(F.collect_list("pos").alias("_gone")))
    rows = docs.withColumn("_k", F.col(key)).withColumn("_th", F.xxhash64(F.col(text))).join(
        lists.select(F.col("k").alias("_k"), F.col("th").alias("_th"), "_gone").hint("merge"), ["_k", "_th"], "left"
    )
    cut = chunked(rows.withColumn("_orig", F.col(text)).withColumn("text", F.when(F.col("_gone").isNotNull(), F.col(text))), window, modulus)
    kept = F.filter("_chunks", lambda c, i: ~F.array_contains("_gone", i))
    clean = F.when(F.col("_gone").isNull(), F.col("_orig")).otherwise(F.array_join(kept, "\n"))
    count = lambda c: F.coalesce(F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1, F.lit(0))
    cut = cut.withColumn("_clean", clean).withColumn("_all", F.size(F.coalesce("_chunks", F.array())))
    cut = cut.withColumn("n_lines", count(F.col("_orig")).cast("bigint"))
    left = F.when(F.col("_gone").isNotNull() & (F.size("_gone") == F.col("_all")), F.lit(0)).otherwise(count(F.col("_clean")))
    cut = cut.withColumn("n_removed", (F.col("n_lines") - left).cast("bigint"))
    fields = [F.col("_clean").alias(c) if c == text else F.col(c) for c in docs.columns]
    return cut.select(*fields, "n_lines", "n_removed")


def line_pairs(docs: DataFrame) -> DataFrame:
    """``k, th, pos, d, w0, w1``: rolling hash and words of lines ``pos`` and ``pos + 1`` (from 0) of every text.

    The rolling hash runs over the hashes of the lines: moving on by a line takes the next line's hash in and lets the oldest one go.
    """
    lines = docs.withColumn("th", F.xxhash64("text")).withColumn("_l", F.split("text", "\n"))
    each = lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"\S+")).alias("w"))
    lines = lines.withColumn("_h", F.transform("_l", each))
    pair = lambda x, i: F.struct(
        F.xxhash64(x["h"], F.get("_h", i + 1)["h"]).alias("d"), x["w"].alias("w0"), F.get("_h", i + 1)["w"].alias("w1")
    )
    items = F.transform(F.slice("_h", F.lit(1), F.size("_h") - 1), pair)
    return unroll_with_pos(lines.filter("text IS NOT NULL"), ["k", "th"], items, "pos", "p").select("k", "th", "pos", "p.*")


def repeated_runs(pairs: DataFrame) -> DataFrame:
    """Candidates: runs of lines of which every two neighbours stand, in the same order, at one and the same earlier place.

    ``k, th, _a`` (first line), ``n`` (lines after it), ``_at`` (lines that may go), ``_words`` and ``_lines`` (what the run
    has for itself), ``k0, th0, p``: the earlier place. A run ends where the next two lines have their first occurrence
    elsewhere. Runs do not overlap: the line on which two meet belongs to the first of them. Lines of the first occurrence of
    two lines that occur again are never among ``_at``.
    """
    place = F.struct("k", "th", "pos")
    # places per hash, counted with map-side combination
    seen = pairs.select("d", place.alias("p")).groupBy("d").agg(F.min("p").alias("p0"), F.max("p").alias("p1"))
    twice = cut_lineage(seen.filter("p0 <> p1").select("d", "p0"))
    again = pairs.join(twice.hint("merge"), "d").select("k", "th", "pos", "w0", "w1", "p0", (place == F.col("p0")).alias("first")).distinct()
    # all that follows works within one text
    own = Window.partitionBy("k", "th").orderBy("pos")
    near = lambda f, off: F.coalesce((f("pos").over(own) == F.col("pos") + off) & f("first").over(own), F.lit(False))
    again = again.withColumn("_stays0", near(F.lag, -1)).withColumn("_stays1", near(F.lead, 1)).filter("NOT first")
    again = again.withColumn("_from", F.struct("p0.k", "p0.th", (F.col("p0.pos") - F.col("pos")).alias("off")))
    meets = F.coalesce(F.lag("pos").over(own) == F.col("pos") - 1, F.lit(False))
    goes_on = meets & F.coalesce(F.lag("_from").over(own) == F.col("_from"), F.lit(False))
    again = again.withColumn("_meets", meets).withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(own))
    none = F.array().cast("array<int>")
    given = F.col("_stays0") | (F.col("_meets") & (F.col("_new") == 1))
    at = F.concat(F.when(given, none).otherwise(F.array("pos")), F.when(F.col("_stays1"), none).otherwise(F.array(F.col("pos") + 1)))
    head = F.struct("_meets", "w0", "p0")
    runs = again.withColumn("_at", at).groupBy("k", "th", "_run").agg(
        F.min("pos").alias("_a"), F.count("*").cast("int").alias("n"), F.min_by(head, "pos").alias("_head"),
        (F.sum("w0") + F.max_by("w1", "pos")).alias("_all"), F.flatten(F.collect_list("_at")).alias("_at"),
    )
    met = F.col("_head._meets")
    return runs.select(
        "k", "th", "_a", "n", F.array_distinct("_at").alias("_at"),
        (F.col("_all") - F.when(met, F.col("_head.w0")).otherwise(0)).alias("_words"), (F.col("n") + 1 - met.cast("int")).alias("_lines"),
        F.col("_head.p0.k").alias("k0"), F.col("_head.p0.th").alias("th0"), F.col("_head.p0.pos").alias("p"),
    )


def whole_copies(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Candidates as of ``repeated_runs``: texts of two lines or more that stand as a whole under a smaller key. ``texts``: k, text.

    Texts of fewer than ``least_words`` words are left out; of the others ``_words`` tells no more than that they have as many.
    """
    # possessive, so a text is read once, and no further than to the last word asked for
    enough = F.col("text").rlike(rf"^\s*+(?:\S++\s++){{{least_words - 1}}}\S") if least_words > 0 else F.lit(True)
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n")))
    each = texts.filter(F.contains("text", F.lit("\n")) & enough).select("k", F.xxhash64("text").alias("th"), n.alias("n"))
    each = cut_lineage(each.distinct())
    # the smallest key of each text, with map-side combination
    first = each.groupBy("th").agg(F.min("k").alias("k0"), F.max("k").alias("k1")).filter("k0 <> k1").select("th", "k0")
    # nothing above the join asks for the copies of one text together, so a large group of them can be split
    copies = cut_lineage(each.join(cut_lineage(first).hint("merge"), "th").filter("k <> k0"))
    return copies.select(
        "k", "th", F.lit(0).alias("_a"), "n", F.sequence(F.lit(0), F.col("n")).alias("_at"), F.lit(least_words).alias("_words"),
        (F.col("n") + 1).alias("_lines"), "k0", F.col("th").alias("th0"), F.lit(0).alias("p"),
    )


def equal_bytes(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``runs`` whose lines are, byte by byte, those of their earlier place. ``texts``: k, text.

    Runs with one earlier place and length are one group, and that place is in it too; a group with one text only is equal.
    A group with several, which is a collision of hashes, stays as it is. Equal texts meet in the map task already, and the runs
    are not dealt out by their earlier place, of which a third of all runs may have the same.
    """
    group = ["k0", "th0", "p", "n"]
    asked = runs.select("k", "th", F.struct(F.col("_a").alias("a"), *group).alias("g"))
    there = runs.select(*group).distinct().select(F.col("k0").alias("k"), F.col("th0").alias("th"), F.struct(F.col("p").alias("a"), *group).alias("g"))
    # the runs of one text, and the places in it that others refer to
    asked = cut_lineage(asked.unionByName(there).distinct().groupBy("k", "th").agg(F.collect_list("g").alias("_g")))
    rows = texts.withColumn("th", F.xxhash64("text")).join(asked.hint("merge"), ["k", "th"])
    each = unroll(rows.select(F.split("text", "\n").alias("_l"), "_g"), ["_l"], F.col("_g"), "g")
    parts = each.select("g.*", F.array_join(F.slice("_l", F.col("g.a") + 1, F.col("g.n") + 1), "\n").alias("c"))
    odd = cut_lineage(parts.select(*group, "c").distinct().groupBy(*group).agg(F.count("*").alias("texts")).filter("texts > 1").select(*group))
    return runs.join(odd, group, "left_anti")


def remove_repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, whole: bool = False
) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, plus ``n_lines``, ``n_removed`` (lines).

    Texts are cut at ``\\n``. A passage is a run of two lines or more, ``least_words`` words in all, that stands as a whole at one
    smaller (key, position): rolling hashes of neighbouring lines find it (``repeated_runs``), its bytes are compared
    with those of that place (``equal_bytes``). Its lines go; but the first occurrence of two lines that occur again stays
    whole, so whatever goes is still there to read. With ``whole``, a text that stands as a whole under a smaller key is one passage too,
    wherever its pairs of lines stand first. Rows keep all other columns, but for ``n_lines`` and ``n_removed``, which give
    way to these. Repeated rows (equal key and text) count once and are treated alike. NULL texts stay NULL with 0 lines; a
    text that goes entirely becomes empty; rows with a NULL key keep their text but count as no occurrence. Hashes are shuffled for
    the count, texts once for the comparison and once for the lists of removed lines. The joins with
    texts are asked to shuffle, so the plan is one and the same at every size.
    """
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).filter("k IS NOT NULL")
    found = repeated_runs(line_pairs(texts))
    found = found.unionByName(whole_copies(texts, least_words)) if whole else found
    runs = cut_lineage(found.filter((F.col("_words") >= least_words) & (F.col("_lines") >= 2) & (F.size("_at") > 0)))
    lists = equal_bytes(runs, texts).groupBy("k", "th").agg(F.flatten(F.collect_list("_at")).alias("_at"))
    lists = cut_lineage(lists.select("k", "th", F.array_sort(F.array_distinct("_at")).alias("_gone")))
    # a document's columns travel as one, so that no name of theirs meets a working column
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(others.alias("_doc"), F.col(key).alias("_k"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_th")).join(
        lists.select(F.col("k").alias("_k"), F.col("th").alias("_th"), "_gone").hint("merge"), ["_k", "_th"], "left"
    )
    # the stretches between removed lines, so the work grows with the lines of a text and not with their square
    cut = rows.withColumn("_l", F.when(F.col("_gone").isNotNull(), F.split("_text", "\n")))
    cut = cut.withColumn("_edge", F.concat(F.array(F.lit(-1)), "_gone", F.array(F.size("_l"))))
    stretch = lambda e, j: F.slice("_l", e + 2, F.get("_edge", j + 1) - e - 1)
    cut = cut.withColumn("_kept", F.flatten(F.transform(F.slice("_edge", F.lit(1), F.size("_edge") - 1), stretch)))
    cut = cut.withColumn("_clean", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")))
    count = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"))) + 1
    cut = cut.withColumn("n_lines", F.coalesce(count, F.lit(0)).cast("bigint"))
    cut = cut.withColumn("n_removed", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("bigint"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    fields = [F.col("_clean").alias(c) if c == text else F.col("_doc").getField(c).alias(c) for c in own]
    return cut.select(*fields, "n_lines", "n_removed")
