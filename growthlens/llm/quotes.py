"""Quotation linking of messages: DataFrame functions only.

A message's lines fall into passages: runs of lines of one quote level, cut at blank lines. Own text is
level 0. Passages are normalised and hashed; a quoted passage belongs to the earliest message
that holds it as own text. The message answers the latest of the messages that its shallowest linked
level quotes, which gives trees of replies; own text without quotes is put in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.groups import unroll_with_pos
from ..session import cut_lineage

#: Between two passages and between level and text while a message is one string. Should a text hold them, or
#: the escape, they stand in it as the escape and a digit meanwhile.
_CUT, _LEVEL, _ESCAPE = "﷐", "﷑", "﷒"
_QUOTE = r"^((?:\s{0,3}>)+)[ ]?"
#: A line that announces the quote after it (fixed values: English, German, French, Spanish).
_ANNOUNCES = r"(?i)^.*\b(wrote|schrieb|a écrit|escribió)\s*:\s*$"


def passages(messages: DataFrame) -> DataFrame:
    """Add ``_p``, the passages of ``text`` in order as ``level || mark || text``."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), r"\s", ""))
    df = messages.withColumn("_l", F.split("text", r"\r?\n"))
    df = df.withColumn("_v", F.transform("_l", level)).withColumn("_t", F.transform("_l", lambda x: F.regexp_replace(x, _QUOTE, "")))
    blank = lambda i: F.trim(F.get("_t", i)) == ""
    told = lambda i: (F.get("_v", i) == 0) & F.get("_t", i).rlike(_ANNOUNCES) & (F.coalesce(F.get("_v", i + 1), F.lit(0)) > 0)

    def line(x: Column, i: Column) -> Column:
        fresh = (i == 0) | (F.get("_v", i - 1) != F.get("_v", i)) | blank(i - 1) | told(i - 1)
        head = F.concat(F.lit(_CUT), F.get("_v", i).cast("string"), F.lit(_LEVEL))
        return F.when(blank(i) | told(i), F.lit("")).otherwise(F.concat(F.when(fresh, head).otherwise(F.lit("\n")), x))

    joined = F.array_join(F.transform("_t", line), "")
    return df.withColumn("_p", F.filter(F.split(joined, _CUT), lambda x: x != "")).drop("_l", "_v", "_t")


def escaped(text: Column) -> Column:
    for mark, digit in ((_ESCAPE, "2"), (_CUT, "0"), (_LEVEL, "1")):
        text = F.replace(text, F.lit(mark), F.lit(_ESCAPE + digit))
    return text


def unescaped(text: Column) -> Column:
    for mark, digit in ((_CUT, "0"), (_LEVEL, "1"), (_ESCAPE, "2")):
        text = F.replace(text, F.lit(_ESCAPE + digit), F.lit(mark))
    return text


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def link_quotes(messages: DataFrame, key: str = "message_id", text: str = "text") -> DataFrame:
    """``key, reply_to, root, depth, n_quoted, n_linked, body``: one row per distinct non-NULL key.

    ``reply_to`` is the message answered (NULL for a root), ``root`` the first message of its conversation,
    ``depth`` the number of replies above it; (root, depth, key) is reply order. ``n_quoted`` counts quoted
    passages, ``n_linked`` those whose original was found; ``body`` is the own text, passages joined by
    an empty line. Rows with a NULL key are left out, as nothing can refer to them. Of several rows with
    one key the smallest text counts. NULL and empty texts quote nothing and have an empty body.
    A passage found in several messages belongs to the smallest key; only messages with a smaller
    key can be answered, so there are no rings. Keys must have an order that follows time. Any character may
    stand in a text; other columns are ignored.
    """
    src = messages.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("m")).agg(F.min(text).alias("text"))
    parts = cut_lineage(passages(src.withColumn("text", escaped(F.col("text")))).select("m", "_p"))
    one = unroll_with_pos(parts, ["m"], F.col("_p"), "pos", "p").select(
        "m", "pos", F.substring_index("p", _LEVEL, 1).cast("int").alias("level"), F.md5(normal(F.substring_index("p", _LEVEL, -1)).cast("binary")).alias("h")
    )
    originals = cut_lineage(one.filter("level = 0").groupBy("h").agg(F.min("m").alias("o")))
    quoted = one.filter("level > 0").join(originals, "h", "left").withColumn("o", F.when(F.col("o") < F.col("m"), F.col("o")))
    per = quoted.groupBy("m").agg(
        F.max(F.when(F.col("o").isNotNull(), F.struct((-F.col("level")).alias("near"), "o"))).alias("best"),
        F.count("*").alias("n_quoted"), F.count("o").alias("n_linked"),
    )
    nodes = cut_lineage(per.select("m", F.col("best.o").alias("reply_to"), "n_quoted", "n_linked"))
    places = _places(parts.select("m"), nodes.filter("reply_to IS NOT NULL").select("m", "reply_to"))
    own = F.filter("_p", lambda x: F.substring_index(x, _LEVEL, 1) == "0")
    body = F.array_join(F.transform(own, lambda x: F.substring_index(x, _LEVEL, -1)), "\n\n")
    out = parts.select("m", F.coalesce(unescaped(body), F.lit("")).alias("body")).join(nodes, "m", "left").join(places, "m", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(F.col("m").alias(key), "reply_to", F.coalesce("root", "m").alias("root"), zero("depth"), zero("n_quoted"), zero("n_linked"), "body")


def _places(all_: DataFrame, replies: DataFrame) -> DataFrame:
    """``m, root, depth`` of every answering message, by doubling the step towards the root.

    Each round halves the rest of every path, so the rounds are the binary logarithm of the
    longest chain of replies; what has arrived at its root takes no further part.
    """
    done, open_ = None, cut_lineage(replies.select("m", F.col("reply_to").alias("up"), F.lit(1).cast("bigint").alias("hops")))
    while True:
        above = open_.select(F.col("m").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        near = above if done is None else above.unionByName(done.select(F.col("m").alias("up"), F.col("root").alias("up2"), F.col("depth").alias("hops2")))
        step = cut_lineage(open_.join(near, "up", "left"))
        arrived = step.filter("up2 IS NULL").select("m", F.col("up").alias("root"), F.col("hops").alias("depth"))
        done = cut_lineage(arrived if done is None else done.unionByName(arrived))
        open_ = cut_lineage(step.filter("up2 IS NOT NULL").select("m", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops")))
        if open_.isEmpty():
            return done


def as_mail(conversations: DataFrame, depth: int = 2) -> DataFrame:
    """``message_id, text``: every turn as a mail that quotes the ``depth`` turns before it.

    The given tables hold chats; this writes them as the mails they would have been, so that
    quotes must be parsed and linked again. Turns of a conversation are matched by number.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = cut_lineage(turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text")))
    out = turns.withColumn("mail", F.col("text"))
    for back in range(1, depth + 1):
        before = turns.select("conv_id", (F.col("turn") + back).alias("turn"), F.regexp_replace("text", "(?m)^", "> " * back).alias(f"q{back}"))
        out = out.join(before, ["conv_id", "turn"], "left")
    quotes = F.concat_ws("\n", *[F.col(f"q{back}") for back in range(depth, 0, -1)])
    told = F.when(quotes != "", F.concat(F.lit("Someone wrote:\n"), quotes, F.lit("\n\n"))).otherwise(F.lit(""))
    return out.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("message_id"), F.concat(told, "mail").alias("text"))
