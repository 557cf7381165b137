"""Exact set-similarity joins by Jaccard without lists of all pairs.

Elements are ordered from rare to frequent, by the counts of hash groups; two sets as similar as asked share an element among the first ``n - ceil(t n) + 1`` of
both, so only those are posted. Sets under one element are numbered by id, in ranges of the data, and met in rounds: in round
r every set that is still open meets the sets numbered 2^r to 2^(r+1) - 1. A set that has found its partner meets nobody who could not
be a better one, so n copies of one text cost n comparisons. Sizes and positions bound the overlap before sets are moved.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import ranges

#: Hash groups of the frequency table: one byte each, so what is broadcast has a fixed size.
HEAT_BITS = 22
#: Hash groups whose parities are kept of a set.
PARITIES = 1024
#: Elements ordered at once.
AT_ONCE = 1 << 20


def _groups(values: np.ndarray) -> np.ndarray:
    return values & ((1 << HEAT_BITS) - 1)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in slices of about ``AT_ONCE`` elements, with the sizes of their sets and the elements one after the other."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("s")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
            part = batch.slice(start, stop - start)
            yield part, np.diff(ends[start:stop], prepend=before), part.column("s").flatten().to_numpy()
            start = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups that stand out in a task, with their elements; all groups while most are empty."""
    seen = np.zeros(1 << HEAT_BITS, np.int32)
    for _, _, values in _elements(batches):
        seen += np.bincount(_groups(values), minlength=len(seen)).astype(np.int32)
    usual = np.median(seen)
    told = np.flatnonzero(seen > (usual + 4 * np.sqrt(usual) + 3 if usual else 0))
    for at in range(0, len(told), 100_000):
        g = told[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(seen[g].astype(np.int64))], ["g", "c"])


def _heat(sets: DataFrame) -> bytes:
    """One byte per group: the binary logarithm of its count, as far as tasks have told it.

    At most 2**HEAT_BITS rows of two numbers come to the driver, whatever the input. The table only sets the order.
    """
    told = sets.select("s").mapInArrow(_count, "g int, c bigint").groupBy("g").agg(F.sum("c").alias("c")).filter("c > 1")
    logs = told.select("g", F.floor(F.log2(F.col("c"))).cast("int").alias("h")).toArrow()
    heat = np.zeros(1 << HEAT_BITS, np.uint8)
    heat[logs.column(0).to_numpy()] = logs.column(1).to_numpy()
    return heat.tobytes()


def _poster(heat, percent: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(heat.value, np.uint8)
        for batch, n, values in _elements(batches):
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, table[_groups(values)], of))
            pos = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            kept = pos < (n + 1 - -(-n * percent // 100))[of]
            of, pos = of[kept], pos[kept].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(values[order][kept]), batch.column("id").take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(pos)], ["x", "id", "n", "pos"])

    return post


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """``x, id, n, pos``: the rare elements of each set by which similar sets must meet; elements of one posting are left out."""
    heat = sets.sparkSession.sparkContext.broadcast(_heat(sets))
    posted = sets.select("id", "s").mapInArrow(_poster(heat, percent), f"x bigint, id {sets.schema['id'].dataType.simpleString()}, n int, pos int")
    posted = cut_lineage(posted)
    several = posted.groupBy("x").agg(F.count("*").alias("f")).filter("f > 1").select("x")
    return posted.join(several, "x", "left_semi")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every set the parities of the counts of its hash groups, 64 to a number."""
    for batch, n, values in _elements(batches):
        odd = np.zeros((len(n), PARITIES), np.uint8)
        spread = (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PARITIES
        np.bitwise_xor.at(odd, (np.repeat(np.arange(len(n)), n), spread), 1)
        words = np.packbits(odd, axis=1).view(np.int64)
        marks = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, PARITIES // 64, dtype=np.int32)), pa.array(words.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int32)), marks], ["id", "n", "mark"])


def marks(sets: DataFrame) -> DataFrame:
    """``id, n, mark`` as a table: two sets differ in at least as many elements as their marks in bits."""
    made = sets.select("id", "s").mapInArrow(_mark, f"id {sets.schema['id'].dataType.simpleString()}, n int, mark array<bigint>")
    return cut_lineage(made)


def _likely(pairs: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """The pairs whose marks allow that they are as similar as asked."""
    a = marked.select("id", F.col("n").alias("n1"), F.col("mark").alias("m1"))
    b = marked.select(F.col("id").alias("other"), F.col("n").alias("n2"), F.col("mark").alias("m2"))
    bits = F.aggregate(F.zip_with("m1", "m2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    met = pairs.join(a, "id").join(b, "other")
    return met.filter(bits * (100 + percent) <= (F.col("n1") + F.col("n2")).cast("bigint") * (100 - percent)).select("id", "other")


def _verified(pairs: DataFrame, sets: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """``id, other, both, either`` of the pairs that are as similar as asked. Only sets of a likely pair are moved to it."""
    pairs = cut_lineage(_likely(cut_lineage(pairs), marked, percent))
    ids = pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct()
    few = cut_lineage(sets.join(ids, "id", "left_semi").select("id", "s"))
    a = few.select("id", F.col("s").alias("s1"))
    b = few.select(F.col("id").alias("other"), F.col("s").alias("s2"))
    both = F.size(F.array_intersect("s1", "s2")).cast("bigint").alias("both")
    met = pairs.join(a, "id").join(b, "other").select("id", "other", both, (F.size("s1") + F.size("s2")).alias("sizes"))
    met = met.select("id", "other", "both", (F.col("sizes") - F.col("both")).alias("either"))
    return met.filter(F.col("both") * 100 >= F.col("either") * percent)


def _candidates(posts: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """Distinct pairs of an open set and an earlier numbered one below the same element that bounds allow."""
    leads = posts.filter(f"no >= {low} AND no < {high}").select("x", F.col("id").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"))
    met = posts.filter("open").join(leads, "x").filter("other < id")
    need = F.call_function("div", (F.col("n") + F.col("m")) * percent + 99 + percent, F.lit(100 + percent))
    bound = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    return met.filter(bound >= need).withColumn("bound", bound)


def first_similar(sets: DataFrame, percent: int = 80) -> DataFrame:
    """``id, other, both, either``: of each set (``id, s`` with distinct elements) the smallest earlier id that is as similar.

    ``both`` and ``either`` are the sizes of intersection and union, ``100 * both >= percent * either``. Empty sets
    match nothing; ids are not NULL and occur once.
    """
    sets = cut_lineage(sets).filter(F.size("s") > 0)  # a filter on computed arrays would be pushed down and compute them anew per element
    marked = marks(sets)
    posts = cut_lineage(ranges.numbered(postings(sets, percent), ["x"], ["id"], "no"))
    most = posts.agg(F.max("no")).first()[0] or 0
    best = sets.sparkSession.createDataFrame([], sets.select("id").schema.add("other", sets.schema["id"].dataType).add("both", "long").add("either", "long"))
    low = 1
    while low < most:
        # closed: whoever has a partner that is smaller than all that this round can bring below the element
        ahead = posts.filter(f"no = {low}").select("x", F.col("id").alias("ahead"))
        state = posts.join(best.select("id", F.col("other").alias("has")), "id", "left").join(ahead, "x")
        state = state.withColumn("open", F.coalesce(F.col("ahead") < F.col("has"), F.lit(True)) & (F.col("no") > low))
        pairs = _candidates(state, low, 2 * low, percent).filter("has IS NULL OR other < has").select("id", "other").distinct()
        found = best.unionByName(_verified(pairs, sets, marked, percent))
        best = cut_lineage(found.groupBy("id").agg(F.min(F.struct("other", "both", "either")).alias("b")).select("id", "b.*"))
        low *= 2
    return best


def best_similar(sets: DataFrame, percent: int = 80) -> DataFrame:
    """``id, other, both, either``: of each set the most similar other one, if as similar as asked; ties to the smaller id.

    As in ``first_similar``, but either end of a pair may be the better partner of the other. A pair is verified when its
    bound on the similarity is above, or equal to, what one of its ends has. ``sets`` is read in every round, so it should be a table.
    """
    sets = sets.filter(F.size("s") > 0)
    marked = marks(sets)
    posts = cut_lineage(ranges.numbered(postings(sets, percent), ["x"], ["id"], "no"))
    most = posts.agg(F.max("no")).first()[0] or 0
    best = sets.sparkSession.createDataFrame([], sets.select("id").schema.add("other", sets.schema["id"].dataType).add("both", "long").add("either", "long"))
    low = 1
    while low < most:
        mine = best.select("id", F.col("both").alias("b1"), F.col("either").alias("e1"))
        pairs = _candidates(posts.withColumn("open", F.col("no") > low), low, 2 * low, percent)
        pairs = pairs.groupBy("id", "other", "n", "m").agg(F.max("bound").alias("bound"))
        pairs = pairs.join(mine, "id", "left").join(mine.toDF("other", "b2", "e2"), "other", "left")
        union = F.col("n") + F.col("m") - F.col("bound")
        better = [F.coalesce(F.col("bound") * F.col(e) >= F.col(b) * union, F.lit(True)) for b, e in (("b1", "e1"), ("b2", "e2"))]
        found = _verified(pairs.filter(better[0] | better[1]).select("id", "other"), sets, marked, percent)
        found = cut_lineage(found)
        every = best.unionByName(found).unionByName(found.select(F.col("other").alias("id"), F.col("id").alias("other"), "both", "either"))
        # exact order of fractions: whole part of a large multiple would round, so compare as decimals of ample scale
        share = (F.col("both").cast("decimal(18,0)") / F.col("either").cast("decimal(18,0)")).cast("decimal(38,20)")
        top = every.groupBy("id").agg(F.max(share).alias("top"))
        tied = every.withColumn("share", share).join(top, "id").filter("share = top")
        best = cut_lineage(tied.groupBy("id").agg(F.min(F.struct("other", "both", "either")).alias("b")).select("id", "b.*"))
        low *= 2
    return best


# the functions go to the executors by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
