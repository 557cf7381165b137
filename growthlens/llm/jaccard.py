"""N-gram Jaccard join over a forest of R-trees of token-group counts.

A text is the set of its 5-word shingles. Every shingle hashes into a group, and the counts per group
are a point; for two points the sum of the coordinate minima is an upper bound of the overlap. All
points form a forest: its roots are shingles, and a point hangs under the roots of its own shortest
sufficient prefix (in one global order, frequent groups last), so two linked texts share a root.
Under their first common root they share no more than what each has from there on, so every search
leaves out pairs for which that ``rest`` is too small: a pair of several roots is met once or seldom.
Under a root, points are packed by size into nodes with an upper corner each; nodes and then points
whose bound is too small are cut, and the pairs that survive are verified by exact overlap.

Only links between different classes matter, so the forest is searched in steps: every point
against the first of its root (n pairs for n copies); then, twice, points outside the largest class
of a root against one member of it, drawn anew for every root; at last and exhaustively, under
roots that still hold several classes, all points of different classes against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import connected_components, shingle_set, ship_by_value, signature

#: Linked when DEN * overlap >= NUM * union.
NUM, DEN = 80, 100
#: Hash groups of the frequency table: one byte each, so what is broadcast has a fixed size.
HEAT_BITS = 22
#: A point has one group for one or two shingles: 2**6 to 2**14 groups.
LEAST_BITS, MOST_BITS = 6, 14
#: Draws from the largest class; they only save work for the last step.
ROUNDS = 2
#: Points of a node, points of a root that meet in one task, and counts compared at once.
NODE, BLOCK, AT_ONCE = 32, 2048, 1 << 20


def level(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (n >> 1).bit_length()))


def point(values: np.ndarray) -> np.ndarray:
    bits = level(len(values))
    return np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def packed(p: np.ndarray) -> bytes:
    """Counts in one byte each where they fit, as nearly always; the first byte says how wide they are."""
    width = 1 if p.max() < 256 else 2
    return bytes([width]) + p.astype(f"u{width}").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1)


def prefix_length(n: int) -> int:
    """Linked sets overlap in at least NUM/DEN of the larger one, so they share one of so many."""
    return n - -(-NUM * n // DEN) + 1


def in_order(values: np.ndarray, heat: np.ndarray) -> np.ndarray:
    """The prefix of a set in the global order: by heat of the shingle's group, then by hash."""
    hot = heat[(values >> np.uint64(64 - HEAT_BITS)).astype(np.int64)]
    return values[np.lexsort((values, hot))[: prefix_length(len(values))]]


def folded(p: np.ndarray, bits: int) -> np.ndarray:
    """A point with fewer groups: neighbours summed up. ``p`` has one row per point."""
    return p if p.shape[1] == 1 << bits else p.reshape(len(p), 1 << bits, -1).sum(axis=2, dtype=np.uint32)


def bounded_pairs(
    points: list[np.ndarray], n: np.ndarray, tag: np.ndarray, rest: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with different tags that the size, the rest and the summed minima cannot rule out.

    Each pair comes once; the points need not be sorted. Without ``rest``, all of a point counts.
    """
    rest = n if rest is None else rest
    order = np.argsort(n, kind="stable")
    bits = np.array([len(p).bit_length() - 1 for p in points])
    for b in np.unique(bits):
        own = order[(bits[order] == b) | (bits[order] == b + 1)]  # linked sizes differ by a quarter at most
        m = np.concatenate([folded(points[i][None, :], b) for i in own])
        size, left, here, mark = n[own].astype(np.int64), rest[own].astype(np.int64), bits[own] == b, tag[own]
        ends = np.arange(0, len(own), NODE)
        corner = np.maximum.reduceat(m, ends, axis=0)
        for node, start in enumerate(ends):
            stop = min(start + NODE, len(own))
            # queries: all points from this node's first on; the node's points are the smaller side
            q = np.arange(start, np.searchsorted(size, size[stop - 1] * DEN // NUM, "right"))
            if stop - start < len(own):  # a single node has nothing to rule out
                need = -(-(size[q] + size[start]) * NUM // (NUM + DEN))
                q = q[np.minimum(m[q], corner[node]).sum(axis=1) >= need]
            x = np.arange(start, stop)[:, None]
            need = NUM * (size[x] + size[q])
            meet = (q > x) & (size[q] * NUM <= size[x] * DEN) & (mark[q] != mark[x]) & (here[q] | here[x])
            meet &= np.minimum(left[x], left[q]) * (NUM + DEN) >= need
            i, j = np.nonzero(meet)
            step = max(1, AT_ONCE >> int(b))
            for k in range(0, len(i), step):
                u, v = i[k : k + step], j[k : k + step]
                ok = np.minimum(m[start + u], m[q[v]]).sum(axis=1) * (NUM + DEN) >= need[u, v]
                if ok.any():
                    yield own[start + u[ok]], own[q[v[ok]]]


# ----------------------------------------------------------------- row-local steps

_MADE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("point", pa.binary()),
                   ("hot_group", pa.int32()), ("hot_count", pa.int64())])
MADE_DDL = "doc_id bigint, n bigint, id bigint, point binary, hot_group int, hot_count bigint"


def make_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, identity and point of every text; at the task's end its frequent groups."""
    seen = np.zeros(1 << HEAT_BITS, np.int32)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        rows = []
        for i, t in zip(ids, texts):
            s = shingle_set(t.as_py())
            if len(s):
                np.add.at(seen, (s >> np.uint64(64 - HEAT_BITS)).astype(np.int64), 1)
            rows.append((i, len(s), signature(s) if len(s) else None, packed(point(s)) if len(s) else None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MADE)] if rows else [pa.array([], f.type) for f in _MADE], schema=_MADE)
    mean = seen.mean()
    hot = np.flatnonzero(seen > mean + 4 * np.sqrt(mean) + 3)
    for at in range(0, len(hot), 50_000):
        g = hot[at : at + 50_000]
        none = [pa.nulls(len(g), f.type) for f in list(_MADE)[:4]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(g.astype(np.int32)), pa.array(seen[g].astype(np.int64))], schema=_MADE)


def posting_maker(heat):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = np.frombuffer(heat.value, np.uint8), set()
        for batch in batches:
            keys, ids, sizes, rests = [], [], [], []
            for t in batch.column(0):
                s = shingle_set(t.as_py())
                if len(s) and (i := signature(s)) not in done:  # copies within a task post once
                    done.add(i)
                    keys.append(in_order(s, table).view(np.int64))
                    ids.append(i)
                    sizes.append(len(s))
                    rests.append(np.arange(len(s), len(s) - len(keys[-1]), -1, dtype=np.int32))
            if keys:
                reps = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, reps)),
                                                  pa.array(np.repeat(np.array(sizes, np.int32), reps)), pa.array(np.concatenate(rests))], ["key", "id", "n", "rest"])

    return make


def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for t in batch.column(0) if len(s := shingle_set(t.as_py()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "s"]
        )


def cut_by_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for pa_, pb in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist()):
            x, y = unpacked(pa_)[None, :], unpacked(pb)[None, :]
            bits = min(x.shape[1], y.shape[1]).bit_length() - 1
            keep.append(bool(np.minimum(folded(x, bits), folded(y, bits)).sum() * (NUM + DEN) >= NUM * (int(x.sum()) + int(y.sum()))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes under each root; rows come sorted by cell, a cell is bounded."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n, rest, root = (t.column(c).to_numpy() for c in ("id", "n", "rest", "root"))
        side = t.column("side").to_numpy()
        pts = [unpacked(p) for p in t.column("point").to_pylist()]
        for x, y in bounded_pairs(pts, n, root, rest):
            if side.any():  # of two blocks that meet, pairs within a block belong to another cell
                keep = side[x] != side[y]
                x, y = x[keep], y[keep]
            if len(x):
                a, b = ids[x], ids[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    open_ = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if open_ is None else pa.concat_tables([open_, t])
        cell = np.stack([t.column(c).to_numpy() for c in ("key", "bi", "bj")])
        cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1)]
        for i, j in zip(cuts, cuts[1:]):
            yield from pairs(t.slice(i, j - i))
        open_ = t.slice(cuts[-1])
    if open_ is not None:
        yield from pairs(open_)


# ----------------------------------------------------------------- the join


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    Two rows link when the Jaccard similarity of their 5-word shingle sets is 0.8 or more;
    ``component_id`` is the smallest key reachable by links. NULL, empty and wordless texts have
    no shingles, link with nothing and are their own class; texts below five words are one
    shingle. Equal sets link whatever the key; repeated rows stay repeated. A NULL key never
    names a class unless all its members have one. Other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    made = cut_lineage(src.mapInArrow(make_points, MADE_DDL))
    rows = made.filter("n IS NOT NULL").select("doc_id", "n", "id")
    heat = spark.sparkContext.broadcast(_heat(made))
    reps = cut_lineage(
        made.filter("id IS NOT NULL").groupBy("id", "n").agg(F.min("doc_id").alias("doc_id"), F.min("point").alias("point"))
    )
    postings = src.select("text").mapInArrow(posting_maker(heat), "key bigint, id bigint, n int, rest int")
    cells = _with_partners(postings)
    cells = cut_lineage(cells)
    first = _verified(_bounded(_with_lead(cells.filter("id <> lead.id")), reps), src, reps)
    links = cut_lineage(first)
    roots = cut_lineage(connected_components(links))
    for round_ in range(ROUNDS):
        more = cut_lineage(_verified(_bounded(_to_largest_class(cells, roots, round_), reps), src, reps))
        links = links.union(more)
        roots = cut_lineage(connected_components(links))
    last = cut_lineage(_between_classes(cells, roots, reps))
    if not last.isEmpty():
        links = links.union(_verified(last, src, reps))
        roots = cut_lineage(connected_components(links))
    # smallest key of every class
    named = reps.select("id", "doc_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = cut_lineage(named)
    least = cut_lineage(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    by_id = cut_lineage(named.join(least, "root").select("id", "component_id"))
    out = rows.join(by_id, "id", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_partners(postings: DataFrame) -> DataFrame:
    """One row per root and text, with the ``lead`` of the root, where another text of the root may be alike enough.

    In order of size the next larger text asks least of a rest, and the next smaller one is the
    nearest in size: where neither fits, no text of the root does. All steps take one shuffle.
    """
    w = Window.partitionBy("key")
    by = w.orderBy("n", "id")
    lead = F.min(F.struct("id", "n", "rest")).over(w).alias("lead"), F.max("id").over(w).alias("top")
    several = postings.select("key", "id", "n", "rest", *lead).filter("lead.id <> top").drop("lead", "top")
    once = several.select("key", "id", "n", "rest", F.lag("id").over(by).alias("last")).filter("last IS NULL OR last <> id")
    near = once.select("key", "id", "n", "rest", F.lag("n").over(by).alias("below"), F.lead("n").over(by).alias("above"), F.first("n").over(by).alias("least"))
    fits = f"""below * {DEN}L >= n * {NUM}L AND rest * {NUM + DEN}L >= (CAST(n AS BIGINT) + least) * {NUM}L
               OR n * {DEN}L >= above * {NUM}L AND rest * {NUM + DEN}L >= (CAST(n AS BIGINT) + above) * {NUM}L"""
    return near.filter(fits).select("key", "id", "n", "rest", *lead).filter("lead.id <> top").drop("top")


def _heat(made: DataFrame) -> bytes:
    """One byte per group: 0, or the binary logarithm of its count where that stands out.

    At most 2**HEAT_BITS rows of two numbers come to the driver, whatever the input.
    """
    hot = made.filter("hot_group IS NOT NULL").groupBy("hot_group").agg(F.sum("hot_count").alias("c"))
    logs = hot.select("hot_group", (F.floor(F.log2(F.col("c"))) + 1).cast("int").alias("h")).toArrow()
    heat = np.zeros(1 << HEAT_BITS, np.uint8)
    heat[logs.column(0).to_numpy()] = logs.column(1).to_numpy()
    return heat.tobytes()


def _bounded(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    p = reps.select("id", "point")
    j = pairs.join(p.select(F.col("id").alias("b"), F.col("point").alias("pb")), "b").join(p.select(F.col("id").alias("a"), F.col("point").alias("pa")), "a")
    return j.select("a", "b", "pa", "pb").mapInArrow(cut_by_bound, "a bigint, b bigint")


def _verified(pairs: DataFrame, src: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose exact overlap suffices. Sets are made again for the texts of a pair only."""
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut_lineage(reps.join(ids, "id", "left_semi").select("id", "doc_id"))
    sets = src.join(wanted, src.doc_id.eqNullSafe(wanted.doc_id)).select("text").mapInArrow(make_sets, "id bigint, s binary")
    sets = cut_lineage(sets.dropDuplicates(["id"]))  # a key may stand at several texts
    j = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return j.select("a", "b", "sa", "sb").mapInArrow(verify, "a bigint, b bigint")


def _with_lead(rows: DataFrame) -> DataFrame:
    """Each row with the ``lead`` of its root, where sizes and rests allow a link."""
    fits = f"""least(n, lead.n) * {DEN}L >= greatest(n, lead.n) * {NUM}L
               AND least(rest, lead.rest) * {NUM + DEN}L >= (CAST(n AS BIGINT) + lead.n) * {NUM}L"""
    return rows.filter(fits).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()


def _labelled(cells: DataFrame, roots: DataFrame) -> DataFrame:
    return cells.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _to_largest_class(cells: DataFrame, roots: DataFrame, round_: int) -> DataFrame:
    """Under each root of several classes: those outside the largest with one member of it.

    Which member depends on the root and the round, so a point meets as many as it has roots.
    """
    member = cut_lineage(_labelled(cells.select("key", "id", "n", "rest"), roots))
    drawn = F.min_by(F.struct("id", "n", "rest"), F.xxhash64("id", "key", F.lit(round_))).alias("lead")
    classes = cut_lineage(member.groupBy("key", "root").agg(F.count("*").alias("c"), drawn))
    largest = classes.groupBy("key").agg(
        F.max(F.struct("c", "root", "lead")).alias("most"), F.count("*").alias("classes")
    ).filter("classes > 1").select("key", F.col("most.root").alias("lead_root"), "most.lead")
    return _with_lead(member.join(cut_lineage(largest), "key").filter("root <> lead_root"))


def _between_classes(cells: DataFrame, roots: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of different classes that the trees under their common roots cannot rule out.

    The first of each root has met all the others already.
    """
    member = cut_lineage(_labelled(cells.filter("id <> lead.id").select("key", "id", "n", "rest"), roots))
    open_keys = member.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c"))
    open_keys = cut_lineage(open_keys.filter("r0 <> r1").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb")))
    m = member.join(open_keys, "key").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    # every block meets itself and every other block once
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    m = m.select("key", "id", "n", "rest", "root", "blk", other).select(
        "key", "id", "n", "rest", "root", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), (F.col("blk") > F.col("o")).cast("int").alias("side")
    )
    m = m.join(reps.select("id", "point"), "id")
    m = m.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return m.mapInArrow(search_cells, "a bigint, b bigint").distinct()


ship_by_value(__name__)
