"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _to_roots(parents: DataFrame) -> DataFrame:
    """``id, root`` of a forest ``id, up`` whose parents are smaller than their children; roots point to themselves."""
    cur = cut_lineage(parents.select("id", F.col("up").alias("root")))
    while True:
        above = cur.select(F.col("id").alias("root"), F.col("root").alias("__next"))
        step = cut_lineage(cur.join(above, "root").select("id", F.col("__next").alias("root"), (F.col("__next") != F.col("root")).alias("__moved")))
        cur = step.drop("__moved")
        if step.filter("__moved").isEmpty():
            return cur


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id of ``edges (a, b)``: the smallest id that can be reached.

    In every round each id hangs itself under its smallest neighbour, if that is smaller; the trees are shortened to their
    roots by doubling, and the edges between different roots are the next, smaller graph. The smallest id of a component
    is never hung under another, so it is the root at the end. Minima are combined map side, and
    a hub is split by the skew join. NULL ends are ignored; loops and repeated edges do no harm.
    """
    known = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    rest = cut_lineage(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or not rest.isEmpty():
        ends = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _to_roots(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("up")))
        if labels is None:
            labels = roots
        else:
            later = roots.select(F.col("id").alias("root"), F.col("root").alias("__new"))
            labels = cut_lineage(labels.join(later, "root", "left").select("id", F.coalesce("__new", "root").alias("root")))
        of_a, of_b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
        moved = rest.join(of_a, "a").join(of_b, "b").filter("ra <> rb")
        rest = cut_lineage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels
