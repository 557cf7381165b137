"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of its
first pivots; a query reads the files of its own first pivots, ranks what it finds by
Spearman's footrule between the pivot orders, and the best are ranked again by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import ship_by_value

#: Pivots (a bounded sample), pivots of a vector's prefix, files that a vector stands in and a query reads.
PIVOTS, PREFIX, POSTED, READ = 512, 64, 12, 26
#: Vectors and queries that meet in one task; of a block, the share (and least number) ranked by exact cosine.
BLOCK, QUERIES, SHARE, LEAST = 4096, 256, 6, 64


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, summed row by row, so equal rows get equal values."""
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def prefixes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    near = unit(x) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :PREFIX].astype(np.int16)


def footrules(q: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Footrule between one prefix and rows of ranks; what a prefix lacks ranks just behind it."""
    k = len(q)
    own = ranks[:, q]
    return np.abs(own - np.arange(k)).sum(axis=1) + k * (k + 1) // 2 - (k - own).sum(axis=1)


def _post(pivots: np.ndarray, every: int, kind_of: type):
    """One row per file that a vector stands in (kind 0) or that a query reads (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=np.float64)
            if not len(ids):
                continue
            order = prefixes(x, pivots)
            raw, pre = [r.tobytes() for r in x.astype(kind_of)], [r.tobytes() for r in order]
            for kind, files, rows in ((0, POSTED, range(len(ids))), (1, READ, np.flatnonzero(ids % every == 0))):
                rows = [i for i in rows]
                files = min(files, order.shape[1])
                file = [int(p) for i in rows for p in order[i, :files]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file, pa.int32()), pa.array([kind] * len(file), pa.int32()), pa.array([int(ids[i]) for i in rows for _ in range(files)], pa.int64()),
                     pa.array([pre[i] for i in rows for _ in range(files)], pa.binary()), pa.array([raw[i] for i in rows for _ in range(files)], pa.binary())],
                    ["file", "kind", "id", "prefix", "raw"],
                )

    return run


def _search(k: int, m: int, kind_of: type):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        ids = t.column("id").to_numpy()
        raw = np.stack([np.frombuffer(x, kind_of) for x in t.column("raw").to_pylist()]).astype(np.float64)
        order = np.stack([np.frombuffer(x, np.int16) for x in t.column("prefix").to_pylist()])
        v = np.flatnonzero(kind == 0)
        v = v[np.argsort(ids[v], kind="stable")]
        ranks = np.full((len(v), m), order.shape[1], np.int16)
        ranks[np.arange(len(v))[:, None], order[v]] = np.arange(order.shape[1])
        out = []
        for q in np.flatnonzero(kind == 1):
            near = footrules(order[q], ranks)
            best = np.argsort(near, kind="stable")[: max(LEAST, len(v) // SHARE) + 1]  # ties: the smaller id
            best = best[ids[v[best]] != ids[q]]
            score = cosines(raw[q], raw[v[best]])
            top = np.lexsort((ids[v[best]], -score))[:k]
            out += [(int(ids[q]), int(ids[v[best[i]]]), float(score[i])) for i in top]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose key is divisible by ``every``.

    Candidates are all other rows, nearness is the cosine, ties go to the smaller key. Vectors that
    are NULL, empty, zero, or hold NULL or non-finite components take no part, nor do NULL keys
    and vectors of another length than the most frequent one. Of rows with one key the smallest
    vector counts. A file with more than ``BLOCK`` vectors is searched in blocks, so one pivot may
    hold a third of all rows; a query's results from all its files are merged.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    src = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(finite)
    src = src.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    src = cut_lineage(src.groupBy("id").agg(F.min("x").alias("x")))
    size = src.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    src = src.filter(F.size("x") == size["n"])
    drawn = src.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    # single precision is kept as it is, without loss
    kind_of = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64
    pivots = unit(np.array([r["x"] for r in drawn]))
    posts = cut_lineage(src.mapInArrow(_post(pivots, every, kind_of), "file int, kind int, id bigint, prefix binary, raw binary"))
    # blocks of vectors and of queries per file: at most one row per pivot is sent to all tasks
    sizes = posts.groupBy("file").agg(
        F.ceil(F.count_if(F.col("kind") == 0) / BLOCK).cast("int").alias("nv"), F.ceil(F.count_if(F.col("kind") == 1) / QUERIES).cast("int").alias("nq")
    ).filter("nv > 0 AND nq > 0")
    p = posts.join(F.broadcast(sizes), "file")
    here = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 0, F.col("nv")).otherwise(F.col("nq"))).cast("int")
    there = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("nq")).otherwise(F.col("nv")) - 1))
    p = p.select("*", here.alias("own"), there.alias("other"))
    p = p.withColumn("bv", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")))
    p = p.withColumn("bq", F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("other")))
    found = p.select("file", "bv", "bq", "kind", "id", "prefix", "raw").groupBy("file", "bv", "bq").applyInArrow(
        _search(k, len(pivots), kind_of), "query_id bigint, vec_id bigint, score double"
    )
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _ranked(once, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship_by_value(__name__)
