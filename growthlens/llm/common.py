"""Helpers that several training-data operators share."""

from __future__ import annotations

import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, tune

#: Rows per Arrow batch. Texts may be megabytes long, so batches stay short.
BATCH_ROWS = 500


def ship_by_value(module: str) -> None:
    """Send the module's functions with the tasks, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators in this package."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, by: int) -> Column:
    """``crc32(key as text) mod by``; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by if isinstance(key, str) else F.crc32(key.cast("string").cast("binary")) % by


def unused(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of ``df`` has, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ----------------------------------------------------------------- words and shingles in numpy


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased: ``bytes.split`` cuts at 0x20 and 0x09-0x0D only."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle."""
    h = word_hashes(words_of(text))
    n = len(h)
    if n == 0:
        return h
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : n - k + 1 + i]
    return np.unique(mixed(out))


def signature(values: np.ndarray) -> int:
    """Signed 64-bit identity of a set given as a sorted array."""
    x = xxhash.xxh3_64_intdigest(values.tobytes())
    return x - (1 << 64) if x >= 1 << 63 else x


# ----------------------------------------------------------------- components


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, root``: the smallest id reachable over ``edges (a, b)``; every id of an edge appears.

    Alternates large-star and small-star until the edge set stands still. A step groups by one id
    with map-side combination and joins the minimum back, so a hub with a third of all edges is
    split by the skew join. NULL ends are ignored; repeated edges and loops do no harm.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    stars = cut_lineage(edges.distinct())
    state = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(low, "a").filter("b > a OR a = b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.a", "e.b").distinct()
        stars = cut_lineage(small)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            return stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
        state = now


ship_by_value(__name__)
