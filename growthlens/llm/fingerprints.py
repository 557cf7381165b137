"""Threshold-scaled fingerprints: all shingle hashes below a fixed fraction of the hash range.

The kept hashes of a union are the union of the kept hashes, so fingerprints merge; the share of one
document's kept hashes that another one holds estimates containment however unequal their sizes.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mixed, ship_by_value

#: Code points of a shingle; one of 2**BITS hashes is kept.
WIDTH, BITS = 8, 4


def kept_hashes(text: str) -> np.ndarray:
    """Sorted distinct kept hashes (32 bits each); a text below the width is one shingle."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    if n == 0:
        return np.empty(0, np.uint32)
    k = min(WIDTH, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + c[i : n - k + 1 + i]
    h = mixed(h)
    h = h[h < np.uint64(1 << (64 - BITS))]
    return np.unique((h >> np.uint64(32 - BITS)).astype(np.uint32))


def fingerprint(text: str, kept: np.ndarray | None = None) -> str:
    """``code points : hash of the whole text : kept hashes`` (base64 of little-endian integers)."""
    kept = kept_hashes(text) if kept is None else kept
    return f"{len(text)}:{xxhash.xxh3_64_hexdigest(text.encode('utf-8', 'surrogatepass'))}:{base64.b64encode(kept.tobytes()).decode()}"


def parse(print_: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(print_.rsplit(":", 1)[1]), np.uint32)


def merge(a: str, b: str) -> str:
    """Fingerprint of two documents taken as one collection of shingles."""
    both = np.union1d(parse(a), parse(b))
    size = int(a.split(":")[0]) + int(b.split(":")[0])
    return f"{size}:{xxhash.xxh3_64_hexdigest(both.tobytes())}:{base64.b64encode(both.tobytes()).decode()}"


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b holds (0 when a keeps no hash)."""
    x, y = parse(a), parse(b)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 0.0


def likeness(x: np.ndarray, y: np.ndarray, same: bool) -> float:
    """Estimated Jaccard similarity; equal texts are 1, texts too short to keep a hash are else 0."""
    if same:
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 0.0


_OUT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_by_next")
_DDL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, held_by_next double")  # fmt: skip
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())


def compared(doc_id, text: str, kept: np.ndarray, after: str, kept_after: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    kept_edited = kept_hashes(edited)
    both = len(np.intersect1d(kept, kept_after, assume_unique=True))
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(text, kept),
        fingerprint(edited, kept_edited), likeness(kept, kept_edited, text == edited), likeness(kept, kept_after, text == after),
        both / len(kept) if len(kept) else 0.0,
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        yield [(p, i, t.as_py()) for p, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], ["doc_id", *_OUT])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the one after it in its stretch; a stretch's last row is left out."""
    before = None
    for given in _in_order(batches):
        rows = []
        for part, i, text in given:
            now = (part, i, text, kept_hashes(text))
            if before is not None and before[0] == part:
                rows.append(compared(*before[1:], text, now[3]))
            before = now
        if rows:
            yield _packed(rows)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stretch: its first text, its last row."""

    def edge(part, first, i, last):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([i], pa.int64()), pa.array([last])],
                                          ["part", "first", "doc_id", "last"])

    first = before = None
    for given in _in_order(batches):
        for row in given:
            if before is None or before[0] != row[0]:
                if before is not None:
                    yield edge(before[0], first, *before[1:])
                first = row[2]
            before = row
    if before is not None:
        yield edge(before[0], first, *before[1:])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [compared(i, a, kept_hashes(a), b, kept_hashes(b)) for i, a, b in zip(*[c.to_pylist() for c in batch.columns])]
        if rows:
            yield _packed(rows)


def _stretch(bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below ``doc_id``: first whole blocks of them, then within one."""
    if not bounds:
        return F.lit(0)
    block = math.isqrt(len(bounds)) + 1
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("doc_id")))
    whole = below(F.lit(bounds[block - 1 :: block]).cast("array<bigint>"))
    within = F.slice(F.lit(bounds).cast("array<bigint>"), whole * block + 1, block)
    return F.when(F.col("doc_id").isNull(), 0).otherwise(whole * block + below(within))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its size, its fingerprint, that of its edited text, and likenesses (see ``_DDL``).

    The edited text has its last ``n // 2`` code points replaced by the first as many of the next row by
    ascending key (the first row after the last). NULL texts count as empty; equal keys follow one another
    in the order of their texts; NULL keys come first. A single row is its own next one. ``held_by_next``
    estimates how much of a document its successor contains. Quantiles of the keys (one number per shuffle
    partition) cut the rows into stretches; the texts are shuffled once, and both the rows within a stretch
    and the ends of neighbouring stretches are compared from that one shuffle.
    """
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    found = src.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n))).first()[0] if shares else None
    bounds = sorted(set(found or []))
    ranged = src.select(_stretch(bounds).alias("part"), "doc_id", "text").repartitionById(len(bounds) + 1, F.col("part"))
    ranged = ranged.sortWithinPartitions("part", "doc_id", "text")
    within = ranged.mapInArrow(_neighbours, _DDL)
    # one row per stretch: the last one wraps around to the first
    order = Window.orderBy("part")
    after = F.coalesce(F.lead("first").over(order), F.first("first").over(order))
    ends = ranged.mapInArrow(_edges, "part int, first string, doc_id bigint, last string")
    ends = ends.select("doc_id", "last", after.alias("after")).mapInArrow(_across, _DDL)
    return within.unionByName(ends).withColumnRenamed("doc_id", key)


ship_by_value(__name__)
