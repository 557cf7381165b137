"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate and an L1 penalty, so few weights differ from zero;
they are sent to all tasks as sorted (coordinate, weight) arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, remainder, ship_by_value, unused

#: Coordinates: 2**BITS for words and as many for pairs (neighbours, and words with one between).
BITS = 22
#: Labelled rows that the model learns from at most, drawn by a hash of their key.
TRAIN_ROWS = 16_000
#: Learning rate, its offset, L1, L2, passes, and the least share of the texts with a coordinate (two texts at least).
ALPHA, BETA, L1, L2, PASSES, LEAST_SHARE = 4.0, 1.0, 4.0, 0.001, 6, 0.0007

_WORD = re.compile(r"\w+")


def features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates of a text: words, neighbouring pairs, pairs with one word between."""
    words = _WORD.findall(text.lower()) if text else []
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    shift, odd = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    pairs = [mixed(h[: len(h) - gap] * odd + h[gap:] + np.uint64(gap)) >> shift for gap in (1, 2) if len(h) > gap]
    parts = [mixed(h) >> shift, *[p + np.uint64(1 << BITS) for p in pairs]]
    return np.unique(np.concatenate(parts)).astype(np.int32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted coordinates with a weight, the weights, and the bias."""
    if not rows:
        return np.empty(0, np.int32), np.empty(0), -20.0
    # tables over all coordinates and one array for all rows: small arrays by the thousand would leave the worker swollen
    at = np.zeros(2 << BITS, np.int32)
    for r in rows:
        at[r] += 1  # a row has a coordinate once
    names = np.flatnonzero(at >= max(2, LEAST_SHARE * len(rows))).astype(np.int32)
    kept, end, local = np.empty(int(at[names].sum()), np.int32), 0, []
    at.fill(-1)
    at[names] = np.arange(len(names), dtype=np.int32)
    for r in rows:
        i = at[r]
        i = i[i >= 0]
        kept[end : end + len(i)] = i
        local.append(kept[end : end + len(i)])
        end += len(i)
    del at
    z, n = np.zeros(len(names)), np.zeros(len(names))
    bias_z = bias_n = 0.0

    def weight(z_, n_, l1=L1):
        return np.where(np.abs(z_) <= l1, 0.0, (np.sign(z_) * l1 - z_) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    order = np.random.default_rng(1)
    for _ in range(PASSES):
        for i in order.permutation(len(local)):
            x = local[i]
            w = weight(z[x], n[x])
            b = float(weight(bias_z, bias_n, 0.0))
            p = 1 / (1 + np.exp(-np.clip(b + w.sum(), -30, 30)))
            g = p - labels[i]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    w = weight(z, n)
    used = np.flatnonzero(w)
    return names[used], w[used], float(weight(bias_z, bias_n, 0.0))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(made, pa.binary())], ["h", "toxic", "x"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        made = [np.frombuffer(x, np.int32) for x in batch.column("x").to_pylist()]
        if made:  # the rows of a batch are parts of one array
            rows += np.split(np.concatenate(made), np.cumsum([len(x) for x in made])[:-1])
            labels += batch.column("toxic").to_pylist()
    names, weights, bias = ftrl(rows, np.array(labels, float))
    yield pa.RecordBatch.from_arrays([pa.array([-1, *names.tolist()], pa.int32()), pa.array([bias, *weights.tolist()], pa.float64())], ["i", "w"])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled rows whose ``crc32(key) mod 5`` is not 0, at most ``TRAIN_ROWS`` of them.

    Several labels of one key: the largest counts, and of several texts the smallest; NULL keys and labels teach nothing. The rows
    have a fixed number at most, so they may be broadcast and be fitted in one task.
    """
    known = labels.filter(F.col(label).isNotNull() & (remainder(key, 5) != 0)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("toxic"))
    drawn = known.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(TRAIN_ROWS)
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(drawn), "k")
    src = src.groupBy("h", "toxic", "k").agg(F.min("text").alias("text")).drop("k")
    x = src.mapInArrow(_featured, "h bigint, toxic int, x binary").repartition(1).sortWithinPartitions("h", "x")
    model = x.mapInArrow(_fitted, "i int, w double").toArrow()
    if not model.num_rows:
        return np.empty(0, np.int32), np.empty(0), -20.0
    i, w = model.column(0).to_numpy(), model.column(1).to_numpy()
    return i[1:], w[1:], float(w[0])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None,
          out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns (the key by default), ``score`` (0 to 1) and ``predicted`` (score >= 0.5) per row.

    The two take the names ``out``; kept columns of these names give way to them. The score depends on the text only. NULL and empty texts have the bias alone; without any
    labelled row nothing is toxic. Repeated rows and NULL keys are scored like others.
    """
    names, weights, bias = learn(docs, labels, key, text, label)
    sent = docs.sparkSession.sparkContext.broadcast((names, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, b = sent.value
        dense = np.zeros(2 << BITS, np.float32)
        dense[i] = w
        for batch in batches:
            sums = np.array([b + float(dense[features(t.as_py())].sum(dtype=np.float64)) for t in batch.column(batch.num_columns - 1)])
            p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], *out]
            )

    kept = [c for c in keep or [key] if c not in out]
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(unused(docs, "text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    return src.mapInArrow(run, ", ".join([*fields, f"`{out[0]}` double", f"`{out[1]}` int"]))


ship_by_value(__name__)
