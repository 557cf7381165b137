"""LM scoring with a log-bilinear model trained in numpy by noise-contrastive estimation.

The classes of the model are the most frequent words, the end of a text, and groups of all other words
by their last letters. Two preceding classes predict the next one: q = C1 * r[w1] + C2 * r[w2], and class c
scores q . r[c] + b[c]; noise-contrastive estimation fits this without summing over classes. For
scoring, matrix products over all pairs of preceding classes give the exact normaliser, so every
log-probability is normalised. A word of a group has the group's probability times its share of
the group's count in the corpus, with one added and one place left for unseen words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import remainder, ship_by_value, words_of

#: Words with a class of their own, groups of the others, dimensions, noise samples per batch.
FREQUENT, GROUPS, DIM, NOISE = 384, 128, 16, 40
#: Tokens of a batch, first learning rate, tokens of the first fit from which all tasks start.
BATCH, RATE, FIRST = 4096, 0.05, 1_500_000
#: Distinct words that a task counts before it hands them over; words whose counts all tasks hold.
FLUSH, SENT = 300_000, 100_000
CLASSES = FREQUENT + 1 + GROUPS
_END = FREQUENT


def hash64(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def group_of(word: bytes) -> int:
    """Group of a word without a class of its own: by its last three bytes."""
    return FREQUENT + 1 + xxhash.xxh32_intdigest(word[-3:]) % GROUPS


class Classes(dict):
    """Classes of words: the frequent ones', and by groups those of all others, remembered up to a number."""

    def __init__(self, frequent: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(frequent))
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.frequent))
        c = self[word] = group_of(word)
        return c

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([*map(self.__getitem__, words), _END], np.int32)


def contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; before the first stands the end of another text."""
    padded = np.concatenate([[_END, _END], classes])
    return padded[1:-1], padded[:-2]


class Model:
    def __init__(self, log_prior: np.ndarray, values: np.ndarray | None = None):
        rng = np.random.default_rng(7)
        if values is None:
            self.r = rng.normal(0, 0.1, (CLASSES, DIM))
            self.c = np.full((2, DIM), 0.5)
            self.b = log_prior.copy()
        else:
            k = CLASSES * DIM
            self.r, self.c, self.b = values[:k].reshape(CLASSES, DIM).copy(), values[k : k + 2 * DIM].reshape(2, DIM).copy(), values[k + 2 * DIM :].copy()
        noise = np.exp(log_prior)
        self.noise, self.log_noise = noise / noise.sum(), np.log(noise / noise.sum())
        self.rng = rng
        # squared gradients so far, per number
        self.seen_r, self.seen_c, self.seen_b = (np.ones(x.shape, np.float32) for x in (self.r, self.c, self.b))

    def values(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.c.ravel(), self.b])

    def fit(self, w1: np.ndarray, w2: np.ndarray, target: np.ndarray) -> None:
        """One pass over the tokens in batches; each batch shares its noise samples, each number its own rate."""
        r, c, b = (x.astype(np.float32) for x in (self.r, self.c, self.b))
        log_noise, k = self.log_noise.astype(np.float32), np.float32(math.log(NOISE))
        step = lambda x, g, seen: (np.add(seen, g * g, out=seen), np.add(x, RATE * g / np.sqrt(seen + 1e-8), out=x))
        for at in range(0, len(target), BATCH):
            a, z, y = w1[at : at + BATCH], w2[at : at + BATCH], target[at : at + BATCH]
            noise = self.rng.choice(CLASSES, NOISE, p=self.noise)
            ra, rz, ry, rn = r[a], r[z], r[y], r[noise]
            q = c[0] * ra + c[1] * rz
            gy = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, ry) + b[y] - log_noise[y] - k))
            gn = -1 / (1 + np.exp(log_noise[noise] + k - b[noise] - q @ rn.T))
            gq = gy[:, None] * ry + gn @ rn
            # gradients summed per class: sorted by class, then added up in runs
            rows = np.concatenate([gy[:, None] * q, gq * c[0], gq * c[1], gn.T @ q])
            names = np.concatenate([y, a, z, noise]).astype(np.int16)
            order = np.argsort(names, kind="stable")
            names = names[order]
            runs = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            grad = np.zeros_like(r)
            grad[names[runs]] = np.add.reduceat(rows[order], runs, axis=0)
            gb = np.bincount(y, gy, CLASSES) + np.bincount(noise, gn.sum(axis=0), CLASSES)
            step(c, np.stack([(gq * ra).sum(axis=0), (gq * rz).sum(axis=0)]), self.seen_c)
            step(r, grad, self.seen_r)
            step(b, gb.astype(np.float32), self.seen_b)
        self.r, self.c, self.b = (x.astype(np.float64) for x in (r, c, b))

    def normalisers(self) -> np.ndarray:
        """log of the sum over all classes, for every pair of preceding classes."""
        out = np.empty((CLASSES, CLASSES), np.float32)
        one, two = self.c[0] * self.r, self.c[1] * self.r
        for i in range(CLASSES):
            s = (one[i] + two) @ self.r.T + self.b
            top = s.max(axis=1)
            out[i] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out

    def log_probs(self, w1, w2, target, normal: np.ndarray) -> np.ndarray:
        q = self.c[0] * self.r[w1] + self.c[1] * self.r[w2]
        return (q * self.r[target]).sum(axis=1) + self.b[target] - normal[w1, w2]


# ----------------------------------------------------------------- corpus statistics


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return made

    for batch in batches:
        for t in batch.column(0):
            counts.update(words_of(t.as_py()))
            counts[b""] += 1  # the end; no word is empty
        if len(counts) > FLUSH:
            yield out()
    if counts:
        yield out()


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows; the empty word counts the ends."""
    return texts.mapInArrow(_counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Statistics:
    """What tasks need of the corpus: totals, the frequent words, the groups' counts; of bounded size."""

    def __init__(self, counts: DataFrame):
        top = counts.filter("word <> X''").orderBy(F.desc("c"), "word").limit(SENT).toArrow()
        words, c = top.column(0).to_pylist(), top.column(1).to_pylist()
        total, distinct, ends = counts.agg(F.sum("c"), F.count("*"), F.max(F.when(F.expr("word = X''"), F.col("c")))).first()
        self.total, self.distinct, self.ends = int(total or 0), int(distinct), int(ends or 0)
        self.frequent = words[:FREQUENT]
        self.sent = dict(zip(words, c))
        sums = counts.filter("word <> X''").mapInArrow(_grouped(self.frequent), "g int, c bigint, n bigint").groupBy("g").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
        self.mass, self.size = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in sums.toLocalIterator():
            self.mass[r["g"]], self.size[r["g"]] = r["c"], r["n"]
        self.mass[_END] = self.ends
        self.log_prior = np.log((self.mass + 1) / (self.mass.sum() + CLASSES))


def _grouped(frequent: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {w: i for i, w in enumerate(frequent)}
        for batch in batches:
            g = np.array([own[w] if w in own else group_of(w) for w in batch.column(0).to_pylist()], np.int64)
            c = np.bincount(g, batch.column(1).to_numpy(), CLASSES)
            n = np.bincount(g, minlength=CLASSES)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(c[used].astype(np.int64)), pa.array(n[used], pa.int64())], ["g", "c", "n"])

    return run


# ----------------------------------------------------------------- training and scoring


def _trained(stats_sent, values, limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, prior = stats_sent.value
        model, classes, tokens = Model(prior, values), Classes(frequent), 0
        for batch in batches:
            if limit is not None and tokens >= limit:
                continue
            parts = [classes.of(words_of(t.as_py())) for t in batch.column(0)]
            pairs = [contexts(p) for p in parts]
            w1, w2, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), np.concatenate(parts)
            order = np.random.default_rng(len(y)).permutation(len(y))
            model.fit(w1[order], w2[order], y[order])
            tokens += len(y)
        if tokens:
            v = model.values() * tokens
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["tokens", "v"])

    return run


def _averaged(made: DataFrame) -> np.ndarray | None:
    """Mean of the tasks' parameters, weighted by tokens; summed per coordinate by Spark."""
    made = cut_lineage(made)
    tokens = made.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return None
    sums = made.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(CLASSES * DIM + 2 * DIM + CLASSES)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy() / tokens
    return out


class Known(dict):
    """Numbers of the words whose counts all tasks hold; other words are numbered as they come.

    ``cls`` and ``lift`` have a row per number: the class and, for a known word, log10(c + 1).
    """

    def __init__(self, frequent: list[bytes], counts: dict[bytes, int]):
        super().__init__((w, i) for i, w in enumerate(counts))
        self.fixed = len(counts)
        own = {w: i for i, w in enumerate(frequent)}
        self.cls = [own[w] if w in own else group_of(w) for w in counts]
        self.lift = np.log10(np.array(list(counts.values()), np.float64) + 1)
        self.others: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.others.append(word)
        self.cls.append(group_of(word))
        return i

    def forget(self) -> None:
        """Drops the words that came; to be called between batches."""
        for w in self.others:
            del self[w]
        self.others.clear()
        del self.cls[self.fixed :]


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, total, distinct, ends, mass, size, prior, values, normal = sent.value
        model, known = Model(prior, values), Known(frequent, counts)
        inside = np.log10(mass + size + 1)
        inside[: _END + 1] = 0
        bottom, end_lift = math.log10(total + distinct + 1), math.log10(ends + 1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for t in batch.column(1) for w in [words_of(t.as_py())]]
            cls = np.array(known.cls, np.int32)
            n_tokens, base, score, known_n, words, times, owner = [], [], [], [], [], [], []
            for i, at in zip(ids, texts):
                y = np.append(cls[at], np.int32(_END))
                w1, w2 = contexts(y)
                s = float(model.log_probs(w1, w2, y, normal).sum()) / math.log(10) - float(inside[y].sum())
                here = at[at < known.fixed]
                lift = known.lift[here]
                s += float(lift[cls[here] > _END].sum())
                if len(here) < len(at):  # looked up in the whole table of counts
                    other, n = np.unique(at[at >= known.fixed], return_counts=True)
                    owner.append(np.full(len(other), i))
                    words.append(other - known.fixed)
                    times.append(n)
                n_tokens.append(len(y))
                base.append(float(lift.sum()) + end_lift - len(y) * bottom)
                score.append(s)
                known_n.append(len(here) + (ends > 0))
            n, m = len(ids), sum(map(len, owner))
            word = pa.array(known.others, pa.binary()).take(pa.array(np.concatenate(words))) if m else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, *owner]), pa.int64()), pa.array(n_tokens + [None] * m, pa.int64()), pa.array(known_n + [None] * m, pa.int64()),
                 pa.array(base + [None] * m, pa.float64()), pa.array(score + [None] * m, pa.float64()),
                 pa.concat_arrays([pa.nulls(n, pa.binary()), word]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *times]), pa.int64())])],
                ["row_id", "n_tokens", "n_known", "base", "score", "word", "times"],
            )
            known.forget()

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Learns from the rows whose ``crc32(key) mod 7`` is not 2 (rows with a NULL key are learned from and
    not held out). NULL and empty texts have one token, their end. Repeated rows count and are
    scored like others. All training rows are counted and trained on: every task passes once over its
    tokens, starting from a first fit, and the parameters are averaged by tokens. Counts of words beyond
    the most frequent ``SENT`` come by a join on the word, so nothing that grows is sent to tasks.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    train = src.filter(~held).select("text")
    counts = cut_lineage(count_words(train))
    stats = Statistics(counts)
    small = spark.sparkContext.broadcast((stats.frequent, stats.log_prior))
    # the first fit reads rows up to a number of tokens in one task; every task then goes on from there
    ddl = "tokens bigint, v array<double>"
    # (its texts are drawn by hash, each once, so only hashes are sorted)
    hashed = train.withColumn("h", F.xxhash64("text"))
    drawn = hashed.select("h").distinct().orderBy("h").limit(FIRST // 500).agg(F.max("h")).first()[0]
    some = hashed.filter(F.col("h") <= F.lit(drawn)).dropDuplicates(["h"]).repartition(1).sortWithinPartitions("h").select("text")
    first = _averaged(some.mapInArrow(_trained(small, None, FIRST), ddl))
    values = _averaged(train.mapInArrow(_trained(small, first, None), ddl))
    model = Model(stats.log_prior, values)
    sent = spark.sparkContext.broadcast(
        (stats.frequent, stats.sent, stats.total, stats.distinct, stats.ends, stats.mass, stats.size, stats.log_prior, model.values(), model.normalisers())
    )
    rows = src.withColumn("row_id", F.xxhash64("doc_id", "text"))
    made = cut_lineage(
        rows.select("row_id", "text").mapInArrow(
            _scored(sent), "row_id bigint, n_tokens bigint, n_known bigint, base double, score double, word binary, times bigint"
        )
    )
    # the logarithm that each rare word of a text adds; unseen words add log10(0 + 1) = 0
    rare = made.filter("word IS NOT NULL").select("row_id", "word", "times").join(counts, "word")
    adds = rare.groupBy("row_id").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("x"))
    # rows that are equal in key and text share a row_id; their scores are equal, so one of each is joined
    again = made.filter("word IS NULL").groupBy("row_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    out = rows.select("doc_id", "row_id").join(again, "row_id").join(adds, "row_id", "left")
    n, k, x = F.col("n"), F.coalesce("k", F.lit(0)), F.coalesce("x", F.lit(0.0))
    return out.select(
        F.col("doc_id").alias(key), held.alias("held_out"), "n_tokens", (F.col("n_known") + k / n).cast("bigint").alias("n_known"),
        F.lit(stats.total).cast("bigint").alias("train_tokens"), (F.col("base") + x / n).alias("base_score"), (F.col("score") + x / n).alias("score"),
    )


ship_by_value(__name__)
