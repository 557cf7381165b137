"""Whitening against numpy: rank-one updates, deflation, merged spectra, repeated rows, few vectors, bad vectors, an empty table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlens.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, x string, component string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def expected(rows):
    x = {j: np.array([math.floor(256 * float(np.float32(c))) for c in v]) for j, (_, v) in enumerate(rows)}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    val, vec = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, val[::-1], vec[:, ::-1]


def check(spark, rows, extra=(), block=whitening.BLOCK):
    got = whitening.whitened(frame(spark, [*rows, *extra]), block=block).collect()
    x, n, s, val, vec = expected(rows)
    k = min(4, len(s))
    assert len(got) == k * len(rows) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    of = {(r.vec_id, r.component): r for r in got}
    rank = int((val > 1e-9 * max(val[0], 1e-300)).sum())
    for c in range(1, k + 1):
        mine = np.array([of[i, c].whitened if of[i, c].whitened is not None else np.nan for i, _ in rows])
        if c > rank:
            assert np.isnan(mine).all()
            continue
        want = (np.array([x[j] for j in range(len(rows))]) - s / n) @ vec[:, c - 1] / math.sqrt(val[c - 1])
        sign = np.sign(mine @ want)
        gaps = [abs(val[c - 1] - v) for j, v in enumerate(val) if j != c - 1]
        if gaps and min(gaps) > 1e-3 * val[0]:
            assert np.abs(mine * sign - want).max() < 1e-9
        assert abs(of[rows[0][0], c].explained - val[c - 1] / val.sum()) < 1e-10
    assert all(r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[j], s)) for j, (i, _) in enumerate(rows) for r in [of[i, 1]])
    assert got[0].identity_error is None or got[0].identity_error < 1e-10
    return got


@pytest.mark.parametrize("block", [1, 7, whitening.BLOCK])
def test_whitening_equals_numpy(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 9)) * np.array([9, 7, 5, 3, 1, 1, 1, 0.1, 0])
    base[:, 6] = base[:, 5]  # equal directions: deflation
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(100 + i, rows) for i, rows in enumerate([[float(c) for c in base[0]]] * 40)]
    bad = [(500, None), (501, []), (502, [1.0] * 8), (503, [float("nan")] * 9), (504, [float("inf")] + [0.0] * 8), (505, [None] + [0.0] * 8), (506, [3e38] * 9)]
    check(spark, rows, bad, block)


def test_few_vectors_and_ids(spark):
    check(spark, [(1, [1.0, 2.0, 3.0])])
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 3.0]), (3, [1.0, 2.5, 3.0])])
    check(spark, [(1, [0.5]), (2, [0.25]), (3, [-0.0])])
    got = whitening.whitened(frame(spark, [(None, [1.0, 0.0]), (None, [0.0, 0.0]), (7, [0.0, 1.0])])).collect()
    assert len(got) == 6 and sum(r.vec_id is None for r in got) == 4
    none = whitening.whitened(frame(spark, []))
    assert none.count() == 0 and none.columns == got[0].__fields__
    huge = whitening.whitened(spark.createDataFrame([(1, [3e16, 0.0]), (2, [-3e16, 1.0])], "vec_id bigint, embedding array<double>")).collect()
    assert all(r.deviation is None for r in huge) and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge if r.component == 1)


def test_rank_one_updates_and_merges_keep_the_scatter():
    rng = np.random.default_rng(4)
    for size in (1, 2, 6, 40):
        val, vec, want = np.zeros(size), np.eye(size), np.zeros((size, size))
        for i in range(120):
            v = rng.normal(size=size) * rng.choice([1.0, 1e-4, 300.0]) if i % 5 else np.eye(size)[i % size]
            val, vec = whitening.rank_one(val, vec, v, 0.5)
            want += 0.5 * np.outer(v, v)
        assert np.abs(vec.T @ vec - np.eye(size)).max() < 1e-12
        assert np.abs(vec * val @ vec.T - want).max() < 1e-12 * np.abs(want).max()
    rows = rng.integers(-300, 300, (400, 12))
    for block in (1, 50):
        parts = []
        for piece in np.split(rows, [3, 3, 150, 390]):
            parts.append(whitening.Spectrum(12))
            for i in range(0, len(piece), block):
                parts[-1].add(piece[i : i + block])
        whole = parts[0]
        for p in parts[1:]:
            whole.merge(whitening.Spectrum.unpacked(p.packed().to_pylist()[0]))
        want = np.cov(rows.T, bias=True) * 400
        assert whole.n == 400 and whole.sums == rows.sum(axis=0).tolist()
        assert np.abs(whole.vec * whole.val @ whole.vec.T - want).max() < 1e-11 * np.abs(want).max()


def test_many_partitions_are_combined_in_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 5)) * [5, 4, 3, 2, 1])]
    df = frame(spark, rows).select("vec_id", "embedding").repartition(30)
    fit = df.select(F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("bigint")).alias("x"))
    s = whitening.spectrum(whitening.cut_lineage(fit).repartition(30), 5)
    x = np.array([np.floor(256 * np.float32(v).astype(float)) for _, v in rows])
    assert s.n == 400 and np.abs(s.vec * s.val @ s.vec.T / 400 - np.cov(x.T, bias=True)).max() < 1e-8
