"""The one task that fits the toxicity model: memory and coordinates."""

import tracemalloc

import numpy as np
import pyarrow as pa

from growthlens.llm import toxicity


def test_the_fit_takes_little_more_than_its_rows():
    draw = np.random.default_rng(3)
    common = np.sort(draw.choice(2 << toxicity.BITS, 20_000, replace=False)).astype(np.int32)
    rows = [common[np.sort(draw.choice(len(common), 4_000, replace=False))] for _ in range(2_000)]
    labels = [int(r[0] == rows[0][0]) for r in rows]
    size = sum(r.nbytes for r in rows)

    def batches():
        for i in range(0, len(rows), 100):
            x = pa.array([r.tobytes() for r in rows[i : i + 100]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(labels[i : i + 100], pa.int32()), x], ["toxic", "x"])

    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in toxicity._fitted(batches())) >= 1
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    table = 4 * (2 << toxicity.BITS)
    assert most < 2.5 * size + 2 * table


def test_coordinates_of_few_rows_have_no_weight():
    # of 6,000 rows at least 5 must have a coordinate
    rows = [np.array([i % 2, *[10] * (i < 5), *[20] * (i < 4), *[1000 + i] * (i % 3 == 0)], np.int32) for i in range(6_000)]
    rows += [np.empty(0, np.int32)]
    names, weights, bias = toxicity.ftrl(rows, np.array([float(i % 2) for i in range(len(rows))]))
    assert names.dtype == np.int32 and {0, 1} <= set(names.tolist()) <= {0, 1, 10}
    assert dict(zip(names, weights))[1] > 0 > dict(zip(names, weights))[0]
    assert len(toxicity.ftrl([np.empty(0, np.int32)], np.array([1.0]))[0]) == 0
