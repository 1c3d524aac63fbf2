"""What a task of near vectors holds."""

import tracemalloc

import numpy as np
import pyarrow as pa

from rolecall.operators.vectors import _links


def test_a_batch_of_meetings_is_taken_one_at_a_time():
    rng = np.random.default_rng(5)
    n, wide, meetings = 200, 64, 40
    vectors = rng.standard_normal((meetings * n, wide))
    vectors[1::n] = vectors[0::n]
    rows = pa.StructArray.from_arrays([
        pa.array(np.arange(meetings * n)[::-1].copy()), pa.array(np.arange(meetings * n) % 2),
        pa.ListArray.from_arrays(pa.array(np.arange(0, meetings * n * wide + 1, wide), pa.int32()), pa.array(vectors.reshape(-1))),
    ], names=["id", "block", "vector"])
    groups = pa.ListArray.from_arrays(pa.array(np.arange(0, meetings * n + 1, n), pa.int32()), rows)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * meetings), pa.array([1] * meetings), groups], names=["own", "other", "rows"])
    tracemalloc.start()
    found = [pair for out in _links(0.9)(iter([batch])) for pair in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    last = meetings * n - 1
    assert found == [(last - k * n - 1, last - k * n) for k in range(meetings)] and peak < 2 << 20
