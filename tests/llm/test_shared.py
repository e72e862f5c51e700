"""Runs of sorted batches, however the batches fall."""

import random

import pyarrow as pa
import pytest

from quire.llm.shared import runs


def batches(keys, sizes):
    out, at = [], 0
    for n in sizes:
        part = keys[at : at + n]
        out.append(pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([v for _, v in part], pa.int64())], ["k", "v"]))
        at += n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    rng = random.Random(seed)
    keys = sorted((rng.randrange(8), i) for i in range(60))
    sizes = []
    while sum(sizes) < len(keys):
        sizes.append(min(rng.randrange(0, 15), len(keys) - sum(sizes)))
    rows = [t.column("v").to_pylist() for t in runs(batches(keys, sizes), ["k"], together=False)]
    assert rows == [[v for k, v in keys if k == x] for x in sorted({k for k, _ in keys})]
    got = [(k, v) for t in runs(batches(keys, sizes), ["k"], whole=False) for k, v in zip(t.column("k").to_pylist(), t.column("v").to_pylist(), strict=True)]
    assert got == keys
    whole = []
    for t in runs(batches(keys, sizes), ["k"]):
        ids = list(zip(t.column("run").to_pylist(), t.column("k").to_pylist(), strict=True))
        assert len(set(ids)) == len({r for r, _ in ids}) == len({k for _, k in ids})
        whole += t.column("v").to_pylist()
    assert whole == [v for _, v in keys]
    assert list(runs([], ["k"])) == []
