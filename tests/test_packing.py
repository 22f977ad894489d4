"""Ordered packing in parallel against one fold, a document at a time."""

import numpy as np
import pytest

from folio.operators import packing

TARGET = 20


def fold(sizes, target=TARGET, fill=0, part=0):
    out = []
    for n in sizes:
        if fill > 0 and fill + n > target:
            fill, part = 0, part + 1
        fill += n
        out.append(part)
    return out, fill


def sizes_of(rng, n):
    return rng.choice([0, 0, 1, 2, 3, 7, 19, 20, 21, 60], n).astype(np.int64)


def test_maps_of_runs_and_their_composition():
    rng = np.random.default_rng(2)
    for _ in range(400):
        runs = [sizes_of(rng, rng.integers(1, 12)) for _ in range(rng.integers(1, 5))]
        whole = packing.run_map(runs[0], TARGET)
        for r in runs[1:]:
            whole = packing.composed(whole, packing.run_map(r, TARGET), TARGET)
        assert (np.diff(whole["above"]) < 0).all() and len(whole["above"]) <= TARGET
        for fill in [*range(TARGET + 1), 21, 70]:
            parts, end = fold(np.concatenate(runs), fill=fill)
            assert packing.applied(whole, fill, TARGET) == (end, parts[-1])
            assert packing.packed(np.concatenate(runs), fill, 5, TARGET).tolist() == [p + 5 for p in parts]


@pytest.mark.parametrize("run,fan", [(1, 2), (7, 3), (4096, 64)])
def test_equals_one_fold(spark, run, fan):
    """Runs of a few documents and maps of two at a time: many levels; ids far apart, null and repeated."""
    sizes = sizes_of(np.random.default_rng(run), 150)
    rows = [(None if i < 5 else 7 if i < 40 else i * 10**12, None if n == 0 and i % 2 else "x" * int(n), "u") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes string").repartition(5)
    ordered = sorted(((d is not None, d or 0), len(t or "")) for d, t, _ in rows)
    want = [(d[1] if d[0] else None, p, n) for (d, n), p in zip(ordered, fold([n for _, n in ordered])[0])]
    got = packing.pack_in_order(docs, TARGET, run, fan)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    parts = packing.parts(got).collect()
    assert len(parts) == want[-1][1] + 1 and sum(r.n_docs for r in parts) == len(rows) and sum(r.bytes for r in parts) == sizes.sum()
    assert packing.pack_in_order(docs.limit(0), TARGET).count() == 0
