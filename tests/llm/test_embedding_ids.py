"""op7 against brute force on planted vectors: null and repeated ids, tiny and huge doubles, hot vectors and large components."""

import collections

import numpy as np
import pytest

from folio.llm import embeddings


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""
    out, ok, unit = [], [], []
    for k, (_, e) in enumerate(rows):
        x = None if not e or any(v is None for v in e) else np.array(e, float)
        if x is None or not np.isfinite(x).all() or not x.any():
            continue
        x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
        ok.append(k)
        unit.append(x / np.linalg.norm(x))
    near = collections.defaultdict(set)
    for a in range(len(ok)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and (unit[a] * unit[b]).sum() >= cosine:
                near[ok[a]].add(ok[b])
                near[ok[b]].add(ok[a])
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(near[k]), least, i is None or i == least))
    return out


def check(spark, rows, kind="double", **given):
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, n_links int"), **given).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(str, plain(rows)))


def test_one_id_with_two_vectors(spark):
    a, b, near = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0]
    check(spark, [(1, a), (1, b), (2, near)])
    check(spark, [(None, a), (2, near), (None, b), (3, [0.0, 1.0, 0.1, 0.0]), (None, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.05])])


@pytest.mark.parametrize("kind", ["double", "float"])
def test_planted(spark, kind):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 16))
    rows = []
    for i in range(160):
        x = base[i % 8] + rng.normal(size=16) * (0.05 + 0.2 * (i % 3))
        scale = 1.0 if kind == "float" else [1.0, 1e-200, 1e250, 1e-310][i % 4]
        x = (x * scale).astype(np.float32 if kind == "float" else float)
        rows.append((None if i % 23 == 0 else i % 60, [float(v) for v in x]))
    rows += [rows[1]] * 40 + [(7, None), (None, None), (8, []), (9, [0.0] * 16), (10, [float("inf")] * 16), (11, [None] * 16), (12, [1.0] * 5), (13, [2.0] * 5), (14, [-0.0] * 16)]
    check(spark, rows, kind, part=30)
