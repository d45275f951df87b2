"""Multi-index search: exact scores and order, recall against brute force, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from corpusloom.llm.multi_index import MultiIndex, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], query: int, top: int) -> list[tuple]:
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows if usable(x)}
    scores = sorted(((-float((v[query] * x).sum()), i) for i, x in v.items() if i != query))
    return [(i, -s) for s, i in scores[:top]]


def usable(x) -> bool:
    return x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x)


def test_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)] + [(1000 + i, [1.0] * 16) for i in range(300)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    asked = df.where("vec_id % 20 = 0")
    got = search(df, asked, least=400, shard_rows=100).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i, x in rows if i % 20 == 0 and usable(x)}
    hits = total = 0
    for q, have in found.items():
        want = brute(rows, q, 20)
        assert [r for r, _ in enumerate(have)] == list(range(20)) and have == sorted(have, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in have} & {i for i, _ in want})
        total += len(want)
    assert hits / total >= 0.9
    best = [i for i, _ in found[1000]]
    assert best == brute_ids(rows, 1000, best)


def brute_ids(rows, query, like) -> list[int]:
    """Ties go to the smaller id."""
    return [i for i, _ in brute(rows, query, len(like))]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_small_tables(spark, n):
    df = spark.createDataFrame([(i * 20, [1.0, float(i)], 0) for i in range(n)], SCHEMA)
    got = search(df, df).collect()
    assert len(got) == n * (n - 1)


def test_traverse_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    index = MultiIndex(rng.normal(size=(5, 3)), rng.normal(size=(4, 3)))
    index.counts[:] = 1
    q = rng.normal(size=6)
    order = index.traverse(q, 20)
    sums = [-(index.left[c // 4] @ q[:3] + index.right[c % 4] @ q[3:]) for c in order]
    assert sorted(order) == list(range(20)) and sums == sorted(sums)
