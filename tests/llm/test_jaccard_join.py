"""The Jaccard join against brute force, in one block and in many, and its filters."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as join


def shingles(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows, percent=85):
    """Expected (doc_id, n_shingles, component_id), sorted."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for a in known:
        for b in known:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for i in known:
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((d, len(sets[i]), least.get(top(i), d) if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, families, members, words, share):
    """Families of edited copies of one text, so that some links fail and hold only through others."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(members):
            text = base[:]
            for at in rng.sample(range(words), rng.randint(0, int(words * share))):
                text[at] = rng.choice(["", f"new{rng.randint(0, 30)}", text[at].upper()])
            cut = rng.randint(0, words // 12)
            rows.append((len(rows) * 7 + 3, " ".join(text[cut:])))
    rng.shuffle(rows)
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, cls string")
    return sorted((tuple(r) for r in join.jaccard_components(df, **more).collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus(1, 12, 14, 60, 0.05) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "two words"), (9005, "Two  WORDS"), (9006, "é É x"), (9007, "é É X")]
    rows += [rows[0], rows[0], (rows[1][0], rows[5][1]), (None, rows[2][1]), (None, "two words"), (None, None)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("block, guests", [(4, 0), (7, 2)])
def test_large_buckets_in_blocks(spark, monkeypatch, block, guests):
    monkeypatch.setattr(join, "BLOCK", block)
    monkeypatch.setattr(join, "GUESTS", guests)
    rows = corpus(2, 3, 45, 50, 0.05)
    assert found(spark, rows) == plain(rows)


def test_failed_edges_are_made_good(spark, monkeypatch):
    """Sketches of a place per word tell little, so many edges of the first forest fail."""
    monkeypatch.setattr(join.Sketches, "least_difference", lambda self, i, others: np.zeros(len(others), np.int64))
    rows = corpus(3, 4, 25, 40, 0.08)
    want = plain(rows)
    assert found(spark, rows) == want
    assert len({c for _, _, c in want}) > 8


def test_threshold_is_met_exactly(spark):
    """17 of 20 shingles are 85 %; 16 of 19 are less."""
    words = [f"a{i}" for i in range(40)]
    rows = [(1, " ".join(words[:23])), (2, " ".join(words[:20])), (3, " ".join(words[20:39])), (4, " ".join(words[20:42]))]
    assert found(spark, rows) == plain(rows)
    assert dict((d, c) for d, _, c in plain(rows))[2] == 1


def test_empty_table_and_one_row(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, "one two three four five")]) == [(5, 2, 5)]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    pool = join.mix(np.arange(1, 5000, dtype=np.uint64))
    for _ in range(60):
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 700))) for _ in range(2))
        held = join.Sketches([join.sketch(x), join.sketch(y)])
        apart = len(np.setxor1d(x, y))
        assert held.least_difference(0, np.array([1]))[0] <= apart
    z = np.concatenate([x[1:], pool[:1]])
    assert join.Sketches([join.sketch(x), join.sketch(z)]).least_difference(0, np.array([1]))[0] <= 2


def test_prefixes_share_a_token_under_every_order():
    rng = np.random.default_rng(1)
    pool = join.mix(np.arange(1, 3000, dtype=np.uint64))
    codes = dict(zip(pool.tolist(), rng.integers(1, 60, len(pool)).tolist()))
    code = lambda s: np.array([codes[t] for t in s.tolist()], np.uint8)
    for _ in range(40):
        x = np.sort(rng.choice(pool, 200, replace=False))
        y = np.sort(np.concatenate([x[rng.permutation(200)[:185]], pool[rng.permutation(len(pool))[:5]]]))
        y = np.unique(y)
        common = len(np.intersect1d(x, y))
        if 100 * common >= 85 * (len(x) + len(y) - common):
            for a, b in zip(join.prefixes(x, code(x), 85), join.prefixes(y, code(y), 85)):
                assert len(np.intersect1d(a, b))
