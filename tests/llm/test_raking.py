"""Iterative proportional fitting against numpy, and the drawn sample against its targets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.raking import mixed, rake, sample, tokens_and_topic


def plain_rake(tokens: np.ndarray, marginals: list[np.ndarray], rounds: int = 25) -> np.ndarray:
    fitted = tokens.astype(float)
    for _ in range(rounds):
        for axis, target in enumerate(marginals):
            others = tuple(i for i in range(tokens.ndim) if i != axis)
            now = fitted.sum(axis=others)
            scale = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            shape = [-1 if i == axis else 1 for i in range(tokens.ndim)]
            fitted = np.minimum(tokens, fitted * scale.reshape(shape))
    return fitted


def filled(have: dict, total: float, power: float) -> dict:
    """Targets by bisection of the common factor."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(n, mid * n**power) for n in have.values()) < total:
            low = mid
        else:
            high = mid
    return {s: min(n, low * n**power) for s, n in have.items()}


def test_rake(spark):
    rng = np.random.default_rng(5)
    tokens = rng.integers(200, 900, (4, 3, 2))
    targets = [0.5 * tokens.sum() * w / w.sum() for w in (rng.uniform(0.8, 1.2, n) for n in tokens.shape)]
    cells = [(f"s{i}", f"l{j}", k, int(tokens[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    frames = {
        "source": spark.createDataFrame([(f"s{i}", float(t)) for i, t in enumerate(targets[0])], "source string, target double"),
        "lang": spark.createDataFrame([(f"l{i}", float(t)) for i, t in enumerate(targets[1])], "lang string, target double"),
        "topic": spark.createDataFrame([(i, float(t)) for i, t in enumerate(targets[2])], "topic int, target double"),
    }
    got = rake(spark.createDataFrame(cells, "source string, lang string, topic int, tokens long"), frames, tolerance=1e-9).collect()
    want = plain_rake(tokens, targets)
    for r in got:
        assert r.fitted == pytest.approx(want[int(r.source[1:]), int(r.lang[1:]), r.topic], rel=1e-4)


def test_sample_meets_targets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        source = rng.choices(["a", "b", "c", None], [12, 4, 2, 1])[0]
        lang = rng.choices(["en", "de", None], [8, 3, 1])[0]
        rows.append((i, " ".join(rng.choice(["house", "river", "stone", "x", "letter", "forest"]) for _ in range(rng.randint(0, 40))), lang, source, 7))
    rows += [(5000, None, None, None, 7), (5001, "", "en", "a", 7), (None, "some words here", "en", "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int")
    got = mixed(df, keep=0.5).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    total = sum(r.n_tokens for r in got)
    expected = sum(r.n_tokens * r.probability for r in got)
    drawn = sum(r.n_tokens for r in got if r.kept)
    assert expected == pytest.approx(0.5 * total, rel=0.03) and drawn == pytest.approx(expected, rel=0.1)
    have: dict = {}
    for r in got:
        x = have.setdefault(r.row.source, [0, 0.0])
        x[0] += r.n_tokens
        x[1] += r.n_tokens * r.probability
    want = filled({s: n for s, (n, _) in have.items()}, 0.5 * total, 0.7)
    for s, (_, fitted) in have.items():
        assert fitted == pytest.approx(want[s], rel=0.03)
    kept = sample(df, keep=0.5)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.row.doc_id for r in got if r.kept}
    assert sample(df.limit(0)).count() == 0
    assert mixed(df.where("doc_id = 5000")).first().probability == 1.0


def test_tokens_and_topic():
    assert tokens_and_topic("") == (0, -1) and tokens_and_topic(" a bc\n") == (2, -1)
    n, topic = tokens_and_topic("house house house")
    assert n == 3 and 0 <= topic < 8 and tokens_and_topic("house")[1] == topic


def test_repeated_rows_share_a_draw(spark):
    df = spark.createDataFrame([(1, "some text here", "en", "a")] * 20, "doc_id long, text string, lang string, source string")
    assert mixed(df).select(F.countDistinct("kept")).first()[0] == 1


def test_texts_are_measured_once_a_task(spark):
    """The join on the topic asks for a topic that is not null; that filter must not measure the texts again."""
    rows = [(i, "house river stone", "en", "a", 17) for i in range(20)]
    drawn = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    assert drawn._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
