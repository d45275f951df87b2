"""Suffix-array dedup against a plain search for strings."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.collection_bwt import CollectionBwt
from corpusloom.llm.suffix_dedup import drop_repeats, joined, whole_characters


def brute(rows: list[tuple], length: int) -> list[tuple]:
    least = {}
    bodies = [((-(1 << 63) if d is None else d), (t or "").encode()) for d, t in rows]
    for d, b in bodies:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(d, least.get(s, d))
    out = []
    for (d, b), (doc_id, _) in zip(bodies, rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "aneréd", "thing", "é", "tion\n", "\x00", "aaaa"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, copied = prose(40), prose(60)
    rows = [(i, prose(rng.randint(0, 30)) + rng.choice(["", shared, shared[7:150], shared[:90]]) + prose(5)) for i in range(60)]
    rows += [(100 + i, copied) for i in range(20)] + [(200, "a" * 700), (201, "b" + "a" * 400)]
    rows += [(300, None), (301, ""), (302, "x" * 49), (303, "y" * 50), (304, "y" * 50), (305, shared), (305, shared), (None, shared)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_drop_repeats(spark, seed):
    rows = texts(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("body", F.lit("x"))
    got = drop_repeats(df)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=repr) == brute(rows, 50)
    assert {"chunk", "body", "doc_id"} == set(got.schema["rest"].dataType.names)


def test_removed_stretches_take_no_memory_by_byte():
    """Stretches joined within a text and drawn back to whole characters, against a flag for every byte."""
    rng = random.Random(3)
    bodies = [("".join(rng.choice(["a", "é", "漢", "𝄞"]) for _ in range(n))).encode() for n in (0, 40, 1, 0, 300, 80)]
    raw, stops = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([len(b) for b in bodies])
    for _ in range(200):
        own = rng.choices([1, 2, 4, 5], k=rng.randrange(12))
        cuts = [sorted(rng.sample(range(stops[i - 1], stops[i] + 1), 2)) if len(bodies[i]) else None for i in own]
        begin, end = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))
        flags, head = np.zeros(len(raw), bool), (raw & 0xC0) != 0x80
        for a, b in cuts:
            flags[a:b] = True
        char = np.cumsum(head) - 1
        whole = np.array([flags[char == char[i]].all() for i in range(len(raw))], bool)
        begin, end, owner = joined(begin, end, np.array(own, np.int64))
        edge = set(stops.tolist())
        assert all(b < a or b in edge for b, a in zip(end, begin[1:])) and (np.diff(owner) >= 0).all()
        assert sorted(i for a, b in zip(begin, end) for i in range(a, b)) == np.flatnonzero(flags).tolist()
        begin, end = whole_characters(raw, begin, end, stops[owner])
        assert sorted(i for a, b in zip(begin, end) for i in range(a, b)) == np.flatnonzero(whole).tolist()
    raw = np.full(4 << 20, 0x61, np.uint8)
    begin = np.arange(0, 4 << 20, 1 << 12)
    tracemalloc.start()
    begin, end, owner = joined(begin, begin + 100, begin >> 20)
    whole_characters(raw, begin, end, (owner + 1) << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(raw) // 4


def test_whole_characters_and_empty_table(spark):
    rows = [(1, "é" * 60), (2, "x" + "é" * 60 + "y"), (3, "z" * 10)]
    got = {r.doc_id: bytes(r.kept).decode() for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), characters=True).collect()}
    assert got == {1: "é" * 60, 2: "xy", 3: "z" * 10}
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block, held", [(7, 30), (64, 1 << 20), (1 << 16, 1 << 20)])
def test_suffix_list(block, held):
    rng = random.Random(block)
    for _ in range(25):
        given = [bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        lens = np.array([len(x) for x in given], np.int64)
        built = CollectionBwt(np.frombuffer(b"".join(given), np.uint8), np.cumsum(lens) - lens, lens, block, held)
        suffix = [(int(x) >> 8, int(x) & 255) for x in built.columns["suffix"]]
        rows = [given[o][len(given[o]) - d :] for o, d in suffix]
        assert rows == sorted(x[i:] for x in given for i in range(len(x) + 1))
        common = [next((n for n, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))) for a, b in zip(rows, rows[1:])]
        assert built.columns["lcp"].tolist()[1:] == common
        before = [given[o][-d - 1] if d < len(given[o]) else 255 for o, d in suffix]
        assert built.columns["bwt"].tolist() == before
