"""Spelling variants against brute force over the whole vocabulary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import variants

LOWERED = str.maketrans(variants.UPPER, variants.LOWER)


def plain_words(rows, every):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=5):
    beside = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, xs in beside.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(beside[w]), words.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def texts(seed, n=60):
    rng = random.Random(seed)
    stems = ["kestrel", "márquez", "ÿvonne", "windmill", "letters", "betters", "llamas", "straße", "×cross÷", "bookkeeper", "aaaaaa", "aaaaaaa"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(200):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "é", "z", "ll", w[at].upper()]) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "_"]).join(words)))
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    return sorted((tuple(r) for r in variants.variants_of(df, **more).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("every", [None, 7, 199])
def test_matches_brute_force(spark, every):
    rows = texts(1) + [(3, None), (4, ""), (None, "kestrel " * 3), (None, None), *texts(1)[:2]]
    want = plain(plain_words(rows, every))
    assert found(spark, rows, every=every) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want) == any(r[1] and dict((x[0], x[1]) for x in want)[r[1]] for r in want)


def test_many_shards_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(variants, "SHARD", 7)
    monkeypatch.setattr(variants, "BROADCAST", 9)
    rows = texts(2)
    words = plain_words(rows, None)
    assert len(variants.Layout(dict(Counter(map(len, words)))).rounds) > 3
    assert found(spark, rows) == plain(words)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 700
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "bbbbbbx": 10, "bbbbbby": 10, "bbbbbb": 2, "cccccc": 9, long: 50, long + "c": 5, long[1:]: 300}
    df = spark.createDataFrame(list(words.items()) + [(None, 4)], "word string, n long")
    got = sorted((tuple(r) for r in variants.spelling_variants(df).collect()), key=lambda r: r[0])
    assert got == plain(words)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][2] == "aaabbb" and by["bbbbbb"][1] == "bbbbbbx" and by[long + "c"][2] == long[1:] == by[long][1]


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "short words only here and there")]) == []


def test_edits_have_the_hash_of_the_edited_word():
    word = "zebrañ"
    letters = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.uint64).reshape(1, -1)
    whole = lambda w: int(variants.weights(np.arange(len(w)), np.frombuffer(w.encode("latin-1"), np.uint8).astype(np.uint64)).sum(dtype=np.uint64))
    got = {(size, int(h)) for size, _, hashes in variants.edits(letters) for h in hashes}
    alphabet = [chr(int(c)) for c in variants.ALPHABET]
    want = {(5, whole(word[:i] + word[i + 1 :])) for i in range(6)}
    want |= {(6, whole(word[:i] + c + word[i + 1 :])) for i in range(6) for c in alphabet if c > word[i]}
    assert got == want
