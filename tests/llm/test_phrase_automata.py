"""Repeated word windows against a plain dictionary of windows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.phrase_automata import drop_repeated_phrases


def brute(rows: list[tuple], length: int) -> list[tuple]:
    first, split = {}, []
    for d, t in rows:
        key, words = (-(1 << 63) if d is None else d), re.findall(r"[^\x20\x09-\x0D]+", t or "")
        split.append((d, key, words))
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            first[w] = min((key, i), first.get(w, (key, i)))
    out = []
    for d, key, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < (key, i):
                gone[i : i + length] = [True] * length
        out.append((d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_drop_repeated_phrases(spark, seed):
    rng = random.Random(seed)
    some = ["the", "of", "ané", "x y", "The", "the,", " ", "\x1c", "a", "b"]
    prose = lambda n: "".join(rng.choice(some) + rng.choice([" ", "\n", " \t", "\x0b"]) for _ in range(n))
    shared, copied = prose(50), prose(70)
    rows = [(i, prose(rng.randint(0, 40)) + rng.choice(["", shared, shared.replace("\n", " "), shared[20:]]) + prose(9)) for i in range(60)]
    rows += [(100 + i, copied) for i in range(20)] + [(200, "la " * 90), (201, shared + prose(3) + shared), (202, "w " * 19), (203, "v " * 20)]
    rows += [(300, None), (301, ""), (302, "  \n"), (305, shared), (305, shared), (None, shared), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("rest", F.lit("x"))
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in drop_repeated_phrases(df).collect()]
    assert sorted(found, key=repr) == brute(rows, 20)


def test_empty_table(spark):
    assert drop_repeated_phrases(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_of_one_polynomial_hash(spark):
    """A Thue-Morse word and its complement, of 2,048 letters, have equal polynomials modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"w{i}" for i in range(19))
    rows = [(d, f"{common} {word if d % 2 else other}") for d in range(2, 4)] + [(7, f"x{word} {common}")]
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in drop_repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=repr) == brute(rows, 20) and all(n == 0 for _, _, n, _ in found)


def test_rows_of_one_id_with_different_texts(spark):
    """Different passages may begin at one place of one id, and an id's first place may be in any of its rows."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))
    shared = [prose(30) for _ in range(40)]
    rows = [(5, s) for s in shared] + [(100 + i, f"{prose(3)} {s}") for i, s in enumerate(shared)]
    rows += [(50, f"{prose(rng.randrange(9))} {late} {prose(2)}") for late in [prose(25) for _ in range(30)] for _ in range(6)]
    rows += [(None, s) for s in shared[:3]] + [(None, f"x {s}") for s in shared[:6]]
    rng.shuffle(rows)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in drop_repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=repr) == brute(rows, 20)


def test_windows_that_recur_within_one_run(spark):
    """A few words again and again, in one place of the whole table: the windows share one key there only."""
    rows = [(1, "one " * 23), (2, "x y z " + "two three " * 13 + "u v w"), (3, " ".join(f"w{i}" for i in range(40)) + " four" * 21), (4, "five " * 20)]
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in drop_repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=repr) == brute(rows, 20) and [n for _, _, n, _ in sorted(found)] == [22, 24, 20, 0]
