"""I-Match fingerprints against a plain version in Python."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from corpusloom.llm.imatch import fingerprints, in_order


def plain(rows: list[tuple]) -> dict:
    """doc_id -> (n_chars, SHA-256 of the edited text), for rows with distinct ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (d, t) in enumerate(rows):
        q = len(t) // 4
        edited = t[: len(t) - q] + rows[(i + 1) % len(rows)][1][:q]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
    return out


def test_fingerprints(spark):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copied = prose(80)
    rows = [(i * 7, prose(rng.randint(40, 150))) for i in range(60)] + [(1000 + i, copied) for i in range(40)]
    rows += [(-5, None), (2000, ""), (2001, "ab"), (2002, "a" * 20000), (2**61, "𝒳y z"), (None, "no id here")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("term", F.lit("x"))
    got = fingerprints(df).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == plain(rows) and len(got) == len(rows)
    by_text: dict = {}
    texts = {d: t or "" for d, t in rows}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len({by_text[t] for t in by_text}) == len(by_text)
    long = [r for r in got if r.doc_id is not None and 0 <= r.doc_id < 59 * 7]
    assert sum(r.near_edited for r in long) > 4 * sum(r.near_next for r in long)
    assert all(r.near_next == 1.0 for r in got if r.doc_id in range(1000, 1039))


def test_repeated_rows_and_small_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (2, "i j k l")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    alone = fingerprints(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_with_sparse_ids(spark):
    ids = [(i * i * 2**40, 0, 1, 1) for i in range(500)]
    got = in_order(spark.createDataFrame(ids, "id long, h long, n int, copies long")).orderBy("id").collect()
    plain_ids = [r[0] for r in ids]
    assert [r.after.id for r in got] == plain_ids[1:] + plain_ids[:1]
    assert [r.before.id for r in got] == plain_ids[-1:] + plain_ids[:-1]


def test_repeated_rows_beside_an_equal_text(spark):
    """How often a row is repeated is no part of its fingerprint, also where it has few band terms."""
    rng = random.Random(5)
    rows = [(10 + i, " ".join(rng.sample(["the", "of", "and", "to"], 3) + [f"w{rng.randint(0, 40)}" for _ in range(12)])) for i in range(390)]
    rows += [(1, "the of and w3 w5 w7")] * 3 + [(2, "the of and w3 w5 w7")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id in (1, 2)").collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 1
