"""Chunked BPE against the tokenizers library, chat windows read back, toxicity held out."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, chat, toxicity
from corpusloom.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def odd_texts() -> list[str | None]:
    rng = random.Random(1)
    parts = ["the ", "Éclaiŕ ", "x" * 900, "  \n\t", " ", " a", "<|endoftext|>", "it's ", "I'LL", "123456 ", "日本語", "𝒳", "\x00", "\x1c", "\x85", "ΣΑΣ ", "İ", "ﬁ", "é"]
    mixed = ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 5, 40, 300, 900) for _ in range(6)]
    shared = "".join(rng.choice(["word ", "other ", "thing, "]) for _ in range(3000))
    return [None, "", " ", "a" * 30000, "é" * 20000, shared, "pre" + shared, shared[5:] + "post", shared.replace(" ", ""), *mixed]


def test_bpe_equals_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(
        table(spark, SMALL, "documents").select((F.col("doc_id") + 10000).alias("doc_id"), "text")
    )
    given = {r.doc_id: r.text or "" for r in df.collect()}
    got = bpe.digests(bpe.encode(df, PATH)).collect()
    assert len(got) == len(given)
    for r in got:
        ids = tok.encode(given[r.doc_id], add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids), (r.doc_id, given[r.doc_id][:80])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), given[r.doc_id][:80]
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_chunks_depend_on_their_surroundings_only():
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefghij é") for _ in range(60000)).encode()
    assert b"".join(bpe.cut(body)) == body
    later = set(bpe.cut(b"a new beginning " * 20 + body))
    assert len(later & set(bpe.cut(body))) >= len(bpe.cut(body)) - 2


@pytest.mark.parametrize("budget, history", [(2048, 256), (40, 10), (5, 0)])
def test_chat_windows(spark, budget, history):
    rng = random.Random(3)
    texts = ["", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>", "<\\s>", "<\\\\/s>", "plain words " * 9, "é𝒳\n"]
    rows = [(c, t, rng.choice(["user", "assistant"]) if t else "system", rng.choice(texts)) for c in range(30) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "x"), (50, None, None, "y"), (50, 1, "assistant", "z"), (50, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    windows = chat.format_windows(df, budget=budget, history=history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by_conv: dict = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), want)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        assert w.n_tokens <= budget or w.n_turns == 1
        if w.window_no and w.n_repeated and any(t[2] == "system" for t in by_conv[w.conv_id][:1]):
            assert chat.parse(w.formatted)[0][0] == "system"


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(documents, toxicity.train_rows(labels))
    got = toxicity.score(documents, model).join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    right = (got.predicted == got.toxic).mean()
    assert right >= 0.93 and got.score.between(0, 1).all()
    order = got.score.rank()
    y = got.toxic.to_numpy()
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc >= 0.95
    kept = toxicity.drop_toxic(documents, model)
    assert kept.columns == documents.columns


def test_toxicity_of_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50000), (None, "x")], "doc_id long, text string")
    got = toxicity.score(df, toxicity.train(df, empty)).collect()
    assert len(got) == 4 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in got)
    assert np.isfinite([r.score for r in got]).all()


def made_documents(rng):
    """Clean and toxic texts: short sentences of 800 words, a toxic one has three of ten words."""
    words = [a + b + c for a in "bdfglmprst" for b in "aeiou" for c in ("n", "rst", "ck", "m", "sh", "ld", "p", "w") for _ in (0, 1)]
    bad = [f"zq{a}x" for a in "abcdefghij"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(12)) + "."
    toxic = lambda: " ".join(rng.sample(bad, 3) + [rng.choice(words)]) + "."
    text = lambda: " ".join(sentence() for _ in range(rng.randint(5, 40)))
    return text, toxic


def test_toxicity_does_not_rise_with_length():
    rng = random.Random(4)
    text, toxic = made_documents(rng)
    texts = [text() for _ in range(600)] + [f"{text()} {toxic()} {text()}" for _ in range(150)]
    labels = np.array([0] * 600 + [1] * 150)
    model = toxicity.train_from([toxicity.features(t)[:2] for t in texts], labels, 0.1)
    fresh = [text() for _ in range(700)]
    assert max(map(model.score, fresh)) < 0.5
    for size in (100_000, 1_000_000, 10_000_000):
        clean = " ".join(fresh * (size // len(" ".join(fresh)) + 1))[:size]
        assert model.score(clean) < 0.1
    half = len(clean) // 20
    found = model.offending(f"{clean[:half]}. {(one := toxic())} {clean[half : 2 * half]}", 0.5)
    assert len(found) == 1 and one.split()[0] in f"{clean[:half]}. {one} "[found[0]["start"] : found[0]["end"]]
    assert model.score(f"{clean[:half]}. {one} {clean[half : 2 * half]}") >= 0.5
    unlabelled = toxicity.train_from([], np.array([]), 1.0)
    assert unlabelled.score(clean) < 0.5
    assert model.score("word " * 2_000_000) < 0.5


@pytest.mark.parametrize("label", [0, 1])
def test_toxicity_with_a_huge_labelled_document(spark, label):
    rng = random.Random(5)
    text, toxic = made_documents(rng)
    ids = spark.range(400).orderBy(F.xxhash64("id", F.lit(11))).toPandas()["id"].tolist()
    made = [(i, f"{text()} {toxic()}" if k % 2 else text(), k % 2) for k, i in enumerate(ids)]
    huge = next(k for k, m in enumerate(made) if m[2] == label)
    made[huge] = (made[huge][0], " ".join(text() for _ in range(1500)) + (toxic() if label else ""), label)
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df, sample_words=200_000)
    assert sum(model.score(f"{text()} {toxic()}") >= 0.5 for _ in range(50)) >= 45
    assert sum(model.score(text()) >= 0.5 for _ in range(50)) <= 2
