"""The pipeline's stages on planted documents, and its tokens against plain Python."""

from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import toxicity
from corpusloom.llm.common import table
from tests.llm.test_suffix_dedup import brute

FOLDER = "/root/testdata/sf0.001"


def planted(spark, docs):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfglmprst" for b in "aeiou" for c in "nrstl"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(10_000 + i, f"{prose(80)} {passage} {prose(40)}") for i in range(20)]
    base = prose(200).split()
    for i in range(15):
        copy = base[:]
        copy[rng.randrange(200)] = "edited"
        rows.append((20_000 + i, " ".join(copy)))
    rows += [(30_000, None), (30_001, ""), (30_002, "short")]
    more = spark.createDataFrame([(d, t, rng.choice(["en", None]), "src1", len(t or "")) for d, t in rows], docs.schema)
    return docs.unionByName(more), rows, passage


def test_stages(spark, tmp_path):
    docs, rows, passage = planted(spark, table(spark, FOLDER, "documents"))
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        tables[name] = docs
        if name != "bpe":
            assert tuple(docs.columns) == corpus_pipeline.DOCUMENTS
    ids = {name: {r.doc_id for r in t.select("doc_id").collect()} for name, t in tables.items()}
    clean = {d for d, _ in rows if d < 20_000}
    labels = table(spark, FOLDER, "labels")
    toxic = {r.doc_id for r in labels.where("toxic = 1").where(~toxicity.held_out()).collect()}
    kept = ids["toxicity"]
    assert clean <= kept and len(toxic & kept) <= 0.3 * len(toxic)
    near = ids["simhash_near_dedup"]
    assert clean <= near and {d for d in near if 20_000 <= d < 30_000} == {20_000}
    left = {r.doc_id: r for r in tables["suffix_array_dedup"].collect()}
    assert set(left) == near
    assert [d for d in sorted(clean) if passage in left[d].text] == [10_000]
    before = [(r.doc_id, r.text) for r in tables["simhash_near_dedup"].collect()]
    for d, _, n_removed, _, body in brute(before, 50):
        assert len((left[d].text or "").encode()) >= len(body) and left[d].n_chars == len(left[d].text or "")
        if not n_removed or (left[d].text or "").isascii() and left[d].text.encode() == body:
            assert (left[d].text or "").encode() == body
    assert ids["mixing"] <= near and len(ids["mixing"]) > 0.5 * len(near)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    texts = {r.doc_id: r.text or "" for r in tables["mixing"].collect()}
    for r in tables["bpe"].collect():
        assert r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, FOLDER, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_repeated_rows_and_extra_columns(spark):
    docs = table(spark, FOLDER, "documents").limit(20).withColumn("topic", F.lit(1)).withColumn("owner", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs_out = stage(spark, docs.union(docs), FOLDER)
        assert tuple(docs_out.columns) == corpus_pipeline.DOCUMENTS and docs_out.count() % 2 == 0
