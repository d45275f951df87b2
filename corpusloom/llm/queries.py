"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, imatch, jaccard_join, multi_index, phrase_automata, raking, simhash, suffix_dedup, toxicity, variants, whitening, wrappers
from corpusloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations in windows, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_windows(turns.unionByName(more)))


@query()
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.drop_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op3_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return multi_index.search(rows, rows.where("vec_id % 20 = 0"))


@query()
def op4_phrase_automata(spark: SparkSession, folder: str) -> DataFrame:
    left = phrase_automata.drop_repeated_phrases(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op5_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return bpe.digests(bpe.encode(documents, public_tokenizers.path("word_bpe_49k.json")))


@query()
def op6_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


@query()
def op7_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


@query()
def op8_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


@query()
def op9_raking(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its chance, and whether it is drawn."""
    rows = raking.mixed(table(spark, folder, "documents"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.lang").alias("lang"),
        "topic", "n_tokens", "probability", "weight", "kept",
    )


@query()
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(documents, toxicity.train_rows(labels))
    return toxicity.score(documents, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "offending"
    )


@query()
def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query()
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query()
def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words with their variants; a run in 199 is misspelt, by a hash of its document and itself."""
    return variants.variants_of(table(spark, folder, "documents"), every=199)


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
