"""Whole jobs over corpus tables, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import arrays as A
from corpusloom.functions.text import char_length
from corpusloom.operators import batching as B
from corpusloom.operators.text_jobs import segment_corpus


def language_segments(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Segments of the labelled documents per language: how many, and how long."""
    labelled = documents.join(labels.select("doc_id", "quality"), "doc_id")
    rows = segment_corpus(
        labelled.select("doc_id", "lang", "quality", "text"), measure=char_length
    )
    return rows.groupBy("lang", "quality").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("n_chars").alias("chars"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
        F.round(F.avg("n_chars"), 6).alias("mean_chars"),
    )


def prepare_waveforms(
    df: DataFrame, length: int, *key: str, channels: str = "channels", seed: int = 42
) -> DataFrame:
    """Mono, peak-safe, RMS-levelled waveforms cut or padded to one length."""
    mono = A.peak_normalise(A.mono_mix(F.col(channels)))
    levelled = A.rms_normalise(F.col("speech"))
    return (
        df.withColumn("speech", mono)
        .withColumn("speech", levelled)
        .withColumn("even_samples", A.even_frames(F.size("speech")))
        .withColumn("speech", A.crop_or_pad(F.col("speech"), length, *key, seed=seed))
        .drop(channels)
    )


def align_features(df: DataFrame, ratio: int, normalise: bool = True) -> DataFrame:
    """Features and tokens cut to one length, unit speaker vectors."""
    feats, tokens = A.align_tokens_feats(F.col("speech_feat"), F.col("speech_token"), ratio)
    out = df.withColumns({"speech_feat": feats, "speech_token": tokens})
    if normalise and "embedding" in df.columns:
        out = out.withColumn("embedding", A.l2_normalise(F.col("embedding")))
    return out


def pad_batches(
    df: DataFrame,
    shard: str,
    order: str,
    length: str,
    columns: dict[str, object],
    sort_size: int = 500,
    kind: str = "dynamic",
    **options,
) -> DataFrame:
    """Length sort, batch and pad: the last stages before training.

    One row per sample with ``batch_no`` and ``in_batch``; ``collate`` makes one row per batch. All stages
    see keys and lengths only; the arrays are shuffled once, by the join that pads them.
    """
    sizes = {f"{c}_len": F.size(c) for c in columns}
    slim = df.select(F.col(shard), F.col(order), F.col(length), *[n.alias(c) for c, n in sizes.items()])
    batched = B.length_bucket_sort(slim, shard, order, length, sort_size)
    if kind == "dynamic":
        options["length"] = length
    batched = B.make_batches(batched, kind, shard, "pos", **options)
    placed = B.pad_sort_order(batched, [shard, "batch_no"], length, "pos")
    inside = W.partitionBy(shard, "batch_no")
    placed = placed.withColumns({f"_{c}": F.max(f"{c}_len").over(inside) for c in columns})
    given = placed.drop(length).withColumnsRenamed({shard: "_shard", order: "_order"})
    same = F.col(shard).eqNullSafe(F.col("_shard")) & (F.col(order) == F.col("_order"))
    return B.pad_to(df.join(given, same).drop("_shard", "_order"), columns)


def text_mel_batch(df: DataFrame, batch: list[str], n_spks: int = 1) -> DataFrame:
    """Pad symbol ids and features of a batch, features to a length that survives two halvings."""
    cut = df.withColumnRenamed("text_token", "x").withColumnRenamed("speech_feat", "y")
    feature = F.transform(F.get("y", F.lit(0)), lambda v: v * 0)
    padded = B.pad_sequences(cut, batch, {"x": 0, "y": 0.0 if _flat(cut) else feature}, {"y": 2})
    return padded if n_spks > 1 else padded.drop("spk")


def _flat(df: DataFrame) -> bool:
    return not df.schema["y"].dataType.elementType.simpleString().startswith("array")
