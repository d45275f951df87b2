"""Joins between corpus tables.

Dimensions go through ``lookup``, which counts them before they are broadcast. Other joins leave
the choice to Spark: it broadcasts a side whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.lookup import lookup
from corpusloom.operators.ordered import hash_int

# What counts as a word and as a Chinese character.
EN_WORD = "[A-Za-z]+(?:'[A-Za-z]+)?"
ZH_CHAR = "[一-鿿]"


def attach_transcripts(audio: DataFrame, sidecar: DataFrame, asr: DataFrame) -> DataFrame:
    """Non-blank sidecar text, else the recognised text; audio with neither is dropped."""

    def said(df: DataFrame, name: str) -> DataFrame:
        text = strip(F.col("text"))
        return df.select("stem", F.when(text != "", text).alias(name))

    return (
        audio.join(said(sidecar, "_side"), "stem", "left")
        .join(said(asr, "_asr"), "stem", "left")
        .withColumn("text", F.coalesce("_side", "_asr"))
        .withColumn("text_from", F.when(F.col("_side").isNotNull(), "sidecar").otherwise("asr"))
        .drop("_side", "_asr")
        .filter(F.col("text").isNotNull())
    )


def lookup_speaker(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requests with their speaker's columns; no speaker means the first id in sorted order."""
    first = catalogue.agg(F.min("speaker_id")).scalar()
    asked = F.when(F.trim("speaker_id") != "", F.col("speaker_id"))
    return lookup(requests.withColumn("speaker_id", F.coalesce(asked, first)), catalogue, "speaker_id", "inner", 20_000)


def unknown_speakers(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requests that name a speaker the catalogue does not have."""
    named = requests.filter(F.trim("speaker_id") != "")
    return named.join(catalogue.select("speaker_id"), "speaker_id", "left_anti")


def _swap(
    df: DataFrame,
    key: str,
    text: str,
    pattern: str,
    least: int,
    lexicon: DataFrame,
    specials: DataFrame,
    seed: int,
) -> DataFrame:
    """Replace up to two matches of ``pattern``, picked by hash, by their bracketed phones.

    The text is cut into matches and gaps once; the two picks are looked up in the lexicon, and
    texts are not shuffled for it while that is small enough to broadcast.
    """
    phones = (
        lexicon.groupBy(F.lower("word").alias("word"))
        .agg(F.min("phones").alias("phones"))
        .select("word", F.posexplode("phones").alias("_i", "_p"))
        .withColumn("marker", F.concat(F.lit("["), "_p", F.lit("]")))
        .join(specials.select("marker").distinct(), "marker", "left_semi")
        .groupBy("word")
        .agg(F.array_sort(F.collect_list(F.struct("_i", "marker"))).alias("_m"))
        .select(
            "word",
            F.concat(F.lit(" "), F.array_join(F.col("_m.marker"), ""), F.lit(" ")).alias("_rep"),
        )
    )
    c = F.col(text)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    n = F.size("_found")
    one = (hash_int(key, F.lit("a"), seed=seed) % n).cast("int")
    other = (hash_int(key, F.lit("b"), seed=seed) % (n - 1)).cast("int")
    out = df.withColumn("_found", F.when(c.rlike(pattern), found).otherwise(F.array())).withColumns(
        {
            "_one": F.when(n >= least, one),
            "_two": F.when(n >= 2, other + (other >= one).cast("int")),
        }
    )
    for name in ("_one", "_two"):
        hit = phones.select(F.col("word").alias(f"{name}_w"), F.col("_rep").alias(f"{name}_r"))
        out = out.withColumn(f"{name}_w", F.lower(F.get("_found", F.col(name))))
        out = lookup(out, hit, f"{name}_w")

    def place(word: Column, i: Column) -> Column:
        return (
            F.when((i == F.col("_one")) & F.col("_one_r").isNotNull(), F.col("_one_r"))
            .when((i == F.col("_two")) & F.col("_two_r").isNotNull(), F.col("_two_r"))
            .otherwise(word)
        )

    words = F.concat(F.transform("_found", place), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(c, pattern, -1), words, lambda g, w: F.concat(g, w)), "")
    changed = F.col("_one_r").isNotNull() | F.col("_two_r").isNotNull()
    return out.withColumn(text, F.when(changed, joined).otherwise(c)).withColumn(
        "_changed", changed
    ).drop(*[f"{n}{s}" for n in ("_one", "_two") for s in ("", "_w", "_r")], "_found")


def phone_substitution(
    df: DataFrame,
    lexicon: DataFrame,
    specials: DataFrame,
    key: str,
    text: str = "text",
    zh_lexicon: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """At most two English words become bracketed phones; a text that stays unchanged may get
    two of its Chinese characters replaced instead.

    ``lexicon``: ``word, phones`` (the least of several pronunciations is used); ``specials``:
    ``marker`` (the bracketed phones that exist).
    """
    out = _swap(df, key, text, EN_WORD, 1, lexicon, specials, seed)
    if zh_lexicon is None:
        return out.drop("_changed")
    done = out.withColumnRenamed("_changed", "_en")
    held = done.withColumn("_keep", F.when(F.col("_en"), F.col(text)))
    held = _swap(held, key, text, ZH_CHAR, 2, zh_lexicon, specials, seed)
    return held.withColumn(text, F.coalesce("_keep", text)).drop("_keep", "_en", "_changed")


def pair_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "utt") -> DataFrame:
    """Chosen sequences, then rejected ones, both with the text of the pair."""
    pairs = chosen.select(key, "text", F.col("speech_token").alias("_c")).join(
        rejected.select(key, F.col("speech_token").alias("_r")), key
    )
    sides = F.posexplode(F.array("_c", "_r")).alias("_i", "speech_token")
    side = F.when(F.col("_i") == 0, "chosen").otherwise("rejected").alias("side")
    return pairs.select(key, "text", sides).select(key, side, "text", "speech_token")


def pair_train_eval(
    metrics: DataFrame, run: str, logging_steps: int, eval_steps: int
) -> DataFrame:
    """Align positive training and evaluation losses on their computed step.

    ``metrics`` has ``kind`` (train or eval), ``step`` (ordinal from 1 inside run and kind),
    ``value``.
    """
    good = metrics.filter(F.col("value") > 0)

    def series(kind: str, step: Column, name: str) -> DataFrame:
        return good.filter(F.col("kind") == kind).select(
            run, step.alias("step"), F.col("value").alias(name)
        )

    train = series("train", (F.col("step") - 1) * logging_steps, "loss")
    evals = series("eval", F.col("step") * eval_steps, "eval_loss")
    return train.join(evals, [run, "step"], "full")
