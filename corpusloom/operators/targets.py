"""Training targets for speech-token models, as array expressions.

``IGNORE`` marks positions without a target. Special ids are offsets from the number of speech
tokens and are passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordered import hash_int

# The ignored label and the text : speech interleaving.
IGNORE = -1
MIX_TEXT, MIX_SPEECH = 5, 15


def ignored(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_repeat(F.lit(IGNORE), n.cast("int"))


def lm_targets_v1(text_len: Column, speech: Column, end: int) -> Column:
    return F.concat(ignored(text_len + 2), speech, F.array(F.lit(end)))


def lm_targets_unistream(text_len: Column, speech: Column, eos: int) -> Column:
    return F.concat(ignored(text_len + 1), speech, F.array(F.lit(eos)))


def lm_targets_bistream(text_len: Column, speech: Column, eos: int, fill: int) -> Column:
    """Blocks of 5 text and 15 speech positions, then the rest and the end mark."""
    blocks = F.ceil((text_len + 1) / MIX_TEXT).cast("int")

    def block(j: Column) -> Column:
        full = (j + 1) * MIX_TEXT <= text_len
        rest = F.slice(speech, j * MIX_SPEECH + 1, F.size(speech))
        return F.when(
            full,
            F.concat(
                ignored(MIX_TEXT - 1),
                F.slice(speech, j * MIX_SPEECH + 1, F.lit(MIX_SPEECH)),
                F.array(F.lit(fill)),
            ),
        ).otherwise(F.concat(ignored(text_len - j * MIX_TEXT), rest, F.array(F.lit(eos))))

    return F.concat(
        ignored(1), F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), block))
    )


def lm_targets_mixed(
    text_len: Column, speech: Column, eos: int, fill: int, *key: Column | str, seed: int = 42
) -> Column:
    """Interleaved form for half of the rows whose speech is long enough, else the plain form."""
    coin = hash_int(*key, seed=seed) % 2 == 0
    long_enough = F.size(speech) > text_len * (MIX_SPEECH / MIX_TEXT)
    return F.when(coin & long_enough, lm_targets_bistream(text_len, speech, eos, fill)).otherwise(
        lm_targets_unistream(text_len, speech, eos)
    )


def lm_targets_multihead(
    df: DataFrame, text_len: Column, speech: Column, eos: int, heads: int = 5
) -> DataFrame:
    """One row per head; head ``c`` predicts ``c`` tokens further ahead."""
    head = F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head")
    c = F.col("head")
    target = F.concat(
        ignored(text_len + 1),
        F.slice(speech, c + 1, F.size(speech)),
        F.array(F.lit(eos)),
        ignored(c),
    )
    return df.select("*", head).withColumn("target", target)


def length_bounds(text_len: Column, low: float = 2, high: float = 20) -> tuple[Column, Column]:
    return (text_len * low).cast("bigint"), (text_len * high).cast("bigint")
