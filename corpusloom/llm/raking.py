"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, mix, tidy, uniform, word_hashes

#: Topics that ``with_topics`` tells apart.
TOPICS = 8
#: Stands for a null source or language, which is a value of its own.
NONE = "\u0000none"


def tokens_and_topic(text: str, topics: int = TOPICS) -> tuple[int, int]:
    """Words of the text, and the part of a hashed lexicon that most of its distinct words of four or
    more bytes are in (ties: the smaller; -1 without such words)."""
    starts, ends, hashes = word_hashes(text.encode("utf-8", "surrogatepass"))
    long = np.unique(hashes[ends - starts >= 4])
    if not len(long):
        return len(hashes), -1
    return len(hashes), int(np.argmax(np.bincount((mix(long) % np.uint64(topics)).astype(np.int64), minlength=topics)))


def measured(text_col: str = "text") -> Column:
    """``struct(n_tokens, topic)`` of a text; null texts are empty.

    Marked as not deterministic, though it is: a filter on the topic (a join on it brings one) would
    else be pushed below and measure each text a second time, in a second worker beside the task's first.
    """

    @F.pandas_udf("n_tokens long, topic int")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = np.array([tokens_and_topic(t) for t in texts], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"n_tokens": got[:, 0], "topic": got[:, 1].astype(np.int32)})
        tidy()

    return measure.asNondeterministic()(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def targets(cells: DataFrame, margin: str, keep: float, power: float) -> DataFrame:
    """``(margin, target)``: tokens wanted of each value, ``keep`` of all tokens together, in
    proportion to their tokens to the ``power``. A value is asked for no more than it has; what it
    lacks is spread over the others."""
    have = checkpointed(
        cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("have")).withColumn("share", F.pow("have", F.lit(power)))
    )
    total = have.agg(F.sum("have"), F.sum("share")).first()
    scale = keep * total[0] / total[1] if total[1] else 0.0
    while True:  # each turn, more values have reached all they have
        full = F.col("have") <= F.col("share") * F.lit(scale)
        used, left = have.agg(F.sum(F.when(full, F.col("have"))), F.sum(F.when(~full, F.col("share")))).first()
        more = (keep * total[0] - (used or 0.0)) / left if left else scale
        if more <= scale * (1 + 1e-9):
            break
        scale = more
    return have.select(margin, F.least("have", F.col("share") * F.lit(scale)).alias("target"))


def rake(cells: DataFrame, marginals: dict[str, DataFrame], rounds: int = 25, tolerance: float = 1e-3) -> DataFrame:
    """``cells`` with ``fitted``, the tokens to take from each cell.

    ``cells`` has one column per margin and ``tokens``. In turn each margin's cells are scaled to its
    ``target``; no cell gives more tokens than it has. Rounds end when no margin is off by more than
    ``tolerance`` of all wanted tokens, or when a round no longer brings them nearer (targets that
    bounded cells can't meet). Rows are cells, sums of the documents in them, so a value that holds a
    third of all documents is no more rows than other combinations; each round is checkpointed.
    """
    margins = list(marginals)
    fitted = cells.select(*margins, "tokens", F.col("tokens").cast("double").alias("fitted"))
    for m in margins:
        fitted = fitted.join(marginals[m].select(m, F.col("target").cast("double").alias(f"target_{m}")), m)
    fitted, last = checkpointed(fitted), None
    for _ in range(rounds):
        step = fitted
        for m in margins:
            now = F.sum("fitted").over(Window.partitionBy(m))
            step = step.withColumn("now", now).withColumn(f"off_{m}", F.abs(F.col("now") - F.col(f"target_{m}")))
            scaled = F.when(F.col("now") > 0, F.col("fitted") * F.col(f"target_{m}") / F.col("now")).otherwise(F.lit(0.0))
            step = step.withColumn("fitted", F.least(F.col("tokens").cast("double"), scaled)).drop("now")
        step = checkpointed(step)
        off = step.agg(F.max(F.greatest(*[F.col(f"off_{m}") for m in margins])), F.sum("fitted")).first()
        fitted = step.drop(*[f"off_{m}" for m in margins])
        worst = (off[0] or 0.0) / (off[1] or 1.0)
        if worst <= tolerance or last is not None and worst > 0.98 * last:
            break
        last = worst
    return fitted.select(*margins, "tokens", "fitted")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
          keep: float = 0.8, powers: Sequence[float] = (0.7, 0.7, 0.5), seed: int = 17) -> DataFrame:
    """All rows with ``row`` (a struct of their columns), ``n_tokens``, ``topic``, ``probability``
    (of being kept), ``weight`` (its inverse) and ``kept``.

    Tokens are words. Source, language and topic marginals are raked to targets that flatten the
    corpus: ``keep`` of all tokens, in proportion to each value's tokens to the power given. A cell's
    fitted share of its tokens is the probability of its documents, so the expected tokens of the
    sample are the fitted ones; each document is drawn by a hash of its id, alike in any run.

    Statistics cover all rows. Only cells (combinations of the three) are gathered, by partial sums,
    and joined back. Null sources and languages are values of their own. Documents without words
    don't weigh and are kept with their cell's probability, or 1 in a cell without tokens. Repeated
    rows share one draw. An empty table gives an empty table.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), measured(text_col).alias("m"))
    rows = rows.select(
        "row", F.col("m.n_tokens").alias("n_tokens"), F.col("m.topic").alias("topic"),
        F.coalesce(F.col("row")[source_col].cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("row")[lang_col].cast("string"), F.lit(NONE)).alias("lang"),
        F.col("row")[id_col].alias("drawn_by"),
    )
    margins = ("source", "lang", "topic")
    cells = checkpointed(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")))
    fitted = rake(cells, {m: targets(cells, m, keep, p) for m, p in zip(margins, powers)})
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("fitted") / F.col("tokens"))).otherwise(F.lit(1.0))
    fitted = fitted.select(*margins, chance.alias("probability"))
    return rows.join(fitted, list(margins)).select(
        "row", "n_tokens", "topic", "probability", (1 / F.col("probability")).alias("weight"),
        (uniform(seed, "drawn_by") < F.col("probability")).alias("kept"),
    )


def sample(df: DataFrame, **options) -> DataFrame:
    """The rows that ``mixed`` keeps, with their own columns."""
    return mixed(df, **options).where("kept").select("row.*")
