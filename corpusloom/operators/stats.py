"""Aggregations. Sums, counts and means are partial aggregates, so a hot key costs one buffer
per task; vectors are averaged by (key, position), never collected whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions.arrays import energy, l2_norm, total
from corpusloom.functions.bind import running
from corpusloom.operators.ordered import SPAN, with_halo, with_ordinal

#: Rows that a task of ``nucleus_candidates`` keeps before it gives them out.
HELD = 1 << 19


def length_profile(df: DataFrame, order: str, first: int = 100) -> DataFrame:
    """Token and feature lengths over the first rows."""
    head = df.orderBy(order).limit(first)
    tokens, frames = F.size("speech_token"), F.col("speech_feat_len")
    return head.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(tokens).alias("token_avg"),
        F.min(tokens).alias("token_min"),
        F.max(tokens).alias("token_max"),
        F.avg(frames).alias("feat_avg"),
        F.min(frames).alias("feat_min"),
        F.max(frames).alias("feat_max"),
        F.min_by(F.size("embedding"), order).alias("embedding_dim"),
    )


def feature_mean_std(df: DataFrame, feat: str = "speech_feat", *, nested: bool = True) -> DataFrame:
    """Global mean and population deviation over all values of a feature column."""
    flat = F.flatten(feat) if nested else F.col(feat)
    sums = df.select(
        total(flat).alias("s"), energy(flat).alias("q"), F.size(flat).cast("bigint").alias("n")
    ).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.try_divide("s", "n")
    return sums.select(
        "n", mean.alias("mean"), F.sqrt(F.try_divide("q", "n") - mean * mean).alias("std")
    )


def mean_vector(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean per key with row count, dimension and norm; null vectors are skipped.

    Fails when the vectors of a key differ in dimension.
    """
    given = df.filter(F.col(vector).isNotNull())
    cells = (
        given.select(key, F.posexplode(vector).alias("pos", "v"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("c"))
    )
    # one row per (key, position): the list below has as many entries as the vector
    mean = cells.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(
            "mean"
        ),
        F.max("c").alias("n"),
        F.min("c").alias("_least"),
    )
    wrong = F.raise_error(F.lit("vectors of one key differ in dimension")).cast("bigint")
    return mean.select(
        key,
        F.when(F.col("_least") == F.col("n"), F.col("n")).otherwise(wrong).alias("n"),
        F.size("mean").alias("dim"),
        l2_norm(F.col("mean")).alias("norm"),
        "mean",
    )


def catalogue_profile(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(
        "speaker_id",
        F.size("embedding").alias("dim"),
        F.round(l2_norm(F.col("embedding")), 6).alias("l2_norm"),
        F.slice("embedding", 1, 8).alias("preview"),
    ).orderBy("speaker_id")


def best_n(metrics: DataFrame, n: int = 5) -> DataFrame:
    """The checkpoints with the lowest loss; side files of training and start are left out."""
    scored = metrics.filter(~F.col("tag").rlike("^(train|init)"))
    return scored.orderBy("loss", "tag").limit(n)


def average_best(parameters: DataFrame, metrics: DataFrame, n: int) -> DataFrame:
    """Mean of every parameter over the n best checkpoints; fails unless there are n."""
    best = best_n(metrics, n).select("tag")
    kept = parameters.filter(~F.col("param").isin("step", "epoch")).join(best, "tag", "left_semi")
    cells = kept.select("tag", "param", F.posexplode("value").alias("pos", "v"))
    found = best.agg(F.count(F.lit(1))).scalar()
    short = F.raise_error(F.lit(f"fewer than {n} checkpoints")).cast("int")
    return (
        cells.groupBy("param", "pos")
        .agg(F.sum(F.col("v").cast("double")).alias("s"))
        .select("param", "pos", (F.col("s") / F.when(found == n, n).otherwise(short)).alias("value"))
    )


def weighted_loss(batches: DataFrame, *by: str) -> DataFrame:
    """Loss per metric name, batches weighted by their utterances."""
    weighted = F.try_divide(F.sum(F.col("value") * F.col("n_utts")), F.sum("n_utts"))
    return batches.groupBy(*by, "metric").agg(weighted.alias("loss"))


def masked_accuracy(df: DataFrame, ignore: int = -1, *by: str) -> DataFrame:
    """Share of correct positions among those whose target is not ignored."""

    def hits(test) -> Column:
        return F.size(F.filter(F.arrays_zip("pred", "target"), test))

    counts = df.select(
        *by,
        hits(lambda p: (p["target"] != ignore) & (p["pred"] == p["target"])).alias("ok"),
        hits(lambda p: p["target"] != ignore).alias("n"),
    )
    return counts.groupBy(*by).agg(
        F.sum("ok").alias("correct"),
        F.sum("n").alias("counted"),
        F.try_divide(F.sum("ok"), F.sum("n")).alias("accuracy"),
    )


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def preference_metrics(
    df: DataFrame, beta: float, smoothing: float = 0.0, ipo: bool = False
) -> DataFrame:
    """Mean preference loss, rewards and reward accuracy over pairs of log-probabilities."""
    margin = (F.col("chosen_logp") - F.col("rejected_logp")) - (
        F.col("ref_chosen_logp") - F.col("ref_rejected_logp")
    )
    if ipo:
        loss = F.pow(margin - 1 / (2 * beta), 2)
    else:
        loss = -log_sigmoid(beta * margin) * (1 - smoothing) - log_sigmoid(
            -beta * margin
        ) * smoothing
    chosen = beta * (F.col("chosen_logp") - F.col("ref_chosen_logp"))
    rejected = beta * (F.col("rejected_logp") - F.col("ref_rejected_logp"))
    return df.agg(
        F.avg(loss).alias("loss"),
        F.avg(chosen).alias("chosen_reward"),
        F.avg(rejected).alias("rejected_reward"),
        F.avg((chosen > rejected).cast("double")).alias("reward_accuracy"),
        F.avg(chosen - rejected).alias("reward_margin"),
    )


def job_summary(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(
        F.count_if("ok").alias("success"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def weighted_progress(reports: DataFrame, order: str, chunks: DataFrame | None = None, by: str = "job") -> DataFrame:
    """Whole percent of a job from the latest percent of each worker.

    ``chunks`` (``by, worker, chunk``) weighs workers by assigned files, 1 where unknown; a plain
    mean without it.
    """
    latest = reports.groupBy(by, "worker").agg(F.max_by("percent", order).alias("percent"))
    if chunks is None:
        share = F.sum("percent") / F.greatest(F.count(F.lit(1)), F.lit(1))
        return latest.groupBy(by).agg(F.floor(share).alias("percent"))
    assigned = chunks.groupBy(by).agg(F.sum("chunk").alias("_assigned"))
    weight = F.coalesce("chunk", F.lit(1))
    return (
        latest.join(chunks, [by, "worker"], "left")
        .groupBy(by)
        .agg(F.sum(F.col("percent") * weight).alias("_done"), F.count(F.lit(1)).alias("_workers"))
        .join(assigned, by, "left")
        .select(
            by,
            F.floor(F.col("_done") / F.coalesce(F.nullif("_assigned", F.lit(0)), "_workers")).alias(
                "percent"
            ),
        )
    )


def speed_profile(runs: DataFrame, rate: int = 24000) -> tuple[DataFrame, DataFrame]:
    """Per run: tokens per second and real-time factor; over all runs: mean and deviation."""
    elapsed = F.col("elapsed")
    per_run = runs.withColumns(
        {
            "tps": F.when(elapsed > 0, F.col("n_tokens") / elapsed).otherwise(0.0),
            "rtf": F.try_divide(elapsed * rate, F.col("n_samples")),
        }
    )
    whole = per_run.agg(
        F.avg("rtf").alias("rtf_mean"),
        F.stddev_pop("rtf").alias("rtf_std"),
        F.avg("tps").alias("tps_mean"),
        F.stddev_pop("tps").alias("tps_std"),
    )
    return per_run, whole


def split_counts(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))


# What a speaker without details is listed as.
SPEAKER_DEFAULTS = {"gender": "unknown", "language": "unknown", "description": ""}


def distinct_speakers(df: DataFrame) -> DataFrame:
    """Sorted unique speakers with defaults for missing details."""
    wanted = ["name", *SPEAKER_DEFAULTS]
    details = [c for c in wanted if c in df.columns]
    one = df.groupBy("speaker_id").agg(*[F.min(c).alias(c) for c in details])

    def filled(c: str, default: Column) -> Column:
        return (F.coalesce(F.col(c), default) if c in details else default).alias(c)

    return one.select(
        "speaker_id",
        filled("name", F.concat(F.lit("Speaker_"), F.col("speaker_id"))),
        *[filled(c, F.lit(d)) for c, d in SPEAKER_DEFAULTS.items()],
    ).orderBy("speaker_id")


def duration_error(df: DataFrame, *by: str) -> DataFrame:
    """Squared duration error over the summed lengths."""
    off = F.aggregate(
        F.zip_with("predicted", "target", lambda a, b: F.pow(a - b, 2)),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    rows = df.select(*by, off.alias("_e"), F.col("length"))
    return rows.groupBy(*by).agg(F.try_divide(F.sum("_e"), F.sum("length")).alias("duration_loss"))


def nucleus_candidates(
    scores: DataFrame, key: str, item: str, logit: str, top_p: float = 0.8, top_k: int = 25
) -> DataFrame:
    """Candidates of each key: highest probabilities first, while the mass before an item is
    under ``top_p`` and at most ``top_k`` of them.

    One scan and one exchange: every task keeps of a key its greatest logit, the sum of powers scaled by
    it, and its ``top_k`` items; such parts are merged per key, so a key brings ``top_k`` items a task
    to one place however many it has. Null logits take no part.
    """

    def normed(sums: pd.DataFrame) -> pd.DataFrame:
        top = sums.groupby("key", dropna=False)["top"].transform("max")
        scaled = sums.assign(top=top, total=sums["total"] * np.exp(sums["top"] - top))
        return scaled.groupby("key", dropna=False, as_index=False).agg(top=("top", "first"), total=("total", "sum"))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["x", "item"], ascending=[False, True], kind="stable")
        return ordered.groupby("key", dropna=False).head(top_k)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, sums = None, None

        def given() -> pd.DataFrame:
            lists = rows.groupby("key", dropna=False).agg(xs=("x", list), items=("item", list))
            return sums.merge(lists, left_on="key", right_index=True)

        for f in frames:
            own = normed(f.assign(top=f["x"], total=1.0)[["key", "top", "total"]])
            rows = first(f if rows is None else pd.concat([rows, f]))
            sums = own if sums is None else normed(pd.concat([sums, own]))
            if len(rows) > HELD:  # very many keys: given out early, their parts are merged later
                yield given()
                rows, sums = None, None
        if rows is not None:
            yield given()

    kinds = dict(scores.select(F.col(key).alias("key"), F.col(item).alias("item")).dtypes)
    slim = scores.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(logit).cast("double").alias("x"))
    schema = f"key {kinds['key']}, top double, total double, xs array<double>, items array<{kinds['item']}>"
    part = F.struct("top", "total", F.zip_with("xs", "items", lambda x, i: F.struct((-x).alias("less"), i.alias("item"))).alias("head"))
    merged = slim.where("x is not null").mapInPandas(parts, schema).groupBy("key").agg(F.collect_list(part).alias("parts"))

    merged = merged.select(
        "key", "parts", F.array_max("parts.top").alias("top"), F.slice(F.array_sort(F.flatten("parts.head")), 1, top_k).alias("head")
    )
    norm = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["total"] * F.exp(p["top"] - F.col("top")))
    merged = merged.withColumn("norm", norm)
    merged = merged.select("key", "head", F.transform("head", lambda h: F.exp(-h["less"] - F.col("top")) / F.col("norm")).alias("probs"))
    merged = merged.withColumn("mass", running(F.col("probs"), lambda x, y: x + y))
    rows = merged.select(
        "key", "mass", F.posexplode(F.arrays_zip("head", "probs")).alias("at", "c")
    ).withColumn("mass_before", F.coalesce(F.get("mass", F.col("at") - 1), F.lit(0.0)))
    return rows.where(F.col("mass_before") < top_p).select(
        F.col("key").alias(key), F.col("c.head.item").alias(item), (F.col("at") + 1).alias("rank"), F.col("c.probs").alias("prob"), "mass_before"
    )


def repetition_flag(
    tokens: DataFrame,
    key: str,
    order: str,
    token: str = "token",
    window: int = 10,
    share: float = 0.1,
    block: int = 1 << 16,
    span: int = SPAN,
) -> DataFrame:
    """Whether a token makes up at least ``share`` of the ``window`` tokens before it."""
    numbered = with_ordinal(tokens.select(key, order, token), [key], order, "_rn", span=span)
    cut = with_halo(numbered, "_rn", block, window)
    near = W.partitionBy(key, "_block").orderBy("_rn").rowsBetween(-window, -1)
    seen = F.filter(F.collect_list(token).over(near), lambda t: t == F.col(token))
    return (
        cut.withColumn("repeats", F.size(seen))
        .filter("_own")
        .select(
            key, order, token, "repeats", (F.col("repeats") >= window * share).alias("repeated")
        )
    )
