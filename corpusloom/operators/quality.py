"""Filters, audits and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions.text import only_punctuation
from corpusloom.operators.ordered import SPAN, hash_int, with_ordered, with_ordinal

# Default bounds of the utterance filter, audit and text check.
MAX_TOKEN_ID = 100000
EMBEDDING_DIM = 192
FEATURE_WIDTH = 80
COLUMNS_BY_MODEL = {
    "llm": ["audio", "text", "text_token"],
    "flow": ["audio", "speech_token", "embedding"],
}


def filter_utterances(
    df: DataFrame,
    max_length: float = 10240,
    min_length: float = 10,
    token_max: int = 200,
    token_min: int = 1,
    min_ratio: float = 0.0005,
    max_ratio: float = 1,
) -> DataFrame:
    """Keep utterances whose 10 ms frame count, token count and their ratio are in bounds.

    Reads ``n_samples``, ``sample_rate``, ``text_token``, ``speech_token`` and, when the column
    is there, ``reject_speech_token`` (null means absent). Where the counts are stored as
    ``n_tokens`` the arrays are not read for the first tests, which then reach the scan.
    """
    frames = F.try_divide("n_samples", "sample_rate") * 100
    tokens = F.col("n_tokens") if "n_tokens" in df.columns else F.size("text_token")
    ratio = F.try_divide(tokens, frames)
    keep = (
        frames.between(min_length, max_length)
        & tokens.between(token_min, token_max)
        & (F.size("speech_token") > 0)
        & ((frames == 0) | ratio.between(min_ratio, max_ratio))
    )
    if "reject_speech_token" in df.columns:
        rejected = F.col("reject_speech_token")
        keep = keep & (rejected.isNull() | (F.size(rejected) > 0))
    return df.filter(keep)


def audit_reason(
    embedding_dim: int = EMBEDDING_DIM, width: int = FEATURE_WIDTH, top: int = MAX_TOKEN_ID
) -> Column:
    """First reason a sample is unusable, null when it is fine."""
    token, vector, feat = F.col("speech_token"), F.col("embedding"), F.col("speech_feat")

    def none(x: Column) -> Column:
        return x.isNull() | (F.size(x) == 0)

    return (
        F.when(none(token), "empty_token")
        .when((F.array_min(token) < 0) | (F.array_max(token) > top), "invalid_token_range")
        .when(none(vector), "empty_embedding")
        .when(F.size(vector) != embedding_dim, "invalid_embedding_dim")
        .when(none(feat) | (F.size(feat[0]) != width), "empty_speech_feat")
    )


def audit_samples(df: DataFrame, **limits) -> DataFrame:
    """Add ``reason``; the usable rows are those where it is null."""
    return df.withColumn("reason", audit_reason(**limits))


def audit_report(audited: DataFrame) -> DataFrame:
    """Rows and percentage per reason (``valid`` for the rest)."""
    counts = audited.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # the report has one row per reason, so this window is as small
    return counts.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0)))).withColumn(
        "percent", F.round(F.col("n") * 100 / F.col("total"), 1)
    )


def validate_text(
    df: DataFrame, order: str, text: str = "text", shortest: int = 5, longest: int = 200
) -> DataFrame:
    """Rows with a text out of bounds: ``row_no`` (from 1) and ``issue``."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    issue = F.when(n < shortest, "too_short").when(n > longest, "too_long")
    slim = df.select(order, issue.alias("issue"))
    rows = with_ordinal(slim, [], order, "row_no")
    return rows.filter(F.col("issue").isNotNull()).select("row_no", "issue")


def issue_report(issues: DataFrame, first: int = 10) -> DataFrame:
    """The first issues by row number, each with the count of all issues."""
    count = issues.agg(F.count(F.lit(1))).scalar()
    return issues.orderBy("row_no").limit(first).withColumn("issues", count)


def select_columns(df: DataFrame, model: str) -> DataFrame:
    """Only the columns a model reads; needs tokens or text for the text model."""
    keep = [c for c in COLUMNS_BY_MODEL[model] if c in df.columns]
    if model == "llm" and not {"text", "text_token"} & set(keep):
        raise ValueError("text or text_token is required")
    return df.select(*keep)


def drop_low_rate(df: DataFrame, target: int, min_rate: int = 16000) -> DataFrame:
    rate = F.col("sample_rate")
    return df.filter((rate == target) | (rate >= min_rate))


def require_equal_rate(df: DataFrame, target: int) -> DataFrame:
    """Fails the job on the first row with another rate."""
    rate = F.col("sample_rate")
    said = F.concat(F.lit(f"expected rate {target}, got "), rate.cast("string"))
    checked = F.when(rate == target, rate).otherwise(F.raise_error(said).cast("int"))
    return df.withColumn("sample_rate", checked)


def unequal_rate(df: DataFrame, target: int) -> DataFrame:
    """Reject table form of the same check."""
    return df.filter(~F.col("sample_rate").eqNullSafe(target))


def cap_duration(df: DataFrame, seconds: float = 30, as_written: bool = False) -> DataFrame:
    """Empty, typed features for audio over the cap; the audit removes those rows later.

    ``as_written`` applies the cap to multi-channel audio only (``n_channels``).
    """
    over = F.col("n_samples") / F.col("sample_rate") > seconds
    if as_written:
        over = over & (F.col("n_channels") > 1)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    empties = {"speech_token": F.array(), "speech_feat": F.array(), "embedding": F.array()}
    emptied = {
        c: F.when(over, e.cast(types[c])).otherwise(F.col(c))
        for c, e in empties.items()
        if c in types
    }
    for c in ("speech_token_len", "speech_feat_len"):
        if c in types:
            emptied[c] = F.when(over, F.lit(0).cast(types[c])).otherwise(F.col(c))
    return df.withColumns(emptied)


def validate_requests(df: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Add ``reason``: the first thing wrong with a synthesis request, null when it is fine.

    Reads ``text``, ``prompt_text``, ``has_prompt_audio`` and ``speaker_id``; null in the prompt
    columns means that the request kind does not need them.
    """

    def blank(c: str) -> Column:
        return F.trim(F.col(c)) == ""

    reason = (
        F.when(F.col("text").isNull() | blank("text"), "empty_text")
        .when(blank("prompt_text"), "empty_prompt_text")
        .when(~F.col("has_prompt_audio"), "missing_prompt_audio")
        .when(F.col("speaker_id").isNotNull() & blank("speaker_id"), "missing_speaker")
    )
    if catalogue is None:
        return df.withColumn("reason", reason)
    known = catalogue.select("speaker_id").distinct().withColumn("_known", F.lit(True))
    unknown = F.col("speaker_id").isNotNull() & F.col("_known").isNull()
    return (
        df.join(known, "speaker_id", "left")
        .withColumn("reason", F.coalesce(reason, F.when(unknown, "unknown_speaker")))
        .drop("_known")
    )


def drop_punctuation_only(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~only_punctuation(F.col(text)))


def annotate_lines(df: DataFrame, text: str = "text", status: str = "annotated") -> DataFrame:
    """One row per non-blank line; blank lines keep their number."""
    lines = F.posexplode_outer(F.split(F.trim(F.col(text)), "\n")).alias("_pos", "line")
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, lines).select(
        *keep,
        F.concat(F.lit("audio_"), F.col("_pos") + 1).alias("audio_id"),
        F.trim("line").alias("text"),
        F.lit(status).alias("status"),
    ).filter(F.col("text") != "")


def slice_rows(df: DataFrame, order: str, start: int, end: int, span: int = SPAN) -> DataFrame:
    """Half-open positional slice in the given order."""
    row = with_ordinal(df, [], order, "_row", span=span)
    return row.filter((F.col("_row") > start) & (F.col("_row") <= end)).drop("_row")


def prompt_ratio_flag(df: DataFrame, text: str = "text", prompt: str = "prompt_text") -> DataFrame:
    return df.withColumn("too_short", F.length(text) < 0.5 * F.length(prompt))


def impute_failed_tokens(
    df: DataFrame,
    shard: str,
    order: str,
    batch: str,
    token: str = "speech_token",
    pool: int = 256,
    seed: int = 42,
    span: int = SPAN,
) -> DataFrame:
    """Replace null token arrays.

    Inside a batch a failed row takes the latest success before it, or the batch's final
    success when there was none yet. A batch without any success takes, for all its rows, one
    member of the last ``pool`` successes of the shard before it, else the placeholder ``[0]``.
    Adds ``source``: own, batch, pool or placeholder.
    """
    ok = F.col(token).isNotNull()
    hits = df.withColumn("_hit", F.when(ok, F.col(order)))
    rows = with_ordered(hits, shard, order, previous={"_hit": "_hit_before"}, span=span)
    inside = W.partitionBy(shard, batch).orderBy(order)
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns(
        {
            "_near": F.last(token, True).over(inside.rowsBetween(W.unboundedPreceding, 0)),
            "_final": F.last(token, True).over(whole),
            "_entry": F.first("_hit_before").over(whole),
        }
    ).drop("_hit", "_hit_before")
    good = with_ordinal(
        df.filter(ok).select(shard, order, token), [shard], order, "_no", span=span
    )
    # successes before a batch that failed whole: ordinal of the last one before it
    lost = (
        rows.filter(F.col("_final").isNull())
        .select(shard, batch, "_entry")
        .distinct()
        .join(
            good.select(shard, F.col(order).alias("_entry"), F.col("_no").alias("_before")),
            [shard, "_entry"],
        )
        .withColumn(
            "_no",
            F.col("_before")
            - hash_int(shard, batch, seed=seed) % F.least(F.col("_before"), F.lit(pool)),
        )
        .join(good.select(shard, "_no", F.col(token).alias("_drawn")), [shard, "_no"])
        .select(shard, batch, "_drawn")
    )
    placeholder = F.array(F.lit(0)).cast(df.schema[token].dataType)
    return (
        rows.join(lost, [shard, batch], "left")
        .withColumn(
            "source",
            F.when(ok, "own")
            .when(F.col("_final").isNotNull(), "batch")
            .when(F.col("_drawn").isNotNull(), "pool")
            .otherwise("placeholder"),
        )
        .withColumn(token, F.coalesce(token, "_near", "_final", "_drawn", placeholder))
        .drop("_near", "_final", "_entry", "_drawn")
    )
