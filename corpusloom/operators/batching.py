"""Shuffling, sampling, sharding and batching of training rows.

Positions come from ``with_ordinal``, so neither a hot shard nor the global order needs one
task; random orders are md5 orders, cut by hash prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions.arrays import round_up_length
from corpusloom.operators.greedy import PaddedBudget, greedy_groups
from corpusloom.operators.greedy import SPAN as GREEDY_SPAN
from corpusloom.operators.ordered import SPAN, hash_chunk, hash_key, with_ordinal


def seeded_shuffle(
    df: DataFrame, key: str, seed: int = 42, name: str = "pos", total: str | None = None
) -> DataFrame:
    """Position of each row in a permutation fixed by the seed (from 0)."""
    hashed = df.withColumn("_h", hash_key(key, seed=seed))
    ranked = with_ordinal(hashed, [], ["_h", key], name, total=total, chunk=hash_chunk("_h"))
    return ranked.withColumn(name, F.col(name) - 1).drop("_h")


def buffer_shuffle(
    df: DataFrame, shard: str, order: str, size: int = 10000, seed: int = 42, span: int = SPAN
) -> DataFrame:
    """Shuffle inside consecutive buffers of a shard; ``pos`` is the new position (from 0)."""
    rows = with_ordinal(df, [shard], order, "_rn", span=span)
    rows = rows.withColumn("_buffer", F.expr(f"(_rn - 1) div {size}"))
    mixed = F.row_number().over(
        W.partitionBy(shard, "_buffer").orderBy(hash_key(order, seed=seed), order)
    )
    return rows.withColumn("pos", F.col("_buffer") * size + mixed - 1).drop("_rn", "_buffer")


def sample_n(df: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """The first n rows of the shuffle (all rows when there are fewer)."""
    return df.orderBy(hash_key(key, seed=seed), key).limit(n)


def train_val_split(
    df: DataFrame,
    key: str,
    ratio: float = 0.05,
    seed: int = 42,
    val: DataFrame | None = None,
    auto: bool = False,
) -> DataFrame:
    """Add ``split``. The last ``int(n * ratio)`` rows of the shuffle are for validation.

    A given ``val`` table is used instead unless ``auto``; a ratio that leaves no training row
    is an error. Rows are not shuffled: prefixes of their hashes are counted (65,536 at most), the
    first validation row is looked for in the one prefix that has it, and every row is compared
    with that. Rows with one key go to one side.
    """
    if val is not None and not auto:
        return df.withColumn("split", F.lit("train")).unionByName(
            val.withColumn("split", F.lit("val"))
        )
    if ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    hashed = hash_key(key, seed=seed)
    prefix = F.substring(hashed, 1, 4)
    counts = df.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    size = int(total * ratio)
    if total and size >= total:
        raise ValueError("validation split is as large as the table")
    if not size:
        return df.withColumn("split", F.lit("train"))
    for edge, n in sorted(((r["prefix"], r["n"]) for r in counts), reverse=True):
        if n >= size:
            break
        size -= n
    place = F.struct(hashed.alias("hash"), F.col(key).alias("key"))
    last = df.where(prefix == edge).select(place.alias("place")).orderBy(F.desc("place")).limit(size)
    first_val = last.agg(F.min("place")).first()[0]
    limit = F.struct(F.lit(first_val["hash"]).alias("hash"), F.lit(first_val["key"]).alias("key"))
    return df.withColumn("split", F.when(place >= limit, "val").otherwise("train"))


def assign_shards(
    shards: DataFrame,
    shard: str,
    world: int,
    workers: int = 1,
    epoch: int | None = None,
    partition: bool = True,
    order: str | None = None,
) -> DataFrame:
    """Which rank and worker reads which shard, in reading order.

    With ``epoch`` the list is shuffled by that seed, otherwise it is taken in ``order`` (the
    integer position in the list). A list shorter than the ranks (or a rank's list shorter than its workers) is repeated and cut.
    """
    if epoch is None or not partition:
        if order is None:
            raise ValueError("without an epoch the shards need an order column")
        listed = with_ordinal(shards, [], order, "_i", total="_n").withColumn(
            "_i", F.col("_i") - 1
        )
    else:
        listed = seeded_shuffle(shards, shard, epoch, "_i", "_n")

    def repeated(df: DataFrame, index: str, n: str, least: int) -> DataFrame:
        copies = F.when(
            F.col(n) < least, F.sequence(F.col(index), F.lit(least - 1).cast("bigint"), F.col(n))
        ).otherwise(F.array(index))
        return df.withColumn("_j", F.explode(copies)).withColumn(
            "_m", F.greatest(n, F.lit(least))
        )

    if partition:
        ranks = repeated(listed.filter(F.col("_n") > 0), "_i", "_n", world)
        ranks = ranks.withColumns(
            {
                "rank": (F.col("_j") % world).cast("int"),
                "_i": F.expr(f"_j div {world}"),
                "_n": F.ceil((F.col("_m") - F.col("_j") % world) / world),
            }
        )
    else:
        ranks = listed.withColumn("rank", F.lit(0))
    # with fewer shards than workers every worker gets one
    spread = repeated(ranks.drop("_j", "_m"), "_i", "_n", workers)
    return spread.select(
        F.col(shard),
        "rank",
        (F.col("_j") % workers).cast("int").alias("worker"),
        F.expr(f"_j div {workers}").alias("read_no"),
    )


def even_chunks(df: DataFrame, order: str, chunks: int, span: int = SPAN) -> DataFrame:
    """Contiguous chunks of ``ceil(n / chunks)`` rows."""
    rows = with_ordinal(df, [], order, "_rn", total="_total", span=span)
    size = F.ceil(F.col("_total") / chunks)
    return rows.withColumn("chunk", F.floor((F.col("_rn") - 1) / size)).drop("_rn", "_total")


def length_bucket_sort(
    df: DataFrame, shard: str, order: str, length: str, size: int = 500, span: int = SPAN
) -> DataFrame:
    """Sort consecutive chunks of a shard by length (stable); ``pos`` counts from 0."""
    rows = with_ordinal(df, [shard], order, "_rn", span=span)
    rows = rows.withColumn("_bucket", F.expr(f"(_rn - 1) div {size}"))
    rank = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(length, "_rn"))
    return rows.withColumn("pos", F.col("_bucket") * size + rank - 1).drop("_rn", "_bucket")


def static_batch(
    df: DataFrame, shard: str, order: str, size: int = 16, span: int = SPAN
) -> DataFrame:
    """Consecutive batches of ``size`` rows; the last may be short."""
    rows = with_ordinal(df, [shard], order, "_rn", span=span)
    return rows.withColumn("batch_no", F.expr(f"(_rn - 1) div {size}")).drop("_rn")


def dynamic_batch(
    df: DataFrame,
    shard: str,
    order: str,
    length: str,
    budget: int = 12000,
    span: int = GREEDY_SPAN,
) -> DataFrame:
    """Batches whose padded size (longest * rows) stays within the budget.

    A row over the budget is a batch of its own. Only key, order and length go through the
    grouping; the other columns are joined back.
    """
    numbers = greedy_groups(
        df.select(shard, order, length), [shard], order, [length], PaddedBudget(budget),
        "batch_no", span,
    ).select(shard, order, "batch_no")
    return df.join(numbers, [shard, order])


def make_batches(df: DataFrame, kind: str, shard: str, order: str, **options) -> DataFrame:
    """``static`` or ``dynamic`` batches."""
    makers = {"static": static_batch, "dynamic": dynamic_batch}
    if kind not in makers:
        raise ValueError(f"unsupported batch type: {kind}")
    return makers[kind](df, shard, order, **options)


def pad_sort_order(df: DataFrame, batch: list[str], length: str, order: str) -> DataFrame:
    """Position inside the batch by descending length (stable)."""
    ranked = F.row_number().over(W.partitionBy(*batch).orderBy(F.col(length).desc(), order))
    return df.withColumn("in_batch", ranked - 1)


def pad_sequences(
    df: DataFrame, batch: list[str], columns: dict[str, object], round_up: dict[str, int] | None = None
) -> DataFrame:
    """Pad the array columns to the longest of their batch; adds ``<column>_len``.

    ``columns`` maps a column to its padding value; ``round_up`` maps a column to the number of
    halvings its padded length must survive. The batch's longest length is a window maximum:
    batches are small by construction.
    """
    inside = W.partitionBy(*batch)
    halvings = round_up or {}
    longest = {}
    for c in columns:
        top = F.max(F.size(c)).over(inside)
        longest[f"_{c}"] = round_up_length(top, halvings[c]) if c in halvings else top
    out = df.withColumns({f"{c}_len": F.size(c) for c in columns}).withColumns(longest)
    return pad_to(out, columns)


def pad_to(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Pad each array column to the length in its column of the same name after ``_``, which goes."""
    types = {f.name: f.dataType for f in df.schema}
    padded = {}
    for c, v in columns.items():
        filler = v if isinstance(v, Column) else F.lit(v).cast(types[c].elementType)
        missing = (F.col(f"_{c}") - F.size(c)).cast("int")
        padded[c] = F.concat(F.col(c), F.array_repeat(filler, missing))
    return df.withColumns(padded).drop(*[f"_{c}" for c in columns])


def choose_batch_columns(
    df: DataFrame, use_spk_embedding: bool, gan: bool = False, dpo: bool = False
) -> DataFrame:
    """Columns of a padded batch for a training mode, and the embedding it uses.

    Waveforms and pitch are kept for gan only, rejected tokens for dpo only.
    """
    drop = []
    if not gan:
        drop += ["speech", "speech_len", "pitch_feat", "pitch_feat_len"]
    if not dpo:
        drop += ["reject_speech_token", "reject_speech_token_len"]
    source = "spk_embedding" if use_spk_embedding else "utt_embedding"
    return df.drop(*drop).withColumn("embedding", F.col(source))


def collate(df: DataFrame, batch: list[str], columns: list[str], order: str) -> DataFrame:
    """One row per batch, its rows as an array of structs in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"), rows.alias("rows"))
