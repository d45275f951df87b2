"""Ordinals, running values and forward fills over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task, and one key may hold a
third of the table. Everything here works in two levels instead: the group is cut along its
order into chunks of bounded size, the window runs inside (key, chunk), and one small row per
chunk carries the value across. Chunk rows are produced by a partial aggregate, so only they
are shuffled a second time; the data itself is shuffled once, by (key, chunk), and the join
with the carried values reuses that partitioning.

``order`` must be unique inside a key. When its first column is an integer the chunk is
``order div span``, which holds at most ``span`` rows; for hash orders the caller passes a
prefix of the hash. Without a key, where sparse integers would leave about a chunk per row for
one task to walk, the chunks are ranges between quantiles of the order. Null is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SPAN = 1 << 20
#: Most ranges that an order without a key is cut into.
RANGES = 4096


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def range_chunk(df: DataFrame, order: str, span: int = SPAN) -> Column:
    """Number of the range that a value of ``order`` is in; ranges have about ``span`` rows each, or a
    RANGES-th of the table. Their bounds are approximate quantiles, but any bounds are right."""
    count = df.agg(F.count(order)).first()[0]
    ranges = min(RANGES, -(-count // span))
    if ranges < 2:
        return F.lit(0)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = df.agg(F.percentile_approx(order, shares, 20 * ranges)).first()[0]
    bounds = sorted(set(found))
    held = F.lit(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        here = F.get(held, at + step - 1)
        return F.when(F.coalesce(here <= F.col(f"`{order}`"), F.lit(False)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def with_ordered(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    ordinal: str | None = None,
    total: str | None = None,
    before: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    chunk: Column | None = None,
    span: int = SPAN,
) -> DataFrame:
    """Any of these columns in one pass: the 1-based ``ordinal`` of a row in its key, the
    ``total`` rows of the key, for ``before`` (source -> name) the sum of the source over the
    earlier rows (0 at the start), for ``previous`` its last non-null value in them.
    """
    keys, order = _list(keys), _list(order)
    before, previous = before or {}, previous or {}
    if chunk is not None:
        piece = chunk
    else:
        piece = F.expr(f"`{order[0]}` div {span}") if keys else range_chunk(df, order[0], span)
    # one struct for the place: rows with a null key meet in the join like any others
    place = F.struct(*keys, piece.alias("_cut")).alias("_place")
    cut = df.select("*", place)
    # one row per (key, chunk): a partial aggregate over the columns in question
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    facts = [F.count(F.lit(1)).alias("_rows")]
    facts += [F.sum(c).alias(f"_sum_{n}") for c, n in before.items()]
    facts += [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_last_{n}")
        for c, n in previous.items()
    ]
    chunks = cut.groupBy("_place").agg(*facts)
    across = W.partitionBy(*[F.col("_place")[k] for k in keys] or [F.lit(0)])
    earlier = across.orderBy(F.col("_place")["_cut"]).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    carry = [F.coalesce(F.sum("_rows").over(earlier), zero).alias("_off")]
    carry += [F.sum("_rows").over(across).alias("_all")]
    carry += [
        F.coalesce(F.sum(f"_sum_{n}").over(earlier), zero).alias(f"_pre_{n}")
        for n in before.values()
    ]
    carry += [F.last(f"_last_{n}", True).over(earlier).alias(f"_old_{n}") for n in previous.values()]
    carried = chunks.select("_place", *carry)

    inside = W.partitionBy("_place").orderBy(*order)
    ahead = inside.rowsBetween(W.unboundedPreceding, -1)
    local = []
    if ordinal:
        local.append(F.row_number().over(inside).alias("_no"))
    local += [F.coalesce(F.sum(c).over(ahead), zero).alias(f"_in_{n}") for c, n in before.items()]
    local += [F.last(c, True).over(ahead).alias(f"_near_{n}") for c, n in previous.items()]
    out = []
    if ordinal:
        out.append((F.col("_no") + F.col("_off")).alias(ordinal))
    if total:
        out.append(F.col("_all").alias(total))
    out += [(F.col(f"_in_{n}") + F.col(f"_pre_{n}")).alias(n) for n in before.values()]
    out += [F.coalesce(f"_near_{n}", f"_old_{n}").alias(n) for n in previous.values()]
    return cut.select("*", *local).join(carried, "_place").select(*df.columns, *out)


def with_ordinal(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    name: str = "rn",
    total: str | None = None,
    chunk: Column | None = None,
    span: int = SPAN,
) -> DataFrame:
    """Add the 1-based position of each row inside its key (and the size of the key)."""
    return with_ordered(df, keys, order, ordinal=name, total=total, chunk=chunk, span=span)


def with_halo(df: DataFrame, ordinal: str, block: int, halo: int) -> DataFrame:
    """Cut rows into blocks of ``block`` ordinals and repeat the last ``halo`` rows of each
    block at the head of the next one, so that a frame of ``halo`` rows fits in a block.

    Adds ``_block`` and ``_own``; keep the rows with ``_own`` after the window.
    """
    own = F.expr(f"(`{ordinal}` - 1) div {block}")
    near_end = (F.col(ordinal) - 1) % block >= block - halo
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def hash_key(*parts: Column | str, seed: int = 42) -> Column:
    """Reproducible random order: md5 over the parts and the seed."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def hash_int(*parts: Column | str, seed: int = 42) -> Column:
    """Non-negative 32-bit integer from the same hash."""
    return F.conv(F.substring(hash_key(*parts, seed=seed), 1, 8), 16, 10).cast("bigint")


def hash_chunk(column: str, digits: int = 4) -> Column:
    """Chunk for an order by md5: its leading hex digits, uniform by construction."""
    return F.substring(F.col(column), 1, digits)
