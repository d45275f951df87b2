"""Audio segments per file, and hops over token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.operators.greedy import SPAN, ShortSegments, greedy_groups
from corpusloom.operators.ordered import with_ordinal


def merge_short_segments(
    segments: DataFrame,
    file: str,
    order: str,
    short: float,
    split: float,
    rate: int = 16000,
    start: str = "start",
    end: str = "end",
    span: int = SPAN,
) -> DataFrame:
    """Merge short segments of a file into their predecessor.

    A segment under ``short`` seconds joins the open one while the two durations stay under
    1.5 * ``split`` (a gap inside the open one counts, the gap between them does not); a short
    last segment joins the one before it. Segments go by start, then end, then ``order``, in
    whatever order they come.
    """
    rule = ShortSegments(short * rate, 1.5 * split * rate)
    groups = greedy_groups(segments, [file], [start, end, order], [start, end], rule, "_g", span)
    place = F.struct(start, end, order)
    merged = groups.groupBy(file, "_g").agg(
        F.min_by(start, place).alias(start),
        F.max_by(end, place).alias(end),
        F.count(F.lit(1)).alias("n"),
    )
    last = merged.groupBy(file).agg(F.max("_g").alias("_last"), F.max_by(
        (F.col(end) - F.col(start)) < short * rate, "_g").alias("_short"))
    # the last group keeps its own number unless it is short and has a predecessor
    number = F.when(
        (F.col("_g") == F.col("_last")) & F.col("_short") & (F.col("_last") > 0), F.col("_g") - 1
    ).otherwise(F.col("_g"))
    return (
        merged.join(last, file)
        .withColumn("_h", number)
        .groupBy(file, F.col("_h").alias("seg_no"))
        .agg(
            F.min_by(start, "_g").alias(start),
            F.max_by(end, "_g").alias(end),
            F.sum("n").alias("n"),
        )
    )


def segment_files(
    files: DataFrame,
    segments: DataFrame,
    file: str,
    order: str,
    short: float,
    split: float,
    rate: int = 16000,
    shortest: float = 0.1,
    span: int = SPAN,
) -> DataFrame:
    """Output clips: files up to ``split`` seconds whole, the others as merged segments of at
    least ``shortest`` seconds, named ``<stem>_part001.wav`` and so on.

    ``files``: ``file, stem, n_samples``; ``segments``: ``file, order, start, end``.
    """
    whole = files.filter(F.col("n_samples") / rate <= split).select(
        file,
        F.concat("stem", F.lit(".wav")).alias("clip"),
        F.lit(0).cast("bigint").alias("start"),
        F.col("n_samples").cast("bigint").alias("end"),
    )
    long = files.filter(F.col("n_samples") / rate > split).select(file, "stem", "n_samples")
    inside = segments.join(long.select(file), file, "left_semi")
    merged = merge_short_segments(inside, file, order, short, split, rate, span=span)
    # a segment reaching past the file is clipped there, as slicing the samples does
    clipped = merged.join(long, file).withColumn("_e", F.least("end", "n_samples"))
    kept = clipped.filter((F.col("_e") - F.col("start")) / rate >= shortest)
    parts = with_ordinal(kept, [file], "seg_no", "_part", span=span)
    name = F.concat(
        "stem", F.lit("_part"), F.when(F.col("_part") < 1000, F.lpad(F.col("_part").cast("string"), 3, "0"))
        .otherwise(F.col("_part").cast("string")), F.lit(".wav"),
    )
    named = parts.select(
        file,
        name.alias("clip"),
        F.col("start").cast("bigint").alias("start"),
        F.col("_e").cast("bigint").alias("end"),
    )
    return whole.unionByName(named)


def _hops(n: Column, need: Column, hop: Column, first: Column, v2: bool) -> Column:
    """Chunks as structs; ``need`` is what must follow the hop before it is emitted."""
    count = F.when(n < first + need, F.lit(0)).otherwise(
        F.floor((n - first - need) / hop).cast("int") + 1
    )
    starts = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.when(k == 0, F.lit(0)).otherwise(first + (k - 1) * hop),
    )
    left = F.when(count == 0, F.lit(0)).otherwise(first + (count - 1) * hop)

    def chunk(offset: Column, size: Column, final: bool) -> Column:
        end = n if final else offset + size + need
        return F.struct(
            offset.cast("int").alias("offset"),
            end.cast("int").alias("end"),
            (F.lit(0) if v2 else offset).cast("int").alias("begin"),
            F.lit(final).alias("final"),
        )

    emitted = F.transform(
        starts, lambda s: chunk(s, F.when(s == 0, first).otherwise(hop), False)
    )
    return F.concat(emitted, F.array(chunk(left, F.lit(0), True)))


def stream_hops(
    df: DataFrame,
    tokens: str,
    hop: int = 25,
    lookahead: int = 3,
    prompt_len: Column | None = None,
    overlap: int | None = None,
) -> DataFrame:
    """The chunks a streaming consumer cuts from a token sequence, one row per chunk.

    With ``overlap`` a chunk is its hop and ``overlap`` tokens more. Otherwise a chunk is the
    sequence up to its hop and ``lookahead`` tokens, new from ``offset``, and the first hop is
    padded so that prompt and hop end on a hop boundary. The rest is the final chunk.
    """
    n = F.size(tokens)
    if overlap is not None:
        chunks = _hops(n, F.lit(overlap), F.lit(hop), F.lit(hop), v2=False)
    else:
        prompt = prompt_len if prompt_len is not None else F.lit(0)
        pad = F.ceil(prompt / hop) * hop - prompt
        chunks = _hops(n, F.lit(lookahead), F.lit(hop), (pad + hop).cast("int"), v2=True)
    return df.select("*", F.posexplode(chunks).alias("chunk_no", "_c")).select(
        *df.columns,
        "chunk_no",
        "_c.offset",
        "_c.begin",
        "_c.end",
        "_c.final",
    )


def crossfade_pieces(pieces: DataFrame, request: str, order: str, window: list[float]) -> DataFrame:
    """Fade each piece of a request into the tail of the piece before it."""
    from corpusloom.functions.arrays import crossfade

    n = len(window) // 2
    numbered = with_ordinal(pieces, [request], order, "_rn")
    tails = numbered.select(
        request,
        (F.col("_rn") + 1).alias("_rn"),
        F.slice("samples", F.size("samples") - n + 1, F.lit(n)).alias("_tail"),
    ).filter(F.size("_tail") == n)
    mixed = F.when(
        F.col("_tail").isNotNull() & (F.size("samples") >= n),
        crossfade(F.col("samples"), F.col("_tail"), window),
    ).otherwise(F.col("samples").cast("array<double>"))
    return numbered.join(tails, [request, "_rn"], "left").withColumn("samples", mixed).drop(
        "_tail", "_rn"
    )


def join_with_pauses(
    pieces: DataFrame,
    request: str,
    order: str,
    rate: int = 24000,
    low_ms: int = 50,
    high_ms: int = 150,
    seed: int = 42,
) -> DataFrame:
    """Position of every piece in its request's joined audio.

    A pause of 50 to 150 ms, hashed from request and order, follows every piece but the last.
    Pieces keep their own rows (``first_sample`` is their place, ``pause`` the zeros after it), so a
    request of any length is never held by one task; ``audio_blocks`` joins them.
    """
    from corpusloom.operators.ordered import hash_int, with_ordered

    n = F.size("samples").cast("bigint")
    numbered = with_ordinal(pieces, [request], order, "_rn", total="_n")
    drawn = F.lit(low_ms) + hash_int(request, order, seed=seed) % (high_ms - low_ms + 1)
    pause = F.when(F.col("_rn") == F.col("_n"), F.lit(0)).otherwise(F.floor(drawn * rate / 1000))
    sized = numbered.withColumn("pause", pause.cast("bigint")).withColumn(
        "_size", n + F.col("pause")
    )
    placed = with_ordered(sized, request, order, before={"_size": "first_sample"})
    return placed.drop("_rn", "_n", "_size")


def audio_blocks(placed: DataFrame, request: str, block: int = 1 << 20) -> DataFrame:
    """The joined audio of each request in rows of ``block`` samples (the last may be shorter), numbered
    from 0. No row is larger than a block or a piece, however long the request."""
    end = F.col("first_sample") + F.size("samples") + F.col("pause")
    first = F.expr(f"first_sample div {block}")
    cut = placed.withColumn("_end", end).where(F.col("_end") > F.col("first_sample"))
    cut = cut.select(request, "first_sample", "samples", "_end", F.explode(F.sequence(first, F.expr(f"(_end - 1) div {block}"))).alias("block_no"))
    begin = F.greatest("first_sample", F.col("block_no") * block)
    until = F.least("_end", (F.col("block_no") + 1) * block)
    own = F.slice("samples", (begin - F.col("first_sample") + 1).cast("int"), F.greatest(until - begin, F.lit(0)).cast("int")).cast("array<double>")
    parts = cut.select(request, "block_no", begin.alias("_at"), own.alias("_own"), (until - begin).cast("int").alias("_n"))
    zeros = F.array_repeat(F.lit(0.0), F.col("_n") - F.size("_own"))
    part = F.struct("_at", F.concat("_own", zeros).alias("_part"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["_part"]))
    return parts.groupBy(request, "block_no").agg(joined.alias("samples"))
