"""Keyed token streams: hop chunks and the pool of latest successes.

State per request is bounded: at most one hop and its lookahead of tokens wait, and a pool holds
its newest members only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Rows that a task of ``newest`` keeps before it gives them out.
HELD = 1 << 20
CHUNK = "request_id string, chunk_no int, offset int, end int, final boolean, expired boolean, tokens array<int>"


class Chunker(StatefulProcessor):
    """Cuts the tokens of one request. A list state holds those that wait, a value state how far the
    request is; a timer in event time moves on with every row and ends a request that falls silent."""

    def __init__(self, hop: int, lookahead: int, first_pad: int, limit_ms: int):
        self.hop, self.lookahead, self.first_pad, self.limit_ms = hop, lookahead, first_pad, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "token int")
        self.place = handle.getValueState("place", "offset int, number int, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh = sorted(((r.seq, r.tokens or [], r.is_end, r.at_ms) for r in rows), key=lambda r: r[0])
        offset, number, timer = self.place.get() or (0, 0, None)
        waiting = [token for (token,) in self.waiting.get()] if timer else []
        for _, tokens, is_end, _ in fresh:
            waiting += tokens
            at = 0
            while True:
                step = self.hop + (self.first_pad if offset == 0 else 0)
                if len(waiting) - at < step + self.lookahead:
                    break
                part = waiting[at : at + step + self.lookahead]
                yield chunk(key[0], number, offset, False, False, part)
                at, offset, number = at + step, offset + step, number + 1
            waiting = waiting[at:]
            if is_end:
                yield chunk(key[0], number, offset, True, False, waiting)
                self.end(timer)
                return
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max([timer or 0, *(at_ms + self.limit_ms for *_, at_ms in fresh)])
        self.handle.registerTimer(timer)
        self.place.update((offset, number, timer))
        if waiting:
            self.waiting.put([(token,) for token in waiting])
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        offset, number, _ = self.place.get()
        yield chunk(key[0], number, offset, True, True, [token for (token,) in self.waiting.get()])
        self.end(None)

    def end(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.place.clear()
        self.waiting.clear()

    def close(self) -> None:
        """Nothing is held open."""


def chunk(request: str, number: int, offset: int, final: bool, expired: bool, tokens: list[int]) -> Row:
    return Row(request_id=request, chunk_no=number, offset=offset, end=offset + len(tokens), final=final, expired=expired, tokens=tokens)


def chunk_token_stream(
    tokens: DataFrame, hop: int = 25, lookahead: int = 3, first_pad: int = 0, limit: str = "10 minutes", late: str = "1 minute"
) -> DataFrame:
    """Chunks of the tokens of each request as they come.

    ``tokens``: ``request_id, seq, tokens, is_end, at``: some tokens of a request and when they came; rows
    of a request arrive in ``seq`` order from one micro-batch to the next. A chunk goes out when a hop
    (the first one longer by ``first_pad``) and ``lookahead`` tokens are there; the stream moves on by
    the hop. The end row's tokens, then the rest go out in a final chunk and the state is dropped; so is
    that of a request without a row for ``limit`` of event time, whose rest goes out as ``expired``. Rows
    later than ``late`` behind the newest are told by ``run_available``. Rows of a request after its end
    begin it anew. The state store must be RocksDB (``rocksdb_state``).
    """
    spark = tokens.sparkSession
    limit_ms = int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + interval {limit})").first()[0])
    timed = tokens.withWatermark("at", late).selectExpr(
        "request_id", "seq", "tokens", "is_end", "at", "unix_millis(cast(at as timestamp)) as at_ms"
    )
    return timed.groupBy("request_id").transformWithState(
        Chunker(hop, lookahead, first_pad, limit_ms), CHUNK, "append", "eventTime"
    )


def newest(successes: DataFrame, size: int, salts: int) -> DataFrame:
    """At most ``size * salts`` rows per shard, with the ``size`` newest of all among them.

    Every task keeps its own newest; then those of a shard meet by ``salts`` shares, and again each
    task keeps the newest. Stateless, so it goes before a stream's shuffle to its keyed state.
    """

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            held = held.sort_values("seq", kind="stable").groupby("shard", dropna=False).tail(size)
            if len(held) > HELD:  # very many shards: given out early, the next step merges them
                yield held
                held = None
        if held is not None:
            yield held

    schema = "shard string, seq bigint, token int"
    rows = successes.select(F.col("shard").cast("string"), F.col("seq").cast("bigint"), F.col("token").cast("int"))
    share = F.pmod(F.xxhash64("seq"), F.lit(salts))
    return rows.mapInPandas(keep, schema).repartition("shard", share).mapInPandas(keep, schema)


def recent_pool(successes: DataFrame, size: int = 256, salts: int = 16) -> DataFrame:
    """The latest ``size`` successes per shard after every micro-batch (update mode).

    ``successes``: ``shard, seq, token``. One row per shard: the newest sequence number and the
    pool from oldest to newest. A shard's state gets ``size * salts`` rows of a micro-batch at most,
    however many it had.
    """

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, pool = state.get if state.exists else ([], [])
        pairs = list(zip(seqs, pool))
        for frame in frames:
            pairs.extend(zip(frame["seq"].tolist(), frame["token"].tolist()))
            pairs = sorted(pairs)[-size:]
        seqs, pool = [int(s) for s, _ in pairs], [int(t) for _, t in pairs]
        state.update((seqs, pool))
        yield pd.DataFrame({"shard": [key[0]], "newest": [seqs[-1]], "pool": [pool]})

    return newest(successes, size, salts).groupBy("shard").applyInPandasWithState(
        push,
        "shard string, newest bigint, pool array<int>",
        "seqs array<bigint>, pool array<int>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
