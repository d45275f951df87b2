"""Structured Streaming forms of the log, progress, status and request operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.runs import parse_metric_line
from corpusloom.session import shared_dir


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files: int | None = 16) -> DataFrame:
    """File stream over a parquet table, one file or a folder of parts (Spark's marker files and
    hidden folders are passed over). ``files``: at most so many in a micro-batch; None: all there are."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # as a pattern of one match, a path may name a file as well as a folder
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def tail_metrics(lines: DataFrame, line: str = "line") -> DataFrame:
    """Metric lines of a log stream (of ``tail_logs``, say); the checkpoint holds the read position."""
    return parse_metric_line(lines, line).filter(F.col("kind").isNotNull())


def live_percent(reports: DataFrame, by: str, order: str) -> DataFrame:
    """Latest percent per worker, as a streaming aggregate (update mode)."""
    return reports.groupBy(by, "worker").agg(F.max_by("percent", order).alias("percent"))


def live_status(events: DataFrame, job: str, order: str) -> DataFrame:
    """Latest event per job, with its place in ``order``, as a streaming aggregate (update mode)."""
    return events.groupBy(job).agg(
        F.max_by(F.struct("kind", "code", "ts", F.col(order).alias("at")), order).alias("last"),
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("start_time"),
    )


def match_with_timeout(requests: DataFrame, results: DataFrame, late: str, seconds: int = 60) -> DataFrame:
    """Each request with the result of its id that came within the limit, or timed out.

    Stream-stream left outer join: the time bound and the watermarks let Spark drop the state of
    requests that can no longer be answered. ``late``: how far behind the newest row of its stream a
    row may come; ``run_available`` fails if one came later still, so none is lost in silence.
    A request still waiting when a stream ends is given out when ``replay`` closes the streams.
    Works on batch tables too.
    """
    asked = requests.withWatermark("asked_at", late)
    answered = results.select(
        F.col("id").alias("result_id"), F.col("duration"), F.col("answered_at")
    ).withWatermark("answered_at", late)
    bound = (
        (F.col("id") == F.col("result_id"))
        & (F.col("answered_at") >= F.col("asked_at"))
        & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {seconds} seconds"))
    )
    matched = asked.join(answered, bound, "left_outer")
    code = F.when(F.col("result_id").isNull(), 408).otherwise(200).alias("code")
    return matched.select(*requests.columns, "duration", "answered_at", code)


def replay(
    tables: list[tuple[DataFrame, str]], run: Callable[..., DataFrame], batches: int = 4, key: str = "id", after: str = "1 day",
    rows: int = 4_000_000,
) -> DataFrame:
    """All rows of ``run`` over stored tables that come as streams, in order of time.

    ``tables``: each with its time column. The rows between two quantiles of all times are a part: there are
    ``batches`` parts, or more, so that none has many more than ``rows`` rows (rows of one time are one part).
    Each table is dealt into its parts once; a part is a file, and the files are given to the stream one after
    the other, so a micro-batch gets one part of each table and no state is read again. Null times come first.
    At last a row of its own closes each stream: its time, ``after`` the latest of all,
    moves the watermark over everything that waits. Its ``key`` is a negative number that no other row has
    (a null would be filtered out before the watermark), all else is null; it is never given out.
    """
    spark = tables[0][0].sparkSession
    base = shared_dir(spark)
    times = reduce(DataFrame.union, [df.select(F.unix_micros(F.col(time).cast("timestamp")).alias("t")) for df, time in tables])
    end = F.max(F.timestamp_micros("t")) + F.expr(f"interval {after}")
    total, end = times.agg(F.count("*"), F.unix_micros(F.coalesce(end, F.current_timestamp()))).first()
    batches = max(batches, -(-total // rows))
    shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
    bounds = times.agg(F.percentile_approx("t", shares)).first()[0] if batches > 1 else None
    place = lambda t: F.coalesce(sum((F.unix_micros(t.cast("timestamp")) >= b).cast("int") for b in bounds or []), F.lit(0))

    def deal(i: int) -> None:
        df, time = tables[i]
        part = f"part_{uuid.uuid4().hex}"
        dealt = df.withColumn(part, place(F.col(time))).repartition(batches, part)
        dealt.write.partitionBy(part).parquet(f"{base}/parts{i}")
        given = {time: F.timestamp_micros(F.lit(end)), key: F.lit(-(uuid.uuid4().int >> 66))}
        last = spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
        stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])).parquet(f"{base}/parts{i}")
        for batch in range(batches + 1):
            # one partition is one file, also of no rows; the stream takes files by the time they were written
            one = stored.where(F.col(part) == batch).drop(part) if batch < batches else last
            one.coalesce(1).write.mode("append").parquet(f"{base}/in{i}")

    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(deal, range(len(tables))))
    streams = [stream_table(spark, f"{base}/in{i}", df.schema, 1) for i, (df, _) in enumerate(tables)]
    with setting(spark, "spark.sql.streaming.numRecentProgressUpdates", 4 * batches + 100):  # none is forgotten before it is looked at
        return run_available(run(*streams), checkpoint=f"{base}/checkpoint", out=f"{base}/out")


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """Queries started inside run with this setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def rocksdb_state(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries started inside keep their state in RocksDB, which list states and timers need."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", provider)


def run_available(
    stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None
) -> DataFrame:
    """Run a query over all input there is and read back its parquet sink (append mode).

    With a ``checkpoint`` of an earlier run give its ``out`` too: the sink holds all runs' rows.
    """
    if checkpoint and not out:
        raise ValueError("a checkpoint goes with the folder its rows are in")
    spark = stream.sparkSession
    base = shared_dir(spark)
    out = out or f"{base}/out"
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if late:
        raise ValueError(f"{late} rows came later than the watermark allows")
    return spark.read.schema(stream.schema).parquet(out)


def run_updates(stream: DataFrame, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """Run an update-mode query over all input; the latest row per key of its change log.

    Every micro-batch appends its changed rows under its own folder, written again as a whole if
    the batch is retried.
    """
    spark = stream.sparkSession
    base = shared_dir(spark)
    out = f"{base}/changes"

    def append(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", checkpoint or f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    log = spark.read.parquet(out)
    latest = log.groupBy(*keys).agg(
        *[F.max_by(c, "batch_id").alias(c) for c in values]
    )
    return latest.select(*stream.columns)
