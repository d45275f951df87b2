"""Helpers shared by the operators: the shared folder, cut lineage, work columns, hashes on arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Seconds at least from one time the driver gives memory back to the next.
PAUSE = 5
_RELIEVED = [0.0]
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which a cluster names. Only a session without one
    (tests, one machine) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there. The driver gives back what the plan took."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    if time.monotonic() - _RELIEVED[0] >= PAUSE:
        relieve(df.sparkSession)
        _RELIEVED[0] = time.monotonic()
    return out


def relieve(spark: SparkSession) -> None:
    """The driver drops what earlier plans left and gives the memory back to the system.

    Jobs of many rounds leave plans, task results, shuffles and broadcasts of rounds that are over. Spark
    forgets a shuffle or a broadcast when the driver's JVM collects its garbage, and a JVM with room left
    takes more memory instead; what compiling took outside the heap it never gives back by itself.
    """
    gc.collect()
    tidy()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = gateway.new_array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    values = gateway.new_array(jvm.java.lang.Object, 4)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    jvm.System.gc()
    try:
        # py4j finds no method for null arguments by itself
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        pass  # a JVM without this command


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text under fixed names, null texts as empty. Other columns don't matter."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from a hash of the keys: a lost task draws the same again."""
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys])
    return F.pmod(hashed, F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a published finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """GOLDEN ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.full(max(n, 1), GOLDEN, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values of ``h``, by doubling; ``len(h) - k + 1`` of them."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    have, part, out, done = 1, h.astype(np.uint64), None, 0
    n = len(h) - k + 1
    factor = lambda e: np.uint64(pow(int(GOLDEN), e, 1 << 64))
    while True:
        if k & have:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * factor(have) + piece
            done += have
        if have * 2 > k:
            return mix(out)
        part = part[:-have] * factor(have) + part[have:]
        have *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours; ``len(h) - w + 1`` values."""
    if len(h) < w:
        return np.empty(0, h.dtype)
    have = 1
    while have * 2 <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return h if have == w else np.minimum(h[: len(h) - (w - have)], h[w - have :])


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    white = np.ones(len(body) + 2, bool)
    white[1:-1] = WHITE[np.frombuffer(body, np.uint8)]
    change = np.flatnonzero(white[1:] != white[:-1])
    return change[::2], change[1::2]


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and a 64-bit hash of every word."""
    starts, ends = word_bounds(body)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    lens = ends - starts
    base = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(base, lens)
    letters = np.frombuffer(body, np.uint8)[np.repeat(starts, lens) + within].astype(np.uint64)
    weighed = (letters + np.uint64(1)) * powers(int(lens.max()))[within]
    return starts, ends, mix(np.add.reduceat(weighed, base) + lens.astype(np.uint64))


def tidy() -> None:
    """Give memory a worker no longer uses back to the system at the end of a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(frames: Iterator, rows: int) -> Iterator:
    """The given pandas frames, cut into at most ``rows`` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]
