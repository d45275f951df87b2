"""SimHash near-duplicates by meeting in the middle: balls of variants are shuffled, not pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, text_of, word_bounds
from corpusloom.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 if set in over half of the XXH64 hashes of the text's word shingles.

    A-Z is lowered; shingles count as often as they occur. Fewer words than a shingle: the whole
    sequence is the one shingle. No words: zero.
    """
    body = text.encode("utf-8", "surrogatepass").translate(LOWER)
    words = body.split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts, ends = word_bounds(joined)
    size = min(shingle, len(words))
    firsts, lasts = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(firsts), BLOCK):
        hashes = np.array(
            [digest(joined[s:e], seed) for s, e in zip(firsts[at : at + BLOCK], lasts[at : at + BLOCK])],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(firsts)).tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = np.array([fingerprint(t, shingle) for t in f["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fps})

    return text_of(df, id_col, text_col).mapInPandas(run, "doc_id long, fp long")


def linked_in_bucket(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that span the groups linked within ``radius`` among distinct fingerprints.

    Breadth first: each fingerprint reached is compared with those not yet reached, so a group
    yields one edge less than it has members, and a dense one costs little more than its size.
    """
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return edges


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``: fingerprints at ``radius`` bits or fewer, enough of them to connect all that are.

    Two fingerprints within 3 bits differ by at most one bit in one half of 32. For each half a
    fingerprint emits all variants within half the radius, that is one bit: itself and the
    variants with one zero bit set (where two halves differ by a bit, one of them has a zero there).
    Equal variants meet in the shuffle, and the pairs are verified on all 64 bits. ``distinct``
    has each fingerprint once, so copies never multiply; a bucket gives spanning edges, not pairs.
    """
    if radius > 3:
        raise ValueError("halves differ by one bit at most only up to a radius of 3")

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones = np.uint64(1) << np.arange(32, dtype=np.uint64)
        for f in frames:
            fp = f["fp"].to_numpy(np.int64).view(np.uint64)
            for half in (0, 1):
                part = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                row, bit = np.nonzero((part[:, None] & ones) == 0)
                key = np.concatenate([part, part[row] | ones[bit]]) | np.uint64(half << 32)
                yield pd.DataFrame({"key": key.view(np.int64), "fp": np.concatenate([fp, fp[row]]).view(np.int64)})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a bucket may run over several batches."""
        held_key, held = None, []

        def close() -> pd.DataFrame:
            fps = np.unique(np.concatenate(held)).view(np.uint64)
            edges = linked_in_bucket(fps, radius) if len(fps) > 1 else []
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for f in frames:
            keys, fps = f["key"].to_numpy(np.int64), f["fp"].to_numpy(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            out = []
            for i in range(len(cuts) - 1):
                key, part = keys[cuts[i]], fps[cuts[i] : cuts[i + 1]]
                if key == held_key:
                    held.append(part)
                    continue
                if held_key is not None and (len(held) > 1 or len(held[0]) > 1):
                    out.append(close())
                held_key, held = key, [part]
            yield pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if held_key is not None:
            yield close()

    keyed = distinct.select("fp").mapInPandas(emit, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: its fingerprint and the smallest id it is linked to.

    Rows with equal fingerprints are one class before anything is paired. Null and empty texts have
    the fingerprint zero and link like any other. Rows without an id get their fingerprint and no
    part in any component (null). Repeated rows stay repeated. An empty table gives an empty table.
    """
    own = checkpointed(fingerprints(df, id_col, text_col))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(classes, radius))
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    group = F.coalesce("component_id", "fp")
    least = joined.groupBy(group.alias("root")).agg(F.min("first_id").alias("component"))
    named = joined.select("fp", group.alias("root")).join(least, "root").select("fp", "component")
    return own.join(named, "fp").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows whose id is the smallest of its component, with all their columns.

    Rows without an id are kept; of repeated rows with the smallest id, all are kept.
    """
    keep = near_duplicates(df, id_col, text_col, radius).where("doc_id = component_id")
    keep = keep.select(F.col("doc_id").alias("_kept_id")).distinct()
    with_id = df.join(keep, F.col(f"`{id_col}`") == F.col("_kept_id"), "left_semi")
    return with_id.unionByName(df.where(F.col(f"`{id_col}`").isNull()))


def hex64(column: str) -> Column:
    """Sixteen lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
