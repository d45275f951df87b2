"""Passages that recur anywhere in a corpus, found by chunks of documents that ask buckets.

A window is ``depth`` neighbouring units (bytes or words) of one document. Its key is the least hash
of the ``k`` units' grams in it, so equal windows have equal keys; neighbouring windows with one key
form a run, and a run with its context is a segment. Three exchanges find all equal windows:

1. every chunk sends the keys it holds, each once, to the key's bucket; a bit comes back for each:
   whether the key recurs;
2. every chunk sends its distinct segments with recurring keys; the operator's ``solve`` compares
   all segments of a bucket and answers each chunk;
3. every chunk reads its documents again with the answers.

A chunk is a bounded amount of text chosen by a hash of the document, and a bucket gets each key at
most once from a chunk and each text of a segment at most once. So a passage that is in a third of
all documents costs a bucket as many entries as there are chunks, and nothing is dropped or capped.
Messages are packed arrays, a row per chunk and bucket; of a key, 32 bits of a hash are asked for
besides its bucket (two keys taken for one only make more candidates). Lost tasks are run again from the shuffled
texts: everything is a function of the rows, in whatever order they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import GOLDEN, mix, powers, sliding_min, tidy, word_bounds

#: Bytes of text in a chunk, on average.
CHUNK = 6 << 20
#: Windows worked on at once.
BLOCK = 1 << 17
NO_ID = -(1 << 63)
_INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))


def dealt(df: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """``(chunk, doc_id, body, rest)``: the text as UTF-8 (null: empty) and all other columns.

    The texts are shuffled once; the exchanges read the same shuffle.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        body.alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("rest"),
    )
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * parts, -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", "body"), F.lit(chunks)).cast("int")
    return rows.select(chunk.alias("chunk"), "*").repartition(parts, "chunk")


class Chunk:
    """The documents of one chunk in order of (id, text), a null id before all others."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        bodies = table["body"].to_pylist()
        self.order = sorted(range(len(bodies)), key=lambda i: (ids[i], bodies[i]))
        self.table = table.take(pa.array(self.order, pa.int64()))
        self.ids = ids[self.order]
        bodies = [bodies[i] for i in self.order]
        self.bodies = bodies
        self.chunk = int(table["chunk"][0].as_py()) if table.num_rows else -1

    def as_bytes(self) -> None:
        """Units are bytes."""
        lens = np.array([len(b) for b in self.bodies], np.int64)
        self.raw = np.frombuffer(b"".join(self.bodies), np.uint8)
        self.values = self.raw
        self.stops = np.cumsum(lens)
        self.firsts = self.stops - lens

    def as_words(self) -> None:
        """Units are words; ``begins`` and ``ends`` are their places in ``joined``, ``codes`` their numbers
        in the chunk. A polynomial of a word's bytes would give words made for it one hash."""
        self.joined = b" ".join(self.bodies)
        self.raw = np.frombuffer(self.joined, np.uint8)
        self.begins, self.ends = word_bounds(self.joined)
        self.words = self.joined.split()
        numbers: dict[bytes, int] = {}
        self.codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, len(self.words))
        self.values = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[self.codes]
        lens = np.array([len(b) + 1 for b in self.bodies], np.int64)
        edges = np.searchsorted(self.begins, np.concatenate([[0], np.cumsum(lens)]))
        self.firsts, self.stops = edges[:-1], edges[1:]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def sums_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums ``s`` and factors ``p``: ``(s[j] - s[i]) * p[i]`` is a hash of ``values[i:j]``
    that does not depend on where they stand."""
    n = len(values) + 1
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        _POWERS[0] = powers(size)
        inverse = np.full(size, _INVERSE, np.uint64)
        inverse[0] = 1
        _POWERS[1] = np.multiply.accumulate(inverse)
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * _POWERS[1][: n - 1], out=sums[1:])
    return sums, _POWERS[0][:n]


@dataclass
class Runs:
    """Runs of windows with one key: the key, a hash of the whole segment, first unit, windows, and
    whether windows of the run itself may be equal."""

    key: np.ndarray
    content: np.ndarray
    first: np.ndarray
    n: np.ndarray
    again: np.ndarray


def runs(chunk: Chunk, k: int, depth: int, within: bool = False) -> Runs:
    """All windows of the chunk, as runs of at most ``depth - k + 1`` windows. ``within``: whether equal
    windows of one run are looked for; they have a gram that is met again less than that further on."""
    w, total = depth - k + 1, len(chunk.values) - depth + 1
    if total <= 0:
        empty = np.empty(0, np.uint64)
        return Runs(empty, empty, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    inside = np.ones(total, bool)
    for first, stop in zip(chunk.firsts.tolist(), chunk.stops.tolist()):
        inside[max(first, stop - depth + 1) : stop] = False
    out = []
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        values = chunk.values[a : b + depth - 1].astype(np.uint64) + np.uint64(1)
        sums, power = sums_of(values)
        grams = mix((sums[k:] - sums[:-k]) * power[: len(values) - k + 1])
        key, ok = sliding_min(grams, w), inside[a:b]
        change = np.ones(b - a, bool)
        change[1:] = (key[1:] != key[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(change)
        n = np.diff(np.append(first, b - a))
        keep = ok[first]
        first, n = first[keep], n[keep]
        if len(n) and n.max() > w:
            pieces = -(-n // w)
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, n = np.repeat(first, pieces) + nth * w, np.minimum(np.repeat(n, pieces) - nth * w, w)
        key = key[first]
        content = mix((sums[first + n + depth - 1] - sums[first]) * power[first] + mix(key + n.astype(np.uint64)))
        again = np.zeros(len(n), bool)
        if within:
            met = np.zeros(len(grams) + 1, np.int64)
            for far in range(1, min(w, len(grams))):
                met[1:-far] |= grams[:-far] == grams[far:]
            met = np.cumsum(met)
            again = (n > 1) & (met[first + n + w - 1] > met[first])
        out.append((key, content, first + a, n, again))
    return Runs(*(np.concatenate(x) for x in zip(*out)))


def bucket(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key) % np.uint64(parts)).astype(np.int32)


def slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of each stretch of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(part)) if len(part) else []):
        yield int(part[a]), int(a), int(b)


def sent_keys(key: np.ndarray, owner: np.ndarray | None, parts: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct keys by bucket, the buckets, and which recur within the chunk: in
    different owners, or at all where ``owner`` is None, or within one of the runs (``alone``)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    if owner is None:
        again = np.diff(np.append(heads, len(key))) > 1
    elif len(key):
        owner = owner[order]
        again = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
    else:
        again = np.empty(0, bool)
    if len(key):
        again = again | np.maximum.reduceat(alone[order], heads)
    key = key[heads]
    part = bucket(key, parts)
    by_part = np.argsort(part, kind="stable")
    return key[by_part], part[by_part], again[by_part]


def short(key: np.ndarray) -> np.ndarray:
    """32 bits of each key, independent of its bucket."""
    return (mix(key ^ GOLDEN) >> np.uint64(32)).astype(np.uint32)


def packed(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values if isinstance(values, bytes) else values.tobytes())


def unpacked(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


class Exchange:
    """The three exchanges for one kind of unit. ``units`` prepares a chunk; ``owners`` tells
    whether a key must recur in different documents (else anywhere)."""

    #: What a chunk sends of a segment. ``start``: unit within the document.
    SEGMENT = "chunk int, part int, key binary, content binary, doc binary, start binary, again binary, size binary, body binary"
    #: What it gets back: of a segment the windows ``at`` to ``at + n`` and where their first stands.
    ANSWER = "chunk int, content binary, at binary, n binary, doc binary, start binary"

    def __init__(self, k: int, depth: int, units: Callable[[Chunk], None], by_document: bool):
        self.k, self.depth, self.units, self.by_document = k, depth, units, by_document

    def open(self, table: pa.Table) -> tuple[Chunk, Runs, np.ndarray]:
        """The chunk, its runs, and the number of each run's document."""
        chunk = Chunk(table)
        self.units(chunk)
        found = runs(chunk, self.k, self.depth, not self.by_document)
        return chunk, found, np.searchsorted(chunk.stops, found.first, "right")

    def ask(self, docs: DataFrame, solve: Callable[[dict[str, np.ndarray], list[bytes]], dict[str, np.ndarray]]) -> DataFrame:
        """The answers by chunk (ANSWER). ``solve`` gets the columns of all segments of a bucket and
        their bodies, and returns ``row`` (the segment answered), ``at``, ``n``, ``doc`` and ``start``."""
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def send_keys(table: pa.Table) -> pa.Table:
            chunk, found, doc = self.open(table)
            key, part, again = sent_keys(found.key, chunk.ids[doc] if self.by_document else None, parts, found.again)
            asked = short(key)
            rows = [(chunk.chunk, p, np.sort(np.repeat(asked[a:b], 1 + again[a:b])).tobytes()) for p, a, b in slices(part)]
            return table_of(rows, "chunk int, part int, keys binary")

        def recurring(table: pa.Table) -> pa.Table:
            sent = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
            key, count = np.unique(np.concatenate(sent), return_counts=True)
            bits = [np.packbits(count[np.searchsorted(key, np.unique(x))] > 1).tobytes() for x in sent]
            return table_of(list(zip(table["chunk"].to_pylist(), table["part"].to_pylist(), bits)), "chunk int, part int, bits binary")

        def send_segments(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return table_of([], self.SEGMENT)
            chunk, found, doc = self.open(table)
            key, part, _ = sent_keys(found.key, None, parts, found.again)
            bits = dict(zip(replies["part"].to_pylist(), replies["bits"].to_pylist()))
            recurs = np.zeros(len(key), bool)
            for p, a, b in slices(part):
                asked, place = np.unique(short(key[a:b]), return_inverse=True)  # the order of the bucket's bits
                recurs[a:b] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=len(asked))[place] > 0
            wanted = np.sort(key[recurs])
            mine = np.flatnonzero(is_in(found.key, wanted))
            own = doc[mine]
            # rows of one id are one document: the first place is not always the first in the chunk
            mine = mine[np.lexsort((found.first[mine] - chunk.firsts[own], chunk.ids[own], found.content[mine]))]
            content = found.content[mine]
            heads = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]])) if len(mine) else mine
            if self.by_document and len(mine):
                own = chunk.ids[doc[mine]]
                again = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
            else:
                again = np.diff(np.append(heads, len(mine))) > 1
            mine = mine[heads]
            part = bucket(found.key[mine], parts)
            order = np.argsort(part, kind="stable")
            mine, part, again = mine[order], part[order], again[order]
            rows = []
            for p, a, b in slices(part):
                r = mine[a:b]
                bodies = [self.body(chunk, f, f + n + self.depth - 1) for f, n in zip(found.first[r].tolist(), found.n[r].tolist())]
                d = doc[r]
                rows.append((
                    chunk.chunk, p, short(found.key[r]).tobytes(), found.content[r].tobytes(),
                    packed(chunk.ids[d]), packed(found.first[r] - chunk.firsts[d]), packed(again[a:b].astype(np.uint8)),
                    packed(np.array([len(x) for x in bodies], np.int32)), packed(b"".join(bodies)),
                ))
            return table_of(rows, self.SEGMENT)

        def answers(table: pa.Table) -> pa.Table:
            columns, bodies, owner = {}, [], []
            for name, kind in (("key", np.uint32), ("content", np.uint64)):
                columns[name] = np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
            for name, kind in (("doc", np.int64), ("start", np.int64), ("again", np.uint8)):
                got = [np.frombuffer(unpacked(x), kind) for x in table[name].to_pylist()]
                columns[name] = np.concatenate(got)
            owner = np.repeat(np.arange(table.num_rows), [len(x) for x in got])
            for size, body in zip(table["size"].to_pylist(), table["body"].to_pylist()):
                lens, body = np.frombuffer(unpacked(size), np.int32), unpacked(body)
                ends = np.cumsum(lens)
                bodies += [body[a:b] for a, b in zip((ends - lens).tolist(), ends.tolist())]
            got = solve(columns, bodies)
            order = np.argsort(owner[got["row"]], kind="stable")
            chunks, rows = table["chunk"].to_pylist(), []
            for o, a, b in slices(owner[got["row"]][order]):
                r = order[a:b]
                rows.append((
                    chunks[o], columns["content"][got["row"][r]].tobytes(), packed(got["at"][r].astype(np.uint8)),
                    packed(got["n"][r].astype(np.uint8)), packed(got["doc"][r].astype(np.int64)), packed(got["start"][r].astype(np.int64)),
                ))
            return table_of(rows, self.ANSWER)

        sent = groups(docs, "chunk", send_keys, "chunk int, part int, keys binary")
        bits = groups(sent.repartition(parts, "part"), "part", recurring, "chunk int, part int, bits binary")
        segments = docs.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(tidied(send_segments), self.SEGMENT)
        return groups(segments.repartition(parts, "part"), "part", answers, self.ANSWER)

    def body(self, chunk: Chunk, first: int, stop: int) -> bytes:
        """The units of a segment as bytes."""
        raise NotImplementedError

    def answered(self, table: pa.Table) -> dict[str, np.ndarray]:
        """The answers a chunk got, in order of their segment's hash."""
        kinds = (("at", np.uint8), ("n", np.uint8), ("doc", np.int64), ("start", np.int64))
        got = {name: np.frombuffer(b"".join(map(unpacked, table[name].to_pylist())), kind) for name, kind in kinds}
        got["content"] = np.frombuffer(b"".join(table["content"].to_pylist()), np.uint64)
        order = np.argsort(got["content"], kind="stable")
        return {name: x[order] for name, x in got.items()}


def is_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def groups(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` on the rows of each value of ``key``, where the rows of a value are in one partition.
    A task reads its partition once, unsorted, and holds its messages in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        del held
        keys = rows[key].to_numpy()
        order = np.argsort(keys, kind="stable")
        for _, a, b in slices(keys[order]):
            yield from fn(rows.take(pa.array(order[a:b]))).to_batches()
        del rows
        tidy()

    return df.mapInArrow(run, schema)


def tidied(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``fn`` for cogrouped tables; after each group the worker gives its memory back."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        tidy()
        return out

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, _ARROW[kind]) for (name, kind), c in zip(fields, columns)})
