"""Spelling variants: near words found by probing generated edits against Bloom filters of the vocabulary.

The vocabulary is hashed by position and letter, so the hash of an edited word follows from that of the
word without building it. Blocked Bloom filters, sharded by word length, are broadcast; every word
probes its edits, and only the hashes of positive edits are shuffled to the vocabulary. There an equal
hash of 64 bits removes the filters' false positives, and the words themselves decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, mix

#: Letters of a word, as the class of a regular expression; all are single bytes in Latin-1.
LETTERS = r"[A-Za-zÀ-ÿ]"
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words a block of 64 bits stands for, bits set by a word, words of a shard, blocks broadcast at once (32 MB).
WORDS_A_BLOCK, SET_BITS, SHARD, BROADCAST = 2, 5, 1 << 20, 1 << 22
#: Blocks built by one task group and sent as one row.
PIECE = 1 << 12
#: Words that are edited at once.
ROWS = 4096


def lowered(run: Column) -> Column:
    """A-Z lowered, other letters as they are."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def occurrences(df: DataFrame, id_col: str, text_col: str, least: int, every: int | None) -> DataFrame:
    """``(word)`` per run of at least ``least`` letters, lowered.

    With ``every``, runs whose CRC-32 of ``<id>:<run>`` it divides lose one letter (a null id is the
    empty text): a reproducible share of misspellings, so that a corpus has variants to find.
    """
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if every is None:
        return rows.select(lowered(F.col("run")).alias("word"))
    rows = rows.select("id", lowered(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.expr("substring(run, int(h % length(run)) + 2)"))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, every: int | None = None) -> DataFrame:
    """``(word, n)`` of the words of at least ``least`` letters that occur at least ``often`` times."""
    words = occurrences(df, id_col, text_col, least, every)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def weights(at: int | np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The share of a letter at a place in a word's hash."""
    return mix(np.asarray(at).astype(np.uint64) * np.uint64(256) + letters + np.uint64(1 << 40))


def by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, letters)``: words of one length as a matrix of letters, ROWS at most."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    lengths = np.array([len(w) for w in coded])
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        step = max(1, min(ROWS, (1 << 22) // size))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield size, part, np.frombuffer(b"".join(coded[r] for r in part), np.uint8).reshape(-1, size).astype(np.uint64)


def hashed(vocab: DataFrame) -> DataFrame:
    """The vocabulary with each word's length and hash: the sum of the shares of its letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, h = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.uint64)
            for length, rows, letters in by_length(b.column("word")):
                size[rows], h[rows] = length, weights(np.arange(length), letters).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(size), pa.array(h.view(np.int64))], names=["word", "n", "size", "h"])

    return vocab.mapInArrow(run, "word string, n long, size int, h long")


class Layout:
    """Where the words of each length have their filters: shards of one length, blocks in a shard, and
    the rounds whose shards are broadcast together."""

    def __init__(self, counts: dict[int, int]):
        self.first: dict[int, int] = {}
        self.shards: dict[int, int] = {}
        self.blocks: dict[int, int] = {}
        self.rounds: list[set[int]] = []
        total, shard = 0, 0
        for size, count in sorted(counts.items()):
            self.first[size], self.shards[size] = shard, -(-count // SHARD)
            self.blocks[size] = -(-count // (self.shards[size] * WORDS_A_BLOCK))
            for _ in range(self.shards[size]):
                if not self.rounds or total + self.blocks[size] > BROADCAST:
                    self.rounds.append(set())
                    total = 0
                self.rounds[-1].add(shard)
                total, shard = total + self.blocks[size], shard + 1

    def place(self, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, block in it and bits of hashes of words of one length."""
        high = h >> np.uint64(34)
        shards = np.uint64(self.shards[size])
        bits = np.zeros(len(h), np.uint64)
        for i in range(SET_BITS):
            bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return self.first[size] + (high % shards).astype(np.int64), ((high // shards) % np.uint64(self.blocks[size])).astype(np.int64), bits


def filters(words: DataFrame, layout: Layout, now: set[int]) -> dict[int, np.ndarray]:
    """The filters of some shards. Pieces of PIECE blocks are summed on Spark; BROADCAST bounds the whole."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, h = b.column("size").to_numpy(), b.column("h").to_numpy().view(np.uint64)
            for length in np.unique(size).tolist():
                shard, block, bits = layout.place(length, h[size == length])
                take = np.isin(shard, list(now))
                yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (shard, block, bits.view(np.int64))], names=["shard", "block", "bits"])

    def build(table: pa.Table) -> pa.Table:
        block, bits = table["block"].to_numpy(), table["bits"].to_numpy().view(np.uint64)
        piece, out = int(block[0]) // PIECE, np.zeros(PIECE, np.uint64)
        np.bitwise_or.at(out, block % PIECE, bits)
        return pa.table({"shard": [table["shard"][0].as_py()], "piece": [piece], "bits": [out.tobytes()]}, pa.schema([("shard", pa.int64()), ("piece", pa.int64()), ("bits", pa.binary())]))

    placed = words.select("size", "h").mapInArrow(place, "shard long, block long, bits long")
    blocks = placed.groupBy("shard", "block").agg(F.bit_or("bits").alias("bits"))
    pieces = blocks.groupBy("shard", F.floor(F.col("block") / PIECE).alias("piece")).applyInArrow(build, "shard long, piece long, bits binary")
    out: dict[int, np.ndarray] = {}
    for size, first in layout.first.items():
        for shard in range(first, first + layout.shards[size]):
            if shard in now:
                out[shard] = np.zeros(-(-layout.blocks[size] // PIECE) * PIECE, np.uint64)
    for r in pieces.collect():
        out[r["shard"]][r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["bits"], np.uint64)
    return out


def edits(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, hashes)`` of words with one letter less, and with one replaced by a later one.

    Being near is symmetric: an inserted letter is the other word's deleted one, an earlier letter the
    other word's later one. So these edits reach every pair of near words.
    """
    count, size = letters.shape
    every = np.arange(count)
    whole = np.zeros(count, np.uint64)
    shifted = np.zeros(count, np.uint64)
    for i in range(size):
        whole += weights(i, letters[:, i])
        if i:
            shifted += weights(i - 1, letters[:, i])
    ahead, behind = np.zeros(count, np.uint64), shifted
    for i in range(size):
        own = weights(i, letters[:, i])
        yield size - 1, every, ahead + behind
        later = np.nonzero(ALPHABET[None, :] > letters[:, i : i + 1])
        yield size, later[0], (whole - own)[later[0]] + weights(i, ALPHABET)[later[1]]
        ahead += own
        if i + 1 < size:
            behind = behind - weights(i, letters[:, i + 1])


def positives(words: DataFrame, layout: Layout, now: set[int]) -> DataFrame:
    """``(a, b)``: hash of a word and of an edit of it that the filters of these shards hold."""
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(filters(words, layout, now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            own = b.column("h").to_numpy().view(np.uint64)
            for _, rows, letters in by_length(b.column("word")):
                found_a, found_b = [], []
                for size, at, h in edits(letters):
                    if size not in layout.first:
                        continue
                    shard, block, bits = layout.place(size, h)
                    for s in np.unique(shard).tolist() if layout.shards[size] > 1 else [layout.first[size]]:
                        if s not in held:
                            continue
                        here = slice(None) if layout.shards[size] == 1 else shard == s
                        hit = held[s][block[here]] & bits[here] == bits[here]
                        found_a.append(own[rows[at[here][hit]]])
                        found_b.append(h[here][hit])
                if found_a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)], names=["a", "b"])

    return words.select("word", "h").mapInArrow(run, "a long, b long")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)`` for every word and each word one inserted, deleted or replaced letter away.

    ``words (word, n, size, h)`` has each word once. Filters beyond BROADCAST blocks go in several
    rounds, so what is broadcast is bounded whatever the vocabulary.
    """
    layout = Layout({r["size"]: r["count"] for r in words.groupBy("size").count().collect()})
    found = None
    for now in layout.rounds:
        part = checkpointed(positives(words, layout, now).distinct())
        found = part if found is None else found.union(part)
    if found is None:
        return words.selectExpr("word", "n", "word as near", "n as near_n").limit(0)
    near = words.selectExpr("h as b", "word as near", "n as near_n")
    pairs = found.join(near, "b").join(words.selectExpr("h as a", "word", "n"), "a")
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def spelling_variants(vocab: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word of a vocabulary ``(word, n)``.

    A word's form is its near word that occurs most (ties: the smallest by code points), if that is at
    least ``ratio`` times as often as the word; ``root`` follows forms to the last one. Each step
    multiplies n by the ratio, so chains end, after a number of doublings that the largest n tells.
    Words are of the letters LETTERS, each once; null words are left out; an empty vocabulary gives an
    empty table.
    """
    words = checkpointed(hashed(vocab.select(F.col("word").cast("string"), F.col("n").cast("long")).where("word is not null")))
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    joined = words.join(near, "word", "left")
    chosen = -F.col("best.less") >= F.col("n") * ratio
    table = checkpointed(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = table.where("form is not null").select("word", F.col("form").alias("root"))
    most = table.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = roots.selectExpr("word as root", "root as further")
        roots = checkpointed(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, every: int | None = None, ratio: int = 5) -> DataFrame:
    """Spelling variants among the words of whole texts; see ``vocabulary`` and ``spelling_variants``.

    Null and empty texts have no words; repeated rows count as often as they occur; other columns don't
    matter. A word occurs as often as its runs do, whatever the document.
    """
    return spelling_variants(checkpointed(vocabulary(df, id_col, text_col, least, often, every)), ratio)
