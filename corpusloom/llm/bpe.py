"""BPE encoding with reuse of content-defined chunks; joins of chunks are repaired by re-encoding."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WHITE, grams, text_of, tidy

#: A chunk ends where the rolling hash of this many bytes has zeros under the mask (1 KB on average).
ROLL, MASK = 16, np.uint64((1 << 10) - 1)
LEAST, MOST = 256, 8192
#: Words, bytes of chunks and names of chunks met once that a worker remembers. Beyond, it forgets words
#: and chunks, or chunks only, and starts again (only speed changes).
WORDS_KEPT, CHUNK_BYTES_KEPT, CHUNKS_MET = 600_000, 8 << 20, 100_000
#: Words that the library encodes as one text.
TOGETHER = 2000


def cut(body: bytes) -> list[bytes]:
    """Chunks of ``body`` whose ends depend on the bytes near them only, so equal passages are cut
    alike in any document. A chunk has LEAST to MOST bytes (the last may be shorter) and never cuts
    a code point."""
    n = len(body)
    if n <= LEAST:
        return [body] if n else []
    raw = np.frombuffer(body, np.uint8)
    hashes = grams(raw.astype(np.uint64) + np.uint64(1), ROLL)
    ends = (np.flatnonzero((hashes & MASK) == 0) + ROLL).tolist()
    ends.append(n)
    out, at = [], 0
    for end in ends:
        while end - at > MOST:
            stop = at + MOST
            while raw[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(body[at:stop])
            at = stop
        if end == n or (end - at >= LEAST and raw[end] & 0xC0 != 0x80):
            if end > at:
                out.append(body[at:end])
            at = end
    return out


class Encoder:
    """Encodes texts as the tokenizer does, each chunk and each word of it once while remembered.

    White space between words yields no token and no rule of the tokenizer reaches over it, so a
    text's ids are those of its words in order (``check`` proves that on every chunk join).
    """

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        self.words_kept = words_kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.joined = self.tok.decoder is None  # then decoding puts one space between tokens
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.size = 0
        self.at, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0
        self.forget_chunks()

    def forget_chunks(self) -> None:
        self.met: set[int] = set()
        self.chunks: dict[bytes, np.ndarray] = {}
        self.chunk_bytes = 0

    def library(self, texts: list[bytes]) -> list[list[int]]:
        got = self.tok.encode_batch([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [e.ids for e in got]

    def several(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has. They go through the library as one text, which costs
        less than a call for each; the tokens' places tell the words they are of."""
        texts = [w.decode("utf-8") for w in words]
        got = self.tok.encode(" ".join(texts), add_special_tokens=False)
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.searchsorted(np.array([begin for begin, _ in got.offsets], np.int64), ends)
        return np.array(got.ids, np.int32), np.diff(cuts, prepend=0)

    def learn(self, words: list[bytes]) -> None:
        """Encode words not yet known."""
        parts = [self.several(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        flat, lens = (np.concatenate(x) for x in zip(*parts))
        while self.size + len(words) > len(self.lens):
            self.at, self.lens = np.append(self.at, self.at * 0), np.append(self.lens, self.lens * 0)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[self.size : self.size + len(words)] = self.used + np.cumsum(lens) - lens
        self.lens[self.size : self.size + len(words)] = lens
        self.index.update(zip(words, range(self.size, self.size + len(words))))
        self.size += len(words)
        self.used += len(flat)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, one after the other."""
        where = list(map(self.index.get, words))
        if None in where:
            self.learn(list({w for w, i in zip(words, where) if i is None}))
            where = list(map(self.index.get, words))
        rows = np.array(where, np.int64)
        lens = self.lens[rows]
        shift = np.repeat(self.at[rows] - (np.cumsum(lens) - lens), lens)
        return self.flat[np.arange(len(shift)) + shift]

    def chunk(self, chunk: bytes) -> np.ndarray:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self.words(chunk.split())
            name = hash(chunk)
            if name in self.met:  # most chunks never come again: kept from the second time on
                self.chunks[chunk] = ids
                self.chunk_bytes += len(chunk) + ids.nbytes
            else:
                self.met.add(name)
        return ids

    def check(self, before: list[bytes], middle: bytes, after: list[bytes]) -> bool:
        """Whether the library, given the words around a join as one text, agrees with their parts."""
        whole = self.library([b" ".join([*before, middle, *after])])[0]
        return np.array_equal(np.array(whole, np.int32), self.words([*before, middle, *after]))

    def encode(self, body: bytes) -> np.ndarray:
        """Ids of a whole text: its chunks', with each join re-encoded until both sides agree."""
        if self.size > self.words_kept:
            self.forget()
        elif self.chunk_bytes > CHUNK_BYTES_KEPT or len(self.met) > CHUNKS_MET:
            self.forget_chunks()
        parts = cut(body)
        out: list[np.ndarray] = []
        carry = b""  # the unfinished word at the end of what is encoded
        for k, part in enumerate(parts):
            ids = self.chunk(part)
            words = None
            if carry:
                words = part.split()
                if WHITE[part[0]] or not words:
                    out.append(self.words([carry]))
                else:
                    head = words[0]
                    ids = ids[len(self.words([head])) :]
                    if len(words) == 1 and not WHITE[part[-1]]:
                        carry += head
                        continue
                    middle, after = carry + head, words[1:2]
                    after = after if len(words) > 2 or WHITE[part[-1]] else []
                    if not self.check([], middle, after):
                        return np.array(self.library([body])[0], np.int32)
                    out.append(self.words([middle]))
                carry = b""
            if k + 1 < len(parts) and not WHITE[part[-1]]:
                words = words or part.split()
                carry = words[-1]
                ids = ids[: len(ids) - len(self.words([carry]))]
            out.append(ids)
        if carry:
            out.append(self.words([carry]))
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray, names: list[str] | None) -> str:
        if names is not None:
            return " ".join([names[i] for i in ids.tolist()])
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, words_kept: int) -> Encoder:
    """One per worker process."""
    if (path, words_kept) not in _ENCODERS:
        _ENCODERS[path, words_kept] = Encoder(path, words_kept)
    return _ENCODERS[path, words_kept]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words_kept: int = WORDS_KEPT) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` per row: the whole text's ids without special tokens
    added, and what they decode to.

    ``path``: the tokenizer's file, on every executor. Null and empty texts have no tokens and decode
    to the empty text. Rows are encoded where they are read: nothing is shuffled, so no key can be
    hot; each worker encodes a chunk or word it has met in any document only once while it remembers it.
    ``words_kept`` bounds the memory of a worker (some 150 bytes a word), not the result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, words_kept)
        names = [enc.tok.id_to_token(i) for i in range(enc.tok.get_vocab_size())] if enc.joined else None
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                ids = [enc.encode(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
                lens = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(lens)]).astype(np.int32),
                    pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()),
                )
                back = pa.array([enc.decode(i, names) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lens), lists, back], schema=schema)
        tidy()

    return text_of(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, decoded string"
    )


def digests(encoded: DataFrame) -> DataFrame:
    """Per row of ``encode``: ids and decoded text as SHA-256."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
