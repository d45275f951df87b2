"""Suffix-array dedup: byte strings that stand in an earlier document are cut out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from corpusloom.llm.collection_bwt import CollectionBwt
from corpusloom.llm.passages import Chunk, Exchange, dealt, tidied

#: Segments in one suffix list, on average (a key's segments stay together).
LIST = 1 << 16


class _Bytes(Exchange):
    def body(self, chunk: Chunk, first: int, stop: int) -> bytes:
        return chunk.raw[first:stop].tobytes()


def _least_documents(length: int):
    def solve(columns: dict[str, np.ndarray], bodies: list[bytes]) -> dict[str, np.ndarray]:
        """Of every window of every segment the smallest document, from the suffix lists of the
        bucket's distinct segments (equal ones are one, with their smallest document)."""
        index: dict[bytes, int] = {}
        of = np.array([index.setdefault(b, len(index)) for b in bodies], np.int64)
        texts = list(index)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, of, columns["doc"])
        key = np.zeros(len(texts), columns["key"].dtype)
        key[of] = columns["key"]
        order = np.argsort(key, kind="stable")
        lens = np.array([len(b) for b in texts], np.int64)[order]
        flat = np.frombuffer(b"".join([texts[i] for i in order.tolist()]), np.uint8)
        stops = np.cumsum(lens)
        starts, docs, windows = stops - lens, least[order], lens - length + 1
        base = np.cumsum(windows) - windows
        first_doc = np.repeat(docs, windows)
        # a text alone under its key has no other to be compared with: lists are built of the others
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(texts) else order
        size = np.diff(np.append(heads, len(texts)))
        some = np.flatnonzero(np.repeat(size > 1, size))
        edges = np.concatenate([[0], np.cumsum(size[size > 1])])
        a = 0
        while a < len(some):
            b = int(edges[min(np.searchsorted(edges, a + LIST), len(edges) - 1)])
            part = some[a:b]
            built = CollectionBwt(flat, starts[part], lens[part])
            for owner, depth, group in built.repeats(length):
                if not len(owner):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                low = np.minimum.reduceat(docs[part[owner]], heads)
                low = np.repeat(low, np.diff(np.append(heads, len(owner))))
                first_doc[base[part[owner]] + lens[part[owner]] - depth] = low
            a = b
        change = np.ones(len(first_doc), bool)
        change[1:] = first_doc[1:] != first_doc[:-1]
        change[base] = True
        head = np.flatnonzero(change)
        size = np.diff(np.append(head, len(first_doc)))
        text = np.searchsorted(base, head, "right") - 1
        # each sender gets its text's pieces
        place = np.empty(len(texts), np.int64)
        place[order] = np.arange(len(texts))
        lo, hi = np.searchsorted(text, place[of]), np.searchsorted(text, place[of], "right")
        row = np.repeat(np.arange(len(of)), hi - lo)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        at, doc = head[piece] - base[text[piece]], first_doc[head[piece]]
        useful = (doc < columns["doc"][row]) | (columns["again"][row] > 0)
        row, piece, at, doc = row[useful], piece[useful], at[useful], doc[useful]
        return {"row": row, "at": at, "n": size[piece], "doc": doc, "start": np.zeros(len(row), np.int64)}

    return solve


def joined(begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal stretches that the given ones cover, in order; stretches of different owners stay apart."""
    order = np.argsort(begin, kind="stable")
    begin, owner = begin[order], owner[order]
    reach = np.maximum.accumulate(end[order])
    head = np.ones(len(order), bool)
    head[1:] = (begin[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(head)
    return begin[heads], reach[np.append(heads[1:], len(order)) - 1] if len(heads) else heads, owner[heads]


def whole_characters(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches without the bytes of characters that are cut into; ``last``: where each one's text ends.
    Only the ends of a stretch can cut into one, so the bytes between them are not looked at."""
    begin, end = begin.copy(), end.copy()
    into = np.flatnonzero(begin < end)
    while len(into := into[(raw[begin[into]] & 0xC0) == 0x80]):
        begin[into] += 1
        into = into[begin[into] < end[into]]
    into = np.flatnonzero((begin < end) & (end < last))
    while len(into := into[(raw[end[into]] & 0xC0) == 0x80]):
        end[into] -= 1
        into = into[begin[into] < end[into]]
    return begin, end


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 20,
                 characters: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, rest)`` per row: what is left of its text.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller id. Texts are UTF-8 bytes; strings are judged on the input, overlaps count, and no string
    crosses documents. ``kept`` holds the remaining bytes, ``n_spans`` counts the maximal removed
    runs, ``rest`` has all other columns of the row. With ``characters`` a character goes only with
    all its bytes, so that ``kept`` is a text again.

    Candidates are segments whose key recurs (see ``passages``); every bucket builds the
    Burrows-Wheeler transform and the common prefixes of its distinct segments column by column, and
    a run of ``length`` common symbols is one string, whose smallest document is known then.

    Null texts are empty and stay so. A null id comes before all others. Rows with one id are one
    document: they don't remove each other's strings. An empty table gives an empty table.
    """
    exchange = _Bytes(k, length, Chunk.as_bytes, by_document=True)
    docs = dealt(df, id_col, text_col)
    answers = exchange.ask(docs, _least_documents(length))
    rest = docs.schema["rest"]
    schema = StructType([
        StructField("doc_id", LongType()), *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
        StructField("kept", BinaryType()), rest,
    ])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk, found, doc = exchange.open(table)
        got = exchange.answered(replies)
        lo = np.searchsorted(got["content"], found.content)
        many = np.searchsorted(got["content"], found.content, "right") - lo
        run = np.repeat(np.arange(len(many)), many)
        piece = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        gone = got["doc"][piece] < chunk.ids[doc[run]]
        run, piece = run[gone], piece[gone]
        begin = found.first[run] + got["at"][piece]
        begin, end, owner = joined(begin, begin + got["n"][piece] + (length - 1), doc[run])
        if characters:
            begin, end = whole_characters(chunk.raw, begin, end, chunk.stops[owner])
            some = begin < end
            begin, end, owner = begin[some], end[some], owner[some]
        n_spans = np.bincount(owner, minlength=len(chunk.ids))
        total = np.concatenate([[0], np.cumsum(end - begin)])
        edges = np.concatenate([[0], np.cumsum(n_spans)])
        n_removed = total[edges[1:]] - total[edges[:-1]]
        kept = list(chunk.bodies)
        for i in np.flatnonzero(n_spans).tolist():
            body, own = kept[i], slice(int(edges[i]), int(edges[i + 1]))
            cuts = zip([0, *(end[own] - chunk.firsts[i]).tolist()], [*(begin[own] - chunk.firsts[i]).tolist(), len(body)])
            kept[i] = b"".join([body[a:b] for a, b in cuts])
        return pa.table({
            "doc_id": pa.array(chunk.ids, mask=np.array(chunk.table["doc_id"].is_null())), "n_bytes": chunk.stops - chunk.firsts,
            "n_removed": n_removed.astype(np.int64), "n_spans": n_spans.astype(np.int64), "kept": pa.array(kept, pa.binary()),
            "rest": chunk.table["rest"],
        })

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidied(finish), schema)
