"""Substring dedup of word windows: confirmed passages are compiled into automata that read all texts."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.llm.passages import Chunk, Exchange, dealt


#: Windows of a passage in one piece; a longer one is compiled in pieces that share words.
LONGEST = 400


class _Words(Exchange):
    def body(self, chunk: Chunk, first: int, stop: int) -> bytes:
        """The words with one space between them."""
        return b" ".join(chunk.joined[chunk.begins[first] : chunk.ends[stop - 1]].split())


def _confirm(length: int):
    def solve(columns: dict[str, np.ndarray], bodies: list[bytes]) -> dict[str, np.ndarray]:
        """Windows that stand in more than one place, word by word the same, and their first place."""
        number: dict[bytes, int] = {}  # of a window
        doc, start, again = columns["doc"].tolist(), columns["start"].tolist(), columns["again"].tolist()
        first: list[tuple[int, int]] = []
        several: list[bool] = []
        windows: list[list[int]] = []
        seen: dict[bytes, list[int]] = {}
        for i, body in enumerate(bodies):
            own = seen.get(body)
            if own is None:
                words = np.flatnonzero(np.frombuffer(body, np.uint8) == 0x20).tolist()
                begins, ends = [0, *[w + 1 for w in words]], [*words, len(body)]
                own = []
                for j in range(len(begins) - length + 1):
                    w = number.setdefault(body[begins[j] : ends[j + length - 1]], len(first))
                    own.append(w)
                    if w == len(first):
                        first.append((doc[i], start[i] + j))
                        several.append(False)
                    else:
                        several[w] = True
                seen[body] = own
            else:
                for w in own:
                    several[w] = True
            for j, w in enumerate(own):
                if (doc[i], start[i] + j) < first[w]:
                    first[w] = (doc[i], start[i] + j)
                if again[i]:
                    several[w] = True
            windows.append(own)
        flat = np.array([w for own in windows for w in own], np.int64)
        size = np.array([len(own) for own in windows], np.int64)
        row = np.repeat(np.arange(len(bodies)), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        docs, starts = (np.array([f[k] for f in first], np.int64)[flat] if len(flat) else flat for k in (0, 1))
        good = np.array(several, bool)[flat] if len(flat) else np.empty(0, bool)
        row, at, docs, starts = row[good], at[good], docs[good], starts[good]
        change = np.ones(len(row), bool)
        change[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(change)
        n = np.diff(np.append(heads, len(row)))
        return {"row": row[heads], "at": at[heads], "n": n, "doc": docs[heads], "start": starts[heads]}

    return solve


def passages(begin: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, own: np.ndarray, place: np.ndarray):
    """Stretches of recurring windows that stand somewhere after their first place: where in the
    chunk each begins, its windows, and its first place. Neighbours that continue each other here
    and there are one passage, of at most LONGEST windows."""
    late = (doc < own) | ((doc == own) & (start < place))
    order = np.flatnonzero(late)[np.argsort(begin[late], kind="stable")]
    begin, n, doc, start = begin[order], n[order], doc[order], start[order]
    head = np.ones(len(order), bool)
    ends, ends_there = begin + n, start + n
    head[1:] = (begin[1:] != ends[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != ends_there[:-1])
    heads = np.flatnonzero(head)
    begin, doc, start = begin[heads], doc[heads], start[heads]
    n = np.add.reduceat(n, heads) if len(heads) else n
    parts = -(-n // LONGEST)
    nth = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
    begin, doc, start = np.repeat(begin, parts) + nth, np.repeat(doc, parts), np.repeat(start, parts) + nth
    n = np.minimum(np.repeat(n, parts) - nth, LONGEST)
    return begin, n, (doc, start)


def occurrences(sequences: list[tuple[int, ...]], text: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Every place where one of the different sequences stands in ``text``: last element, number of the sequence."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, s in enumerate(sequences):
        automaton.add_word(s, i)
    if not len(automaton) or not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def drop_repeated_phrases(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, k: int = 8) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, rest)`` per row: what is left of its words.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``length`` words of its
    document covers it whose words also start earlier (in a document with a smaller id, or further
    to the front of the same document); windows are judged on the input. ``kept``: the remaining
    words with one space between them; ``rest``: all other columns.

    Candidate segments meet in buckets, where recurring windows are confirmed word by word. Each
    chunk of documents then compiles the confirmed passages that it holds into an Aho-Corasick
    automaton over word numbers, one shard of the whole, and streams its documents through it: every
    occurrence is located, and its words go unless it is the passage's first place.

    Null texts have no words. A null id comes before all others. Rows with one id count as one
    document, in which passages at the same place don't remove each other. Empty table: empty result.
    """
    exchange = _Words(k, length, Chunk.as_words, by_document=False)
    docs = dealt(df, id_col, text_col)
    answers = exchange.ask(docs, _confirm(length))
    rest = docs.schema["rest"]
    schema = StructType([
        StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()),
        StructField("kept", StringType()), rest,
    ])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk, found, doc = exchange.open(table)
        got = exchange.answered(replies)
        words, text = chunk.words, tuple(chunk.codes.tolist())
        lo = np.searchsorted(got["content"], found.content)
        many = np.searchsorted(got["content"], found.content, "right") - lo
        run = np.repeat(np.arange(len(many)), many)
        piece = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        begin, size, origin = passages(
            found.first[run] + got["at"][piece], got["n"][piece].astype(np.int64), got["doc"][piece], got["start"][piece],
            chunk.ids[doc[run]], found.first[run] + got["at"][piece] - chunk.firsts[doc[run]],
        )
        size = size + (length - 1)
        # equal passages have one first place; rows of one id may have different ones at the same place
        distinct: dict[tuple[int, ...], int] = {}
        for i, (x, n) in enumerate(zip(begin.tolist(), size.tolist())):
            distinct.setdefault(text[x : x + n], i)
        sequences, of = list(distinct), np.fromiter(distinct.values(), np.int64, len(distinct))
        size, origin = size[of], (origin[0][of], origin[1][of])
        last, which = occurrences(sequences, text)
        first = last - size[which] + 1
        owner = np.searchsorted(chunk.stops, first, "right")
        inside = last < chunk.stops[np.minimum(owner, len(chunk.ids) - 1)]
        first, which, owner = first[inside], which[inside], owner[inside]
        from_doc, from_start = origin[0][which], origin[1][which]
        own, place = chunk.ids[owner], first - chunk.firsts[owner]
        earlier = (from_doc < own) | ((from_doc == own) & (from_start < place))
        first, which = first[earlier], which[earlier]
        change = np.zeros(len(text) + 1, np.int32)
        np.add.at(change, first, 1)
        np.add.at(change, first + size[which], -1)
        removed = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[chunk.stops] - total[chunk.firsts]
        kept = []
        for a, b, n in zip(chunk.firsts.tolist(), chunk.stops.tolist(), n_removed.tolist()):
            left = [w for w, gone in zip(words[a:b], removed[a:b].tolist()) if not gone] if n else words[a:b]
            kept.append(b" ".join(left).decode("utf-8"))
        return pa.table({
            "doc_id": pa.array(chunk.ids, mask=np.array(chunk.table["doc_id"].is_null())), "n_words": chunk.stops - chunk.firsts,
            "n_removed": n_removed.astype(np.int64), "kept": pa.array(kept, pa.string()), "rest": chunk.table["rest"],
        })

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
