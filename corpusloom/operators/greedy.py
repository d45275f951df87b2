"""Greedy grouping of ordered rows, exact for groups of any size.

A greedy rule opens a group at a row and keeps adding rows until a test on the open group
fails; the failing row opens the next group. The state is small, but it depends on all rows
before, so a window frame cannot hold it and a fold over a whole key would need one task.

The rules here share two properties: a group opened at a row does not depend on anything
before that row, and a group that was opened earlier never ends later. So a chunk of the key
can be summarised without knowing how it is entered: whatever state enters it, the first cut
falls no later than the first cut of a group opened at the chunk's first row. The rows up to
there, each with the state the chunk would be left in if that row opened a group, say all about
the chunk. The summaries of neighbouring chunks compose to a summary of the same form, so they
are reduced a second time before anything is walked in order:

1. summarise every (key, chunk): about one group's worth of rows per ``span`` rows,
2. summarise every (key, block of ``FAN`` chunks) from those,
3. walk the block summaries of a key, then the chunk summaries of every block, in order, which
   gives the state that enters each chunk,
4. number the groups of every (key, chunk) from its entry state.

Step 1 holds one chunk, steps 2 and 3 one group's rows per chunk of a block or per block of a
key: 2**28 rows of a key leave one group's worth of rows for the walk over blocks. Step 4 streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordered import with_ordinal

SPAN = 1 << 18
FAN = 1 << 10
#: Rows that a rule looks at first for the end of a group; twice as many each time it is not there.
AHEAD = 32


class PaddedBudget:
    """Open a new batch when longest * rows would exceed the budget."""

    def __init__(self, budget: float):
        self.budget = budget

    def open(self, row):
        return (1.0, float(row[0]))

    def add(self, state, row):
        """State after the row joins, or None when it must open a new group."""
        rows, longest = state[0] + 1, max(state[1], row[0])
        return None if longest * rows > self.budget else (rows, float(longest))

    def grown(self, state, columns, at, stop):
        """Whether each of some rows can't join any more, and the states if they do."""
        rows = state[0] + np.arange(1, stop - at + 1)
        longest = np.fmax(np.fmax.accumulate(columns[0][at:stop]), state[1])
        return longest * rows > self.budget, rows, longest


class ShortSegments:
    """Append a short segment to the open one while the two durations stay under a limit."""

    def __init__(self, short: float, limit: float):
        self.short, self.limit = short, limit

    def open(self, row):
        return (float(row[0]), float(row[1]))

    def add(self, state, row):
        length = row[1] - row[0]
        if length >= self.short or (state[1] - state[0]) + length >= self.limit:
            return None
        return (state[0], float(row[1]))

    def grown(self, state, columns, at, stop):
        start, end = columns[0][at:stop], columns[1][at:stop]
        length, before = end - start, np.concatenate([[state[1]], end[:-1]])
        return (length >= self.short) | ((before - state[0]) + length >= self.limit), np.full(stop - at, state[0]), end


def _run(lines: list[tuple], rule, state, at: int) -> tuple[int, tuple]:
    """Advance an open group from line ``at``; returns the cut position and the last state."""
    while at < len(lines):
        grown = rule.add(state, lines[at])
        if grown is None:
            return at, state
        state, at = grown, at + 1
    return at, state


def _gallop(columns: list[np.ndarray], rule, state, at: int, end: int) -> tuple[int, tuple]:
    """The same on arrays, for rows ``at`` to ``end``: running values of ever more rows at once."""
    ahead = AHEAD
    while at < end:
        stop = min(at + ahead, end)
        over, *states = rule.grown(state, columns, at, stop)
        cut = int(over.argmax())
        whole = not over[cut]
        last = stop - at - 1 if whole else cut - 1
        if last >= 0:
            state = tuple(float(s[last]) for s in states)
        if not whole:
            return at + cut, state
        at, ahead = stop, 2 * ahead
    return end, state


def _leave(columns: list[np.ndarray], rule, start: int, known: dict) -> tuple[tuple, int]:
    """State at the end of the chunk, and later cuts in it, if ``start`` opens a group."""
    trail, n = [], len(columns[0])
    while start not in known:
        trail.append(start)
        cut, state = _gallop(columns, rule, rule.open([c[start] for c in columns]), start + 1, n)
        if cut == n:
            known[start] = (state, 0)
        start = cut if cut < n else start
    for s in reversed(trail):
        if s not in known:
            state, cuts = known[start]
            known[s] = (state, cuts + 1)
        start = s
    return known[trail[0]] if trail else known[start]


def _pass(lines: list[tuple], ends: list[int], rule, state, part: int) -> tuple[int, tuple]:
    """Advance an open group over whole parts; returns the line that cuts it, or the state.

    ``lines`` are summary lines (fields, exit state, later cuts), ``ends`` where each part ends.
    """
    at = ends[part - 1] if part else 0
    while at < len(lines):
        grown = rule.add(state, lines[at])
        if grown is None:
            return at, state
        state, at = grown, at + 1
    return at, state


def _compose(lines: list[tuple], parts: list[int], rule) -> list[tuple]:
    """Summary of a run of parts from their summaries.

    ``parts`` holds the part number of each line. A line's exit state is that of its own part;
    it is carried on through the parts that follow.
    """
    ends = [i + 1 for i in range(len(lines)) if i + 1 == len(lines) or parts[i + 1] != parts[i]]
    index = {}
    for n, end in enumerate(ends):
        index.update((i, n) for i in range(ends[n - 1] if n else 0, end))
    known: dict = {}

    def leave(start: int) -> tuple[tuple, int]:
        trail = []
        while start not in known:
            state, cuts, part = lines[start][-3:-1], lines[start][-1], index[start] + 1
            cut, state = _pass(lines, ends, rule, state, part)
            trail.append((start, cuts))
            if cut == len(lines):
                known[start] = (state, cuts)
            else:
                start = cut
        for s, cuts in reversed(trail):
            if s not in known:
                state, later = known[start]
                known[s] = (state, cuts + 1 + later)
            start = s
        return known[start]

    first_cut, _ = _run(lines, rule, rule.open(lines[0]), 1)
    out = []
    for i in range(min(first_cut + 1, len(lines))):
        state, cuts = leave(i)
        out.append((*lines[i][:-3], *state, cuts))
    return out


def greedy_groups(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    fields: list[str],
    rule,
    name: str = "group_no",
    span: int = SPAN,
    fan: int = FAN,
) -> DataFrame:
    """Number the greedy groups of each key from 0; returns ``keys, order, fields, name``.

    ``order``: columns, unique inside a key, the first of them an integer. A key's first chunk is
    entered without a group; what enters a later chunk comes from the summaries of those before,
    so a key of one chunk has nothing to summarise. The numbering pass streams over sorted rows and
    keeps only the open group's state; rules look at rows in arrays, ever more until a group ends.
    """
    by = [order] if isinstance(order, str) else order
    kept = list(dict.fromkeys([*by, *fields]))
    slim = with_ordinal(df.select(*keys, *kept), keys, by, "_rn", total="_size")
    slim = slim.withColumn("_cut", F.expr(f"(_rn - 1) div {span}"))
    key_type = {f.name: f.dataType.simpleString() for f in slim.schema}
    key_ddl = ", ".join(f"`{k}` {key_type[k]}" for k in keys)
    field_ddl = ", ".join(f"`{f}` {key_type[f]}" for f in fields)

    summary_columns = [*keys, "_cut", "_at", *fields, "_s0", "_s1", "_cuts"]
    entry_columns = [*keys, "_cut", "_open", "_e0", "_e1", "_number"]

    def summarise(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf.sort_values("_rn", inplace=True)
        columns = [pdf[f].to_numpy() for f in fields]
        first_cut, _ = _gallop(columns, rule, rule.open([c[0] for c in columns]), 1, len(pdf))
        known: dict = {}
        out = []
        for at in range(min(first_cut + 1, len(pdf))):
            state, cuts = _leave(columns, rule, at, known)
            out.append((*group, at, *[c[at] for c in columns], *state, cuts))
        return pd.DataFrame(out, columns=summary_columns)

    def lines_of(pdf: pd.DataFrame) -> list[tuple]:
        return list(zip(*[pdf[c].tolist() for c in [*fields, "_s0", "_s1", "_cuts"]]))

    def compose(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf.sort_values(["_cut", "_at"], inplace=True)
        lines = _compose(lines_of(pdf), pdf["_cut"].tolist(), rule)
        out = [(*group, at, *line) for at, line in enumerate(lines)]
        return pd.DataFrame(out, columns=summary_columns)

    def walk(key: tuple, pdf: pd.DataFrame, state, number: int) -> pd.DataFrame:
        """Entry state of every part of ``pdf``, entered with ``state`` and group ``number``."""
        pdf.sort_values(["_cut", "_at"], inplace=True)
        out = []
        for cut, part in pdf.groupby("_cut", sort=True):
            out.append((*key, cut, state is not None, *(state or (0.0, 0.0)), number))
            for line in lines_of(part):
                grown = rule.add(state, line) if state is not None else None
                if grown is None:
                    state, number = line[-3:-1], number + 1 + line[-1]
                    break
                state = grown
        return pd.DataFrame(out, columns=entry_columns)

    def enter_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return walk(key, pdf, None, -1)

    def enter_chunks(place: tuple, pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        e = entry.iloc[0]
        state = (e["_e0"], e["_e1"]) if e["_open"] else None
        return walk(place[:-1], pdf, state, int(e["_number"]))

    def number_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, number = None, None, -1
        for pdf in frames:
            columns = [pdf[f].to_numpy() for f in fields]
            parts = pdf.groupby(place, sort=False, dropna=False).ngroup().to_numpy()
            bounds = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(pdf)]
            ids = np.empty(len(pdf), np.int64)
            for at, end in zip(bounds, bounds[1:]) if len(pdf) else []:
                here = tuple(None if pd.isna(x) else x for x in pdf[place].iloc[at])
                if here != current:
                    current, entry = here, pdf[["_open", "_e0", "_e1", "_number"]].iloc[at]
                    state, number = (entry["_e0"], entry["_e1"]) if entry["_open"] else None, int(entry["_number"])
                while at < end:
                    if state is not None:
                        cut, state = _gallop(columns, rule, state, at, end)
                        ids[at:cut] = number
                        at = cut
                    if at < end:
                        state, number = rule.open([c[at] for c in columns]), number + 1
                        ids[at] = number
                        at += 1
            yield pdf[[*keys, *kept]].assign(**{name: ids})

    place = [*keys, "_cut"]
    summary_ddl = (
        f"{key_ddl}, _cut bigint, _at bigint, {field_ddl}, _s0 double, _s1 double, _cuts bigint"
    )
    entry_ddl = (
        f"{key_ddl}, _cut bigint, _open boolean, _e0 double, _e1 double, _number bigint"
    )
    large = slim.filter(F.col("_size") > span)
    chunks = large.groupBy(*place).applyInPandas(summarise, summary_ddl)
    block = F.expr(f"_cut div {fan}").alias("_block")
    blocks = chunks.groupBy(*keys, block).applyInPandas(compose, summary_ddl)
    into_blocks = blocks.groupBy(*keys).applyInPandas(enter_blocks, entry_ddl)
    entries = (
        chunks.groupBy(*keys, block)
        .cogroup(into_blocks.groupBy(*keys, "_cut"))
        .applyInPandas(enter_chunks, entry_ddl)
    )
    unentered = {"_open": F.lit(False), "_e0": F.lit(0.0), "_e1": F.lit(0.0)}
    first = slim.filter("_cut = 0").withColumns({**unentered, "_number": F.lit(-1).cast("bigint")})
    rows = first.unionByName(slim.filter("_cut > 0").join(entries, place))
    kept_ddl = ", ".join(f"`{c}` {key_type[c]}" for c in kept)
    return (
        rows.repartition(*place)
        .sortWithinPartitions(*place, "_rn")
        .mapInPandas(number_rows, f"{key_ddl}, {kept_ddl}, {name} bigint")
    )
