"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round ``r`` inserts one symbol of every text, the ``r``-th from its end, so that the sorted list of
all suffixes of ``r`` symbols or fewer becomes that of ``r + 1`` or fewer. The list lives in files
that each round reads from front to back, block by block, and writes anew.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Stands before the first symbol of a text. No byte of UTF-8 has this value.
END = 255
#: Texts must be shorter, as lengths are kept in a byte.
LONGEST = 250
KINDS = {"bwt": np.uint8, "lcp": np.uint8, "suffix": np.int32}


class CollectionBwt:
    """The suffix list of the texts ``flat[starts[i] : starts[i] + lens[i]]``.

    A row of the list is a suffix: ``bwt`` the symbol before it, ``lcp`` what it has in common with
    the row before, ``suffix`` its text's number times 256 plus its length. ``block`` rows are worked
    on at once; a list of up to ``held`` rows is kept in memory instead of files. The files are
    unlinked as soon as they are open: they are scratch of the one task that builds the list, and a
    task that is run again builds it again.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, block: int = 1 << 18, held: int = 1 << 23):
        if len(lens) and (int(lens.max()) > LONGEST or len(lens) >= 1 << 23):
            raise ValueError(f"texts of more than {LONGEST} symbols, or too many of them")
        self.flat, self.starts, self.lens = flat, starts.astype(np.int64), lens.astype(np.int64)
        self.texts, self.block, self.held = len(lens), block, held
        texts = np.arange(self.texts)
        self.rows, self.columns = self.texts, self._files(self.texts)
        self.columns["bwt"][:] = self._before(texts, 0)
        self.columns["lcp"][:] = 0
        self.columns["suffix"][:] = texts << 8
        self.counts = np.bincount(self.columns["bwt"], minlength=256)
        self.fresh, done = texts, 0  # rows of the last round
        while self._insert(done):
            done += 1

    def _files(self, rows: int) -> dict[str, np.ndarray]:
        if rows <= self.held:
            return {k: np.empty(rows, t) for k, t in KINDS.items()}
        out = {}
        for k, t in KINDS.items():
            with tempfile.NamedTemporaryFile(delete=False) as f:
                f.truncate(rows * np.dtype(t).itemsize)
            out[k] = np.memmap(f.name, t, "r+", shape=(rows,))
            os.unlink(f.name)
        return out

    def _before(self, owner: np.ndarray, depth: int) -> np.ndarray:
        """The symbol before the suffix of ``depth`` symbols of each owner."""
        left = self.lens[owner] - depth
        out = np.full(len(owner), END, np.uint8)
        out[left > 0] = self.flat[(self.starts[owner] + left - 1)[left > 0]]
        return out

    def _insert(self, r: int) -> bool:
        """One round. The next list is the empty suffixes, then all rows that have a symbol before
        them, in stable order of that symbol. The last round's rows give new suffixes; any other row
        gives one that is in the list already, so what is there keeps its order."""
        places = self._places()
        if places is None:
            return False
        at, lcp, is_new, owner = places
        new_at, owner = at[is_new], owner[is_new]
        symbols = self._before(owner, r + 1)
        self.counts = self.counts + np.bincount(symbols, minlength=256)
        old, rows = self.columns, self.rows + len(new_at)
        new = self._files(rows)
        taken = 0
        for a in range(0, rows, self.block):
            b = min(rows, a + self.block)
            lo, hi = np.searchsorted(new_at, (a, b))
            spot = new_at[lo:hi] - a
            kept = np.ones(b - a, bool)
            kept[spot] = False
            was = slice(taken, taken + (b - a) - (hi - lo))
            taken = was.stop
            for kind, fill in (("bwt", symbols[lo:hi]), ("lcp", 0), ("suffix", (owner[lo:hi] << 8) + r + 1)):
                column = new[kind][a:b]
                column[kept] = old[kind][was]
                column[spot] = fill
            lo, hi = np.searchsorted(at, (a, b))
            new["lcp"][at[lo:hi]] = lcp[lo:hi]
        self.columns, self.rows, self.fresh = new, rows, new_at
        return True

    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows of the next list that are new or follow a new one, in order: place, common prefix,
        whether new, owner. One pass over the list, with what is open at a block's edge carried."""
        first = self.texts + np.cumsum(self.counts) - self.counts
        passed = np.zeros(256, np.int64)  # rows before this block, by symbol
        least = np.full(256, 255, np.uint8)  # common prefix of all rows since the symbol's last one
        was_new = np.zeros(256, bool)
        found = []
        for a in range(0, self.rows, self.block):
            b = min(self.rows, a + self.block)
            bwt, lcp = np.asarray(self.columns["bwt"][a:b]), np.append(self.columns["lcp"][a:b], np.uint8(255))
            sizes = np.bincount(bwt, minlength=256)
            heads = np.cumsum(sizes) - sizes
            order = np.argsort(bwt, kind="stable")[: (b - a) - sizes[END]]
            new = np.zeros(b - a, bool)
            lo, hi = np.searchsorted(self.fresh, (a, b))
            new[self.fresh[lo:hi] - a] = True
            new = new[order]
            here = np.flatnonzero(sizes[:END])
            touched = new.copy()
            touched[1:] |= new[:-1]
            touched[heads[here]] = new[heads[here]] | was_new[here]
            t = np.flatnonzero(touched)
            row = order[t]
            symbol = bwt[row]
            head = t == heads[symbol]
            if len(t):
                spans = np.empty((len(t), 2), np.int64)
                spans[:, 0] = np.where(head, 0, order[t - 1] + 1)
                spans[:, 1] = row + 1
                common = np.minimum.reduceat(lcp, spans.ravel())[::2]
                common[head] = np.minimum(common[head], least[symbol[head]])
                common += np.uint8(1)
                common[head & (passed[symbol] == 0)] = 0
                suffix = self.columns["suffix"][a:b][row]
                found.append((first[symbol] + passed[symbol] + t - heads[symbol], common, new[t], suffix >> 8))
            least = np.minimum(least, lcp.min())
            if len(here):
                last = heads[here] + sizes[here] - 1
                spans = np.empty((len(here), 2), np.int64)
                spans[:, 0], spans[:, 1] = order[last] + 1, b - a
                tail = spans[:, 0] < b - a
                least[here] = 255
                if tail.any():
                    least[here[tail]] = np.minimum.reduceat(lcp, spans[tail].ravel())[::2]
                was_new[here] = new[last]
            passed += sizes
        if not any(part[2].any() for part in found):
            return None
        at, lcp, is_new, owner = (np.concatenate(parts) for parts in zip(*found))
        order = np.argsort(at, kind="stable")
        return at[order], lcp[order], is_new[order], owner[order]

    def repeats(self, length: int, batch: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The suffixes of ``length`` symbols or more as (owner, depth, group), about ``batch`` rows
        of whole groups at a time: a group is a maximal run of rows with ``length`` symbols in common."""
        a, lcp = 0, self.columns["lcp"]
        while a < self.rows:
            b = min(self.rows, a + batch)
            while b < self.rows:  # to the end of the group
                ahead = np.flatnonzero(np.asarray(lcp[b : b + batch]) < length)
                if len(ahead):
                    b += int(ahead[0])
                    break
                b = min(self.rows, b + batch)
            suffix = np.asarray(self.columns["suffix"][a:b])
            long = (suffix & 255) >= length
            group = np.cumsum(np.asarray(lcp[a:b]) < length)
            yield suffix[long] >> 8, suffix[long] & 255, group[long]
            a = b
