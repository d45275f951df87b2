"""Growing text logs as a stream: a source that reads on from the last byte of every file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpusloom.sources.files import hidden, opened

SCHEMA = "file string, offset bigint, line string"
#: Bytes of a file that one task reads, and bytes looked at or sent on at once.
RANGE, BLOCK = 64 << 20, 1 << 16


def whole_lines(source: pa.NativeFile, size: int, known: int) -> int:
    """Where the last whole line ends; looked for backwards, not beyond what is ``known`` to be whole."""
    at = size
    while at > known:
        begin = max(known, at - BLOCK)
        source.seek(begin)
        found = source.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return known


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from ``begin`` up to ``end``; ``first`` begins a line."""

    path: str
    begin: int
    end: int
    first: bool


class TailReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file, so what is appended later comes once, and a query that
    starts again from its checkpoint goes on where it was. A last line without its end waits."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, base = opened(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(base, recursive=True))
        else:
            found = [info]
        for file in found:
            if file.type != fs.FileType.File or hidden(file.path, base):
                continue
            known = self.known.get(file.path, 0)
            if file.size > known:
                with system.open_input_file(file.path) as source:
                    self.known[file.path] = whole_lines(source, file.size, known)
            elif file.size < known:
                self.known[file.path] = file.size
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if stop < begin:
                raise ValueError(f"{path} has become shorter than what was read of it")
            out += [Range(path, at, min(at + RANGE, stop), at == begin) for at in range(begin, stop, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as source:
            for rows in lines_of(source, partition):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.path] * len(rows), pa.string()),
                        pa.array([at for at, _ in rows], pa.int64()),
                        pa.array([line.rstrip(b"\r").decode("utf-8", "replace") for _, line in rows], pa.string()),
                    ],
                    names=["file", "offset", "line"],
                )

    def commit(self, end: dict) -> None:
        """Nothing to release: the logs stay."""


def lines_of(source: pa.NativeFile, part: Range) -> Iterator[list[tuple[int, bytes]]]:
    """``(offset, line)`` of the lines that begin in a range, about a block at a time."""
    at, begun, rest = part.begin, part.first, []
    # the line that runs into the range belongs to the one before
    source.seek(part.begin - (not begun))
    while at < part.end:
        block = source.read(BLOCK)
        if not block:
            return
        if not begun:
            found = block.find(b"\n")
            if found < 0:
                at += len(block)
                continue
            at, block, begun = at + found, block[found + 1 :], True
        first, *others = block.split(b"\n")
        rest.append(first)
        if not others:
            continue
        rows = []
        for line in [b"".join(rest), *others[:-1]]:
            if at >= part.end:
                break
            rows.append((at, line))
            at += len(line) + 1
        rest = others[-1:]
        yield rows


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def tail_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, line)`` stream of the lines of a file, or of all files of a folder (hidden ones
    are passed over), from wherever the query's checkpoint was. ``offset`` is the line's first byte.

    Files only grow. New files are found; one that is gone gives no more; one that has become shorter
    ends the query with an error. Lines end with ``\\n``; a ``\\r`` before it is dropped; bytes that are
    not UTF-8 are replaced. A large addition is read by several tasks, cut at lines.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).load(path)
