"""Shard lists, filelists and JSON maps in; datasets and exports out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.files import hidden, opened

PROBE = "path string, file string, inside string, rows bigint, columns array<string>, schema string, error string"


def read_list(spark: SparkSession, list_file: str) -> list[str]:
    """Paths in a list file; the list is driver-side because Spark's reader takes paths."""
    return [r.value.strip() for r in spark.read.text(list_file).toLocalIterator() if r.value.strip()]


def read_shards(
    spark: SparkSession, shards: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """Rows of the listed parquet shards with their ``src``; an unreadable shard is skipped.

    ``shards`` is a list file or the paths. With a ``schema`` no shard is opened for planning.
    """
    paths = read_list(spark, shards) if isinstance(shards, str) else list(shards)
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    reader = reader.schema(schema) if schema is not None else reader
    return reader.parquet(*paths).withColumn("src", F.input_file_name())


def probe_files(spark: SparkSession, paths: list[str], tasks: int = 256) -> DataFrame:
    """A row per parquet file of the given files and folders, from its footer: PROBE. ``inside`` is
    the file's place in the folder.

    The footers are read by up to ``tasks`` tasks, with pyarrow, so the paths must be of a file system it
    knows. What cannot be read, is missing or has no files is a row with an ``error``, not the job's end.
    """

    def read(path: str) -> Iterator[tuple]:
        from pyarrow import fs, parquet

        system, base = opened(path)
        found = system.get_file_info(base)
        files = [found]
        if found.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
            files = sorted((f for f in files if not hidden(f.path, base)), key=lambda f: f.path)
        if found.type == fs.FileType.NotFound or not files:
            yield path, None, None, None, None, None, "missing" if found.type == fs.FileType.NotFound else "no files"
            return
        for file in files:
            inside = file.path.removeprefix(base).lstrip("/")
            try:
                with system.open_input_file(file.path) as source:
                    footer = parquet.read_metadata(source)
                schema = footer.schema.to_arrow_schema().remove_metadata()
                yield path, file.path, inside, footer.num_rows, schema.names, schema.to_string(show_field_metadata=False), None
            except Exception as broken:  # any reason makes a row of the report
                yield path, file.path, inside, None, None, None, f"{type(broken).__name__}: {broken}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
        for b in batches:
            rows = [row for path in b.column("path").to_pylist() for row in read(path)]
            if rows:
                names = [field.split()[0] for field in PROBE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(tasks, len(paths)))).mapInArrow(run, PROBE)


def read_reported(spark: SparkSession, shards: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the readable shards with their ``src``, and a report with a row per file: PROBE.

    Shards with different columns have null where theirs are missing. ``shortfall`` tells of files whose
    pages turned out to be unreadable.
    """
    paths = read_list(spark, shards) if isinstance(shards, str) else list(shards)
    report = probe_files(spark, paths)
    good = [r.file for r in report.where("error is null").select("file").collect()]
    if not good:
        raise ValueError("no shard can be read")
    reader = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true")
    return reader.parquet(*good).withColumn("src", F.input_file_name()), report


def shortfall(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``file, rows, rows_read, error`` of the files that gave fewer rows than their footers say, or none.

    Reads all columns but maps: a count alone would be answered from the footers.
    """
    seen = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if c != "src" and "map<" not in kind])
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = rows.groupBy(F.url_decode(bare(F.col("src"))).alias("_file")).agg(F.sum(seen.bitwiseAND(0) + 1).alias("rows_read"))
    joined = report.join(read, bare(F.col("file")) == F.col("_file"), "left").withColumn("rows_read", F.coalesce("rows_read", F.lit(0)))
    return joined.where("error is not null or rows_read < rows").select(F.coalesce("file", "path").alias("file"), "rows", "rows_read", "error")


def expand_requests(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per sample and text; ``requests``: ``utt, tts_index, tts_text``."""
    return samples.join(requests.select("utt", "tts_index", "tts_text"), "utt")


def _field(line: Column, i: int) -> Column:
    return F.get(F.split(line, "\\|", -1), F.lit(i))


def parse_filelist(lines: DataFrame, n_spks: int = 1, line: str = "value") -> DataFrame:
    """``path|text`` or ``path|speaker|text`` lines."""
    c = F.col(line)
    keep = [x for x in lines.columns if x != line]
    if n_spks > 1:
        fields = [_field(c, 1).cast("int").alias("spk"), _field(c, 2).alias("text")]
    else:
        fields = [F.lit(None).cast("int").alias("spk"), _field(c, 1).alias("text")]
    return lines.select(*keep, _field(c, 0).alias("path"), *fields)


def read_filelist(spark: SparkSession, path: str, n_spks: int = 1) -> DataFrame:
    return parse_filelist(spark.read.text(path), n_spks)


def audio_filelist(
    train: DataFrame, valid: DataFrame, root: str, line: str = "value"
) -> DataFrame:
    """Audio paths of two filelists: the first field under the root, blank lines dropped."""

    def paths(lines: DataFrame, split: str) -> DataFrame:
        name = F.concat(F.lit(root.rstrip("/") + "/"), _field(F.col(line), 0), F.lit(".wav"))
        keep = [x for x in lines.columns if x != line]
        return lines.filter(F.length(line) > 0).select(
            *keep, name.alias("path"), F.lit(split).alias("split")
        )

    return paths(train, "train").unionByName(paths(valid, "valid"))


def merge_json_maps(files: DataFrame, body: str, order: str) -> DataFrame:
    """Union of JSON objects as key and value; the later file wins on an equal key."""
    entries = files.select(
        F.col(order).alias("_o"), F.explode(F.from_json(body, "map<string,string>")).alias("key", "value")
    )
    return entries.groupBy("key").agg(F.max_by("value", "_o").alias("value"))


def write_dataset(df: DataFrame, folder: str, batch_size: int | None = None, mode: str = "overwrite") -> bool:
    """A parquet dataset, in files of at most ``batch_size`` rows if given; an empty input writes nothing.

    The commit protocol leaves no partial dataset behind.
    """
    if df.isEmpty():
        return False
    df.write.mode(mode).option("maxRecordsPerFile", batch_size or 0).parquet(folder)
    return True


def export_table(df: DataFrame, folder: str, kind: str) -> str:
    """CSV with a header, or one JSON record per line."""
    if kind == "CSV":
        df.write.mode("overwrite").option("escape", '"').csv(folder, header=True)
    elif kind == "JSON":
        df.write.mode("overwrite").json(folder)
    else:
        raise ValueError(f"unsupported format: {kind}")
    return folder
