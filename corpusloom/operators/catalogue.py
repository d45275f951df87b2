"""Merging datasets and keeping the speaker catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.sources.tables import probe_files


def merge_datasets(parts: list[DataFrame]) -> DataFrame:
    """All rows, on the columns every part has (sorted by name); none in common is an error."""
    common = sorted(set.intersection(*[set(p.columns) for p in parts])) if parts else []
    if not common:
        raise ValueError("the datasets have no column in common")
    return reduce(DataFrame.unionByName, [p.select(*common) for p in parts])


def merge_stored(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stored datasets merged, and a report ``folder, splits, rows, error`` on each folder.

    A folder holds parquet files (also in ``key=value`` folders), or a sub-folder of them for each split;
    splits are flattened: all their rows are merged, on the columns that all have. A folder that is
    missing, empty or has a file that cannot be read is left out, with the reason in the report.
    Files of one schema are read together, so the plan grows with the schemas, not the folders.
    """
    split = F.regexp_extract("inside", "^([^/=]+)/", 1)
    files = probe_files(spark, [f.rstrip("/") for f in folders]).groupBy(F.col("path").alias("folder"), split.alias("split"), "schema")
    parts = files.agg(
        F.collect_list("file").alias("files"), F.sum("rows").alias("rows"), F.first("error", True).alias("error")
    ).collect()
    told, schemas = {}, {}
    for p in parts:
        splits, rows, error = told.get(p.folder, (set(), 0, None))
        told[p.folder] = splits | {p.split}, rows + (p.rows or 0), error or p.error
    for p in parts:
        if told[p.folder][2] is None:
            schemas.setdefault(p.schema, []).extend(p.files)
    if not schemas:
        raise ValueError("no dataset can be read")
    report = [(folder, len(splits), rows, error) for folder, (splits, rows, error) in sorted(told.items())]
    merged = merge_datasets([spark.read.parquet(*files) for files in schemas.values()])
    return merged, spark.createDataFrame(report, "folder string, splits int, rows bigint, error string")


def concat_datasets(parts: list[DataFrame]) -> DataFrame:
    """All rows of parts with the same columns."""
    return reduce(DataFrame.unionByName, parts)


def upsert_speaker(catalogue: DataFrame, changes: DataFrame) -> DataFrame:
    """New or replaced speakers by trimmed, non-blank name; rows without a vector are dropped.

    Both sides: ``speaker_id, embedding, version``. The latest version of a name wins, by a
    partial aggregate rather than a window, so a much-changed name is no hot group.
    """
    rows = catalogue.unionByName(changes).withColumn("speaker_id", strip(F.col("speaker_id")))
    usable = rows.filter((F.col("speaker_id") != "") & F.col("embedding").isNotNull())
    return usable.groupBy("speaker_id").agg(
        F.max_by("embedding", "version").alias("embedding"), F.max("version").alias("version")
    )
