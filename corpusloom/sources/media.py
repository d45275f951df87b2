"""Media inventories: listing, output planning, pairing, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Suffixes per task, model file suffixes, folders that are not runs.
SUFFIXES = {
    "convert": ".wav .flac .mp3 .ogg .m4a .mp4 .mov .webm .mkv",
    "resample": ".wav .flac .mp3 .ogg .m4a .aac .wma",
    "vad": ".wav .mp3 .flac .m4a .ogg .wma",
    "asr": ".wav .mp3",
}
CASE_SENSITIVE = ("resample", "asr")
MODEL_SUFFIXES = ".pt .pth .ckpt .bin .safetensors"
NOT_RUNS = "runs logs figure training checkpoints models outputs ckpt"


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime`` of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def suffix(path: Column) -> Column:
    """Last dot and what follows in the file name (a leading dot is no suffix)."""
    return F.regexp_extract(file_name(path), "(?<=.)\\.[^.]+$", 0)


def without_suffix(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(suffix(path)))


def stem(path: Column) -> Column:
    return without_suffix(file_name(path))


def media_only(inventory: DataFrame, task: str) -> DataFrame:
    """Files whose suffix belongs to a task; two tasks compare the case as it is."""
    end = suffix(F.col("path"))
    end = end if task in CASE_SENSITIVE else F.lower(end)
    return inventory.filter(end.isin(*SUFFIXES[task].split()))


def scan_media(
    spark: SparkSession, folder: str, task: str, recursive: bool = True
) -> DataFrame:
    return media_only(list_files(spark, folder, recursive), task)


def asr_order(files: DataFrame) -> DataFrame:
    """Wav files first, then mp3, each by path."""
    first = F.when(F.lower(suffix(F.col("path"))) == ".wav", 0).otherwise(1)
    return files.orderBy(first, "path")


def default_output_dir(folder: str, ending: str) -> str:
    return folder.rstrip("/") + ending if folder else ""


def plan_outputs(inventory: DataFrame, src: str, dst: str) -> DataFrame:
    """Add ``target``: the same relative path under ``dst`` as a wav; others are left out."""
    root = src.rstrip("/") + "/"
    inside = inventory.filter(F.col("path").startswith(root))
    relative = F.substring(without_suffix(F.col("path")), F.lit(len(root) + 1), F.length("path"))
    return inside.withColumn(
        "target", F.concat(F.lit(dst.rstrip("/") + "/"), relative, F.lit(".wav"))
    )


def preview(plan: DataFrame, n: int = 50) -> DataFrame:
    return plan.orderBy("path").limit(n)


def pending_only(plan: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows whose target does not exist yet."""
    if overwrite:
        return plan
    return plan.join(existing.select(F.col("path").alias("target")), "target", "left_anti")


def output_progress(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing and expected targets and the whole percent."""
    there = existing.select(F.col("path").alias("target")).distinct().withColumn("_e", F.lit(True))
    counts = plan.join(there, "target", "left").agg(
        F.count("_e").alias("existing"), F.count(F.lit(1)).alias("expected")
    )
    return counts.withColumn("percent", F.expr("existing * 100 div greatest(expected, 1)"))


def pair_sidecars(inventory: DataFrame, root: str) -> DataFrame:
    """A wav and the txt of the same name, one or two folders below the root."""
    base = F.substring(
        without_suffix(F.col("path")), F.lit(len(root.rstrip("/")) + 2), F.length("path")
    )
    inside = inventory.filter(F.col("path").startswith(root.rstrip("/") + "/"))
    named = inside.select("path", base.alias("name"), suffix(F.col("path")).alias("_x"))
    deep = F.size(F.split("name", "/"))
    named = named.filter(deep.between(2, 3))
    audio = named.filter(F.col("_x") == ".wav").select("name", F.col("path").alias("audio"))
    text = named.filter(F.col("_x") == ".txt").select("name", F.col("path").alias("text_file"))
    return audio.join(text, "name")


def scan_run_outputs(inventory: DataFrame, roots: list[str], shown: int = 3) -> DataFrame:
    """Model files per run folder: count, MB, first names, newest first.

    ``inventory``: ``path, length, modificationTime``. Roots are tried in order: the first is
    the primary one and the others count only when it has no run folder; a folder name seen
    under an earlier root wins.
    """
    per_root = []
    for rank, root in enumerate(roots):
        base = root.rstrip("/") + "/"
        rest = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
        per_root.append(
            inventory.filter(F.col("path").startswith(base) & rest.contains("/")).select(
                F.substring_index(rest, "/", 1).alias("folder"),
                F.lit(rank).alias("_rank"),
                F.lit(root.rstrip("/")).alias("root"),
                file_name(F.col("path")).alias("file"),
                suffix(F.col("path")).isin(*MODEL_SUFFIXES.split()).alias("_model"),
                "length",
                "modificationTime",
            )
        )
    files = per_root[0]
    for other in per_root[1:]:
        files = files.unionByName(other)
    files = files.filter(~F.col("folder").isin(*NOT_RUNS.split()))
    folders = files.groupBy("folder", "root", "_rank").agg(
        F.count_if("_model").alias("models"),
        F.round(F.coalesce(F.sum(F.when(F.col("_model"), F.col("length"))), F.lit(0)) / 1048576, 1).alias("mb"),
        F.max("modificationTime").alias("modified"),
    )
    first = folders.agg(F.min("_rank")).scalar()
    usable = folders.filter((first > 0) | (F.col("_rank") == 0))
    best = usable.groupBy("folder").agg(F.min("_rank").alias("_rank"))
    # distinct names are ranked, so a folder of any size brings only the names that are shown
    distinct = files.filter("_model").select("folder", "_rank", "file").distinct()
    by_name = F.row_number().over(W.partitionBy("folder", "_rank").orderBy("file"))
    first_names = (
        distinct.withColumn("_no", by_name)
        .filter(F.col("_no") <= shown)
        .groupBy("folder", "_rank")
        .agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("content"))
    )
    counts = distinct.groupBy("folder", "_rank").agg(F.count(F.lit(1)).alias("names"))
    place = ["folder", "_rank"]
    return (
        usable.join(best, place)
        .join(counts, place, "left")
        .join(first_names, place, "left")
        .withColumns(
            {"names": F.coalesce("names", F.lit(0)), "content": F.coalesce("content", F.lit(""))}
        )
        .drop("_rank")
        .orderBy(F.col("modified").desc(), "folder")
    )
