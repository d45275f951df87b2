"""Inventories, filelists, JSON maps, datasets and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.session import shared_dir
from corpusloom.sources import media as M
from corpusloom.sources import tables as S
from queries import query

ENDS = [".wav", ".MP3", ".flac", ".mp4", ".txt", ".aac", ".WAV", ".tar.gz"]
PATH = "concat('/media/', source, '/', lang, '/', doc_id, e)"
INVENTORY = f"""
WITH d AS (SELECT *, {ENDS}[doc_id % 8 + 1] AS e FROM documents),
i AS (SELECT {PATH} AS path, n_chars AS length FROM d)
"""


def inventory(t):
    """A file per document."""
    ends = F.array(*[F.lit(e) for e in ENDS])
    rows = t.documents.withColumn("e", F.get(ends, (F.col("doc_id") % 8).cast("int")))
    return rows.select(F.expr(PATH).alias("path"), F.col("n_chars").alias("length"))


@query(INVENTORY + "SELECT * FROM i WHERE lower(regexp_extract(path, '[.][^.]+$')) IN ('.wav', '.flac', '.mp3', '.ogg', '.m4a', '.mp4', '.mov', '.webm', '.mkv')")
def scan_media(t):
    return M.media_only(inventory(t), "convert")


@query(INVENTORY + "SELECT * FROM i WHERE regexp_extract(path, '[.][^.]+$') IN ('.wav', '.flac', '.mp3', '.ogg', '.m4a', '.aac', '.wma')")
def scan_media_case(t):
    return M.media_only(inventory(t), "resample")


PLAN = INVENTORY.rstrip() + """,
p AS (SELECT *, '/out' || regexp_replace(substr(path, 7), '[.][^./]+$', '') || '.wav' AS target FROM i)
"""


def planned(t):
    return M.plan_outputs(inventory(t), "/media", "/out")


@query(PLAN + "SELECT * FROM p")
def plan_outputs(t):
    return planned(t)


@query(PLAN + "SELECT * FROM p ORDER BY path LIMIT 50")
def preview_outputs(t):
    return M.preview(planned(t))


def existing(t):
    """Labelled documents are done."""
    done = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return done.select(F.expr("concat('/out/', source, '/', lang, '/', doc_id, '.wav')").alias("path"))


DONE = ", x AS (SELECT '/out/' || source || '/' || lang || '/' || doc_id || '.wav' AS target FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


@query(PLAN + DONE + " SELECT * FROM p WHERE target NOT IN (SELECT target FROM x)")
def pending_only(t):
    return M.pending_only(planned(t), existing(t))


@query(PLAN + DONE + """
SELECT count(*) FILTER (target IN (SELECT target FROM x)) AS existing, count(*) AS expected,
  count(*) FILTER (target IN (SELECT target FROM x)) * 100 // count(*) AS percent FROM p
""")
def output_progress(t):
    return M.output_progress(planned(t), existing(t))


@query("""
SELECT 'documents.parquet' AS shard, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source
""")
def read_shards(t):
    rows = S.read_shards(t.spark, [f"{t.folder}/documents.parquet"])
    return rows.groupBy(M.file_name(F.col("src")).alias("shard"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


def shards(t):
    """A shard per language, one that is no parquet, one that is not there."""
    base = shared_dir(t.spark)
    t.documents.select("doc_id", F.col("lang").alias("part"), "n_chars").write.partitionBy("part").parquet(f"{base}/shards")
    t.benchmark.select("text").coalesce(1).write.text(f"{base}/broken")
    parts = [r.part for r in t.documents.select(F.col("lang").alias("part")).distinct().collect()]
    return [*[f"{base}/shards/part={p}" for p in parts], f"{base}/broken", f"{base}/nowhere"]


@query("SELECT doc_id, lang FROM documents")
def read_reported(t):
    rows, _ = S.read_reported(t.spark, shards(t))
    return rows.select("doc_id", F.regexp_extract("src", "part=([^/]+)/", 1).alias("lang"))


@query("""
SELECT lang AS shard, count(*) AS "rows", true AS readable FROM documents GROUP BY 1 UNION ALL
SELECT 'broken', 0, false UNION ALL SELECT 'nowhere', 0, false
""")
def shard_report(t):
    _, report = S.read_reported(t.spark, shards(t))
    found = report.groupBy(F.regexp_extract("path", "([^/=]+)$", 1).alias("shard"))
    return found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), (F.count("error") == 0).alias("readable"))


@query("""
SELECT doc_id AS utt, source, turn AS tts_index, c.text AS tts_text FROM documents JOIN conversations c ON conv_id = doc_id
""")
def expand_requests(t):
    samples = t.documents.select(F.col("doc_id").alias("utt"), "source")
    requests = t.conversations.select(
        F.col("conv_id").alias("utt"),
        F.col("turn").alias("tts_index"),
        F.col("text").alias("tts_text"),
    )
    return S.expand_requests(samples, requests)


LISTED = "concat(source, '/', doc_id, '.wav|', doc_id % 40, '|', replace(text, chr(10), ' '))"


@query("""
SELECT source || '/' || doc_id || '.wav' AS path, CAST(doc_id % 40 AS INTEGER) AS spk,
  string_split(replace(text, chr(10), ' '), '|')[1] AS text FROM documents
""")
def read_filelist(t):
    return S.parse_filelist(t.documents.select(F.expr(LISTED).alias("value")), n_spks=40)


@query("""
SELECT '/wavs/' || source || '/' || doc_id || '.wav' AS path, 'train' AS split FROM documents
UNION ALL SELECT '/wavs/' || role || '_' || conv_id || '.wav', 'valid' FROM conversations WHERE turn > 0
""")
def audio_filelist(t):
    train = t.documents.select(
        F.expr("concat(source, '/', doc_id, '|', replace(text, chr(10), ' '))").alias("value")
    )
    valid = t.conversations.select(
        F.expr("if(turn = 0, '', concat(role, '_', conv_id, '|', replace(text, chr(10), ' ')))").alias("value")
    )
    return S.audio_filelist(train, valid, "/wavs/")


@query("SELECT 'user_' || user_id AS key, max_by(event_type, event_id) AS value FROM events GROUP BY user_id")
def merge_json_maps(t):
    body = F.expr("concat('{\"user_', user_id, '\": \"', event_type, '\"}')")
    return S.merge_json_maps(t.events.select("event_id", body.alias("body")), "body", "event_id")


@query("""
WITH l AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT source || '/' || lang || '/' || doc_id AS name, '/s/' || source || '/' || lang || '/' || doc_id || '.wav' AS audio,
  '/s/' || source || '/' || lang || '/' || doc_id || '.txt' AS text_file FROM documents WHERE doc_id IN (SELECT doc_id FROM l)
""")
def pair_sidecars(t):
    base = "concat('/s/', source, '/', lang, '/', doc_id, '{}')"
    good = t.labels.filter("quality = 1").select("doc_id")
    audio = t.documents.select(F.expr(base.format(".wav")).alias("path"))
    text = t.documents.join(good, "doc_id", "left_semi").select(F.expr(base.format(".txt")).alias("path"))
    return M.pair_sidecars(audio.unionByName(text), "/s")


@query("""
WITH f AS (SELECT CASE WHEN doc_id % 19 = 0 THEN 'logs' ELSE source END AS folder, 'm' || doc_id % 6 || ['.pt', '.bin', '.txt'][doc_id % 3 + 1] AS file,
  doc_id % 3 <> 2 AS model, n_chars * 1000 AS length, 1700000000 + doc_id * 60 AS mtime, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS rank FROM documents),
g AS (SELECT folder, rank, count(*) FILTER (model) AS models, round(coalesce(sum(length) FILTER (model), 0) / 1048576, 1) AS mb,
  coalesce(list_sort(list(DISTINCT file) FILTER (model)), []) AS names, max(mtime) AS modified FROM f WHERE folder <> 'logs' GROUP BY folder, rank)
SELECT folder, CASE rank WHEN 0 THEN '/ckpt/a' ELSE '/ckpt/b' END AS root, models, mb, len(names) AS names,
  array_to_string(names[1:3], ', ') AS content, modified FROM g WHERE rank = 0
""")
def scan_run_outputs(t):
    rows = t.documents.select(
        F.expr(
            "concat('/ckpt/', if(lang = 'en', 'a/', 'b/'), if(doc_id % 19 = 0, 'logs', source), '/m', doc_id % 6, "
            "element_at(array('.pt', '.bin', '.txt'), cast(doc_id % 3 + 1 as int)))"
        ).alias("path"),
        (F.col("n_chars") * 1000).alias("length"),
        F.expr("timestamp_seconds(1700000000 + doc_id * 60)").alias("modificationTime"),
    )
    out = M.scan_run_outputs(rows, ["/ckpt/a", "/ckpt/b"])
    return out.withColumn("modified", F.unix_seconds("modified"))


@query("SELECT doc_id, source, text FROM documents")
def write_dataset(t):
    folder = shared_dir(t.spark)
    S.write_dataset(t.documents.select("doc_id", "source", "text"), folder)
    return t.spark.read.parquet(folder)


@query("SELECT doc_id, source, n_chars FROM documents")
def export_table(t):
    rows = t.documents.select("doc_id", "source", "n_chars")
    folder = S.export_table(rows, shared_dir(t.spark), "JSON")
    return t.spark.read.schema(rows.schema).json(folder)


@query("SELECT doc_id, text FROM documents")
def export_csv(t):
    rows = t.documents.select("doc_id", "text")
    folder = S.export_table(rows, shared_dir(t.spark), "CSV")
    reader = t.spark.read.schema(rows.schema).option("header", True).option("multiLine", True)
    return reader.option("escape", '"').csv(folder)
