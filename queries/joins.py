"""Joins, merges and the speaker catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.markers import marker_names, marker_vocabulary, syllable_phones
from corpusloom.functions.text import WHITESPACE
from corpusloom.operators import catalogue as C
from corpusloom.operators import joins as J
from corpusloom.session import shared_dir
from queries import query
from queries.sqltext import words_list
from queries.stats import csv, sql_csv
from queries.texts import HAN, LATIN, mixed


@query(f"""
WITH s AS (SELECT doc_id AS stem, nullif(trim(CASE WHEN quality = 1 THEN 'label ' || toxic ELSE '  ' END, '{WHITESPACE}'), '') AS x FROM labels),
a AS (SELECT item_id * 7 AS stem, nullif(trim(text, '{WHITESPACE}'), '') AS y FROM benchmark)
SELECT doc_id AS stem, coalesce(x, y) AS text, CASE WHEN x IS NOT NULL THEN 'sidecar' ELSE 'asr' END AS text_from
FROM documents LEFT JOIN s ON s.stem = doc_id LEFT JOIN a ON a.stem = doc_id WHERE coalesce(x, y) IS NOT NULL
""")
def attach_transcripts(t):
    audio = t.documents.select(F.col("doc_id").alias("stem"))
    label = F.when(F.col("quality") == 1, F.concat(F.lit("label "), "toxic")).otherwise("  ")
    sidecar = t.labels.select(F.col("doc_id").alias("stem"), label.alias("text"))
    asr = t.benchmark.select((F.col("item_id") * 7).alias("stem"), "text")
    return J.attach_transcripts(audio, sidecar, asr)


def asked(t):
    n = F.col("doc_id") % 13
    speaker = F.when(n == 12, "").when(n == 11, None).otherwise(F.concat(F.lit("speaker_"), n))
    return t.documents.select("doc_id", speaker.alias("speaker_id"))


def speakers(t):
    """One speaker per label, with the number of its vectors."""
    return t.embeddings.groupBy(F.concat(F.lit("speaker_"), "label").alias("speaker_id")).agg(
        F.count(F.lit(1)).alias("vectors")
    )


ASKED = """
WITH q AS (SELECT doc_id, CASE doc_id % 13 WHEN 12 THEN '' WHEN 11 THEN NULL ELSE 'speaker_' || doc_id % 13 END AS speaker_id FROM documents),
c AS (SELECT 'speaker_' || label AS speaker_id, count(*) AS vectors FROM embeddings GROUP BY 1)
"""


@query(ASKED + """
SELECT doc_id, c.speaker_id, vectors FROM q JOIN c ON c.speaker_id =
  CASE WHEN coalesce(q.speaker_id, '') = '' THEN (SELECT min(speaker_id) FROM c) ELSE q.speaker_id END
""")
def lookup_speaker(t):
    return J.lookup_speaker(asked(t), speakers(t))


@query(ASKED + "SELECT * FROM q WHERE speaker_id <> '' AND speaker_id NOT IN (SELECT speaker_id FROM c)")
def unknown_speakers(t):
    return J.unknown_speakers(asked(t), speakers(t))


HASH = "CAST('0x' || substr(md5(doc_id || '|{0}|42'), 1, 8) AS BIGINT)"
MARKERS = words_list(marker_names())


#: Characters of the mixed texts with their syllables, and the phones these have.
SYLLABLES = {"中": "zhong1", "文": "wen2", "音": "yin1", "频": "pin2", "道": "dao4"}
ZH_PHONES = {"中": "[zh][ōng]", "文": "[w][én]", "音": "[y][īn]", "频": "[p][ín]", "道": "[d][ào]"}
ZH_MAP = "MAP {" + ", ".join(f"'{c}': ' {p} '" for c, p in ZH_PHONES.items()) + "}"


def swapped(source, pattern, least, rep):
    """SQL of two picked matches of a pattern in ``source (doc_id, text)`` replaced by ``rep``'s."""
    return f"""
d AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS g FROM {source}),
p AS (SELECT *, CASE WHEN len(f) >= {least} THEN {HASH.format('a')} % len(f) END AS one,
  CASE WHEN len(f) >= 2 THEN {HASH.format('b')} % (len(f) - 1) END AS other FROM d),
q AS (SELECT *, other + CASE WHEN other >= one THEN 1 ELSE 0 END AS two FROM p),
{rep}
SELECT doc_id, r1 IS NOT NULL OR r2 IS NOT NULL AS changed, CASE WHEN r1 IS NULL AND r2 IS NULL THEN text
  ELSE array_to_string(list_transform(range(len(g)), lambda i: g[i + 1] || CASE WHEN i = one AND r1 IS NOT NULL THEN r1
  WHEN i = two AND r2 IS NOT NULL THEN r2 ELSE coalesce(f[i + 1], '') END), '') END AS text FROM j"""


EN_REP = """j AS (SELECT q.*, r1.r AS r1, r2.r AS r2 FROM q LEFT JOIN rep r1 ON r1.w = lower(f[one + 1])
  LEFT JOIN rep r2 ON r2.w = lower(f[two + 1]))"""
ZH_REP = f"j AS (SELECT q.*, {ZH_MAP}[f[one + 1]] AS r1, {ZH_MAP}[f[two + 1]] AS r2 FROM q)"


@query(f"""
WITH mixed AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, '{LATIN}', '{HAN}') ELSE text END AS text FROM documents),
lex AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'))) AS w FROM benchmark),
ph AS (SELECT w, list_filter(list_transform(string_split(upper(w), ''), lambda c: '[' || c || ']'),
  lambda m: list_contains({MARKERS}, m)) AS m FROM lex),
rep AS (SELECT w, ' ' || array_to_string(m, '') || ' ' AS r FROM ph WHERE len(m) > 0),
en AS (WITH {swapped("mixed", "[A-Za-z]+(?:''[A-Za-z]+)?", 1, EN_REP)}),
rest AS (SELECT doc_id, text FROM en WHERE NOT changed),
zh AS (WITH {swapped("rest", "[一-鿿]", 2, ZH_REP)})
SELECT doc_id, text FROM en WHERE changed UNION ALL SELECT doc_id, text FROM zh
""")
def phone_substitution(t):
    words = F.explode(F.regexp_extract_all("text", F.lit(J.EN_WORD), F.lit(0)))
    lexicon = t.benchmark.select(words.alias("word")).select(F.lower("word").alias("word")).distinct()
    lexicon = lexicon.withColumn("phones", F.split(F.upper("word"), ""))
    syllables = t.spark.createDataFrame(list(SYLLABLES.items()), "word string, syllable string")
    zh_lexicon = syllables.select("word", syllable_phones(F.col("syllable")).alias("phones"))
    texts = mixed(t).select("doc_id", "text")
    out = J.phone_substitution(texts, lexicon, marker_vocabulary(t.spark), "doc_id", zh_lexicon=zh_lexicon)
    return out.select("doc_id", "text")


@query("""
WITH p AS (SELECT conv_id * 100000 + turn AS utt, text, length(text) AS chosen, length(role) + 2 * turn AS rejected FROM conversations)
SELECT utt, 'chosen' AS side, text, chosen AS token FROM p
UNION ALL SELECT utt, 'rejected', text, rejected FROM p
""")
def pair_preferences(t):
    """Every turn with its own length as the chosen token, and a rejected one from its role and place."""
    turns = t.conversations.withColumn("utt", F.col("conv_id") * 100000 + F.col("turn"))
    chosen = turns.select("utt", "text", F.array(F.length("text").cast("bigint")).alias("speech_token"))
    rejected = turns.select("utt", F.array((F.length("role") + 2 * F.col("turn")).cast("bigint")).alias("speech_token"))
    out = J.pair_preferences(chosen, rejected)
    return out.select("utt", "side", "text", F.col("speech_token")[0].alias("token"))


@query("""
SELECT lang, source, text FROM documents UNION ALL SELECT role AS lang, 'chat' AS source, text FROM conversations
""")
def merge_datasets(t):
    """Documents stored in two splits, conversations without any, and a folder that cannot be read."""
    return C.merge_stored(t.spark, stored(t))[0]


def stored(t):
    base = shared_dir(t.spark)
    for split, part in (("train", "doc_id % 5 <> 0"), ("test", "doc_id % 5 = 0")):
        t.documents.where(part).write.parquet(f"{base}/documents/{split}")
    chat = t.conversations.withColumns({"lang": F.col("role"), "source": F.lit("chat")}).drop("role")
    chat.write.parquet(f"{base}/chat")
    t.benchmark.select("text").write.text(f"{base}/broken")
    return [f"{base}/{name}" for name in ("documents", "chat", "broken", "nowhere")]


@query("""
SELECT 'documents' AS folder, 2 AS splits, count(*) AS "rows", true AS readable FROM documents UNION ALL
SELECT 'chat', 1, count(*), true FROM conversations UNION ALL SELECT 'broken', 1, 0, false UNION ALL SELECT 'nowhere', 1, 0, false
""")
def merge_report(t):
    report = C.merge_stored(t.spark, stored(t))[1]
    return report.select(F.substring_index("folder", "/", -1).alias("folder"), "splits", "rows", F.col("error").isNull().alias("readable"))


@query("SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def concat_datasets(t):
    return C.concat_datasets(
        [
            t.documents.select("doc_id", "text"),
            t.benchmark.select(F.col("item_id").alias("doc_id"), "text"),
        ]
    )


@query(f"""
WITH r AS (SELECT CASE WHEN vec_id % 17 = 0 THEN '' ELSE 'speaker_' || vec_id % 97 END AS s, embedding, vec_id AS v
  FROM embeddings WHERE vec_id % 5 <> 0)
SELECT s AS speaker_id, max(v) AS version, {sql_csv('max_by(embedding, v)')} AS embedding FROM r WHERE s <> '' GROUP BY s
""")
def upsert_speaker(t):
    name = F.when(F.col("vec_id") % 17 == 0, " ").otherwise(
        F.concat(F.lit(" speaker_"), F.col("vec_id") % 97)
    )
    vector = F.when(F.col("vec_id") % 5 != 0, F.col("embedding"))
    rows = t.embeddings.select(
        name.alias("speaker_id"), vector.alias("embedding"), F.col("vec_id").alias("version"), "label"
    )
    out = C.upsert_speaker(rows.filter("label < 5").drop("label"), rows.filter("label >= 5").drop("label"))
    return out.withColumn("embedding", csv(F.col("embedding")))
