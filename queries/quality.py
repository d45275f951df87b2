"""Filters, audits and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import quality as Q
from corpusloom.operators.batching import static_batch
from queries import query


def utterances(t):
    """Documents as utterances: a frame per character, words as tokens."""
    words = F.split("text", " ")
    return t.documents.select(
        "doc_id",
        "source",
        "lang",
        (F.col("n_chars") * 160).alias("n_samples"),
        F.lit(16000).alias("sample_rate"),
        words.alias("text_token"),
        F.transform(words, F.length).alias("speech_token"),
        F.when(F.col("doc_id") % 3 == 0, F.filter(words, lambda w: F.length(w) > 12)).alias(
            "reject_speech_token"
        ),
    )


@query("""
WITH u AS (
  SELECT doc_id, n_chars * 160 / 16000 * 100 AS frames, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens FROM u
WHERE frames BETWEEN 10 AND 10240 AND len(w) BETWEEN 1 AND 200
  AND len(w) / frames BETWEEN 0.0005 AND 1
  AND (doc_id % 3 <> 0 OR len(list_filter(w, lambda x: length(x) > 12)) > 0)
""")
def filter_utterances(t):
    return Q.filter_utterances(utterances(t)).select("doc_id", F.size("text_token").alias("n_tokens"))


def samples(t):
    """Utterances with the speaker vector of the same number, some of them damaged."""
    words = F.split("text", " ")
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return (
        t.documents.select(
            "doc_id",
            F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w: F.length(w) - 1).alias(
                "speech_token"
            ),
            F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<array<int>>"))
            .otherwise(
                F.array(F.array_repeat(F.lit(0), F.when(F.col("doc_id") % 7 == 0, 9).otherwise(8)))
            )
            .alias("speech_feat"),
        )
        .join(vectors, "doc_id", "left")
        .withColumn(
            "embedding",
            F.when(F.col("doc_id") % 5 == 0, F.slice("embedding", 1, 10)).otherwise(
                F.col("embedding")
            ),
        )
    )


AUDIT = """
WITH s AS (
  SELECT d.doc_id, list_transform(string_split(text, ' ')[2:], lambda w: length(w) - 1) AS token,
         CASE WHEN d.doc_id % 5 = 0 THEN e.embedding[1:10] ELSE e.embedding END AS emb
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
a AS (SELECT doc_id, CASE
    WHEN len(token) = 0 THEN 'empty_token'
    WHEN list_min(token) < 0 OR list_max(token) > 60 THEN 'invalid_token_range'
    WHEN emb IS NULL OR len(emb) = 0 THEN 'empty_embedding'
    WHEN len(emb) <> 64 THEN 'invalid_embedding_dim'
    WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'empty_speech_feat' END AS reason FROM s)
"""


def audited(t):
    return Q.audit_samples(samples(t), embedding_dim=64, width=8, top=60)


@query(AUDIT + "SELECT doc_id, reason FROM a")
def audit_samples(t):
    return audited(t).select("doc_id", "reason")


@query(AUDIT + """
SELECT coalesce(reason, 'valid') AS reason, count(*) AS n, (SELECT count(*) FROM a) AS total,
       round(count(*) * 100 / (SELECT count(*) FROM a), 1) AS percent FROM a GROUP BY 1
""")
def audit_report(t):
    return Q.audit_report(audited(t))


ISSUES = """
WITH i AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS row_no,
         CASE WHEN length(text) < 5 THEN 'too_short' WHEN length(text) > 200 THEN 'too_long' END AS issue
  FROM documents)
"""


@query(ISSUES + "SELECT row_no, issue FROM i WHERE issue IS NOT NULL")
def validate_text(t):
    return Q.validate_text(t.documents, "doc_id")


@query(ISSUES + """
SELECT row_no, issue, (SELECT count(*) FROM i WHERE issue IS NOT NULL) AS issues
FROM i WHERE issue IS NOT NULL ORDER BY row_no LIMIT 10
""")
def validate_text_report(t):
    return Q.issue_report(Q.validate_text(t.documents, "doc_id"))


@query("SELECT doc_id AS audio, text FROM documents")
def select_columns(t):
    wide = t.documents.withColumn("audio", F.col("doc_id"))
    return Q.select_columns(wide, "llm")


def rated(t):
    rate = F.element_at(F.array(*[F.lit(r) for r in (8000, 16000, 22050, 24000)]), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", "source", rate.alias("sample_rate"))


RATED = "WITH r AS (SELECT doc_id, source, [8000, 16000, 22050, 24000][doc_id % 4 + 1] AS sample_rate FROM documents) "


@query(RATED + "SELECT * FROM r WHERE sample_rate = 22050 OR sample_rate >= 16000")
def drop_low_rate(t):
    return Q.drop_low_rate(rated(t), 22050)


@query(RATED + "SELECT * FROM r WHERE sample_rate <> 22050")
def require_equal_rate(t):
    return Q.unequal_rate(rated(t), 22050)


@query("""
SELECT doc_id, CASE WHEN n_chars * 320 / 16000 > 30 THEN 0 ELSE CAST(len(string_split(text, ' ')) AS INTEGER) END
  AS n_tokens, CASE WHEN n_chars * 320 / 16000 > 30 THEN 0 ELSE 1 END AS n_feat,
  CASE WHEN n_chars * 320 / 16000 > 30 THEN 0 ELSE n_chars END AS speech_feat_len
FROM documents
""")
def cap_duration(t):
    rows = t.documents.select(
        "doc_id",
        (F.col("n_chars") * 320).alias("n_samples"),
        F.lit(16000).alias("sample_rate"),
        F.split("text", " ").alias("speech_token"),
        F.array(F.array(F.lit(0.0))).alias("speech_feat"),
        F.col("n_chars").alias("speech_feat_len"),
    )
    return Q.cap_duration(rows).select(
        "doc_id",
        F.size("speech_token").alias("n_tokens"),
        F.size("speech_feat").alias("n_feat"),
        "speech_feat_len",
    )


REQUESTS = """
WITH q AS (
  SELECT conv_id, turn, CASE WHEN turn = 3 THEN ' ' ELSE text END AS text,
    CASE WHEN turn % 4 = 1 THEN '  ' ELSE text END AS prompt_text,
    turn % 5 <> 2 AS has_prompt_audio,
    CASE WHEN turn % 7 = 6 THEN '' ELSE role END AS speaker_id FROM conversations)
"""


def requests(t):
    turn = F.col("turn")
    return t.conversations.select(
        "conv_id",
        "turn",
        F.when(turn == 3, " ").otherwise(F.col("text")).alias("text"),
        F.when(turn % 4 == 1, "  ").otherwise(F.col("text")).alias("prompt_text"),
        (turn % 5 != 2).alias("has_prompt_audio"),
        F.when(turn % 7 == 6, "").otherwise(F.col("role")).alias("speaker_id"),
    )


@query(REQUESTS + """
SELECT conv_id, turn, CASE
    WHEN trim(text) = '' THEN 'empty_text'
    WHEN trim(prompt_text) = '' THEN 'empty_prompt_text'
    WHEN NOT has_prompt_audio THEN 'missing_prompt_audio'
    WHEN trim(speaker_id) = '' THEN 'missing_speaker'
    WHEN speaker_id NOT IN (SELECT role FROM conversations WHERE role <> 'system')
      THEN 'unknown_speaker' END AS reason
FROM q
""")
def validate_requests(t):
    speakers = t.conversations.filter("role <> 'system'").select(F.col("role").alias("speaker_id"))
    return Q.validate_requests(requests(t), speakers).select("conv_id", "turn", "reason")


@query("""
SELECT lang, count(*) AS kept, CAST(sum(length(w)) AS BIGINT) AS chars
FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents)
WHERE NOT regexp_full_match(w, '[\\p{P}\\p{S}]*') GROUP BY lang
""")
def drop_punctuation_only(t):
    words = t.documents.select("lang", F.explode(F.split("text", " ")).alias("text"))
    return Q.drop_punctuation_only(words).groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.length("text")).alias("chars")
    )


@query("""
WITH l AS (
  SELECT doc_id, string_split(trim(text), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l)
SELECT doc_id, 'audio_' || i AS audio_id, trim(line) AS text, 'annotated' AS status
FROM e WHERE trim(line) <> ''
""")
def annotate_lines(t):
    return Q.annotate_lines(t.documents.select("doc_id", "text"))


@query("""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
WHERE r > 100 AND r <= 600
""")
def slice_rows(t):
    return Q.slice_rows(t.documents.select("doc_id", "source"), "doc_id", 100, 600)


@query("""
SELECT b.conv_id, b.turn, length(b.text) < 0.5 * length(a.text) AS too_short
FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1
""")
def prompt_ratio_flag(t):
    prompt = t.conversations.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt_text")
    )
    pairs = t.conversations.join(prompt, ["conv_id", "turn"])
    return Q.prompt_ratio_flag(pairs).select("conv_id", "turn", "too_short")


@query("""
WITH r AS (SELECT doc_id, lang, n_chars,
    (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 8 AS batch_no FROM documents),
t AS (SELECT *, CASE WHEN batch_no % 3 <> 0 AND n_chars % 3 = 0 THEN n_chars END AS tok FROM r),
g AS (SELECT lang, tok, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS no
      FROM t WHERE tok IS NOT NULL),
f AS (SELECT *,
    count(tok) OVER (PARTITION BY lang ORDER BY doc_id) - CASE WHEN tok IS NULL THEN 0 ELSE 1 END AS before,
    last_value(tok IGNORE NULLS) OVER (PARTITION BY lang, batch_no ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near,
    last_value(tok IGNORE NULLS) OVER (PARTITION BY lang, batch_no ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM t),
p AS (SELECT *, CASE WHEN final IS NULL AND before > 0 THEN before -
    CAST('0x' || substr(md5(lang || '|' || batch_no || '|42'), 1, 8) AS BIGINT) % least(before, 16) END AS pick
  FROM f)
SELECT doc_id, p.lang, batch_no, coalesce(p.tok, near, final, g.tok, 0) AS token,
  CASE WHEN p.tok IS NOT NULL THEN 'own' WHEN final IS NOT NULL THEN 'batch'
       WHEN g.tok IS NOT NULL THEN 'pool' ELSE 'placeholder' END AS source
FROM p LEFT JOIN g ON g.lang = p.lang AND g.no = p.pick
""")
def impute_failed_tokens(t):
    rows = static_batch(t.documents.select("doc_id", "lang", "n_chars"), "lang", "doc_id", 8)
    good = (F.col("batch_no") % 3 != 0) & (F.col("n_chars") % 3 == 0)
    tokens = rows.withColumn("speech_token", F.when(good, F.array("n_chars")))
    filled = Q.impute_failed_tokens(
        tokens.drop("n_chars"), "lang", "doc_id", "batch_no", pool=16
    )
    return filled.select("doc_id", "lang", "batch_no", F.col("speech_token")[0].alias("token"), "source")
