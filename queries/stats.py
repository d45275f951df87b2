"""Aggregations over samples, vectors, runs and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import stats as S
from queries import query


def csv(x, scale: int = 1000000):
    """Array of numbers as comma separated scaled integers."""
    cells = F.transform(x, lambda v: F.round(v.cast("double") * scale).cast("bigint").cast("string"))
    return F.array_join(cells, ",")


def sql_csv(x: str, scale: int = 1000000) -> str:
    return (
        f"array_to_string(list_transform({x}, lambda cv: CAST(CAST(round(CAST(cv AS DOUBLE) * {scale}) AS BIGINT) AS VARCHAR)), ',')"
    )


@query("""
WITH h AS (SELECT doc_id, len(string_split(text, ' ')) AS w, n_chars AS f, len(embedding) AS e
  FROM documents JOIN embeddings ON vec_id = doc_id ORDER BY doc_id LIMIT 100)
SELECT count(*) AS n, avg(w) AS token_avg, CAST(min(w) AS INTEGER) AS token_min, CAST(max(w) AS INTEGER) AS token_max,
  avg(f) AS feat_avg, min(f) AS feat_min, max(f) AS feat_max,
  CAST(min_by(e, doc_id) AS INTEGER) AS embedding_dim FROM h
""")
def length_profile(t):
    rows = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id")).select(
        "doc_id",
        F.split("text", " ").alias("speech_token"),
        F.col("n_chars").alias("speech_feat_len"),
        "embedding",
    )
    return S.length_profile(rows, "doc_id")


MOMENTS = """
WITH c AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
g AS (SELECT count(*) AS n, avg(v) AS mean, sqrt(sum(v * v) / count(*) - avg(v) * avg(v)) AS std FROM c)
"""


@query(MOMENTS + "SELECT n, round(mean, 9) AS mean, round(std, 9) AS std FROM g")
def feature_mean_std(t):
    out = S.feature_mean_std(t.embeddings, "embedding", nested=False)
    return out.select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


Z = "list_transform(embedding, lambda v: (CAST(v AS DOUBLE) - mean) / std)"


@query(MOMENTS + f"""
SELECT vec_id, {sql_csv(Z, 1000)} AS z, {sql_csv(f'list_transform({Z}, lambda u: u * std + mean)', 10000)} AS back
FROM embeddings, g
""")
def standardise(t):
    moments = S.feature_mean_std(t.embeddings, "embedding", nested=False)
    rows = t.embeddings.withColumns(
        {"mean": moments.select("mean").scalar(), "std": moments.select("std").scalar()}
    )
    mean, std = F.col("mean"), F.col("std")
    rows = rows.withColumn("z", A.standardise(F.col("embedding"), mean, std))
    return rows.select(
        "vec_id",
        csv(F.col("z"), 1000).alias("z"),
        csv(A.destandardise(F.col("z"), mean, std), 10000).alias("back"),
    )


@query(f"""
WITH c AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS v FROM (
  SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
m AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM c GROUP BY label, i),
l AS (SELECT label, max(n) AS n, list(m ORDER BY i) AS mean FROM m GROUP BY label)
SELECT label, n, CAST(len(mean) AS INTEGER) AS dim,
  round(sqrt(list_sum(list_transform(mean, lambda v: v * v))), 6) AS norm, {sql_csv('mean')} AS mean FROM l
""")
def mean_vector(t):
    out = S.mean_vector(t.embeddings, "label")
    return out.select("label", "n", "dim", F.round("norm", 6).alias("norm"), csv(F.col("mean")).alias("mean"))


@query(f"""
SELECT 'speaker_' || vec_id AS speaker_id, CAST(len(embedding) AS INTEGER) AS dim,
  round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS l2_norm,
  {sql_csv('embedding[1:8]')} AS preview FROM embeddings
""")
def catalogue_profile(t):
    speakers = t.embeddings.select(
        F.concat(F.lit("speaker_"), "vec_id").alias("speaker_id"), "embedding"
    )
    out = S.catalogue_profile(speakers)
    return out.withColumn("preview", csv(F.col("preview")))


@query("""
SELECT tag, loss FROM (SELECT CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'train'
  ELSE 'epoch' END || '_' || event_id AS tag, value AS loss FROM events)
WHERE tag NOT LIKE 'train%' AND tag NOT LIKE 'init%' ORDER BY loss, tag LIMIT 5
""")
def best_n(t):
    kind = F.when(F.col("event_type") == "signup", "init").when(F.col("event_type") == "view", "train")
    metrics = t.events.select(
        F.concat_ws("_", F.coalesce(kind, F.lit("epoch")), "event_id").alias("tag"),
        F.col("value").alias("loss"),
    )
    return S.best_n(metrics, 5)


@query("""
WITH best AS (SELECT vec_id FROM embeddings ORDER BY abs(CAST(embedding[1] AS DOUBLE)), 'epoch_' || vec_id LIMIT 5),
c AS (SELECT i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM (
  SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IN (SELECT vec_id FROM best)))
SELECT 'weight' AS param, CAST(pos AS INTEGER) AS pos, round(sum(v) / 5, 9) AS value FROM c GROUP BY pos
""")
def average_best(t):
    tag = F.concat(F.lit("epoch_"), "vec_id").alias("tag")
    metrics = t.embeddings.select(tag, F.abs(F.col("embedding")[0].cast("double")).alias("loss"))
    weights = t.embeddings.select(tag, F.lit("weight").alias("param"), F.col("embedding").alias("value"))
    steps = t.embeddings.select(
        tag, F.lit("step").alias("param"), F.array(F.col("vec_id").cast("float")).alias("value")
    )
    out = S.average_best(weights.unionByName(steps), metrics, 5)
    return out.withColumn("value", F.round("value", 9))


@query("""
SELECT event_type AS metric, round(sum(value * (event_id % 16 + 1)) / sum(event_id % 16 + 1), 6) AS loss
FROM events GROUP BY 1
""")
def weighted_loss(t):
    batches = t.events.select(
        F.col("event_type").alias("metric"), "value", (F.col("event_id") % 16 + 1).alias("n_utts")
    )
    return S.weighted_loss(batches).withColumn("loss", F.round("loss", 6))


@query("""
WITH p AS (SELECT lang, list_transform(string_split(text, ' '), lambda w: length(w)) AS pred FROM documents),
z AS (SELECT lang, unnest(list_zip(pred, list_reverse(pred))) AS z FROM p)
SELECT lang, CAST(count(*) FILTER (z[1] = z[2] AND z[2] <> 3) AS BIGINT) AS correct,
  count(*) FILTER (z[2] <> 3) AS counted,
  round(count(*) FILTER (z[1] = z[2] AND z[2] <> 3) / count(*) FILTER (z[2] <> 3), 9) AS accuracy
FROM z GROUP BY lang
""")
def masked_accuracy(t):
    rows = t.documents.select("lang", F.transform(F.split("text", " "), F.length).alias("pred"))
    out = S.masked_accuracy(rows.withColumn("target", F.reverse("pred")), 3, "lang")
    return out.withColumn("accuracy", F.round("accuracy", 9))


PAIRS = """
WITH p AS (SELECT -value / 100 AS c, -(event_id % 97) / 20.0 AS r, -(event_id % 31) / 10.0 AS rc,
  -(event_id % 53) / 15.0 AS rr FROM events),
m AS (SELECT *, (c - r) - (rc - rr) AS m FROM p)
"""
REWARDS = """
round(avg(0.1 * (c - rc)), 8) AS chosen_reward, round(avg(0.1 * (r - rr)), 8) AS rejected_reward,
round(avg(CASE WHEN 0.1 * (c - rc) > 0.1 * (r - rr) THEN 1.0 ELSE 0.0 END), 8) AS reward_accuracy,
round(avg(0.1 * (c - rc) - 0.1 * (r - rr)), 8) AS reward_margin FROM m
"""


def pairs(t):
    e = F.col("event_id")
    return t.events.select(
        (-F.col("value") / 100).alias("chosen_logp"),
        (-(e % 97) / F.lit(20.0)).alias("rejected_logp"),
        (-(e % 31) / F.lit(10.0)).alias("ref_chosen_logp"),
        (-(e % 53) / F.lit(15.0)).alias("ref_rejected_logp"),
    )


def rounded(df, digits: int):
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


LOGSIG = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"


@query(PAIRS + f"SELECT round(avg(-{LOGSIG.format('(0.1 * m)')}), 8) AS loss, " + REWARDS)
def preference_metrics(t):
    return rounded(S.preference_metrics(pairs(t), 0.1), 8)


@query(PAIRS + f"""SELECT round(avg(-{LOGSIG.format('(0.1 * m)')} * 0.9 - {LOGSIG.format('(-0.1 * m)')} * 0.1), 8)
  AS loss, """ + REWARDS)
def preference_metrics_smoothed(t):
    return rounded(S.preference_metrics(pairs(t), 0.1, smoothing=0.1), 8)


@query(PAIRS + "SELECT round(avg(pow(m - 1 / (2 * 0.1), 2)), 8) AS loss, " + REWARDS)
def preference_metrics_squared(t):
    return rounded(S.preference_metrics(pairs(t), 0.1, ipo=True), 8)


@query("""
SELECT user_id, count(*) FILTER (event_type <> 'error') AS success, count(*) AS total,
  count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id
""")
def job_summary(t):
    return S.job_summary(t.events.withColumn("ok", F.col("event_type") != "error"), "user_id")


@query("""
WITH r AS (SELECT user_id AS job, event_type AS worker, max_by(event_id % 101, event_id) AS percent
  FROM events GROUP BY ALL),
c AS (SELECT user_id AS job, event_type AS worker, max(event_id % 37) AS chunk FROM events
  WHERE event_type <> 'view' GROUP BY ALL),
a AS (SELECT job, sum(chunk) AS assigned FROM c GROUP BY job)
SELECT job, CAST(floor(sum(percent * coalesce(chunk, 1)) / coalesce(nullif(max(assigned), 0), count(*))) AS BIGINT) AS percent
FROM r LEFT JOIN c USING (job, worker) LEFT JOIN a USING (job) GROUP BY job
""")
def weighted_progress(t):
    reports = t.events.select(
        F.col("user_id").alias("job"),
        F.col("event_type").alias("worker"),
        (F.col("event_id") % 101).alias("percent"),
        "event_id",
    )
    chunks = (
        t.events.filter("event_type <> 'view'")
        .groupBy(F.col("user_id").alias("job"), F.col("event_type").alias("worker"))
        .agg(F.max(F.col("event_id") % 37).alias("chunk"))
    )
    return S.weighted_progress(reports, "event_id", chunks)


@query("""
WITH r AS (SELECT user_id AS job, event_type AS worker, max_by(event_id % 101, event_id) AS percent
  FROM events GROUP BY ALL)
SELECT job, CAST(floor(sum(percent) / count(*)) AS BIGINT) AS percent FROM r GROUP BY job
""")
def mean_progress(t):
    reports = t.events.select(
        F.col("user_id").alias("job"),
        F.col("event_type").alias("worker"),
        (F.col("event_id") % 101).alias("percent"),
        "event_id",
    )
    return S.weighted_progress(reports, "event_id")


RUNS = """
WITH r AS (SELECT event_id, round((event_id % 500) / (value / 10), 6) AS tps,
  round(value / 10 * 24000 / (24000 * (1 + event_id % 10)), 6) AS rtf FROM events)
"""


def runs(t):
    return t.events.select(
        "event_id",
        (F.col("value") / 10).alias("elapsed"),
        (F.col("event_id") % 500).alias("n_tokens"),
        ((F.col("event_id") % 10 + 1) * 24000).alias("n_samples"),
    )


@query(RUNS + "SELECT * FROM r")
def speed_profile(t):
    per_run, _ = S.speed_profile(runs(t))
    return per_run.select("event_id", F.round("tps", 6).alias("tps"), F.round("rtf", 6).alias("rtf"))


@query("""
WITH r AS (SELECT (event_id % 500) / (value / 10) AS tps, value / 10 * 24000 / (24000 * (1 + event_id % 10)) AS rtf FROM events)
SELECT round(avg(rtf), 6) AS rtf_mean, round(stddev_pop(rtf), 6) AS rtf_std, round(avg(tps), 6) AS tps_mean,
  round(stddev_pop(tps), 6) AS tps_std FROM r
""")
def speed_summary(t):
    return rounded(S.speed_profile(runs(t))[1], 6)


@query("SELECT source AS dataset, count(*) AS n FROM documents GROUP BY 1")
def split_counts(t):
    return S.split_counts(t.documents.withColumn("dataset", F.col("source")))


@query("""
SELECT source AS speaker_id, 'Speaker_' || source AS name, 'unknown' AS gender, min(lang) AS language,
  '' AS description FROM documents GROUP BY source
""")
def distinct_speakers(t):
    rows = t.documents.select(F.col("source").alias("speaker_id"), F.col("lang").alias("language"))
    return S.distinct_speakers(rows)


@query("""
WITH p AS (SELECT lang, list_transform(string_split(text, ' '), lambda w: length(w)) AS p FROM documents),
e AS (SELECT lang, list_sum(list_transform(list_zip(p, list_reverse(p)), lambda z: pow(z[1] - z[2], 2))) AS e, len(p) AS n FROM p)
SELECT lang, round(sum(e) / sum(n), 9) AS duration_loss FROM e GROUP BY lang
""")
def duration_error(t):
    rows = t.documents.select("lang", F.transform(F.split("text", " "), F.length).alias("predicted"))
    rows = rows.withColumns({"target": F.reverse("predicted"), "length": F.size("predicted")})
    return S.duration_error(rows, "lang").withColumn("duration_loss", F.round("duration_loss", 9))


SCORES = """
WITH s AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS item, CAST(embedding[i] AS DOUBLE) * 10 AS x FROM (
  SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
p AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM s),
q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS prob,
  row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, item) AS rank FROM p),
c AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
"""


@query(SCORES + """
SELECT vec_id, item, CAST(rank AS INTEGER) AS rank, round(prob, 8) AS prob, round(before, 8) AS mass_before
FROM c WHERE before < 0.8 AND rank <= 25
""")
def nucleus_candidates(t):
    scores = t.embeddings.select(
        "vec_id", F.posexplode("embedding").alias("item", "v")
    ).select("vec_id", "item", (F.col("v").cast("double") * 10).alias("x"))
    out = S.nucleus_candidates(scores, "vec_id", "item", "x")
    return out.withColumns(
        {"prob": F.round("prob", 8), "mass_before": F.round("mass_before", 8)}
    )


@query("""
WITH e AS (SELECT user_id, event_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 7 AS token FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e),
n AS (SELECT a.user_id, a.event_id, a.token, count(b.r) AS repeats FROM r a LEFT JOIN r b
  ON a.user_id = b.user_id AND b.r BETWEEN a.r - 10 AND a.r - 1 AND a.token = b.token GROUP BY ALL)
SELECT user_id, event_id, token, CAST(repeats AS INTEGER) AS repeats, repeats >= 3 AS repeated FROM n
""")
def repetition_flag(t):
    tokens = t.events.select(
        "user_id",
        "event_id",
        (F.get_json_object("props", "$.k").cast("int") % 7).alias("token"),
    )
    return S.repetition_flag(tokens, "user_id", "event_id", share=0.3, block=64)
