"""Structured Streaming over the event and document tables; the SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.session import shared_dir
from corpusloom.sources.tail import tail_logs
from corpusloom.streaming import jobs as J
from corpusloom.streaming import tokens as K
from queries import query
from queries.logs import LINE, PARSED, job_events


#: Micro-batches that the tokens of a request come in.
BATCHES = 3


def events(t, files=16):
    return J.stream_table(t.spark, f"{t.folder}/events.parquet", t.events.schema, files)


@query(PARSED + """
SELECT user_id, event_id, kind, parsed_by, loss, eval_loss FROM p WHERE kind IS NOT NULL
""")
def tail_metrics(t):
    """Text logs that grow between two runs of one query: the second goes on from the first's bytes."""
    lines = t.events.select(F.concat_ws("\t", "user_id", "event_id", F.expr(LINE)).alias("value"), "event_id")
    base = shared_dir(t.spark)
    for part in (0, 1):
        lines.filter(F.col("event_id") % 2 == part).select("value").write.mode("append").text(f"{base}/logs")
        fields = F.split("line", "\t", 3)
        told = tail_logs(t.spark, f"{base}/logs").select(
            fields[0].cast("bigint").alias("user_id"), fields[1].cast("bigint").alias("event_id"), fields[2].alias("line")
        )
        out = J.tail_metrics(told).select("user_id", "event_id", "kind", "parsed_by", "loss", "eval_loss")
        found = J.run_available(out, checkpoint=f"{base}/checkpoint", out=f"{base}/out")
    return found


@query("""
SELECT user_id AS job, event_type AS worker, max_by(event_id % 101, event_id) AS percent FROM events GROUP BY ALL
""")
def live_progress(t):
    reports = events(t).select(
        F.col("user_id").alias("job"),
        F.col("event_type").alias("worker"),
        (F.col("event_id") % 101).alias("percent"),
        "event_id",
    )
    return J.run_updates(J.live_percent(reports, "job", "event_id"), ["job", "worker"])


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'exit'
  WHEN 'purchase' THEN 'stop' ELSE 'log' END AS kind, event_id % 2 AS code FROM events)
SELECT user_id, max_by(kind, event_id) AS kind, max_by(code, event_id) AS code, max(event_id) AS event_id,
  min(ts) FILTER (kind = 'start') AS start_time FROM e GROUP BY user_id
""")
def live_job_status(t):
    live = J.live_status(job_events(events(t)), "user_id", "event_id")
    return J.run_updates(live, ["user_id"]).select(
        "user_id", "last.kind", "last.code", F.col("last.at").alias("event_id"), "start_time"
    )


@query("""
SELECT event_id AS id, user_id, CASE WHEN event_id % 3 <> 0 AND event_id % 120 <= 60 THEN value END AS duration,
  CASE WHEN event_id % 3 <> 0 AND event_id % 120 <= 60 THEN 200 ELSE 408 END AS code FROM events
""")
def match_with_timeout(t):
    """Stored history streamed in order of time, whatever the order of its files."""
    asked = t.events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("asked_at"))
    delay = F.make_dt_interval(secs=(F.col("event_id") % 120).cast("decimal(18,6)"))
    answered = (F.col("ts").cast("timestamp") + delay).alias("answered_at")
    answers = t.events.filter("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("value").alias("duration"), answered)
    matched = J.replay([(asked, "asked_at"), (answers, "answered_at")], lambda q, a: J.match_with_timeout(q, a, late="10 seconds"))
    return matched.select("id", "user_id", "duration", "code")


@query("""
WITH n AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS s, len(string_split(text, ' ')) AS n FROM documents),
k AS (SELECT *, CASE WHEN n < 28 THEN 0 ELSE (n - 28) // 25 + 1 END AS k FROM n),
c AS (SELECT *, unnest(range(k + 1)) AS i FROM k)
SELECT CAST(doc_id AS VARCHAR) AS request_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 25 AS INTEGER) AS offset,
  CAST(CASE WHEN i = k THEN n ELSE i * 25 + 28 END AS INTEGER) AS "end", i = k AS final,
  array_to_string(CASE WHEN i = k THEN s[i * 25 + 1:] ELSE s[i * 25 + 1:i * 25 + 28] END, ',') AS tokens FROM c
""")
def chunk_token_stream(t):
    """Words' lengths as tokens, 64 to a row; later rows of a request come in later micro-batches."""
    words = F.concat(F.transform(F.split("text", " "), F.length), F.array().cast("array<int>"))
    parts = F.expr("transform(sequence(0, int(ceil(size(words) / 64)) - 1), i -> slice(words, i * 64 + 1, 64))")
    rows = t.documents.select("doc_id", words.alias("words")).select(
        F.col("doc_id").cast("string").alias("request_id"), F.size("words").alias("n"), F.posexplode(parts).alias("seq", "tokens")
    )
    rows = rows.select(
        "request_id", "seq", "tokens", ((F.col("seq") + 1) * 64 >= F.col("n")).alias("is_end"),
        F.timestamp_seconds(F.col("seq") + 1_700_000_000).alias("at"),
    )
    base = shared_dir(t.spark)
    with J.rocksdb_state(t.spark):
        for batch in range(BATCHES):
            due = F.least("seq", F.lit(BATCHES - 1)) == batch
            rows.filter(due).write.mode("append").parquet(f"{base}/tokens")
            cells = J.stream_table(t.spark, f"{base}/tokens", rows.schema, None)
            out = J.run_available(K.chunk_token_stream(cells), checkpoint=f"{base}/checkpoint", out=f"{base}/out")
    return out.withColumn("tokens", F.array_join("tokens", ",")).drop("expired")


@query("""
WITH r AS (SELECT event_type, event_id, regexp_extract(props, '[0-9]+') AS k,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS b FROM events)
SELECT event_type AS shard, max(event_id) AS newest, string_agg(k, ',' ORDER BY event_id) AS pool FROM r WHERE b <= 256 GROUP BY event_type
""")
def recent_pool(t):
    tokens = events(t).select(
        F.col("event_type").alias("shard"),
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").cast("int").alias("token"),
    )
    out = J.run_updates(K.recent_pool(tokens), ["shard"])
    return out.withColumn("pool", F.array_join("pool", ","))
