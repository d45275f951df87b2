"""Training logs, progress, jobs and audio segments, from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import joins as J
from corpusloom.operators import runs as R
from corpusloom.operators import segments as G
from corpusloom.session import spread
from queries import query

# A run per user; the kind of event picks the kind of line.
LINE = """
CASE event_type
  WHEN 'click' THEN concat('{''loss'': ', value, ', ''grad_norm'': ', event_id % 50, ', ''learning_rate'': ', event_id % 9, 'e-05, ''epoch'': ', event_id % 40, '.5}')
  WHEN 'view' THEN concat('{''loss'': ', value, ', ''epoch'': ', event_id % 40, '.25}')
  WHEN 'purchase' THEN concat('{''loss'': ', value, ', ''grad_norm'': ', event_id % 50, ', ''learn')
  WHEN 'signup' THEN concat(chr(27), '[1m{''eval_loss'': ', value, '}', chr(27), '[0m')
  ELSE concat('Traceback in step ', event_id) END
"""


def log_lines(t):
    return t.events.select("user_id", "event_id", F.expr(LINE).alias("line"))


def parsed(t):
    return R.parse_metric_line(spread(log_lines(t)))


PARSED = """
WITH p AS (SELECT user_id, event_id, event_type,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'train' WHEN event_type = 'signup' THEN 'eval' END AS kind,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'literal' WHEN event_type = 'purchase' THEN 'regex' END AS parsed_by,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value END AS loss,
  CASE WHEN event_type IN ('click', 'purchase') THEN CAST(event_id % 50 AS DOUBLE) END AS grad_norm,
  CASE WHEN event_type = 'click' THEN CAST(event_id % 9 || 'e-05' AS DOUBLE) END AS learning_rate,
  CASE WHEN event_type = 'click' THEN event_id % 40 + 0.5 WHEN event_type = 'view' THEN event_id % 40 + 0.25 END AS epoch,
  CASE WHEN event_type = 'signup' THEN value END AS eval_loss FROM events)
"""


@query(PARSED + """
SELECT user_id, event_id, kind, parsed_by, loss, grad_norm, learning_rate, CAST(epoch AS DOUBLE) AS epoch, eval_loss FROM p
""")
def parse_metric_line(t):
    return parsed(t).drop("line")


@query(PARSED + """
SELECT user_id, event_id, loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step
FROM p WHERE kind = 'train'
""")
def number_steps(t):
    return R.number_steps(parsed(t), "user_id", "event_id").select(
        "user_id", "event_id", "loss", "step"
    )


def sql_carry(c: str) -> str:
    known = f"CASE WHEN event_type = 'purchase' THEN {c} ELSE coalesce({c}, 0) END"
    return (
        f"CAST(coalesce({known}, last_value({known} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)"
    )


@query(PARSED + f"""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, loss,
  {sql_carry('grad_norm')} AS grad_norm, {sql_carry('learning_rate')} AS learning_rate, {sql_carry('epoch')} AS epoch
FROM p WHERE kind = 'train'
""")
def fill_forward_metrics(t):
    return R.fill_metrics(parsed(t), "user_id", "event_id").select(
        "user_id", "event_id", "step", "loss", "grad_norm", "learning_rate", "epoch"
    )


@query(PARSED + """
SELECT user_id, event_id, loss, coalesce(grad_norm, 0) AS grad_norm, coalesce(learning_rate, 0) AS learning_rate,
  CAST(coalesce(epoch, 0) AS DOUBLE) AS epoch FROM p WHERE kind = 'train'
""")
def memory_metrics(t):
    return R.fill_metrics(parsed(t), "user_id", "event_id", carry=False).select(
        "user_id", "event_id", "loss", "grad_norm", "learning_rate", "epoch"
    )


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, greatest(n - 50, 0) AS omitted FROM r WHERE b <= 50
""")
def tail_lines(t):
    logs = t.events.select("user_id", "event_id")
    return R.tail_lines(logs, "user_id", "event_id", 50)


@query("SELECT event_id, value FROM events WHERE (event_id + 1) % 100 = 0")
def thin_steps(t):
    return R.thin_steps(t.events.select("event_id", "value"), "event_id", 100)


STATE = """
concat('{"log_history": [{"step": ', event_id, ', "loss": ', value, ', "epoch": ', event_id % 40, '}, ',
  '{"step": ', event_id, ', "eval_loss": ', value + 1, ', "loss": 3}, {"train_runtime": 5, "loss": 1.5}]}')
"""


@query("""
SELECT event_id, 0 AS entry_no, 'train' AS kind, event_id AS step, value, CAST(event_id % 40 AS DOUBLE) AS epoch FROM events
UNION ALL SELECT event_id, 1, 'eval', event_id, value + 1, 0.0 FROM events
""")
def explode_log_history(t):
    states = t.events.select("event_id", F.expr(STATE).alias("state"))
    out = R.explode_log_history(states)
    return out.select("event_id", "entry_no", "kind", "step", "value", "epoch")


@query(PARSED + """,
s AS (SELECT user_id, kind, coalesce(loss, eval_loss) AS v,
  row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS s FROM p WHERE kind IS NOT NULL),
a AS (SELECT user_id, (s - 1) * 10 AS step, v AS loss FROM s WHERE kind = 'train' AND v > 0),
b AS (SELECT user_id, s * 50 AS step, v AS eval_loss FROM s WHERE kind = 'eval' AND v > 0)
SELECT user_id, step, loss, eval_loss FROM a FULL JOIN b USING (user_id, step)
""")
def pair_train_eval_metrics(t):
    series = R.metric_series(parsed(t), "user_id", "event_id")
    return J.pair_train_eval(series, "user_id", 10, 50)


PROGRESS = """
CASE event_type
  WHEN 'click' THEN concat('Found ', event_id % 700, ' audio files in the folder')
  WHEN 'view' THEN concat('Processing audio files: 9%|#  | ', event_id % 40, '/', 40 + event_id % 11, ' [00:01]')
  WHEN 'purchase' THEN concat('Starting worker ', event_id % 6, ', assigned ', event_id % 90, ' files')
  WHEN 'signup' THEN concat('Worker ', event_id % 6, ': ', event_id % 101, '%|####  |')
  ELSE concat('启动多进程处理: ', event_id % 6, ' 个工作进程处理 ', event_id % 500, ' 个文件') END
"""


@query("""
SELECT event_id,
  CASE event_type WHEN 'click' THEN event_id % 700 WHEN 'view' THEN 40 + event_id % 11 WHEN 'error' THEN event_id % 500 END AS total,
  CASE WHEN event_type = 'view' THEN event_id % 40 END AS done,
  CASE WHEN event_type = 'error' THEN event_id % 6 END AS workers,
  CASE WHEN event_type IN ('purchase', 'signup') THEN event_id % 6 END AS worker,
  CASE WHEN event_type = 'purchase' THEN event_id % 90 END AS chunk,
  CASE event_type WHEN 'signup' THEN event_id % 101 WHEN 'view' THEN event_id % 40 * 100 // (40 + event_id % 11) END AS percent
FROM events
""")
def parse_progress_line(t):
    lines = t.events.select("event_id", F.expr(PROGRESS).alias("line"))
    return R.parse_progress_line(lines).drop("line")


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'exit'
  WHEN 'purchase' THEN 'stop' ELSE 'log' END AS kind, event_id % 2 AS code FROM events)
SELECT user_id, max_by(CASE WHEN kind = 'stop' THEN 'stopped' WHEN kind = 'exit' AND code = 0 THEN 'completed'
    WHEN kind = 'exit' THEN 'failed' ELSE 'running' END, event_id) AS status,
  min(ts) FILTER (kind = 'start') AS start_time, arg_max_null(CASE WHEN kind IN ('exit', 'stop') THEN ts END, event_id) AS end_time
FROM e GROUP BY user_id
""")
def job_status(t):
    return R.job_status(job_events(t.events), "user_id", "event_id")


def job_events(events):
    kind = (
        F.when(F.col("event_type") == "signup", "start")
        .when(F.col("event_type") == "error", "exit")
        .when(F.col("event_type") == "purchase", "stop")
        .otherwise("log")
    )
    return events.select(
        "user_id", "event_id", "ts", kind.alias("kind"), (F.col("event_id") % 2).alias("code")
    )


def segments(t):
    """A speech segment per event: starts in ms, lengths by value."""
    # from the fields of a timestamp without zone, so that the session's zone plays no part
    start = F.expr(
        "datediff(ts, date'1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L"
        " + cast(floor(extract(second from ts) * 1000) as bigint)"
    )
    return t.events.select(
        F.col("user_id").alias("file"),
        "event_id",
        start.alias("start"),
        (start + F.floor(F.col("value") * 10000).cast("bigint")).alias("end"),
    )


MERGED = """
WITH RECURSIVE s AS (SELECT user_id AS file, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 10000) AS BIGINT) AS e,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, epoch_us(ts) // 1000 + CAST(floor(value * 10000) AS BIGINT), event_id) AS r FROM events),
f AS (
  SELECT file, r, s, e, 0 AS g, s AS cs FROM s WHERE r = 1
  UNION ALL
  SELECT n.file, n.r, n.s, n.e, CASE WHEN n.e - n.s >= 300000 OR f.e - f.cs + n.e - n.s >= 9000000 THEN f.g + 1 ELSE f.g END,
    CASE WHEN n.e - n.s >= 300000 OR f.e - f.cs + n.e - n.s >= 9000000 THEN n.s ELSE f.cs END
  FROM f JOIN s n ON n.file = f.file AND n.r = f.r + 1),
g AS (SELECT file, g, min_by(s, r) AS s, max_by(e, r) AS e, count(*) AS n FROM f GROUP BY file, g),
l AS (SELECT *, max(g) OVER (PARTITION BY file) AS last FROM g),
h AS (SELECT *, CASE WHEN g = last AND e - s < 300000 AND last > 0 THEN g - 1 ELSE g END AS h FROM l),
m AS (SELECT file, h, min_by(s, g) AS s, max_by(e, g) AS e, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY file, h)
"""


@query(MERGED + """
SELECT file, CAST(h AS BIGINT) AS seg_no, s AS start, e AS "end", n FROM m
""")
def merge_short_segments(t):
    return G.merge_short_segments(segments(t), "file", "event_id", 300, 6000, rate=1000)


@query(MERGED + """,
k AS (SELECT user_id AS file, CASE WHEN user_id % 10 = 0 THEN 5000000 ELSE 1706500000000 + user_id * 1000000 END AS n
  FROM events GROUP BY user_id),
c AS (SELECT m.file, m.s, least(m.e, k.n) AS e, row_number() OVER (PARTITION BY m.file ORDER BY h) AS part
  FROM m JOIN k USING (file) WHERE k.n > 6000000 AND (least(m.e, k.n) - m.s) >= 100)
SELECT file, 'user' || file || '.wav' AS clip, 0 AS start, n AS "end" FROM k WHERE n <= 6000000
UNION ALL SELECT file, 'user' || file || '_part' || CASE WHEN part < 1000 THEN lpad(CAST(part AS VARCHAR), 3, '0') ELSE CAST(part AS VARCHAR) END || '.wav', s, e FROM c
""")
def segment_files(t):
    user = F.col("user_id")
    files = t.events.select("user_id").distinct().select(
        user.alias("file"),
        F.concat(F.lit("user"), user).alias("stem"),
        F.when(user % 10 == 0, F.lit(5000000)).otherwise(F.lit(1706500000000) + user * 1000000).alias("n_samples"),
    )
    return G.segment_files(files, segments(t), "file", "event_id", 300, 6000, rate=1000)
