"""Training logs, progress lines and job results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions.bind import bind
from corpusloom.functions.text import strip, strip_ansi
from corpusloom.operators.ordered import SPAN, with_ordered, with_ordinal

# Metric names and the progress messages in both languages.
METRICS = ["loss", "grad_norm", "learning_rate", "epoch"]
FILES_FOUND = "找到\\s+(\\d+)\\s+个音频文件|Found\\s+(\\d+)\\s+audio\\s+files"
FILES_STEP = "(?:处理音频文件|Processing audio files).*?(\\d+)\\s*/\\s*(\\d+)"
MEDIA_FOUND = (
    "找到\\s+(\\d+)\\s+个\\s+\\.wav\\s+文件和\\s+(\\d+)\\s+个\\s+\\.mp3\\s+文件|"
    "Found\\s+(\\d+)\\s+\\.wav\\s+files\\s+and\\s+(\\d+)\\s+\\.mp3\\s+files"
)
POOL_STARTED = (
    "启动多进程处理:\\s*(\\d+)\\s*个工作进程处理\\s*(\\d+)\\s*个文件|"
    "Starting multi-process:\\s*(\\d+)\\s*workers?\\s*for\\s*(\\d+)\\s*files"
)
WORKER_CHUNK = (
    "启动工作进程\\s*(\\d+)，分配\\s*(\\d+)\\s*个文件|"
    "Starting worker\\s*(\\d+),\\s*assigned\\s*(\\d+)\\s*files"
)
ASR_PERCENT = "ASR.*?(\\d+)%\\|"
WORKER_PERCENT = "Worker\\s*(\\d+).*?(\\d+)%\\|"


def parse_metric_line(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``kind`` (train, eval or null), ``parsed_by`` (literal or regex) and the metrics.

    A line counts when it starts with a brace. A literal keeps null for a missing key, as does
    the regex form; ``fill_metrics`` gives each its own default. The values are computed inside
    a generator, so that a filter on them is not pushed into a second parse.
    """
    fields = [*METRICS, "eval_loss"]
    schema = ", ".join(f"{m} double" for m in fields) + ", _bad string"
    options = {"allowSingleQuotes": "true", "columnNameOfCorruptRecord": "_bad"}

    def by_regex(text: Column, name: str) -> Column:
        found = F.regexp_extract(text, f"'{name}':\\s*([-+.0-9eE]+)", 1)
        return found.try_cast("double")

    def metrics(text: Column, literal: Column) -> Column:
        ok = F.coalesce(literal["_bad"].isNull() & literal.isNotNull(), F.lit(False))
        values = [
            F.when(ok, literal[m]).otherwise(by_regex(text, m)).alias(m) for m in fields
        ]
        return F.struct(ok.alias("_ok"), *values)

    def parsed(text: Column) -> Column:
        brace = F.when(text.startswith("{"), text)
        literal = F.from_json(F.when(brace.endswith("}"), brace), schema, options)
        return bind(literal, lambda found: metrics(brace, found))

    found = bind(strip(strip_ansi(F.col(line))), parsed)
    kind = F.when(F.col("loss").isNotNull(), "train").when(F.col("eval_loss").isNotNull(), "eval")
    way = F.when(F.col("_ok"), "literal").otherwise("regex")
    return (
        df.select("*", F.inline(F.array(found)))
        .withColumn("kind", kind)
        .withColumn("parsed_by", F.when(kind.isNotNull(), way))
        .drop("_ok")
    )


def number_steps(parsed: DataFrame, run: str, order: str, span: int = SPAN) -> DataFrame:
    """Accepted training lines with their ordinal in the run."""
    return with_ordinal(
        parsed.filter(F.col("kind") == "train"), [run], order, "step", span=span
    )


def fill_metrics(
    parsed: DataFrame, run: str, order: str, carry: bool = True, span: int = SPAN
) -> DataFrame:
    """Accepted training lines with their ``step``; missing metrics are 0 for literal lines and
    the previous line's value for regex lines.

    The previous line's value is itself filled, so a literal line counts as 0 where the key is
    missing. Without ``carry`` (the in-memory form) every missing value is 0.
    """
    rest = METRICS[1:]
    lines = parsed.filter(F.col("kind") == "train")
    settled = (F.col("parsed_by") == "literal") | F.lit(not carry)
    known = lines.withColumns(
        {m: F.when(settled, F.coalesce(m, F.lit(0.0))).otherwise(F.col(m)) for m in rest}
    )
    if not carry:
        return with_ordinal(known, run, order, "step", span=span)
    filled = with_ordered(
        known, run, order, ordinal="step", previous={m: f"_{m}" for m in rest}, span=span
    )
    return filled.withColumns(
        {m: F.coalesce(m, f"_{m}", F.lit(0.0)) for m in rest}
    ).drop(*[f"_{m}" for m in rest])


def metric_series(parsed: DataFrame, run: str, order: str, span: int = SPAN) -> DataFrame:
    """Long form for ``pair_train_eval``: kind, step inside run and kind, value."""
    lines = parsed.filter(F.col("kind").isNotNull()).select(
        run, order, "kind", F.coalesce("loss", "eval_loss").alias("value")
    )
    return with_ordinal(lines, [run, "kind"], order, "step", span=span)


def tail_lines(logs: DataFrame, run: str, order: str, n: int = 200) -> DataFrame:
    """The last ``n`` lines of each run with the number left out.

    The rank filter runs before the shuffle as well (window group limit), so at most ``n`` rows
    per run and task are moved.
    """
    counts = logs.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    latest = F.row_number().over(W.partitionBy(run).orderBy(F.col(order).desc()))
    return (
        logs.withColumn("_back", latest)
        .filter(F.col("_back") <= n)
        .join(counts, run)
        .withColumn("omitted", F.greatest(F.col("_n") - n, F.lit(0)))
        .drop("_back", "_n")
    )


def thin_steps(df: DataFrame, index: str, interval: int) -> DataFrame:
    return df.filter(F.pmod(F.col(index) + 1, F.lit(interval)) == 0)


def explode_log_history(states: DataFrame, state: str = "state") -> DataFrame:
    """Entries of ``log_history``: eval if they have an eval loss, else train if loss and step."""
    entry = "struct<step:bigint,loss:double,eval_loss:double,grad_norm:double,learning_rate:double,epoch:double>"
    logs = F.from_json(state, f"log_history array<{entry}>")["log_history"]
    keep = [c for c in states.columns if c != state]
    rows = states.select(*keep, F.posexplode(logs).alias("entry_no", "_e"))
    e = F.col("_e")
    kind = F.when(e["eval_loss"].isNotNull(), "eval").when(
        e["loss"].isNotNull() & e["step"].isNotNull(), "train"
    )
    zero = F.lit(0.0)
    return rows.withColumn("kind", kind).filter("kind is not null").select(
        *keep,
        "entry_no",
        "kind",
        e["step"].alias("step"),
        F.coalesce(e["eval_loss"], e["loss"]).alias("value"),
        *[F.coalesce(e[m], zero).alias(m) for m in METRICS[1:]],
    )


def parse_progress_line(df: DataFrame, line: str = "line") -> DataFrame:
    """Totals, done counts, worker ids, chunk sizes and percents found in a progress line."""

    def number(pattern: str, *groups: int) -> Column:
        texts = [F.regexp_extract(F.col(line), pattern, g) for g in groups]
        return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts]).cast("bigint")

    step_done, step_total = number(FILES_STEP, 1), number(FILES_STEP, 2)
    media = number(MEDIA_FOUND, 1, 3) + number(MEDIA_FOUND, 2, 4)
    return df.withColumns(
        {
            "total": F.coalesce(step_total, number(FILES_FOUND, 1, 2), media, number(POOL_STARTED, 2, 4)),
            "done": step_done,
            "workers": number(POOL_STARTED, 1, 3),
            "worker": F.coalesce(number(WORKER_CHUNK, 1, 3), number(WORKER_PERCENT, 1)),
            "chunk": number(WORKER_CHUNK, 2, 4),
            "percent": F.coalesce(
                number(WORKER_PERCENT, 2),
                number(ASR_PERCENT, 1),
                F.when(
                    step_total > 0,
                    F.greatest(
                        F.lit(0), F.least(F.lit(100), F.floor(step_done * 100 / step_total))
                    ),
                ),
            ),
        }
    )


def job_status(events: DataFrame, job: str, order: str) -> DataFrame:
    """Latest status per job: running, completed or failed by exit code, stopped by the user.

    ``events``: ``kind`` (start, exit or stop), ``code``, ``ts``.
    """
    status = (
        F.when(F.col("kind") == "stop", "stopped")
        .when((F.col("kind") == "exit") & (F.col("code") == 0), "completed")
        .when(F.col("kind") == "exit", "failed")
        .otherwise("running")
    )
    ended = F.when(F.col("kind").isin("exit", "stop"), F.col("ts"))
    marked = events.withColumn("_s", status).withColumn("_e", ended)
    return marked.groupBy(job).agg(
        F.max_by("_s", order).alias("status"),
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("start_time"),
        F.max_by("_e", order).alias("end_time"),
    )


def clock(seconds: Column) -> Column:
    """Wall-clock text of epoch seconds."""
    return F.from_unixtime(seconds, "yyyy-MM-dd HH:mm:ss")
