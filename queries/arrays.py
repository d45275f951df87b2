"""Waveforms, features, targets and pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import segments as G
from corpusloom.operators import targets as T
from corpusloom.operators.batching import static_batch
from corpusloom.plans import jobs
from queries import query
from queries.stats import csv, sql_csv

DOUBLES = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def ints(x):
    return F.array_join(x, ",")


def lines(rows):
    """Rows of digits as text, a space between rows: JSON without its signs, which is written without an expression per digit."""
    text = F.replace(F.to_json(rows), F.lit("],["), F.lit(" "))
    for sign in ",[]":
        text = F.replace(text, F.lit(sign))
    return text


def sql_gain(x: str, gain: str) -> str:
    top = f"(list_max(list_transform({x}, lambda v: abs(v))) * {gain})"
    return (
        f"list_transform({x}, lambda v: CASE WHEN {top} > 0.95 THEN v * {gain} / {top} * 0.95 ELSE v * {gain} END)"
    )


def sql_rms(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda v: v * v)) / len({x}))"


CROP = "CAST('0x' || substr(md5(vec_id || '|42'), 1, 8) AS BIGINT)"


@query(f"""
WITH m AS (SELECT vec_id, label, list_transform(list_zip({DOUBLES}, list_reverse({DOUBLES})),
  lambda z: (z[1] * 20 + z[2] * 10) / 2) || [0.25, 0.5] AS x FROM embeddings),
n AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS top FROM m),
p AS (SELECT vec_id, CASE WHEN top > 1 THEN list_transform(x, lambda v: v / top) ELSE x END AS x FROM n),
r AS (SELECT vec_id, {sql_gain('x', f"(0.1 / {sql_rms('x')})")} AS x FROM p),
c AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 48 ELSE 80 END AS w, x FROM r)
SELECT vec_id, 66 AS even_samples, {sql_csv(f'x[CAST({CROP} % 19 + 1 AS INTEGER):CAST({CROP} % 19 + 48 AS INTEGER)]', 100000)} AS speech FROM c
""")
def prepare_waveforms(t):
    both = F.array(
        F.concat(A.scale(F.col("embedding"), F.lit(20)), F.array(F.lit(0.25), F.lit(0.5))),
        F.concat(A.scale(F.reverse("embedding"), F.lit(10)), F.array(F.lit(0.25), F.lit(0.5))),
    )
    rows = t.embeddings.select("vec_id", both.alias("channels"))
    out = jobs.prepare_waveforms(rows, 48, "vec_id")
    return out.select(
        "vec_id",
        F.col("even_samples").cast("int").alias("even_samples"),
        csv(F.col("speech"), 100000).alias("speech"),
    )


@query(f"""
SELECT vec_id, {sql_csv("embedding || list_transform(range(100 - len(embedding)), lambda i: 0)", 100000)} AS speech
FROM embeddings
""")
def crop_or_pad(t):
    speech = A.crop_or_pad(F.col("embedding"), 100, "vec_id")
    return t.embeddings.select("vec_id", csv(speech, 100000).alias("speech"))


@query(f"""
WITH x AS (SELECT vec_id, label, {DOUBLES} AS x, CASE WHEN label % 3 = 0 THEN NULL ELSE -30.0 + label * 2 END AS l FROM embeddings),
g AS (SELECT *, CASE WHEN l IS NULL THEN 0.1 / {sql_rms('x')} ELSE pow(10, (-23 - l) / 20) END AS gain FROM x)
SELECT vec_id, {sql_csv(sql_gain('x', 'gain'), 100000)} AS speech FROM g
""")
def loudness_gain(t):
    loudness = F.when(F.col("label") % 3 != 0, F.lit(-30.0) + F.col("label") * 2)
    return t.embeddings.select(
        "vec_id", csv(A.loudness_gain(F.col("embedding"), loudness), 100000).alias("speech")
    )


@query(f"""
WITH s AS (SELECT vec_id, embedding, len(string_split(text, ' ')) AS f, len(string_split(text, 'e')) AS k
  FROM documents JOIN embeddings ON vec_id = doc_id),
a AS (SELECT *, CAST(floor(least(f / 2, k)) AS INTEGER) AS n,
  greatest(sqrt(list_sum(list_transform({DOUBLES}, lambda v: v * v))), 1e-12) AS norm FROM s)
SELECT vec_id, CAST(least(f, n * 2) AS INTEGER) AS frames, CAST(least(k, n) AS INTEGER) AS tokens,
  {sql_csv('list_transform(embedding, lambda v: CAST(v AS DOUBLE) / norm)')} AS embedding FROM a
""")
def align_features(t):
    rows = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id")).select(
        "vec_id",
        F.split("text", " ").alias("speech_feat"),
        F.split("text", "e").alias("speech_token"),
        "embedding",
    )
    out = jobs.align_features(rows, 2)
    return out.select(
        "vec_id",
        F.size("speech_feat").alias("frames"),
        F.size("speech_token").alias("tokens"),
        csv(F.col("embedding")).alias("embedding"),
    )


@query("""
WITH b AS (SELECT doc_id, source, len(string_split(text, ' ')) AS n,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS b FROM documents),
m AS (SELECT *, max(n) OVER (PARTITION BY source, b) AS longest FROM b)
SELECT doc_id, repeat('0', n) || repeat('1', longest - n) AS pad, repeat('1', n) || repeat('0', longest - n) AS valid,
  CAST(ceil(longest / 4) * 4 AS BIGINT) AS rounded FROM m
""")
def pad_mask(t):
    from pyspark.sql.window import Window as W

    rows = t.documents.select("doc_id", "source", F.size(F.split("text", " ")).alias("n"))
    rows = static_batch(rows, "source", "doc_id", 8).withColumn(
        "longest", F.max("n").over(W.partitionBy("source", "batch_no"))
    )

    def bits(mask):
        return F.array_join(F.transform(mask, lambda b: b.cast("int").cast("string")), "")

    return rows.select(
        "doc_id",
        bits(A.pad_mask(F.col("n"), F.col("longest"))).alias("pad"),
        bits(A.sequence_mask(F.col("n"), F.col("longest"))).alias("valid"),
        A.round_up_length(F.col("longest")).alias("rounded"),
    )


TOKENS = """
WITH s AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS s,
  len(string_split(text, ' ')) // 5 + doc_id % 3 AS t FROM documents)
"""


def tokens(t):
    words = F.split("text", " ")
    rows = t.texts("doc_id", "text").select("doc_id", F.transform(words, F.length).alias("s"))
    return rows.withColumn("t", F.expr("cast(size(s) div 5 + doc_id % 3 as int)"))


def sql_ignored(n: str) -> str:
    return f"list_transform(range({n}), lambda i: -1)"


COIN = "CAST('0x' || substr(md5(doc_id || '|42'), 1, 8) AS BIGINT) % 2 = 0"
BISTREAM = f"""[-1] || flatten(list_transform(range(CAST(ceil((t + 1) / 5) AS BIGINT)), lambda j: CASE
  WHEN (j + 1) * 5 <= t THEN [-1, -1, -1, -1] || s[j * 15 + 1:j * 15 + 15] || [102]
  ELSE {sql_ignored('t - j * 5')} || s[j * 15 + 1:] || [100] END))"""


@query(TOKENS + f"""
SELECT doc_id, array_to_string({sql_ignored('t + 2')} || s || [100], ',') AS v1,
  array_to_string({sql_ignored('t + 1')} || s || [100], ',') AS unistream,
  array_to_string(CASE WHEN {COIN} AND len(s) > t * 3 THEN {BISTREAM} ELSE {sql_ignored('t + 1')} || s || [100] END, ',') AS mixed,
  CAST(t * 2 AS BIGINT) AS least_len, CAST(t * 20 AS BIGINT) AS most_len FROM s
""")
def build_targets(t):
    n, s = F.col("t"), F.col("s")
    low, high = T.length_bounds(n)
    return tokens(t).select(
        "doc_id",
        ints(T.lm_targets_v1(n, s, 100)).alias("v1"),
        ints(T.lm_targets_unistream(n, s, 100)).alias("unistream"),
        ints(T.lm_targets_mixed(n, s, 100, 102, "doc_id")).alias("mixed"),
        low.alias("least_len"),
        high.alias("most_len"),
    )


@query(TOKENS + f"""
SELECT doc_id, CAST(h AS INTEGER) AS head,
  array_to_string({sql_ignored('t + 1')} || s[h + 1:] || [100] || {sql_ignored('h')}, ',') AS target
FROM s, range(5) r(h)
""")
def lm_targets_multihead(t):
    out = T.lm_targets_multihead(tokens(t), F.col("t"), F.col("s"), 100)
    return out.select("doc_id", "head", ints(F.col("target")).alias("target"))


@query(TOKENS + """
SELECT doc_id, array_to_string(flatten(list_transform(range(len(s)), lambda i:
  list_transform(range(s[i + 1] % 4), lambda k: i))), ',') AS owners FROM s
""")
def expand_durations(t):
    short = F.transform("s", lambda v: v % 4)
    return tokens(t).select("doc_id", ints(A.expand_durations(short)).alias("owners"))


@query("""
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x) % 4) AS d FROM documents),
u AS (SELECT doc_id, unnest(range((len(d) + 11) // 12)) AS part, d FROM w),
s AS (SELECT doc_id, part, d[part * 12 + 1:part * 12 + 12] AS d FROM u),
o AS (SELECT *, flatten(list_transform(range(len(d)), lambda i: list_transform(range(d[i + 1]), lambda k: i))) AS o FROM s)
SELECT doc_id, CAST(part AS INTEGER) AS part, array_to_string(list_transform(range(len(d)), lambda i: array_to_string(
  list_transform(range(1, 37), lambda j: CASE WHEN o[j] = i THEN 1 ELSE 0 END), '')), ' ') AS path FROM o
""")
def duration_path(t):
    """All words of a text, twelve to an utterance; a word lasts as many frames as its length modulo four."""
    d = F.transform(F.split("text", " "), lambda w: (F.length(w) % 4).cast("int"))
    # cut before they are exploded, so that no part carries its whole text
    parts = F.expr("transform(sequence(0, (size(d) - 1) div 12), k -> slice(d, int(k) * 12 + 1, 12))")
    rows = t.documents.select("doc_id", d.alias("d")).select("doc_id", F.posexplode(parts).alias("part", "d"))
    path = A.duration_path(F.col("d"), F.lit(36))
    return rows.select("doc_id", "part", lines(path).alias("path"))


@query(f"""
WITH x AS (SELECT vec_id, {DOUBLES} AS x, 0.5 + label / 10 AS speed FROM embeddings),
n AS (SELECT *, greatest(1, CAST(floor(64 / speed) AS INTEGER)) AS n FROM x),
p AS (SELECT *, list_transform(range(n), lambda i: greatest((i + 0.5) * 64 / n - 0.5, 0)) AS p FROM n)
SELECT vec_id, {sql_csv('''CASE WHEN speed = 1 THEN x ELSE list_transform(p, lambda q: x[least(CAST(floor(q) AS INTEGER), 63) + 1]
  + (x[least(CAST(floor(q) AS INTEGER) + 1, 63) + 1] - x[least(CAST(floor(q) AS INTEGER), 63) + 1]) * (q - least(CAST(floor(q) AS INTEGER), 63))) END''', 100000)} AS samples FROM p
""")
def time_stretch(t):
    speed = F.lit(0.5) + F.col("label") / 10
    return t.embeddings.select(
        "vec_id", csv(A.time_stretch(F.col("embedding"), speed), 100000).alias("samples")
    )


@query(f"""
WITH x AS (SELECT vec_id, {DOUBLES} AS x FROM embeddings),
c AS (SELECT vec_id, list_transform(x, lambda v: ln(greatest(v, 0.00001) * 2)) AS c FROM x)
SELECT vec_id, {sql_csv('c')} AS packed, {sql_csv('list_transform(c, lambda v: exp(v) / 2)')} AS back FROM c
""")
def log_compress(t):
    rows = t.embeddings.withColumn("c", A.log_compress(F.col("embedding"), 2.0))
    return rows.select(
        "vec_id",
        csv(F.col("c")).alias("packed"),
        csv(A.log_decompress(F.col("c"), 2.0)).alias("back"),
    )


@query(f"""
WITH x AS (SELECT vec_id, {DOUBLES} AS x FROM embeddings),
e AS (SELECT *, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM x)
SELECT vec_id, {sql_csv('list_transform(e, lambda v: v / list_sum(e))')} AS probs,
  {sql_csv('list_transform(x, lambda v: v - list_max(x) - ln(list_sum(e)))')} AS logs FROM e
""")
def softmax(t):
    x = F.col("embedding")
    return t.embeddings.select(
        "vec_id", csv(A.softmax(x)).alias("probs"), csv(A.log_softmax(x)).alias("logs")
    )


def requests(t):
    """Vectors as pieces of audio, eight to a request."""
    request = F.expr("vec_id div 8").alias("request")
    return t.embeddings.select(request, "vec_id", F.col("embedding").alias("samples"))


@query(f"""
WITH x AS (SELECT vec_id // 8 AS request, vec_id, {DOUBLES} AS x,
  lag(embedding) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS prev FROM embeddings)
SELECT request, vec_id, {sql_csv('''CASE WHEN prev IS NULL THEN x ELSE [x[1] * 0.1 + prev[61] * 0.9, x[2] * 0.4 + prev[62] * 0.6,
  x[3] * 0.6 + prev[63] * 0.4, x[4] * 0.9 + prev[64] * 0.1] || x[5:] END''', 100000)} AS samples FROM x
""")
def crossfade(t):
    pieces = requests(t)
    window = [0.1, 0.4, 0.6, 0.9, 0.9, 0.6, 0.4, 0.1]
    out = G.crossfade_pieces(pieces, "request", "vec_id", window)
    return out.select("request", "vec_id", csv(F.col("samples"), 100000).alias("samples"))


PAUSES = """
WITH e AS (SELECT vec_id // 8 AS request, vec_id FROM embeddings),
p AS (SELECT request, vec_id, CASE WHEN row_number() OVER (PARTITION BY request ORDER BY vec_id DESC) = 1 THEN 0
  ELSE CAST(floor((50 + CAST('0x' || substr(md5(request || '|' || vec_id || '|42'), 1, 8) AS BIGINT) % 101) * 240 / 1000) AS BIGINT) END AS pause
  FROM e),
a AS (SELECT *, CAST(coalesce(sum(64 + pause) OVER (PARTITION BY request ORDER BY vec_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_sample FROM p)
"""


def placed(t):
    pieces = requests(t)
    return G.join_with_pauses(pieces, "request", "vec_id", rate=240)


@query(PAUSES + "SELECT request, vec_id, pause, first_sample FROM a")
def join_with_pauses(t):
    return placed(t).select("request", "vec_id", "pause", "first_sample")


@query(PAUSES + f""",
j AS (SELECT request, flatten(list(embedding || list_transform(range(pause), lambda i: 0) ORDER BY first_sample)) AS x
  FROM a JOIN embeddings USING (vec_id) GROUP BY request),
b AS (SELECT request, unnest(range((len(x) + 255) // 256)) AS block_no, x FROM j)
SELECT request, block_no, {sql_csv('x[block_no * 256 + 1:block_no * 256 + 256]', 1000)} AS samples FROM b
""")
def assemble_pieces(t):
    out = G.audio_blocks(placed(t), "request", 256)
    return out.select("request", "block_no", csv(F.col("samples"), 1000).alias("samples"))


@query("""
WITH n AS (SELECT doc_id, len(string_split(text, ' ')) AS n, CAST(ceil((doc_id % 60) / 25) * 25 - doc_id % 60 + 25 AS INTEGER) AS first FROM documents),
k AS (SELECT *, CASE WHEN n < first + 3 THEN 0 ELSE (n - first - 3) // 25 + 1 END AS k FROM n),
c AS (SELECT *, unnest(range(k + 1)) AS i FROM k),
o AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE first + (i - 1) * 25 END AS o FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(o AS INTEGER) AS offset, 0 AS "begin",
  CAST(CASE WHEN i = k THEN n ELSE o + CASE WHEN i = 0 THEN first ELSE 25 END + 3 END AS INTEGER) AS "end", i = k AS final FROM o
""")
def stream_hops(t):
    rows = t.documents.select("doc_id", F.split("text", " ").alias("tokens"))
    out = G.stream_hops(rows, "tokens", 25, 3, prompt_len=F.col("doc_id") % 60)
    return out.drop("tokens")


@query("""
WITH n AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents),
k AS (SELECT *, CASE WHEN n < 70 THEN 0 ELSE (n - 70) // 50 + 1 END AS k FROM n),
c AS (SELECT *, unnest(range(k + 1)) AS i FROM k)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 50 AS INTEGER) AS offset, CAST(i * 50 AS INTEGER) AS "begin",
  CAST(CASE WHEN i = k THEN n ELSE i * 50 + 70 END AS INTEGER) AS "end", i = k AS final FROM c
""")
def stream_hops_overlap(t):
    rows = t.documents.select("doc_id", F.split("text", " ").alias("tokens"))
    return G.stream_hops(rows, "tokens", 50, overlap=20).drop("tokens")


@query(f"""
WITH x AS (SELECT vec_id, {DOUBLES} AS x FROM embeddings),
c AS (SELECT vec_id, flatten(list_transform(range(4), lambda i: list_transform(x[i * 16 + 1:i * 16 + 16], lambda v: (v - i * 0.25) / (i + 1.5)))) AS s FROM x)
SELECT vec_id, s AS scaled, list_transform(range(64), lambda j: s[j + 1] * (j // 16 + 1.5) + (j // 16) * 0.25) AS back FROM c
""")
def standardise_channels(t):
    """Four channels of sixteen values, each with its own mean and deviation, there and back."""
    channels = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    means, stds = F.array(*[F.lit(i * 0.25) for i in range(4)]), F.array(*[F.lit(i + 1.5) for i in range(4)])
    scaled = t.embeddings.select("vec_id", A.standardise_channels(channels, means, stds).alias("s"))
    return scaled.select("vec_id", F.flatten("s").alias("scaled"), F.flatten(A.destandardise_channels(F.col("s"), means, stds)).alias("back"))


@query("""
WITH x AS (SELECT vec_id, embedding, vec_id % 70 AS a, vec_id % 70 + vec_id % 21 - 2 AS b FROM embeddings)
SELECT vec_id, (b - a) / 16 AS seconds, array_to_string(list_transform(
  embedding[a + 1:greatest(b, a)], lambda v: CAST(floor(v * 1000) AS BIGINT)), ',') AS samples FROM x
""")
def clip_segments(t):
    """A segment of each vector, taken as samples at rate 16; it may be empty or run over the end."""
    a = F.col("vec_id") % 70
    b = a + F.col("vec_id") % 21 - 2
    part = F.transform(A.clip(F.col("embedding"), a, b), lambda v: F.floor(v * 1000).cast("bigint"))
    return t.embeddings.select("vec_id", A.segment_seconds(a, b, 16).alias("seconds"), F.array_join(part, ",").alias("samples"))
