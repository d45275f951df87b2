"""Shuffling, sampling, sharding, batching, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import batching as B
from corpusloom.plans import jobs
from queries import query


def docs(t):
    return t.documents.select("doc_id", "source", "n_chars")


@query("""
SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) - 1 AS pos FROM documents
""")
def seeded_shuffle(t):
    return B.seeded_shuffle(t.documents.select("doc_id"), "doc_id")


@query("""
WITH r AS (SELECT doc_id, source,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS b FROM documents)
SELECT doc_id, source, b * 20 + row_number() OVER (PARTITION BY source, b
  ORDER BY md5(doc_id || '|42'), doc_id) - 1 AS pos FROM r
""")
def buffer_shuffle(t):
    return B.buffer_shuffle(t.documents.select("doc_id", "source"), "source", "doc_id", 20)


@query("SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id || '|42'), vec_id LIMIT 200")
def sample_n(t):
    return B.sample_n(t.embeddings.select("vec_id", "label"), "vec_id", 200)


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS p,
  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN p > n - floor(n * 0.05) THEN 'val' ELSE 'train' END AS split FROM r
""")
def train_val_split(t):
    return B.train_val_split(t.orders.select("o_orderkey"), "o_orderkey", 0.05)


@query("""
WITH s AS (SELECT DISTINCT source FROM documents),
l AS (SELECT source, row_number() OVER (ORDER BY md5(source || '|3'), source) - 1 AS i,
  count(*) OVER () AS n FROM s),
j AS (SELECT source, unnest(range(i, greatest(n, 32), n)) AS j, n FROM l),
r AS (SELECT source, j % 32 AS rank, j // 32 AS i,
  (greatest(n, 32) - j % 32 + 31) // 32 AS n FROM j WHERE n < 32 OR j < n),
w AS (SELECT source, rank, unnest(range(i, greatest(n, 2), n)) AS j, n FROM r)
SELECT source, CAST(rank AS INTEGER) AS rank, CAST(j % 2 AS INTEGER) AS worker, j // 2 AS read_no FROM w
""")
def assign_shards(t):
    return B.assign_shards(t.documents.select("source").distinct(), "source", 32, 2, epoch=3)


@query("""
WITH l AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|7'), o_orderkey) - 1 AS i
  FROM orders)
SELECT o_orderkey, CAST(i % 6 AS INTEGER) AS rank, CAST(i // 6 % 4 AS INTEGER) AS worker,
  i // 6 // 4 AS read_no FROM l
""")
def assign_shards_many(t):
    return B.assign_shards(t.orders.select("o_orderkey"), "o_orderkey", 6, 4, epoch=7)


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(floor((r - 1) / ceil(n / 7)) AS BIGINT) AS chunk FROM r
""")
def even_chunks(t):
    return B.even_chunks(t.documents.select("doc_id"), "doc_id", 7)


BUCKETS = """
WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
  FROM documents),
s AS (SELECT doc_id, source, n_chars, (r - 1) // 25 * 25 + row_number() OVER (
    PARTITION BY source, (r - 1) // 25 ORDER BY n_chars, r) - 1 AS pos FROM r)
"""


@query(BUCKETS + "SELECT * FROM s")
def length_bucket_sort(t):
    return B.length_bucket_sort(docs(t), "source", "doc_id", "n_chars", 25)


@query("""
SELECT doc_id, source, n_chars,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS batch_no FROM documents
""")
def static_batch(t):
    return B.make_batches(docs(t), "static", "source", "doc_id", size=16)


def fold(rows: str, budget: int) -> str:
    """Recursive form of the batch rule over rows (source, r, n_chars, ...)."""
    return f"""
f AS (
  SELECT *, 0 AS batch_no, 1 AS c, n_chars AS m FROM {rows} WHERE r = 1
  UNION ALL
  SELECT d.*, CASE WHEN greatest(f.m, d.n_chars) * (f.c + 1) > {budget} THEN f.batch_no + 1 ELSE f.batch_no END,
    CASE WHEN greatest(f.m, d.n_chars) * (f.c + 1) > {budget} THEN 1 ELSE f.c + 1 END,
    CASE WHEN greatest(f.m, d.n_chars) * (f.c + 1) > {budget} THEN d.n_chars ELSE greatest(f.m, d.n_chars) END
  FROM f JOIN {rows} d ON d.source = f.source AND d.r = f.r + 1)
"""


@query("""
WITH RECURSIVE d AS (SELECT doc_id, source, n_chars,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),""" + fold("d", 12000) + """
SELECT doc_id, source, n_chars, CAST(batch_no AS BIGINT) AS batch_no FROM f
""")
def dynamic_batch(t):
    return B.make_batches(
        docs(t), "dynamic", "source", "doc_id", length="n_chars", budget=12000
    )


@query("""
SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source, b ORDER BY n_chars DESC, doc_id) - 1 AS INTEGER) AS in_batch,
  b AS batch_no
FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS b FROM documents)
""")
def pad_sort_order(t):
    rows = B.static_batch(docs(t), "source", "doc_id", 16)
    return B.pad_sort_order(rows, ["source", "batch_no"], "n_chars", "doc_id").drop("n_chars")


PADDED = "WITH RECURSIVE " + BUCKETS.strip()[5:] + """,
d AS (SELECT s.*, pos + 1 AS r, list_transform(string_split(text, ' '), lambda w: length(w)) AS token
  FROM s JOIN documents USING (doc_id, source, n_chars)),""" + fold("d", 20000)


@query(PADDED + """,
m AS (SELECT *, max(len(token)) OVER (PARTITION BY source, batch_no) AS longest FROM f)
SELECT doc_id, source, CAST(batch_no AS BIGINT) AS batch_no, len(token) AS token_len,
  row_number() OVER (PARTITION BY source, batch_no ORDER BY n_chars DESC, pos) - 1 AS in_batch,
  array_to_string(token || list_transform(range(longest - len(token)), lambda i: 0), ',') AS token
FROM m
""")
def pad_batches(t):
    rows = t.documents.select(
        "doc_id", "source", "n_chars", F.transform(F.split("text", " "), F.length).alias("token")
    )
    padded = jobs.pad_batches(
        rows, "source", "doc_id", "n_chars", {"token": 0}, sort_size=25, budget=20000
    )
    return padded.select(
        "doc_id",
        "source",
        "batch_no",
        F.col("token_len").cast("bigint").alias("token_len"),
        F.col("in_batch").cast("bigint").alias("in_batch"),
        F.array_join("token", ",").alias("token"),
    )


@query("""
WITH r AS (SELECT doc_id, source, n_chars, string_split(text, ' ') AS w,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS b FROM documents),
m AS (SELECT *, max(len(w)) OVER (PARTITION BY source, b) AS xm,
  max(len(w) + 3) OVER (PARTITION BY source, b) AS ym FROM r)
SELECT doc_id, b AS batch_no, len(w) AS x_len, len(w) + 3 AS y_len, xm AS x_padded,
  CAST(ceil(ym / 4) * 4 AS BIGINT) AS y_padded,
  CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS x_sum FROM m
""")
def text_mel_batch(t):
    words = F.transform(F.split("text", " "), F.length)
    rows = t.documents.select(
        "doc_id",
        "source",
        words.alias("text_token"),
        F.transform(F.concat(words, F.array(F.lit(1), F.lit(1), F.lit(1))), lambda v: F.array(v * 1.0, v * 0.5)).alias(
            "speech_feat"
        ),
        F.lit(1).alias("spk"),
    )
    batched = B.static_batch(rows, "source", "doc_id", 8)
    out = jobs.text_mel_batch(batched, ["source", "batch_no"])
    return out.select(
        "doc_id",
        "batch_no",
        F.col("x_len").cast("bigint").alias("x_len"),
        F.col("y_len").cast("bigint").alias("y_len"),
        F.size("x").cast("bigint").alias("x_padded"),
        F.size("y").cast("bigint").alias("y_padded"),
        F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("x_sum"),
    )


@query("""
WITH r AS (SELECT doc_id, source, n_chars,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS b FROM documents)
SELECT source, b AS batch_no, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids
FROM r GROUP BY ALL
""")
def collate(t):
    rows = B.static_batch(docs(t), "source", "doc_id", 16)
    out = B.collate(rows, ["source", "batch_no"], ["n_chars"], "doc_id")
    return out.select("source", "batch_no", "n", F.array_join("rows.doc_id", ",").alias("ids"))
