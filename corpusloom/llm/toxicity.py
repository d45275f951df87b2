"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of its distinct words; a document's is their
noisy-or, ``1 - prod(1 - p)``. One bias for all lengths would let the noise of the clean sentences add
up to 1: so beyond LONG sentences the log-odds of each fall by ``log(n / LONG)``, which bounds what
the background expects whatever the length, and what a sentence without weighted words scores is
taken out of the product. The weights are fitted to document labels only, and the sentences that carry a
high probability are then the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, powers, text_of, tidy

#: Hash buckets of words, and of their first bytes (inflected forms share those).
BITS, STEM = 18, 5
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True
#: Bound of the training sample: documents of a class, and words of a class.
SAMPLE_DOCS, SAMPLE_WORDS = 4000, 1_500_000
#: Sentences of a document up to which they have the full bias: in training, and in scoring.
USUAL, LONG = 32, 512
#: A document holds one in so many words of its class's sample at most.
LARGE = 32


def features(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bucket and sentence number of every feature, and the bytes they were taken from."""
    body = text.encode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    body = low if len(low) == len(body) else body.lower()
    raw = np.frombuffer(body, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = WORD[raw]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lens = change[::2], change[1::2] - change[::2]
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int32), body
    base = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(base, lens)
    weighed = (raw[np.repeat(starts, lens) + within].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[within]
    shift = np.uint64(64 - BITS)
    whole = (mix(np.add.reduceat(weighed, base)) >> shift).astype(np.int32)
    stem = (mix(np.add.reduceat(np.where(within < STEM, weighed, np.uint64(0)), base) + np.uint64(7)) >> shift).astype(np.int32)
    sentence = np.cumsum(ENDS[raw])[starts].astype(np.int32)
    longer = lens > STEM
    return np.concatenate([whole, stem[longer]]), np.concatenate([sentence, sentence[longer]]), body


def distinct(bucket: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once per sentence, however often the word is repeated there."""
    both = np.unique((sentence.astype(np.int64) << BITS) | bucket)
    return (both & ((1 << BITS) - 1)).astype(np.int32), (both >> BITS).astype(np.int32)


def first_sentences(bucket: np.ndarray, sentence: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of the first whole sentences with ``most`` together; of a longer one, its first words."""
    if len(bucket) <= most:
        return bucket, sentence
    fits = int(np.searchsorted(np.cumsum(np.bincount(sentence)), most, "right"))
    keep = np.flatnonzero(sentence < fits)
    keep = keep if len(keep) else np.argsort(sentence, kind="stable")[:most]
    return bucket[keep], sentence[keep]


def lowered(n, usual: int):
    """What the log-odds of each of ``n`` sentences lose."""
    return np.log(np.maximum(n, usual) / usual)


class Model:
    """``weights`` by bucket and ``bias``; both bounded by BITS."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Numbers of the sentences with words, their log-odds, and the bytes scored."""
        bucket, sentence, body = features(text)
        if not len(bucket):
            return np.zeros(1, np.int32), np.array([self.bias]), body
        bucket, sentence = distinct(bucket, sentence)
        sums = np.bincount(sentence, self.weights[bucket])
        have = np.unique(sentence)
        return have, self.bias - lowered(len(have), LONG) + sums[have], body

    def score(self, text: str) -> float:
        odds = self.sentences(text)[1]
        return float(-np.expm1(-np.maximum(0, np.logaddexp(0, odds) - np.logaddexp(0, self.bias - lowered(len(odds), LONG))).sum()))

    def offending(self, text: str, threshold: float) -> list[dict]:
        """Spans (in code points) of the sentences at or above ``threshold``, with their scores."""
        numbers, odds, body = self.sentences(text)
        raw = np.frombuffer(body, np.uint8)
        stops = np.concatenate([[-1], np.flatnonzero(ENDS[raw]), [len(raw) - 1]])
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        out = []
        for k, z in zip(numbers.tolist(), odds.tolist()):
            p = 1 / (1 + np.exp(-z))
            if p >= threshold:
                out.append({"start": int(points[stops[k] + 1]), "end": int(points[stops[k + 1] + 1]), "score": float(p)})
        return out


def train_from(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, odds: float, steps: int = 120) -> Model:
    """Fit by gradient steps with a step size per weight. ``odds``: of label 1 in the whole table.

    Only buckets in several positive documents get a weight; rare words would memorise documents.
    """
    size = 1 << BITS
    if not len(docs) or labels.min() == labels.max():
        return Model(np.zeros(size), -6.0)
    seen = np.zeros(size, np.int32)
    for (bucket, _), y in zip(docs, labels):
        if y:
            seen[np.unique(bucket)] += 1
    used = np.flatnonzero(seen >= max(3, 0.003 * labels.sum()))
    column = np.full(size, -1, np.int32)
    column[used] = np.arange(len(used))
    col, sent, owner, n = [], [], [], 0
    for d, (bucket, sentence) in enumerate(docs):
        bucket, sentence = distinct(bucket, sentence)
        numbers, sentence = np.unique(sentence, return_inverse=True)
        count = max(1, len(numbers))
        keep = column[bucket] >= 0
        col.append(column[bucket[keep]])
        sent.append((sentence[keep] + n).astype(np.int32))
        owner.append(np.full(count, d, np.int32))
        n += count
    col, sent, owner = np.concatenate(col), np.concatenate(sent), np.concatenate(owner)
    less = lowered(np.bincount(owner, minlength=len(labels)), USUAL)[owner]
    positives = labels.sum()
    weight = np.where(labels == 1, 1.0, positives / odds / (len(labels) - positives))
    weight /= weight.sum()
    w, b = np.zeros(len(used) + 1), -4.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = b
    for step in range(1, steps + 1):
        z = w[-1] - less + np.bincount(sent, w[col], n)
        total = np.bincount(owner, np.logaddexp(0, z), len(labels))
        by_doc = np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-9, 500.0)), 1.0) * weight
        dz = by_doc[owner] / (1 + np.exp(-z))
        g = np.append(np.bincount(col, dz[sent], len(used)), dz.sum())
        g[:-1] += 2e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(size)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """Fit on a bounded sample of the labelled rows given.

    Of each class at most ``sample_docs`` documents (in the order of a hash of their id) holding at
    most ``sample_words`` words together reach the driver, as hashed words; their weights restore
    the classes' shares in all labels. Of a document with more than 1 / LARGE of the words the first
    whole sentences up to that share are used, so none takes the place of all others; toxic ones cut so
    come last, as their toxic sentence may be missing. A document labelled more than once counts as toxic if any
    row says so; null labels and labels without a document don't count. Without labels of both
    classes the model scores everything low.
    """
    marked = (
        labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
        .agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    )
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(np.zeros(1 << BITS), -6.0)
    drawn = None
    for y in (0, 1):
        part = marked.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_docs)
        drawn = part if drawn is None else drawn.union(part)

    most = max(1, sample_words // LARGE)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            whole = [features(t)[:2] for t in f["text"]]
            got = [first_sentences(*x, most) for x in whole]
            yield pd.DataFrame({
                "doc_id": f["doc_id"], "label": f["label"], "n": [len(a) for a, _ in got],
                "cut": [len(a) < len(x) for (a, _), (x, _) in zip(got, whole)],
                "bucket": [a.tobytes() for a, _ in got], "sentence": [s.tobytes() for _, s in got],
            })

    # two bounded lists of ids: their size is sample_docs rows a class, whatever the table's
    picked = text_of(documents, id_col, text_col).join(F.broadcast(drawn), "doc_id")
    rows = picked.mapInPandas(extract, "doc_id long, label int, n long, cut boolean, bucket binary, sentence binary")
    order = Window.partitionBy("label").orderBy(F.expr("cut and label = 1"), F.xxhash64("doc_id", F.lit(11)), "doc_id", "n", "bucket")
    rows = rows.withColumn("words", F.sum("n").over(order)).where(F.col("words") <= sample_words)
    got = sorted(rows.select("doc_id", "bucket", "sentence", "label").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["bucket"]))
    docs = [(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["sentence"], np.int32)) for r in got]
    model = train_from(docs, np.array([r["label"] for r in got], np.int64), counts[1] / counts[0])
    del got, docs
    tidy()  # the driver has other stages to run
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """``(doc_id, score, predicted, offending)`` per row, from the text alone.

    A text without words counts as one sentence without words. ``offending``: sentences whose own
    score reaches ``threshold`` (none if the document's does not), with code point spans.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = [model.score(t) for t in f["text"]]
            yield pd.DataFrame({
                "doc_id": f["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores],
                "offending": [model.offending(t, threshold) if s >= threshold else [] for t, s in zip(f["text"], scores)],
            })

    return text_of(documents, id_col, text_col).mapInPandas(
        run, "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    )


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.fillna("").map(model.score)
        tidy()

    return documents.where(toxicity(F.col(f"`{text_col}`")) < threshold)


def train_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0
