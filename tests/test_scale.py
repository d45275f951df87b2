"""Chunked operators against brute force, with chunks of a few rows and one hot key."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import annotations, batching, ordered, quality, runs, segments, stats
from corpusloom.operators.greedy import PaddedBudget, greedy_groups


def shuffled_rows(seed: int, n: int = 400):
    """(key, order, value) with a third and more of the rows under one key, gaps in the order."""
    rng = random.Random(seed)
    orders = rng.sample(range(5000), n)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", o, rng.randrange(1, 40)) for o in orders]


def by_key(rows):
    out = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((o, v))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = shuffled_rows(1)
    return rows, spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5).cache()


def test_ordinal_and_total(table):
    rows, df = table
    got = ordered.with_ordinal(df, "k", "o", total="n", span=64).collect()
    want = {(k, o): (i + 1, len(g)) for k, g in by_key(rows).items() for i, (o, _) in enumerate(g)}
    assert {(r.k, r.o): (r.rn, r.n) for r in got} == want


def test_running_sum(table):
    rows, df = table
    got = ordered.with_ordered(df, "k", "o", before={"v": "before"}, span=50).collect()
    want = {}
    for k, g in by_key(rows).items():
        s = 0
        for o, v in g:
            want[(k, o)] = s
            s += v
    assert {(r.k, r.o): r.before for r in got} == want


def test_previous_value_skips_nulls(table):
    rows, df = table
    sparse = df.withColumn("v", F.when(F.col("v") % 5 == 0, F.col("v")))
    got = ordered.with_ordered(sparse, "k", "o", previous={"v": "p"}, span=40).collect()
    want = {}
    for k, g in by_key(rows).items():
        last = None
        for o, v in g:
            want[(k, o)] = last
            last = v if v % 5 == 0 else last
    assert {(r.k, r.o): r.p for r in got} == want


def batches(lengths, budget):
    out, count, longest, number = [], 0, 0, 0
    for n in lengths:
        longest = max(longest, n)
        if count and longest * (count + 1) > budget:
            number, count, longest = number + 1, 0, n
        count += 1
        out.append(number)
    return out


@pytest.mark.parametrize("span,fan", [(16, 3), (7, 2), (64, 4), (1000, 8), (3, 5)])
def test_dynamic_batch_over_chunks(table, span, fan):
    rows, df = table
    got = greedy_groups(df, ["k"], "o", ["v"], PaddedBudget(200), "b", span, fan).collect()
    want = {}
    for k, g in by_key(rows).items():
        want.update({(k, o): b for (o, _), b in zip(g, batches([v for _, v in g], 200))})
    assert {(r.k, r.o): r.b for r in got} == want


@pytest.mark.parametrize("budget", [5, 39, 100000])
def test_dynamic_batch_extremes(table, budget):
    """Rows over the budget, and one batch longer than many chunks."""
    rows, df = table
    got = batching.dynamic_batch(df, "k", "o", "v", budget, span=10).collect()
    want = {}
    for k, g in by_key(rows).items():
        want.update({(k, o): b for (o, _), b in zip(g, batches([v for _, v in g], budget))})
    assert {(r.k, r.o): r.batch_no for r in got} == want


def merged(segs, short, limit):
    out, cur = [], list(segs[0])
    for s, e in segs[1:]:
        if e - s < short and (cur[1] - cur[0]) + (e - s) < limit:
            cur[1] = e
        else:
            out.append(tuple(cur))
            cur = [s, e]
    if cur[1] - cur[0] < short and out:
        out[-1] = (out[-1][0], cur[1])
    else:
        out.append(tuple(cur))
    return out


def test_merge_unordered_segments_alike_for_every_span(spark):
    rng = random.Random(8)
    rows = [("f", i, (x := rng.randrange(9000)), x + rng.randrange(1, 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "file string, i long, start long, end long")
    got = {
        span: sorted(map(tuple, segments.merge_short_segments(df, "file", "i", 0.6, 2, rate=10, span=span).collect()))
        for span in (16, 100, 1 << 18)
    }
    assert got[16] == got[100] == got[1 << 18]
    ordered_rows = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    again = spark.createDataFrame([(f, k, s, e) for k, (f, _, s, e) in enumerate(ordered_rows)], df.schema)
    same = segments.merge_short_segments(again, "file", "i", 0.6, 2, rate=10).collect()
    assert sorted(map(tuple, same)) == got[16]


@pytest.mark.parametrize("span", [4, 11, 4096])
def test_merge_segments_over_chunks(spark, span):
    rng = random.Random(7)
    rows, at = [], 0
    for i in range(500):
        length = rng.choice([2, 3, 5, 8, 30])
        rows.append(("hot" if i % 3 else f"f{i % 7}", i, at, at + length))
        at += length + rng.randrange(4)
    df = spark.createDataFrame(rows, "file string, i bigint, start bigint, end bigint")
    got = segments.merge_short_segments(df, "file", "i", 0.6, 2, rate=10, span=span).collect()
    want = {}
    for f in {r[0] for r in rows}:
        segs = [(s, e) for g, _, s, e in rows if g == f]
        want.update({(f, n): x for n, x in enumerate(merged(segs, 6, 30))})
    # group numbers may skip the one a short tail left
    have = {}
    for f in {r.file for r in got}:
        mine = sorted((r.seg_no, r.start, r.end) for r in got if r.file == f)
        have.update({(f, n): (s, e) for n, (_, s, e) in enumerate(mine)})
    assert have == want


def test_repetition_over_blocks(table):
    rows, df = table
    small = df.withColumn("token", F.col("v") % 4)
    got = stats.repetition_flag(small, "k", "o", window=5, share=0.4, block=16, span=64).collect()
    want = {}
    for k, g in by_key(rows).items():
        seq = [v % 4 for _, v in g]
        for i, (o, _) in enumerate(g):
            want[(k, o)] = sum(t == seq[i] for t in seq[max(0, i - 5) : i])
    assert {(r.k, r.o): r.repeats for r in got} == want


def impute(rows, batch_of, pool):
    """Brute force: {order: (value, source)} for one shard."""
    out, history = {}, []
    groups = {}
    for o, v in rows:
        groups.setdefault(batch_of[o], []).append((o, v))
    for b in sorted(groups):
        items, before = groups[b], list(history)
        good = [v for _, v in items if v is not None]
        last = None
        for o, v in items:
            if v is not None:
                out[o], last = (v, "own"), v
                history.append(v)
            elif good:
                out[o] = (last if last is not None else good[-1], "batch")
            else:
                out[o] = ((before[-pool:], "pool") if before else (0, "placeholder"))
    return out


def test_impute_pool_over_chunks(table):
    rows, df = table
    numbered = batching.static_batch(df, "k", "o", 4, span=64)
    bad = (F.col("v") % 3 != 0) | ((F.col("batch_no") % 4) == 0)
    tokens = numbered.withColumn("speech_token", F.when(~bad, F.array("v")))
    got = quality.impute_failed_tokens(
        tokens.drop("v"), "k", "o", "batch_no", pool=5, span=32
    ).collect()
    assert len(got) == len(rows)
    batch = {(r.k, r.o): r.batch_no for r in got}
    have = {(r.k, r.o): (r.speech_token[0], r.source) for r in got}
    for k, g in by_key(rows).items():
        masked = [(o, v if v % 3 == 0 and batch[(k, o)] % 4 else None) for o, v in g]
        for o, (v, source) in impute(masked, {o: batch[(k, o)] for o, _ in g}, 5).items():
            value, said = have[(k, o)]
            assert said == source
            assert value in v if source == "pool" else value == v
    for k, b in {(r.k, r.batch_no) for r in got if r.source == "pool"}:
        assert len({r.speech_token[0] for r in got if (r.k, r.batch_no) == (k, b)}) == 1


def test_fill_forward_over_chunks(spark):
    lines = []
    for i in range(300):
        run = "hot" if i % 3 else "cold"
        kind = (i * 7) % 5
        text = {
            0: f"{{'loss': {i}.5, 'grad_norm': {i}}}",
            1: f"{{'loss': {i}.5}}",
            2: f"{{'loss': {i}.5, 'grad_norm': {i}, broken",
            3: f"{{'loss': {i}.5, broken",
            4: "hello",
        }[kind]
        lines.append((run, i, text, kind))
    df = spark.createDataFrame(lines, "run string, n bigint, line string, kind int")
    parsed = runs.parse_metric_line(df.drop("kind"))
    got = runs.fill_metrics(parsed, "run", "n", span=16).collect()
    want = {}
    for run in ("hot", "cold"):
        last, step = 0.0, 0
        for r, i, _, kind in lines:
            if r != run or kind == 4:
                continue
            step += 1
            last = float(i) if kind in (0, 2) else (0.0 if kind == 1 else last)
            want[(run, i)] = (step, last)
    assert {(r.run, r.n): (r.step, r.grad_norm) for r in got} == want


def test_null_key_is_a_key(table):
    rows, df = table
    holed = df.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    got = ordered.with_ordinal(holed, "k", "o", total="n", span=64).collect()
    renamed = [(None if k == "hot" else k, o, v) for k, o, v in rows]
    groups = {}
    for k, o, _ in sorted(renamed, key=lambda r: r[1]):
        groups.setdefault(k, []).append(o)
    want = {(k, o): (i + 1, len(g)) for k, g in groups.items() for i, o in enumerate(g)}
    assert {(r.k, r.o): (r.rn, r.n) for r in got} == want


def test_shuffles_are_permutations(table):
    rows, df = table
    whole = batching.seeded_shuffle(df, "o").collect()
    assert sorted(r.pos for r in whole) == list(range(len(rows)))
    inside = batching.buffer_shuffle(df, "k", "o", 10, span=64).collect()
    for k, g in by_key(rows).items():
        mine = [r for r in inside if r.k == k]
        assert sorted(r.pos for r in mine) == list(range(len(g)))
        place = {o: i for i, (o, _) in enumerate(g)}
        assert all(place[r.o] // 10 == r.pos // 10 for r in mine)
    ranked = batching.length_bucket_sort(df, "k", "o", "v", 10, span=64).collect()
    for k in by_key(rows):
        mine = sorted((r.pos, r.v) for r in ranked if r.k == k)
        for b in range(0, len(mine), 10):
            part = [v for _, v in mine[b : b + 10]]
            assert part == sorted(part)


def test_slice_and_chunks(table):
    rows, df = table
    ordered_rows = sorted(o for _, o, _ in rows)
    got = sorted(r.o for r in quality.slice_rows(df, "o", 37, 141, span=64).collect())
    assert got == ordered_rows[37:141]
    chunks = batching.even_chunks(df, "o", 7, span=64).collect()
    size = -(-len(rows) // 7)
    assert {r.o: r.chunk for r in chunks} == {o: i // size for i, o in enumerate(ordered_rows)}


@pytest.mark.parametrize("most, how", [(100, "left"), (100, "inner"), (2, "left"), (2, "inner")])
def test_lookup_of_a_hot_key(spark, most, how):
    from corpusloom.operators.lookup import lookup

    rows = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(300, None), (301, "none")]
    wide = spark.createDataFrame(rows, "i long, k string")
    entries = spark.createDataFrame([("hot", 1), *[(f"k{i}", 10 + i) for i in range(7)]], "k string, v long")
    values = {r.k: r.v for r in entries.collect()}
    got = {r.i: r.v for r in lookup(wide, entries, "k", how, most).collect()}
    assert got == {i: values.get(k) for i, k in rows if how == "left" or k in values}


def test_sparse_order_without_a_key(spark):
    """Values spread over 2^60, with nulls and ties in size, are cut into ranges of about the span."""
    rng = random.Random(8)
    values = rng.sample(range(-(1 << 60), 1 << 60), 2000) + list(range(2000)) + [None]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "o bigint")
    got = ordered.with_ordinal(df, [], "o", total="n", span=100).collect()
    place = {v: i for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v or 0)), 1)}
    assert all(r.rn == place[r.o] and r.n == 4001 for r in got) and len(got) == 4001
    sizes = df.groupBy(ordered.range_chunk(df, "o", 100).alias("c")).count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) < 300


def plain_packs(pieces, ends, merge, measure):
    """The packs of a loop; ``ends(open, piece)``: whether the open pack is closed before the piece."""
    done, text = [], ""
    for piece in pieces:
        if ends(text, piece):
            done.append(text)
            text = piece
        else:
            text += piece
    if text and done and measure(text) < merge:
        done[-1] += text
    elif text:
        done.append(text)
    return done


@pytest.mark.parametrize("fold", [0, 1000])
def test_packs_by_fold_and_by_pointers(spark, monkeypatch, fold):
    monkeypatch.setattr(T, "FOLD", fold)
    rng = random.Random(9)
    rows = [(i, ["".join(rng.choice("ab é.") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 1, 2, 5, 40]))]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, p array<string>")
    for c, longest, shortest, merge, measure, size in (
        (T.pack_sentences(F.col("p"), 12, 5, 4), 12, 5, 4, len, None),
        (T.pack_sentences(F.col("p"), 5, 2, 2, T.word_length), 5, 2, 2, lambda s: len(s.split()), None),
        (T.merge_short_text(F.col("p"), 5), None, None, 5, len, 5),
    ):
        for r in df.select("i", c.alias("packs")).collect():
            if size:
                ends = lambda text, piece: len(text) >= size
            else:
                ends = lambda text, piece: measure(text + piece) > longest and measure(text) > shortest
            assert r.packs == plain_packs(rows[r.i][1], ends, merge, measure)
    nothing = spark.createDataFrame([(None,)], "p array<string>").select(T.merge_short_text(F.col("p")))
    assert nothing.first()[0] is None


def test_packs_of_very_many_pieces(spark):
    """100,000 sentences in one text: seconds, not hours."""
    df = spark.createDataFrame([("some sentence here. " * 33_334,)], "t string")
    packs = T.pack_sentences(F.split("t", "(?<= )"), 30, 10, 5)
    began = time.time()
    assert df.select(F.array_join(packs, "") == F.col("t"), F.size(packs)).first()[0]
    assert time.time() - began < 120


def stacked(text):
    """Bracket segments by a stack, token by token."""
    tokens = re.findall("[(（]|[)）]|[^()（）]+", text)
    waiting, paired = [], {}
    for i, token in enumerate(tokens):
        if token in "(（":
            waiting.append(i)
        elif token in ")）" and waiting:
            paired[waiting.pop()] = i
    out, held, since = [], "", None
    for i, token in enumerate([*tokens, ""]):
        if i == len(tokens) or i in paired or i in paired.values() or token in "(（":
            if held:
                out.append((held, i in paired.values() and paired.get(since) == i))
            held = ""
        if i in paired:
            since = i
        elif i in paired.values():
            since = None
        else:
            held += token
    return out


def test_brackets_without_a_stack(spark):
    rng = random.Random(10)
    texts = [None, "", "a", "()", ")(", "((", "((a(b)c)d)e(", "x(y)z（w）", "(" * 50 + "a" + ")" * 60]
    texts += ["".join(rng.choice("()（）abé ") for _ in range(rng.choice([3, 9, 40]))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    parsed = df.select("i", annotations.parse_annotations(F.col("t")).alias("s"))
    assert "Python" not in parsed._jdf.queryExecution().toString()
    for r in parsed.collect():
        assert (None if r.s is None else [tuple(x) for x in r.s]) == (None if texts[r.i] is None else stacked(texts[r.i])), texts[r.i]


@pytest.mark.parametrize("held", [10, 1 << 19])
def test_nucleus_of_a_hot_key(spark, monkeypatch, held):
    """Parts of a key from many tasks, ties, null keys and logits, logits that overflow a power."""
    import math

    monkeypatch.setattr(stats, "HELD", held)
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, float(rng.randrange(4)), 900.0 + rng.randrange(3)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, item int, x double").repartition(7)
    got = {}
    for r in stats.nucleus_candidates(df, "key", "item", "x", 0.8, 25).collect():
        got.setdefault(r.key, []).append((r.rank, r.item, r.prob, r.mass_before))
    for key in {k for k, _, _ in rows}:
        own = sorted(((x, i) for k, i, x in rows if k == key and x is not None), key=lambda r: (-r[0], r[1]))
        norm = math.fsum(math.exp(x - own[0][0]) for x, _ in own)
        before, want = 0.0, []
        for rank, (x, i) in enumerate(own[:25], 1):
            if before >= 0.8:
                break
            prob = math.exp(x - own[0][0]) / norm
            want.append((rank, i, prob, before))
            before += prob
        assert [r[:2] for r in sorted(got[key])] == [w[:2] for w in want]
        assert all(abs(a - b) < 1e-9 for r, w in zip(sorted(got[key]), want) for a, b in zip(r[2:], w[2:]))
