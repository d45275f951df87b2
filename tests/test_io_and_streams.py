"""Sources, sinks, and streams fed in several micro-batches against their batch forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalogue, segments
from corpusloom.sources import media, tables, tail
from corpusloom.streaming import jobs, tokens


def touch(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_media_scan_and_plan(spark, tmp_path):
    for name in ("a.wav", "b.MP3", "sub/c.mp4", "sub/d.txt", "sub/e.aac"):
        touch(tmp_path / name)
    root = f"file:{tmp_path}"
    found = media.scan_media(spark, root, "convert")
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.wav", "b.MP3", "c.mp4"]
    assert media.scan_media(spark, root, "vad", recursive=False).count() == 2
    exact = media.scan_media(spark, root, "resample").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in exact) == ["a.wav", "e.aac"]
    plan = media.plan_outputs(found, root, "/out")
    assert sorted(r.target for r in plan.collect()) == ["/out/a.wav", "/out/b.wav", "/out/sub/c.wav"]
    done = spark.createDataFrame([("/out/a.wav",)], "path string")
    assert media.pending_only(plan, done).count() == 2
    assert media.pending_only(plan, done, overwrite=True).count() == 3
    assert media.output_progress(plan, done).first().percent == 33
    assert media.default_output_dir("/data/in/", "_wav") == "/data/in_wav"


def test_shards_and_lists(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/one")
    spark.range(5, 8).write.parquet(f"{tmp_path}/two")
    touch(tmp_path / "bad.parquet", "not parquet at all")
    listing = tmp_path / "list.txt"
    touch(listing, f"{tmp_path}/one\n{tmp_path}/bad.parquet\n\n{tmp_path}/two\n")
    rows = tables.read_shards(spark, str(listing), spark.range(1).schema)
    assert sorted(r.id for r in rows.collect()) == list(range(8))
    touch(tmp_path / "files.txt", "a.wav|3|hello\nb.wav|4|bye\n")
    got = tables.read_filelist(spark, str(tmp_path / "files.txt"), n_spks=9).orderBy("path").collect()
    assert [(r.path, r.spk, r.text) for r in got] == [("a.wav", 3, "hello"), ("b.wav", 4, "bye")]


def test_write_and_export(spark, tmp_path):
    df = spark.range(2500).repartition(1)
    assert tables.write_dataset(df, f"{tmp_path}/ds", 1000)
    assert len(list((tmp_path / "ds").glob("part-*"))) == 3
    assert not tables.write_dataset(df.limit(0), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        tables.export_table(df, f"{tmp_path}/x", "XML")


def test_json_maps_and_sidecars(spark):
    files = spark.createDataFrame([(0, '{"a": "1", "b": "2"}'), (1, '{"b": "3"}')], "n int, body string")
    got = {r.key: r.value for r in tables.merge_json_maps(files, "body", "n").collect()}
    assert got == {"a": "1", "b": "3"}
    paths = ["/s/w/a.wav", "/s/w/a.txt", "/s/w/c/b.wav", "/s/w/c/b.txt", "/s/x.wav", "/s/x.txt", "/s/w/z.wav"]
    inv = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.name for r in media.pair_sidecars(inv, "/s").collect()) == ["w/a", "w/c/b"]


TOKENS = "request_id string, seq int, tokens array<int>, is_end boolean, at timestamp"


def token_rows(spark, folder, batches):
    """A file per micro-batch of ``(request, seq, tokens, is_end, minute)``."""
    start = datetime(2024, 1, 1)
    for rows in batches:
        rows = [(r, seq, t, end, start + timedelta(minutes=m)) for r, seq, t, end, m in rows]
        spark.createDataFrame(rows, TOKENS).coalesce(1).write.mode("append").parquet(folder)
    return jobs.stream_table(spark, folder, spark.read.parquet(folder).schema, files=1)


def test_token_stream_in_batches(spark, tmp_path):
    lengths = {"r1": 131, "r2": 28, "r3": 3, "r4": 0}
    batches = []
    for part in range(4):  # tokens of a request arrive over several files, in order, some of them empty
        rows = []
        for r, n in lengths.items():
            cut = [n * k // 8 for k in (2 * part, 2 * part + 1, 2 * part + 2)]
            rows += [(r, 2 * part + k, list(range(cut[k], cut[k + 1])), part == 3 and k == 1, part) for k in (1, 0)]
        batches.append(rows)
    with jobs.rocksdb_state(spark):
        out = jobs.run_available(tokens.chunk_token_stream(token_rows(spark, str(tmp_path / "in"), batches), 25, 3)).collect()
    arrays = spark.createDataFrame([(r, list(range(n))) for r, n in lengths.items()], "r string, t array<int>")
    want = {(x.r, x.chunk_no, x.offset, x.end, x.final) for x in segments.stream_hops(arrays, "t", 25, 3).collect()}
    assert {(x.request_id, x.chunk_no, x.offset, x.end, x.final) for x in out} == want
    assert all(x.tokens == list(range(x.offset, x.end)) and not x.expired for x in out)


def test_silent_requests_expire(spark, tmp_path):
    """A request that falls silent for the limit gives what it has; one that goes on doesn't; after its
    end a request may begin anew."""
    batches = [
        [("silent", 0, [1, 2, 3], False, 0), ("goes on", 0, [1], False, 0), ("twice", 0, [7], True, 0), ("null", 0, None, False, 0)],
        [("goes on", 1, [2], False, 8), ("twice", 0, [8], True, 8)],
        [("goes on", 2, [3], False, 16), ("other", 0, [5] * 9, True, 16)],
        [("goes on", 3, [4], True, 17)],
    ]
    with jobs.rocksdb_state(spark):
        stream = tokens.chunk_token_stream(token_rows(spark, str(tmp_path / "in"), batches), 4, 1, limit="10 minutes")
        out = jobs.run_available(stream).collect()
    got = {(x.request_id, x.chunk_no, x.offset, x.final, x.expired, tuple(x.tokens)) for x in out}
    assert got == {
        ("silent", 0, 0, True, True, (1, 2, 3)), ("null", 0, 0, True, True, ()), ("goes on", 0, 0, True, False, (1, 2, 3, 4)),
        ("twice", 0, 0, True, False, (7,)), ("twice", 0, 0, True, False, (8,)),
        ("other", 0, 0, False, False, (5,) * 5), ("other", 1, 4, False, False, (5,) * 5), ("other", 2, 8, True, False, (5,)),
    }


def test_state_of_many_requests_stays_small(spark, tmp_path):
    """Ended and expired requests leave no state behind."""
    batches = [[(f"r{k}", 0, list(range(40)), k % 2 == 0, 0) for k in range(400)], [("last", 0, [1], True, 60)]]
    stream = tokens.chunk_token_stream(token_rows(spark, str(tmp_path / "in"), batches), 25, 3)
    with jobs.rocksdb_state(spark):
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) >= 200 and held[-1] == 0


def test_tail_of_growing_logs(spark, tmp_path):
    """Appended lines come once, a cut last line waits, a restart from the checkpoint loses none."""
    logs, out, at = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    want = []

    def grow(name, text, lines):
        logs.mkdir(exist_ok=True)
        with open(logs / name, "ab") as f:
            f.write(text)
        want.extend(lines)

    def run():
        found = jobs.run_available(tail.tail_logs(spark, str(logs)), checkpoint=at, out=out)
        return sorted(r.line for r in found.collect())

    grow("a.log", "one\ntwö\r\n\nthr".encode(), ["one", "twö", ""])
    grow("_hidden", b"no\n", [])
    assert run() == sorted(want)
    assert run() == sorted(want)
    grow("a.log", b"ee\n\xff\n", ["three", "\ufffd"])
    grow("sub.log", b"cut", [])
    assert run() == sorted(want)
    grow("sub.log", b"\n", ["cut"])
    assert run() == sorted(want)
    with open(logs / "a.log", "wb") as f:
        f.write(b"x\n")
    with pytest.raises(Exception, match="shorter than what was read"):
        run()


def test_ranges_of_a_log_meet_at_lines(tmp_path, monkeypatch):
    """Whatever the size of ranges and blocks, every line comes from one range."""
    rng = random.Random(4)
    lines = [bytes(rng.choice(b"ab\xc3\xa9 ") for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(60)]
    path = str(tmp_path / "x.log")
    with open(path, "wb") as f:
        f.write(b"\n".join(lines) + b"\nrest")
    places = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    for size, block in ((1, 1), (3, 2), (7, 64), (50, 5), (10_000, 3), (10_000, 10_000)):
        monkeypatch.setattr(tail, "RANGE", size)
        monkeypatch.setattr(tail, "BLOCK", block)
        reader = tail.TailReader(path)
        found = []
        for part in reader.partitions({}, reader.latestOffset()):
            with open(path, "rb") as source:
                found += [row for rows in tail.lines_of(source, part) for row in rows]
        assert found == list(zip(places, lines))


def test_pool_in_batches(spark, tmp_path):
    for part in range(3):
        rows = [("s", part * 10 + i, part * 10 + i) for i in range(10)]
        spark.createDataFrame(rows, "shard string, seq bigint, token int").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = jobs.stream_table(spark, str(tmp_path / "in"), schema, files=1)
    out = jobs.run_updates(tokens.recent_pool(stream, 4), ["shard"]).collect()
    assert [(r.shard, r.newest, r.pool) for r in out] == [("s", 29, [26, 27, 28, 29])]


def test_pool_takes_few_rows_of_a_shard(spark):
    """However many rows a shard has, its state gets the newest of each share only."""
    rows = spark.range(20_000).select(F.expr("if(id % 3 = 0, 'hot', null)").alias("shard"), F.xxhash64("id").alias("seq"), F.col("id").cast("int").alias("token"))
    found = tokens.newest(rows, 5, 4).collect()
    for shard in ("hot", None):
        all_ = sorted(r.seq for r in rows.collect() if r.shard == shard)
        kept = sorted(r.seq for r in found if r.shard == shard)
        assert len(kept) <= 5 * 4 and kept[-5:] == all_[-5:]


def test_replay_waits_for_no_one(spark):
    """Times far apart, after 2200 and null, a table without rows: every request comes out once."""
    times = ["1999-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:30", "2300-01-01 00:00:00", None]
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(times)], "id bigint, x string").selectExpr("id", "cast(x as timestamp) as asked_at")
    answers = spark.createDataFrame([(1, 2.0, "2024-01-01 00:00:59"), (3, 3.0, "2300-01-01 00:02:00")], "id bigint, duration double, x string")
    answers = answers.selectExpr("id", "duration", "cast(x as timestamp) as answered_at")
    match = lambda q, a: jobs.match_with_timeout(q, a, late="10 seconds")
    got = jobs.replay([(asked, "asked_at"), (answers, "answered_at")], match, 3).collect()
    assert sorted((r.id, r.code) for r in got if r.id != 4) == [(0, 408), (1, 200), (2, 408), (3, 408)]
    got = jobs.replay([(asked.where("id = 0"), "asked_at"), (answers.limit(0), "answered_at")], match, 2).collect()
    assert [(r.id, r.code) for r in got] == [(0, 408)]


def test_replay_is_one_run_of_bounded_parts(spark, monkeypatch):
    """Parts grow in number with the rows; one run reads them in order of time, each part a file, empty ones too."""
    asked = spark.range(400).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7 % 400) * 20).alias("asked_at"))
    later = F.when(F.col("id") % 4 == 0, 30).otherwise(90)
    answers = asked.filter("id % 2 = 0 and id > 390 or id % 10 = 0").select("id", F.lit(1.0).alias("duration"), F.timestamp_seconds(F.unix_seconds("asked_at") + later).alias("answered_at"))
    runs, run_available = [], jobs.run_available

    def watched(stream, **options):
        out = run_available(stream, **options)
        runs.append(options["checkpoint"].rsplit("/", 1)[0])
        return out

    monkeypatch.setattr(jobs, "run_available", watched)
    match = lambda q, a: jobs.match_with_timeout(q, a, late="10 seconds")
    got = jobs.replay([(asked, "asked_at"), (answers, "answered_at")], match, 2, rows=40)
    assert sorted((r.id, r.code) for r in got.collect()) == sorted((r.id, r.code) for r in match(asked, answers).collect())
    (base,) = runs
    root = Path(base.removeprefix("file://").removeprefix("file:"))
    for i, (df, total) in enumerate([(asked, 400), (answers, answers.count())]):
        files = sorted((root / f"in{i}").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        parts = [spark.read.parquet(str(f)).agg(F.count("*"), F.min(df.columns[-1]), F.max(df.columns[-1])).first() for f in files]
        assert len(parts) == -(-(400 + answers.count()) // 40) + 1 and parts[-1][0] == 1
        assert sum(p[0] for p in parts) == total + 1 and max(p[0] for p in parts) <= 80
        spans = [(p[1], p[2]) for p in parts if p[0]]
        assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_requests_time_out(spark, tmp_path):
    base = "timestamp'2024-01-01 00:00:00'"
    asked = spark.range(40).select(
        "id", F.expr(f"{base} + make_dt_interval(0, 0, cast(id as int) * 5)").alias("asked_at")
    )
    answers = spark.range(40).filter("id % 2 = 0").select(
        "id",
        F.lit(1.5).alias("duration"),
        F.expr(f"{base} + make_dt_interval(0, 0, cast(id as int) * 5, if(id % 4 = 0, 30, 90))").alias("answered_at"),
    )
    asked.coalesce(1).write.parquet(str(tmp_path / "q"))
    answers.coalesce(1).write.parquet(str(tmp_path / "a"))
    live = jobs.match_with_timeout(
        jobs.stream_table(spark, str(tmp_path / "q"), asked.schema),
        jobs.stream_table(spark, str(tmp_path / "a"), answers.schema),
        late="10 seconds",
    )
    got = {r.id: r.code for r in jobs.run_available(live).collect()}
    batch = {r.id: r.code for r in jobs.match_with_timeout(asked, answers, late="10 seconds").collect()}
    assert batch == {i: 200 if i % 4 == 0 else 408 for i in range(40)}
    assert {i for i, c in got.items() if c == 200} == {i for i in range(40) if i % 4 == 0}
    assert all(batch[i] == c for i, c in got.items()) and 1 in got


STREAMED = ["tail_metrics", "live_progress", "live_job_status", "match_with_timeout", "chunk_token_stream", "recent_pool"]


@pytest.fixture(scope="module")
def interleaved(spark, tmp_path_factory):
    """The tables as folders of four files whose rows interleave."""
    folder = tmp_path_factory.mktemp("interleaved")
    for name, key in (("events", "event_id"), ("documents", "doc_id")):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows.repartition(4, F.col(key) % 4).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", STREAMED)
def test_streams_read_whole_folders(spark, interleaved, name):
    import __spark_entry__ as entry

    run = entry.queries()[name]
    whole = sorted(map(repr, run(spark, "/root/testdata/sf0.001").collect()))
    assert sorted(map(repr, run(spark, interleaved).collect())) == whole and whole


def test_late_rows_are_told(spark, tmp_path):
    base = "timestamp'2024-01-01 00:00:00'"
    for part in range(4):  # one file per micro-batch, the third far behind
        shift = 10_000 if part < 2 else 0
        rows = spark.range(part * 10, part * 10 + 10).select("id", F.expr(f"{base} + make_dt_interval(0, 0, 0, id + {shift})").alias("asked_at"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
    answers = spark.range(1).select("id", F.lit(1.5).alias("duration"), F.expr(base).alias("answered_at"))
    answers.coalesce(1).write.parquet(str(tmp_path / "a"))
    schema = spark.read.parquet(str(tmp_path / "q")).schema
    ends = jobs.stream_table(spark, str(tmp_path / "a"), answers.schema, None)
    spark.range(1).select((-F.col("id") - 5).alias("id"), F.lit(None).cast("double").alias("duration"), F.expr(f"{base} + interval 1 year").alias("answered_at")).write.mode("append").parquet(str(tmp_path / "a"))
    live = jobs.match_with_timeout(jobs.stream_table(spark, str(tmp_path / "q"), schema, 1), ends, late="10 seconds")
    with pytest.raises(ValueError, match="later than the watermark"):
        jobs.run_available(live)


def test_unreadable_files_are_told(spark, tmp_path):
    """Footers of good, broken, empty and missing shards; a file whose pages are broken shows as a shortfall."""
    good = spark.range(10).select("id", F.lit("a b%").alias("odd name"))
    good.repartition(2).write.parquet(f"{tmp_path}/good one")
    spark.range(5).select("id", F.lit(1).alias("more")).coalesce(1).write.parquet(f"{tmp_path}/other")
    touch(tmp_path / "bad" / "part-0.parquet", "not parquet at all")
    touch(tmp_path / "bad" / "_hidden", "passed over")
    (tmp_path / "empty").mkdir()
    paths = [f"{tmp_path}/{n}" for n in ("good one", "bad", "empty", "nowhere")] + [f"file:{tmp_path}/other"]
    rows, report = tables.read_reported(spark, paths)
    told = {}
    for r in report.collect():
        told.setdefault(r.path.rsplit("/", 1)[1], []).append((r.rows, r.error is None))
    assert sum(n for n, fine in told.pop("good one") if fine) == 10
    assert told == {"bad": [(None, False)], "empty": [(None, False)], "nowhere": [(None, False)], "other": [(5, True)]}
    assert rows.count() == 15 and set(rows.columns) == {"id", "odd name", "more", "src"}
    short = {r.file.rsplit("/", 1)[1]: r.rows_read for r in tables.shortfall(rows, report).collect()}
    assert short == {"part-0.parquet": 0, "empty": 0, "nowhere": 0}
    part = next((tmp_path / "other").glob("part-*.parquet"))
    body = bytearray(part.read_bytes())
    body[4:40] = b"\0" * 36
    part.write_bytes(body)
    next((tmp_path / "other").glob(".part-*.crc")).unlink()
    rows, report = tables.read_reported(spark, paths)
    assert (part.name, 5, 0) in {(r.file.rsplit("/", 1)[1], r.rows, r.rows_read) for r in tables.shortfall(rows, report).collect()}
    with pytest.raises(ValueError, match="no shard"):
        tables.read_reported(spark, [f"{tmp_path}/bad"])


def test_stored_datasets_are_flattened(spark, tmp_path):
    ids = spark.range(12)
    ids.where("id < 8").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/split/train")
    ids.where("id >= 8").withColumn("text", F.lit("y")).write.parquet(f"{tmp_path}/split/test")
    ids.selectExpr("id + 100 as id", "'z' as text", "id % 2 as k", "1 as extra").write.partitionBy("k").parquet(f"{tmp_path}/parted")
    ids.write.parquet(f"{tmp_path}/half")
    touch(tmp_path / "half" / "part-broken.parquet", "no")
    merged, report = catalogue.merge_stored(spark, [f"{tmp_path}/{n}" for n in ("split/", "parted", "half", "nowhere")])
    assert merged.columns == ["id", "text"]
    assert sorted(map(tuple, merged.collect())) == sorted([(i, "x" if i < 8 else "y") for i in range(12)] + [(100 + i, "z") for i in range(12)])
    told = {r.folder.rsplit("/", 1)[1]: (r.splits, r.rows, r.error is None) for r in report.collect()}
    assert told == {"split": (2, 12, True), "parted": (1, 12, True), "half": (1, 12, False), "nowhere": (1, 0, False)}
    with pytest.raises(ValueError, match="no dataset"):
        catalogue.merge_stored(spark, [f"{tmp_path}/half"])


def test_audio_comes_in_blocks(spark):
    rows = [("r", 0, [1.0] * 7, 3), ("r", 10, [], 5), ("r", 15, [2.0] * 4, 0), ("s", 0, [3.0], 0), ("none", 0, [], 0)]
    placed = spark.createDataFrame(rows, "request string, first_sample bigint, samples array<double>, pause bigint")
    whole = [1.0] * 7 + [0.0] * 8 + [2.0] * 4
    for block in (1, 4, 6, 100):
        got = segments.audio_blocks(placed, "request", block).orderBy("request", "block_no").collect()
        want = [("r", b, whole[b * block : (b + 1) * block]) for b in range(-(-len(whole) // block))] + [("s", 0, [3.0])]
        assert [tuple(r) for r in got] == want


def test_token_rows_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task writes or reads all tokens of a micro-batch, and long texts are cut once."""
    from queries import Tables, streams

    docs = [(i, "a bb ccc " * (50 * i)) for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    files, plain = [], jobs.stream_table
    monkeypatch.setattr(jobs, "stream_table", lambda s, path, *more: (files.append(len(spark.read.parquet(path).inputFiles())), plain(s, path, *more))[1])
    out = streams.chunk_token_stream(Tables(spark, str(tmp_path)))
    got = {(r.request_id, r.chunk_no): r.tokens for r in out.collect()}
    assert files[-1] > streams.BATCHES
    for i, text in docs:
        want, n = [len(w) for w in text.split(" ")], len([k for k in got if k[0] == str(i)])
        for k in range(n):
            assert got[str(i), k] == ",".join(map(str, want[25 * k : 25 * k + 28] if k < n - 1 else want[25 * k :]))
