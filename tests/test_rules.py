"""Rules that no table comparison shows: brute force, leakage, conservation, restarts, refusals."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridewave.operators import blocks as B
from ridewave.operators import counts as C
from ridewave.operators import external as X
from ridewave.operators import features as W
from ridewave.operators import graph as G
from ridewave.operators import joins as J
from ridewave.operators import mapping as M
from ridewave.operators import sessions as S
from ridewave.operators import stops as ST
from ridewave.plans import forecast as P
from ridewave.plans import learned as L
from ridewave.operators.profiles import feature_frame, with_calendar
from ridewave.sources import events as E
from ridewave.sources import timetable as T
from ridewave.streaming import jobs

c = F.col


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows, in uneven clusters."""
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", int(rng.choice([rng.gauss(5e4, 900), rng.random() * 2e5])), i)
            for i in range(3000)]
    return spark.createDataFrame(data, "key string, sec bigint, id bigint").cache()


def test_previous_row_equals_plain_window(hot):
    w = Window.partitionBy("key").orderBy("sec", "id")
    want = rows(hot.withColumn("p", F.lag("id").over(w)), "id", F.coalesce("p", F.lit(-1)))
    got = B.previous_row(hot, ["key"], ["sec", "id"], "sec", ["id"], block_seconds=1000)
    assert rows(got, "id", F.coalesce("prev_id", F.lit(-1))) == want


def test_running_sum_and_index_equal_plain_window(hot):
    w = Window.partitionBy("key").orderBy("sec", "id")
    want = rows(hot.withColumn("n", F.row_number().over(w) - 1), "id", "n")
    assert rows(B.row_index(hot, ["key"], ["sec", "id"], "sec", block_seconds=777), "id", "row_index") == want


def test_halo_window_equals_plain_window(hot):
    w = Window.partitionBy("key").orderBy("sec").rangeBetween(-300, 200)
    want = rows(hot.withColumn("n", F.count("*").over(w)), "id", "n")
    wide = B.with_halo(hot, "sec", 1000, 300, 200)
    inner = Window.partitionBy("key", B.BLOCK).orderBy("sec").rangeBetween(-300, 200)
    assert rows(wide.withColumn("n", F.count("*").over(inner)).where("owned"), "id", "n") == want


def test_asof_and_nearest_against_brute_force(spark, hot):
    marks = [("hot", int(x)) for x in np.random.default_rng(1).integers(0, 200000, 200)] + [("k1", 500)]
    right = spark.createDataFrame(marks, "key string, at bigint")
    got = {r["id"]: r["right_second"] for r in B.asof_backward(hot, right, ["key"], "sec", "at", [], block_seconds=900).collect()}
    near = {r["id"]: r["distance"] for r in B.nearest_distance(hot, right, ["key"], "sec", "at", block_seconds=900).collect()}
    for r in hot.collect():
        mine = [a for k, a in marks if k == r["key"]]
        before = [a for a in mine if a <= r["sec"]]
        assert got[r["id"]] == (max(before) if before else None)
        assert near[r["id"]] == (min(abs(a - r["sec"]) for a in mine) if mine else None)


def test_range_join_against_brute_force(spark, hot):
    rng = random.Random(5)
    spans = [("hot", a, a + rng.randrange(1, 5000), i) for i, a in enumerate(rng.randrange(0, 200000) for _ in range(60))]
    iv = spark.createDataFrame(spans, "key string, a bigint, b bigint, iv bigint")
    got = rows(J.range_join(hot, iv, ["key"], "sec", "a", "b", bucket=700), "id", "iv")
    want = sorted((r["id"], i) for r in hot.collect() for k, a, b, i in spans if k == r["key"] and a <= r["sec"] < b)
    assert got == want


def brute_bursts(secs, gap, span):
    out, start, last = [], None, None
    for s in secs:
        if last is None or s - last > gap or s - start > span:
            start = s
        out.append((s, start))
        last = s
    return out


def test_capped_bursts_against_brute_force(spark):
    rng = random.Random(8)
    data = [(k, s) for k in ("a", "b") for s in sorted({rng.randrange(0, 4000) for _ in range(900)})]
    df = spark.createDataFrame(data, "key string, sec bigint").withColumn("n", F.lit(1)).withColumn("successful", F.lit(1))
    got = rows(S.capped_bursts(df, ["key"], 30, 90), "key", "sec", "burst")
    want = sorted((k, s, b) for k in ("a", "b") for s, b in brute_bursts([s for kk, s in data if kk == k], 30, 90))
    assert got == want


def test_bursts_split_only_above_the_gap(spark):
    df = spark.createDataFrame([("a", 0), ("a", 30), ("a", 61)], "key string, sec bigint").withColumn("n", F.lit(1)).withColumn("successful", F.lit(1))
    assert rows(S.gap_bursts(df, ["key"], 30), "sec", "burst") == [(0, 0), (30, 0), (61, 61)]


def test_peaks_against_brute_force(spark):
    rng = random.Random(2)
    data = [("a", s, rng.random() * 5) for s in sorted(rng.sample(range(3000), 700))]
    df = spark.createDataFrame(data, "key string, sec bigint, score double").withColumn("w", F.lit(10))
    kept = []
    for _, s, v in sorted(data, key=lambda r: (-r[2], r[1])):
        if v > 1.0 and all(s + 10 <= j or j + 10 <= s for j in kept):
            kept.append(s)
    assert [r[0] for r in rows(S.peaks(df, ["key"], "score", "w", 1.0), "sec")] == sorted(kept)


def test_onset_matching_is_one_to_one(spark):
    a = spark.createDataFrame([("x", 0), ("x", 10), ("x", 100), ("x", 900)], "key string, sec bigint")
    b = spark.createDataFrame([("x", 5), ("x", 104), ("x", 112), ("x", 500)], "key string, sec bigint")
    assert rows(S.match_onsets(a, b, ["key"], 15), "reference", "detected", "matched") == [(4, 4, 2)]


def test_consensus_needs_votes_from_families(spark):
    d = spark.createDataFrame([("x", 10, "a"), ("x", 12, "b"), ("x", 13, "a"), ("x", 50, "a"), ("x", 51, "a"), ("x", 90, "b"), ("x", 96, "a")],
                              "key string, sec bigint, family string")
    assert rows(S.consensus(d, ["key"], 5, 2), "sec") == [(11.0,)]


def test_corrected_clock_moves_forward_only():
    moved, anchors = M.corrected_clock([0, 100, 200, 300], 10.0, [10.0, 130.0, 131.0, 450.0])
    assert moved == [10.0, 130.0, 230.0, 330.0] and anchors == 2


def test_mapping_conserves_mass(spark):
    spans = spark.createDataFrame([(1, 7, 0, 1000, 0, date(2024, 1, 1)), (2, 7, 900, 2000, 1, date(2024, 1, 1))],
                                  "trip_id bigint, duty bigint, first_clock bigint, last_clock bigint, direction int, service_day date")
    stops = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 500, "b"), (1, 2, 1000, "c"), (2, 0, 900, "d"), (2, 1, 2000, "e")],
                                  "trip_id bigint, seq int, clock bigint, stop_id string")
    nested = T.nest_trips(stops).join(spans.select("trip_id", "direction"), "trip_id")
    ev = spark.createDataFrame([(i, 7 if i % 5 else 8, i * 37 % 2400, "r", date(2024, 1, 1), 0) for i in range(200)],
                               "event_id bigint, duty bigint, sec bigint, route string, date date, hour int")
    out = M.map_events(ev, spans, nested)
    assert out.count() == 200 and out.select("event_id").distinct().count() == 200
    assert {r[0] for r in rows(out, "status")} == {"assigned", "unknown_duty", "no_trip", "ambiguous_trip", "stop_clock_unstable"}
    assert out.where("status <> 'assigned' AND stop_id <> 'unallocated:r'").count() == 0


@pytest.fixture(scope="module")
def labels(spark):
    data = [(r, date(2024, 1, 1 + d), h, (d * 7 + h * (3 if r == "a" else 5)) % 23) for r in ("a", "b") for d in range(28) for h in range(24)]
    return spark.createDataFrame(data, "route string, date date, hour int, boardings bigint").cache()


ORIGIN = date(2024, 1, 22)


def test_later_rows_change_no_feature(spark, labels):
    future = labels.where(c("date") >= F.lit(ORIGIN)).select("route", "date", "hour")
    poisoned = labels.withColumn("boardings", F.when(c("date") >= F.lit(ORIGIN), F.lit(10 ** 15)).otherwise(c("boardings")))
    a, b = (feature_frame(x, future, ORIGIN, scale=0.25) for x in (labels, poisoned))
    assert rows(a) == rows(b)


def test_robust_profile_refuses_future_history(labels):
    future = labels.where(c("date") >= F.lit(ORIGIN)).select("route", "date", "hour")
    feats = feature_frame(labels, future, ORIGIN, scale=0.25)
    with pytest.raises(Exception, match="reaches the forecast origin"):
        P.robust_profile(labels, feats, ORIGIN, "long").collect()


def test_hour_shape_keeps_day_totals(labels):
    past = labels.where(c("date") < F.lit(ORIGIN))
    future = labels.where(c("date") >= F.lit(ORIGIN)).select("route", "date", "hour")
    base = P.robust_profile(past, feature_frame(past, future, ORIGIN, scale=0.25), ORIGIN, "long", scale=0.25)
    shaped = P.hour_shape(past, base, ORIGIN, ["route"], scale=0.25)
    total = lambda df: rows(df.groupBy("route", "date").agg(F.round(F.sum("prediction"), 6).alias("t")))
    assert total(base) == total(shaped) and rows(base, "prediction") != rows(shaped, "prediction")


def test_hybrid_stays_within_its_cap(labels):
    future = labels.where(c("date") >= F.lit(ORIGIN)).select("route", "date", "hour")
    out = L.bounded_hybrid_forecast(labels.where(c("date") < F.lit(ORIGIN)), future, ORIGIN, [date(2024, 1, 12)], 7, scale=0.25)
    got = out.select(F.count("*"), F.max(F.abs(c("prediction") - c("anchor")) - 0.025 * c("anchor")), F.min("prediction")).first()
    assert got[0] == future.count() and got[1] <= 1e-9 and got[2] >= 0


def test_visibility_is_half_open_on_the_event_and_closed_on_availability(spark):
    from ridewave.operators.ingest import visible_at
    cut = datetime(2024, 1, 1, 12)
    df = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 11:59:59', TIMESTAMP_NTZ'2024-01-01 12:00:00'),
      (2, TIMESTAMP_NTZ'2024-01-01 12:00:00', TIMESTAMP_NTZ'2024-01-01 12:00:00'), (3, TIMESTAMP_NTZ'2024-01-01 10:00:00', TIMESTAMP_NTZ'2024-01-01 12:00:01') AS t(id, event_at, available_at)""")
    assert rows(visible_at(df, cut), "id") == [(1,)]


def test_missing_is_not_zero(spark):
    cov = spark.createDataFrame([(date(2024, 1, 1), None), (date(2024, 1, 3), None)], "date date, published_at timestamp_ntz")
    cells = spark.createDataFrame([("a", datetime(2024, 1, 1), 5)], "route string, bucket timestamp_ntz, value bigint")
    targets = spark.createDataFrame([("a", datetime(2024, 1, 4))], "route string, bucket timestamp_ntz")
    out = W.look_back(targets, cells, cov, ["route"], W.MONTH_DAY, datetime(2024, 1, 4), [1, 2, 3])
    assert {r["offset"]: r["value"] for r in out.collect()} == {1: 0, 2: None, 3: 5}


def test_uncovered_events_stop_the_run(spark):
    cov = spark.createDataFrame([(date(2024, 1, 1), None)], "date date, published_at timestamp_ntz")
    ev = spark.createDataFrame([("a", datetime(2024, 1, 2, 3))], "route string, ts timestamp_ntz")
    with pytest.raises(Exception, match="coverage calendar"):
        C.bucket_counts(ev, ["route"], "daily", cov).collect()


def test_guards_refuse_bad_labels(spark, labels):
    grid = labels.select("route", "date", "hour")
    keys = ["route", "date", "hour"]
    with pytest.raises(Exception, match="label keys missing"):
        J.complete_labels(labels.where("hour > 0"), grid, keys, "boardings").collect()
    with pytest.raises(Exception, match="outside the grid"):
        J.complete_labels(labels, grid.where("hour > 0"), keys, "boardings").collect()
    with pytest.raises(Exception, match="duplicate"):
        J.complete_labels(labels.unionByName(labels), grid, keys, "boardings").collect()


def test_invalid_successful_row_is_fatal(spark):
    raw = spark.createDataFrame([("2024-13-01 00:00:00", "1", "5 tram")], "tran_date_time string, validation_result string, ngpt_route string")
    with pytest.raises(Exception, match="invalid successful"):
        E.read_validations(raw, date(2024, 1, 1), date(2024, 2, 1), r"^(\d+) tram$").collect()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("route;date;hour;boardings\n1;2025-01-01;5;7\n")
    (tmp_path / "b.csv").write_text("route;date;hour;boardings\n2;2025-01-02;6;8\n")
    assert rows(E.read_labels(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]), "route", "boardings") == [(1, 7), (2, 8)]
    (tmp_path / "bad.csv").write_text("route;day;hour;boardings\n1;2025-01-01;5;7\n")
    with pytest.raises(Exception):
        E.read_labels(spark, [str(tmp_path / "bad.csv")]).collect()
    lines = tmp_path / "e.jsonl"
    lines.write_bytes(b'{"id":1}\n[1]\nnot json\n{"id":2,"x":"\xff"}\n')
    from pyspark.sql import types as TT
    got = E.read_events_jsonl(spark, str(lines), TT.StructType([TT.StructField("id", TT.LongType())]))
    assert sorted(r[0] or "" for r in got.select("problem.detail").collect()) == ["", "JSON value is not an object", "invalid JSON", "invalid UTF-8"]
    head = tmp_path / "h.csv"
    head.write_bytes("﻿id,name\n1,a\n2\n".encode())
    out = E.read_events_csv(spark, str(head), ["id", "name"])
    assert sorted(r[0] or "" for r in out.select("problem.detail").collect()) == ["", "expected 2 columns, got 1"]


def tree_by_force(data, fanout):
    import hashlib
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = data.split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    level = [sha(x) for x in lines]
    while level:
        level = [sha("".join(level[i:i + fanout]).encode()) for i in range(0, len(level), fanout)]
        if len(level) == 1:
            break
    return len(lines), sha(f"{level[0] if level else ''}:{len(data)}".encode())


@pytest.mark.parametrize("block", ["128m", "3k"])
def test_file_inventory_by_ranges(spark, tmp_path, block):
    """Files of many byte ranges, without a last line feed, and binary: the same digest however they are split."""
    rng = random.Random(6)
    files = {"a.csv": b"id,name\n1,a\n2\n", "empty.csv": b"", "one.csv": b"x" * 9000, "bytes.csv": bytes(rng.randrange(256) for _ in range(30_000)),
             "long.csv": b"".join(b"%d,%s\r\n" % (i, b"y" * (i % 37)) for i in range(4000)), "end.csv": b"\n\n\n", "other.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    keys = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "64" if block == "3k" else "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = {r["file"]: (r["bytes"], r["lines"], r["tree_sha256"]) for r in E.file_inventory(spark, str(tmp_path), "*.csv", 16).collect()}
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert got == {n: (len(d), *tree_by_force(d, 16)) for n, d in files.items() if d and n.endswith(".csv")}


def test_day_shards_prune_and_conserve(spark, tmp_path):
    ev = spark.createDataFrame([(f"k{i}", "r1" if i % 2 else "r2", date(2024, 1, 1 + i % 3), i % 24, i % 5 > 0) for i in range(90)],
                               "event_key string, route string, date date, hour int, success boolean")
    out = str(tmp_path / "days")
    days = E.write_day_shards(ev, out)
    assert rows(days, "date", "events", "successful") == rows(ev.groupBy("date").agg(F.count(F.lit(1)), F.count_if("success")))
    one = E.read_day(spark, out, date(2024, 1, 2), ["r1"])
    assert one.count() == ev.where("date = DATE'2024-01-02' AND route = 'r1'").count()
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()
    some = E.read_days(spark, out, days.where("successful = (SELECT max(successful) FROM VALUES (24) AS t(successful))"))
    assert {r["date"] for r in some.collect()} <= {date(2024, 1, d) for d in (1, 2, 3)} and "dynamicpruning" in some._jdf.queryExecution().toString()
    picked = E.read_days(spark, out, days.where("date_format(date, 'dd') = '03'"))
    assert rows(picked, "event_key") == rows(ev.where("date = DATE'2024-01-03'"), "event_key")
    wrong = ev.groupBy("route", "date", "hour").agg(F.lit(9).cast("bigint").alias("source"))
    with pytest.raises(Exception, match="conservation"):
        E.write_day_shards(ev, str(tmp_path / "bad"), wrong)


def test_ingest_outputs_and_manifest(spark, tmp_path):
    valid = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b"), ("s2", 3, None)], "stream string, row_index bigint, v string")
    bad = spark.createDataFrame([("s2", 4, "decode_error", "invalid JSON", '{"x"')], "stream string, row_index bigint, reason string, detail string, raw string")
    manifest = E.write_ingest(valid, bad, str(tmp_path / "o"))
    assert rows(manifest, "kind", "stream", "rows") == [("quarantine", "s2", 1), ("valid", "s1", 2), ("valid", "s2", 1)]
    assert rows(E.read_quarantine(spark, str(tmp_path / "o")), "raw", "stream") == [('{"x"', "s2")]
    assert E.write_ingest(valid.limit(0), bad.limit(0), str(tmp_path / "none")).count() == 0


def line_check(batch):
    from pyspark.sql import types as TT
    from ridewave.operators.ingest import content_hash
    schema = TT.StructType([TT.StructField("id", TT.LongType()), TT.StructField("v", TT.StringType())])
    lines = batch.withColumn("row_index", F.xxhash64("value"))
    return E.parse_jsonl(lines, schema).withColumn("payload_hash", content_hash(["id", "v"])).withColumn("stream", F.lit("s"))


def test_interrupted_stream_equals_one_run(spark, tmp_path):
    """Three files in three batches, in one run, with restarts between, and with a failure in the middle."""
    parts = [['{"id":1,"v":"a"}', '{"id":2,"v":"b"}'], ['{"id":1,"v":"a"}', '{"id":2,"v":"x"}', 'broken', '{"v":"y"}'], ['{"id":3,"v":"c"}', '{"id":2,"v":"x"}', '{"id":2,"v":"b"}']]

    def run(name, stops, broken=()):
        src, out = tmp_path / name, str(tmp_path / (name + "-out"))
        src.mkdir()
        for i, lines in enumerate(parts):
            (src / f"p{i}.txt").write_text("\n".join(lines) + "\n")
            if i in stops:
                stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
                if i in broken:  # rows and heads are written, then the run dies: the batch is replayed
                    def fail(batch):
                        if batch.sparkSession is not None:
                            raise RuntimeError("lost")
                    with pytest.raises(Exception, match="lost"):
                        jobs.stream_ingest(stream, fail, "id", out, out + "-cp")
                jobs.stream_ingest(stream, line_check, "id", out, out + "-cp")
        found = jobs.ingest_rows(spark, out, "id")
        assert rows(found.where("verdict IN ('new', 'conflict')"), "id", "v", "verdict") == [(1, "a", "new"), (2, "b", "new"), (2, "x", "conflict"), (2, "x", "conflict"), (3, "c", "new")]
        # the state of an id is read and written only in batches that bring it
        assert rows(spark.read.parquet(f"{out}/known"), "id", "batch_id", "first_batch") == [("1", 0, 0), ("1", 1, 0), ("2", 0, 0), ("2", 1, 0), ("2", 2, 0), ("3", 2, 2)]
        return rows(jobs.ingest_ledger(spark, out, "id", ["stream"]))

    assert run("whole", {2}) == run("stopped", {0, 1, 2}) == run("lost", {0, 1, 2}, {1}) == [("s", 9, 3, 2, 4)]


def at(minute, second=0):
    return datetime(2024, 1, 5, 8 + minute // 60, minute % 60, second)


def streamed(spark, folder, batches, schema, job, write):
    src, out = folder / "in", str(folder / "out")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(2).write.mode("append").parquet(str(src))
        write(job(spark.readStream.schema(schema).parquet(str(src))), out, out + "-cp").awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def test_conflict_verdicts_do_not_depend_on_arrival(spark, tmp_path):
    """Order inside a batch, the horizon, a longer delay and rows that come too late."""
    schema = "id string, ts timestamp, payload string"
    first = [("a", at(0), "x"), ("a", at(5), "y"), ("a", at(9), "x"), ("a", at(31), "y"), ("a", at(32), "x"), ("b", at(0), "q"), ("b", at(0), "p")]
    second = [("a", at(40), "y"), ("a", at(62), "z"), ("b", at(29), "p"), ("a", at(20), "x")]
    opened = min(("p", "q"), key=lambda x: __import__("hashlib").sha256(x.encode()).hexdigest())
    want = sorted([("a", at(0), "new"), ("a", at(5), "conflict"), ("a", at(9), "duplicate"), ("a", at(31), "new"), ("a", at(32), "conflict"), ("a", at(40), "duplicate"),
                   ("a", at(62), "new"), ("a", at(20), "conflict"), ("b", at(0), "new"), ("b", at(0), "conflict"), ("b", at(29), "duplicate" if opened == "p" else "conflict")])
    rng, results = random.Random(3), []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for i in range(2):
            batches = [rng.sample(first, len(first)), rng.sample(second, len(second))]
            (folder := tmp_path / str(i)).mkdir()
            job = lambda df: jobs.stream_conflicts(df, "id", "ts", c("payload"), "2 hours", "30 minutes")
            results.append(rows(streamed(spark, folder, batches, schema, job, jobs.write_conflicts)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results == [want, want]
    (folder := tmp_path / "late").mkdir()
    batches = [[("a", at(0), "x"), ("c", at(100), "x")], [("a", at(3), "x"), ("a", at(95), "y"), ("c", at(101), "y")]]
    got = rows(streamed(spark, folder, batches, schema, lambda df: jobs.stream_conflicts(df, "id", "ts", c("payload"), "10 minutes"), jobs.write_conflicts))
    assert got == [("a", at(0), "new"), ("a", at(95), "new"), ("c", at(100), "new"), ("c", at(101), "conflict")]  # 8:03 is 97 minutes late


def test_a_late_bridge_joins_two_sessions(spark, tmp_path):
    """Two sessions of the first batch become one by an event of the second; a silence of exactly the gap does not split."""
    schema = "device string, ts timestamp"
    batches = [[("d", at(0)), ("d", at(12)), ("e", at(0)), ("e", at(10)), ("f", at(0)), ("f", at(10, 1))], [("d", at(6)), ("d", at(60))]]
    batches.append([tuple(r) for r in jobs.closing_row(spark.createDataFrame(sum(batches, []), schema), "ts", "1 DAY").collect()])
    job = lambda df: jobs.stream_sessions(df, "device", "ts", "10 minutes", "20 minutes")
    out = streamed(spark, tmp_path, batches, schema, job, lambda df, out, cp: jobs.write_updates(df, out, cp, "append"))
    assert rows(out, "device", "first", "last", "events") == [("d", at(0), at(12), 3), ("d", at(60), at(60), 1), ("e", at(0), at(10), 2),
                                                              ("f", at(0), at(0), 1), ("f", at(10, 1), at(10, 1), 1)]


def test_components_and_paths_on_a_hand_graph(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 13)], "stop_id bigint, lat double, lon double")
    edges = spark.createDataFrame([(i, i + 1, 1.0, ["x"]) for i in range(1, 8)] + [(1, 3, 5.0, ["y"]), (9, 10, 2.0, ["z"]), (11, 10, 1.0, ["z"])],
                                  "source bigint, target bigint, length_m double, routes array<string>")
    parts = G.components(nodes, edges)
    assert rows(parts, "component", "size")[0] == (0, 8) and rows(parts.where("stop_id = 12"), "size") == [(1,)]
    pairs = spark.createDataFrame([(1, 8), (8, 1), (1, 9), (1, 77), (9, 11)], "source bigint, target bigint")
    out = {(r["source"], r["target"]): (r["reason"], r["length_m"], r["path"]) for r in G.shortest_path(nodes, edges, pairs, parts).collect()}
    assert out[(1, 8)] == (None, 7.0, list(range(1, 9))) and out[(8, 1)][0] == "wrong_direction"
    assert out[(1, 9)][0] == "different_components" and out[(1, 77)][0] == "unknown_stop" and out[(9, 11)][0] == "wrong_direction"


def test_ways_chain_with_flips_and_gaps():
    assert G.chain_ways([[1, 2], [3, 2], [4, 1], [1 + 8, 10]]) == [4, 1, 2, 3, 9, 10]
    assert G.chain_ways([[1, 2], [1, 5]]) == [5, 1, 2]


def test_one_ineligible_row_masks_its_hour(spark):
    cat = spark.createDataFrame([("a", "s1", 0), ("a", "s2", 0)], "route string, stop_id string, direction int")
    lab = spark.createDataFrame([("a", date(2024, 1, 1), 5, 4), ("a", date(2024, 1, 1), 6, 0)], "route string, date date, hour int, boardings bigint")
    data = [("a", "s1", 0, date(2024, 1, 1), 5, 3.0, True), ("a", "unallocated:a", -1, date(2024, 1, 1), 5, 1.0, False)]
    kind = "route string, stop_id string, direction int, date date, hour int, expected_count double, training_eligible boolean"
    assert {r[0] for r in rows(ST.prepare_targets(spark.createDataFrame(data, kind), cat, lab), F.col("masked").isNull())} == {True}
    short = spark.createDataFrame(data[:1], kind)
    with pytest.raises(Exception, match="reconcile"):
        ST.prepare_targets(short, cat, lab).collect()
    more = lab.unionByName(spark.createDataFrame([("a", date(2024, 1, 1), 7, 2)], lab.schema))
    with pytest.raises(Exception, match="reconcile"):
        ST.prepare_targets(spark.createDataFrame(data, kind), cat, more).collect()


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("origin", (c("id") % 3).cast("string"))
    a = ST.sample_per_origin(df, 40, c("id"))
    assert a.count() == 120 and rows(a, "id") == rows(ST.sample_per_origin(df.repartition(7), 40, c("id")), "id")


def record(spark, **kw):
    base = dict(start_date=None, start_time=None, end_date=None, end_time=None, start_unix=None, end_unix=None, is_continuous=False)
    base.update(kw)
    kind = "start_date string, start_time string, end_date string, end_time string, start_unix bigint, end_unix bigint, is_continuous boolean"
    df = spark.createDataFrame([tuple(base[k.split()[0]] for k in kind.split(", "))], kind)
    r = X.classify_record(df, "Europe/Moscow").first()
    return r["precision"], r["flag"]


def test_city_event_rules(spark):
    at = lambda text: int(datetime.fromisoformat(text + "+03:00").timestamp())
    whole = dict(start_date="2025-01-15", start_time="19:00:00", end_date="2025-01-15", end_time="21:00:00")
    assert record(spark, **whole, start_unix=at("2025-01-15T19:00:00"), end_unix=at("2025-01-15T21:00:00")) == ("exact_interval", None)
    assert record(spark, **whole, start_unix=at("2025-01-15T20:00:00"), end_unix=at("2025-01-15T21:00:00")) == ("unresolved", "time_conflict")
    assert record(spark, start_date="2025-01-15", start_unix=at("2025-01-15T19:00:00"))[1] == "time_conflict"
    assert record(spark, start_date="2025-01-15", start_unix=at("2025-01-15T00:00:00")) == ("date_only", None)
    assert record(spark, start_date="2025-01-15", start_time="19:00:00", end_time="21:00:00") == ("start_only", "end_day_unknown")
    span = dict(start_date="2025-01-05", start_time="10:00:00", end_date="2025-01-20", end_time="22:00:00")
    assert record(spark, **span) == ("unresolved", "ambiguous_multiday")
    assert record(spark, **span, is_continuous=True) == ("exact_interval", "continuous_span")
    assert record(spark, **{**whole, "end_time": "18:00:00"}) == ("quarantine", "negative_interval")
    assert record(spark) == ("unresolved", "empty_record")


def test_discovered_schema_names_gaps():
    from ridewave.operators.intake import discover_schema
    got = discover_schema(["id", "line", "extra", "extra"], ["event_id", "route_id", "unit"], {"event_id": "id", "route_id": "gone"}, ["unit"])
    assert got["never_seen"] == ["gone"] and got["constants"] == ["unit"] and got["repeated"] == ["extra"] and "line" in got["unused"]


@pytest.mark.parametrize("name", [False, True])
def test_enrolment_by_segments_equals_every_pair(spark, name):
    """Trips that overlap, touch, repeat, are empty or have no duty; events on both edges, without a duty, of a hot duty."""
    rng = random.Random(12)
    trips = [(rng.choice(["hot", "hot", "a", "b"]), 100 + i, i % 2, s := rng.randrange(0, 200_000), s + rng.choice([-5, 0, 60, 4000, 30_000])) for i in range(120)]
    trips += [trips[0], ("a", 500, 0, 10, 20), ("a", 501, 1, 20, 30), (None, 502, 0, 0, 10 ** 6)]
    edges = [x for t in trips for x in (t[3], t[4], t[4] + 1)]
    events_ = [(i, rng.choice(["hot", "hot", "a", "b", "z", None]), rng.choice(edges) if i % 2 else rng.randrange(-10, 240_000)) for i in range(1500)]
    spans = spark.createDataFrame(trips, "duty string, trip_id bigint, direction int, first_clock bigint, last_clock bigint")
    if name:
        spans = spans.withColumn("trip_id", F.concat(F.lit("t"), c("trip_id").cast("string")))
    events = spark.createDataFrame(events_, "event_id bigint, duty string, sec bigint")

    def active(duty, at, inclusive=True):
        return [t for t in trips if t[0] is not None and t[0] == duty and t[3] <= at and (at <= t[4] if inclusive else at < t[4])]

    for inclusive in (True, False):
        want = []
        for i, duty, at in events_:
            hits = active(duty, at, inclusive)
            only = hits[0][1] if len(hits) == 1 else None
            want.append((i, len(hits), f"t{only}" if name and only else only))
        out = M.enroll(events, spans, inclusive=inclusive)
        assert rows(out, "event_id", "trips", "trip_id") == sorted(want)
    from ridewave.operators import audits as A
    stable = {r["event_id"]: r for r in A.enroll_stability(events, spans, ["duty"]).collect()}
    for i, duty, at in events_:
        found = [active(duty, at + s) for s in (0, -300, 300, -900, 900)]
        ok = [len(f) == 1 and len(found[0]) == 1 and f[0][2] == found[0][0][2] for f in found]
        assert (stable[i]["trips"], stable[i]["stable300"], stable[i]["stable900"]) == (len(found[0]), all(ok[:3]), all(ok))
    plan = M.enroll(events, spans)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" not in plan


def test_cheapest_paths_equal_brute_force(spark):
    rng = random.Random(8)
    arcs = [(rng.randrange(18), rng.randrange(18), float(rng.choice((0, 1, 1, 2, 3)))) for _ in range(50)] + [(30, 31, 1.0), (31, 30, 1.0), (3, 4, None)]
    arcs += arcs[:5]
    pairs = [(a, b) for a in range(0, 18, 3) for b in range(18)] + [(30, 31), (0, 30), (0, 99), (99, 0)]
    nodes = spark.createDataFrame([(i,) for i in [*range(18), 30, 31]], "stop_id long").coalesce(1)
    edges = spark.createDataFrame(arcs, "source long, target long, length_m double").coalesce(1)
    parts = G.components(nodes, edges)
    wanted = {}
    for start in {a for a, _ in pairs}:
        best = {start: (0.0, 0, (start,))}  # length, edges, nodes backwards
        for _ in range(20):
            for a, b, d in arcs:
                if a in best and d is not None:
                    label = (best[a][0] + d, best[a][1] + 1, (b, *best[a][2]))
                    best[b] = min(best.get(b, label), label)
        wanted |= {(start, b): (label[0], list(label[2][::-1])) for b, label in best.items()}
    got = {(r["source"], r["target"]): r for r in G.shortest_path(nodes, edges, spark.createDataFrame(pairs, "source long, target long"), parts, 3.0).collect()}
    assert set(got) == set(pairs)
    part = {r["stop_id"]: r["component"] for r in parts.collect()}
    for (a, b), r in got.items():
        if a not in part or b not in part:
            assert r["reason"] == "unknown_stop"
        elif part[a] != part[b]:
            assert r["reason"] == "different_components" and r["path"] is None
        elif (a, b) not in wanted:
            assert r["reason"] == "wrong_direction" and r["length_m"] is None
        else:
            assert (r["reason"], r["length_m"], r["path"]) == (None, *wanted[a, b])


def test_cheapest_path_search_ends_at_its_targets(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "source long, target long, length_m double")
    labels = G.search_paths(edges, spark.createDataFrame([(0, 2), (10, 10)], "source long, target long"), 1.0)
    assert max(r["node"] for r in labels.where("source = 0").collect()) <= 3 and labels.where("source = 10").count() <= 2


def test_sweep_equals_brute_force_with_seasons_months_and_windows(spark):
    rng, first = random.Random(4), date(2024, 3, 1)
    days = [first + timedelta(days=i) for i in range(150)]
    labels = {(r, d): rng.randrange(60) for r in ("a", "b") for d in days if rng.random() > 0.05}
    origins = [date(2024, 6, 20), date(2024, 7, 20)]
    configs = [P.Config("w40", "mean", 40), P.Config("season", "median", seasonal=True), P.Config("trim", "trim10", 90, day_type_weight=1.0, seasonal=True),
               P.Config("months", "month_exp", half_life=2.0, months=3, day_type_weight=0.25), P.Config("equal", "month_equal", seasonal=True),
               P.Config("exp", "exp", half_life=9.0, correction=0.5), P.Config("low", "q40", 70), P.Config("mean2", "mean", months=2)]

    def reduced(k, origin, seen):
        def months(d):
            return (origin.year - d.year) * 12 + origin.month - d.month
        by_month = k.months or k.statistic.startswith("month_")
        seen = sorted((v, d) for d, v in seen if d < origin and (not k.window or (origin - d).days <= k.window)
                      and (not by_month or months(d) > 0) and (not k.months or months(d) <= k.months))
        if not seen:
            return None
        v = [x for x, _ in seen]
        if k.statistic in P.QUANTILES:
            return float(np.quantile(v, P.QUANTILES[k.statistic]))
        if k.statistic == "trim10":
            cut = len(v) // 10
            return float(np.mean(v[cut:len(v) - cut]))
        if k.statistic == "exp":
            return float(np.average(v, weights=[2.0 ** (-(origin - d).days / k.half_life) for _, d in seen]))
        if k.statistic.startswith("month_"):
            groups = {}
            for x, d in seen:
                groups.setdefault(months(d), []).append(x)
            weights = [2.0 ** (-m / k.half_life) if k.statistic == "month_exp" else 1.0 for m in groups]
            return float(np.average([np.mean(g) for g in groups.values()], weights=weights))
        return float(np.mean(v))

    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    plain = {r["date"]: r for r in with_calendar(calendar).collect()}

    def kind(d):
        return plain[d]["day_type"]

    def warm(d):
        return d.month in (6, 7, 8)

    want = {}
    for k in configs:
        for o in origins:
            for (r, d), _ in labels.items():
                if not o <= d < o + timedelta(days=9):
                    continue
                level = []
                for member in (date.weekday, kind):
                    own = [(x, v) for (q, x), v in labels.items() if q == r and member(x) == member(d)]
                    both = reduced(k, o, [(x, v) for x, v in own if warm(x) == warm(d)]) if k.seasonal else None
                    level.append(reduced(k, o, own) if both is None else both)
                w = 1.0 if plain[d]["exception"] else k.day_type_weight
                mixed = level[0] if w == 0 else level[1] if w == 1 else (1 - w) * level[0] + w * level[1]
                past = [(v, (o - x).days) for (q, x), v in labels.items() if q == r and 0 < (o - x).days <= 42]
                new, old = np.mean([v for v, a in past if a <= 14]), np.mean([v for v, a in past if a > 14])
                want[k.name, o, r, d] = max(0.0, mixed * (1 + k.correction * (min(max(new / old, 0.8), 1.2) - 1)))
    table = spark.createDataFrame([(r, d, 7, v) for (r, d), v in labels.items()], "route string, date date, hour int, boardings int")
    got = {(r["model"], r["origin"], r["route"], r["date"]): r["prediction"] for r in P.sweep(table, origins, configs, 9).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_ridge_by_sums_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    data = [(k, *map(float, x), float(x @ [1, -2, 0.5] + shift + rng.normal())) for k, shift in (("a", 900.0), ("b", -3.0))
            for x in rng.normal(size=(40, 3)) + 5] + [("c", 1.0, 2.0, 3.0, 8.0), ("a", 1.0, 1.0, 1.0, None)]
    got = {r["key"]: r for r in L.ridge_fit(spark.createDataFrame(data, "key string, x double, y double, z double, t double"), ["key"], ["x", "y", "z"], "t", 2.0).collect()}
    for key in "abc":
        rows_of = np.array([r[1:] for r in data if r[0] == key and r[4] is not None])
        x, y = rows_of[:, :3], rows_of[:, 3]
        centred = np.vstack([x - x.mean(axis=0), np.sqrt(2.0) * np.eye(3)])
        weights = np.linalg.lstsq(centred, np.concatenate([y - y.mean(), np.zeros(3)]), rcond=None)[0]
        assert np.allclose(got[key]["weights"], weights) and np.isclose(got[key]["intercept"], y.mean() - x.mean(axis=0) @ weights)


def test_synchrony_equals_pairs_of_seconds_and_devices(spark):
    rng, scales = random.Random(6), (2, 10, 80)
    data = [("hot" if rng.random() < 0.8 else "k", f"d{rng.randrange(6)}", 80000 + int(rng.choice((rng.random() * 2500, rng.gauss(700, 60)))), rng.randrange(1, 4)) for _ in range(220)]
    merged = {}
    for key, device, sec, n in [*data, ("one", "d", 5, 1)]:
        merged[key, device, sec] = merged.get((key, device, sec), 0) + n
    got = {(r["key"], r["sec"]): r for r in S.synchrony(spark.createDataFrame([(*k, n) for k, n in merged.items()], "key string, device string, sec bigint, n bigint"), ["key"], scales).collect()}
    assert set(got) == {(k, s) for k, _, s in merged}
    for (key, at), row in got.items():
        devices = {}
        for (k, d, s), n in merged.items():
            if k == key:
                devices.setdefault(d, []).append((s, n))
        for w in scales:
            seen, mean, var = 0, 0.0, 0.0
            for marks in devices.values():
                t0, t1 = min(marks)[0], max(marks)[0]
                ring = sum(n for s, n in marks if -300 <= s - at < -80 or 80 <= s - at < 300)
                exposure = max(min(300, at - t0) - 80, 0) + max(min(300, t1 - at) - 80, 0)
                p = 1 - np.exp(-max(ring / max(exposure, 1), 1 / 600) * w)
                seen, mean, var = seen + any(0 <= s - at < w for s, _ in marks), mean + p, var + p * (1 - p)
            assert row[f"devices{w}"] == seen
            assert abs(row[f"sync{w}"] - ((seen - mean) / max(var, 0.1) ** 0.5 if seen > 1 else -100)) < 1e-9
