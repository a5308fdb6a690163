"""Steps whose plans must not grow faster than their input, against plain Python on small rows."""

import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from ridewave.operators import audits as A
from ridewave.operators import graph as G
from ridewave.operators import identity as N
from ridewave.operators import mapping as M
from ridewave.operators import serve as V
from ridewave.operators import sessions as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SHIFTS = (-600, -90, 0, 30, 1800)


def losses_by_hand(events, clocks):
    out = {}
    for key, half, second in events:
        for s in SHIFTS:
            near = [abs(second - k - s) for d, k in clocks if d == key and k is not None] if second is not None and key is not None else []
            e = out.setdefault((key, half, s), [0, 0])
            e[0] += min([300, *near])
            e[1] += 1
    return {k: (a / n, n) for k, (a, n) in out.items()}


def calibration_rows(spark):
    events = [(i % 5, "a" if i % 3 else "b", 10_000 + (i * 7919) % 20_000) for i in range(400)]
    events += [(1, "a", None), (None, "b", 12_000), (1, "a", 10_500), (1, "a", 10_500)]
    clocks = [(i % 4, (i * 613) % 33_000) for i in range(60)] + [(1, None), (None, 12_000), (2, 5), (2, 5)]
    return events, clocks, spark.createDataFrame(events, "duty int, half string, sec bigint"), spark.createDataFrame(clocks, "duty int, clock bigint")


def test_calibration_losses_stay_off_the_driver(spark):
    events, clocks, e, k = calibration_rows(spark)
    losses = A.calibration_losses(e, k, ["duty"], SHIFTS, within=["half"])
    assert "BroadcastExchange" not in plan(losses)  # the seconds copied per shift were sent through the driver
    got = {(r.duty, r.half, r.shift): (r.loss, r.events) for r in losses.collect()}
    assert got == losses_by_hand(events, clocks)


def test_calibrated_shift_needs_no_join(spark):
    _, _, e, k = calibration_rows(spark)
    losses = A.calibration_losses(e, k, ["duty"], SHIFTS)
    chosen = A.calibrate_shift(losses, ["duty"])
    assert "BroadcastExchange" not in plan(chosen) and plan(chosen).count("Join") == plan(losses).count("Join")
    by = {}
    for r in losses.collect():
        by.setdefault(r.duty, []).append((r.loss, abs(r["shift"]), r["shift"], r.events))
    rows = chosen.collect()
    assert sorted(r.duty for r in rows) == list(range(5))  # events without a key get no shift
    for r in rows:
        best = min(by[r.duty])
        near = [x[2] for x in by[r.duty] if x[0] <= best[0] + 5]
        assert (r.loss, r["shift"], r.events, r.near_low, r.near_high, r.near_count) == (best[0], best[2], best[3], min(near), max(near), len(near))
        assert r.at_bound == (abs(r["shift"]) == 1800)


def test_guarded_shift_shares_one_loss_table(spark):
    _, _, e, k = calibration_rows(spark)
    out = A.guarded_shift(e, k, ["duty"], F.col("half") == "a", SHIFTS, minimum=20)
    text = plan(out)
    assert "BroadcastExchange" not in text and text.count("SortMergeJoin") == 1
    rows = {r.duty: r for r in out.collect()}
    assert set(rows) == set(range(5))
    b = {(r.duty, r["shift"]): r.loss for r in A.calibration_losses(e.where("half = 'b'"), k, ["duty"], SHIFTS).collect()}
    a = {r.duty: r["shift"] for r in A.calibrate_shift(A.calibration_losses(e.where("half = 'a'"), k, ["duty"], SHIFTS), ["duty"]).collect()}
    for d in range(5):
        assert rows[d].gain == b[d, 0] - b[d, a[d]]


def test_service_estimate_stays_off_the_driver(spark):
    first = date(2024, 1, 1)
    profiles = [(f"r{i % 7}", i, list(range(7))[: 3 + i % 5], [(i * h) % 6 for h in range(48)], first + timedelta(i % 4), first + timedelta(5 + i % 9)) for i in range(12)]
    profiles += [("r1", 99, [0, 1], list(range(48)), first, first)]
    days = [first + timedelta(i) for i in range(16) if i != 6]
    df = spark.createDataFrame(profiles, "route string, cycle int, weekdays array<int>, starts array<int>, valid_from date, valid_to date")
    # more copies than the size estimate sees
    out = V.service_estimate(df, spark.createDataFrame([(d,) for d in days], "date date"))
    assert plan(out).count("BroadcastHashJoin") <= 1  # the days alone

    def one(route, d):
        fit = [p for p in profiles if p[0] == route and p[4] <= d <= p[5] and d.weekday() in p[2] and d in days]
        return fit[0] if len(fit) == 1 else None

    want = {}
    for route in {p[0] for p in profiles}:
        for d in days:
            now, before = one(route, d), one(route, d - timedelta(1))
            if now and before:
                want[route, d] = (now[1], [now[3][h] + (before[3][24 + h] if h < 24 else 0) for h in range(24)])
    assert want and {(r.route, r.date): (r.cycle, r.departures) for r in out.collect()} == want


def test_path_rounds_broadcast_nothing(spark, monkeypatch):
    kept, cut = [], G.reliable_checkpoint

    def watched(df):
        kept.append(plan(df))
        return cut(df)

    monkeypatch.setattr(G, "reliable_checkpoint", watched)
    legs = [(i, i + 1, 1.0) for i in range(6)] + [(0, 3, 2.5), (3, 0, 9.0), (10, 11, 1.0)]
    edges = spark.createDataFrame([(a, b, x, ["A"]) for a, b, x in legs], "source bigint, target bigint, length_m double, routes array<string>")
    nodes = spark.createDataFrame([(i,) for i in [*range(7), 10, 11]], "stop_id bigint")
    parts = G.components(nodes, edges)
    labels = G.search_paths(edges, spark.createDataFrame([(0, 6), (3, 1), (10, 11)], "source bigint, target bigint"), 2.0)
    walked = G.path_nodes(labels, spark.createDataFrame([(0, 6), (3, 1)], "source bigint, target bigint")).collect()
    assert {r.stop_id: r.component for r in parts.collect()} == {**dict.fromkeys(range(7), 0), 10: 1, 11: 1}
    dist = {(r.source, r.node): r.dist for r in labels.collect()}
    assert dist[0, 6] == 5.5 and dist[3, 1] == 10.0 and dist[10, 11] == 1.0
    paths = {}
    for r in sorted(walked, key=lambda r: (r.source, r.hops)):
        paths.setdefault((r.source, r.target), []).append(r.node)
    assert paths == {(0, 6): [0, 3, 4, 5, 6], (3, 1): [3, 0, 1]}
    assert len(kept) > 6 and not [x for x in kept if "BroadcastExchange" in x]


def paths_by_force(arcs, nodes, pairs):
    """(length, path) of each pair among known nodes: least length, then edges, then nodes from the back."""
    wanted = {}
    for start in {a for a, _ in pairs if a in nodes}:
        best = {start: (0.0, 0, (start,))}
        for _ in range(30):
            for a, b, d in arcs:
                if a in best and d is not None:
                    label = (round(best[a][0] + d, 6), best[a][1] + 1, (b, *best[a][2]))
                    best[b] = min(best.get(b, label), label)
        wanted |= {(start, b): (round(x[0], 1), list(x[2][::-1])) for b, x in best.items()}
    return {p: wanted[p] for p in pairs if p in wanted}


def test_paths_take_no_round_for_each_band_or_hop(spark, monkeypatch):
    """A chain takes the steps of a single edge; components of too many edges, or open ones, give the same by rounds."""
    kept, cut, rounds, search = [], G.reliable_checkpoint, [], G.search_paths
    monkeypatch.setattr(G, "reliable_checkpoint", lambda df: kept.append(plan(df)) or cut(df))
    monkeypatch.setattr(G, "search_paths", lambda e, p, band=None: rounds.append({r.source for r in p.collect()}) or search(e, p, band))
    monkeypatch.setattr(G, "PATH_SOURCES", 2)
    arcs = [(i, i + 1, 0.1) for i in range(9)] + [(3, 5, 0.2), (5, 3, 4.0), (2, 2, 0.0), (3, 5, None), (30, 31, 1.0), (31, 32, 1.0), (30, 32, 2.0)]
    arcs += [(98, None, 1.0), (None, 31, 1.0)]
    known = [*range(10), 30, 31, 32, 40, 41, 50]
    pairs = [(0, 9), (9, 0), (1, 7), (30, 32), (50, 50), (0, 31), (7, 77)] + [(i, i) for i in range(6)]
    ends = "source bigint, target bigint"
    nodes = spark.createDataFrame([(i,) for i in known], "stop_id bigint").coalesce(1)
    whole = spark.createDataFrame([x for x in [*arcs, (40, 41, 5.0)] if None not in x], f"{ends}, length_m double").coalesce(1)
    parts = cut(G.components(nodes, whole))
    edges = spark.createDataFrame(arcs, f"{ends}, length_m double").coalesce(1)

    def found(arcs, pairs):
        kept.clear(), rounds.clear()
        out = G.shortest_path(nodes, arcs, spark.createDataFrame(pairs, ends).coalesce(1), parts, 0.5)
        return {(r.source, r.target): (r.length_m, r.path) for r in out.collect() if r.reason is None}

    want = paths_by_force([x for x in arcs if None not in x], known, pairs)
    assert found(edges, pairs) == want and want[0, 9][0] == 0.9 and not rounds
    assert len(kept) <= 5 and not [x for x in kept if "BroadcastExchange" in x]  # nine hops took a step each
    # 99 is no stop, but leads on: what is found through it does not stay in a component
    more = [*arcs, (40, 41, 5.0), (40, 99, 1.0), (99, 41, 1.0)]
    monkeypatch.setattr(G, "PATH_EDGES", 3)
    pairs = [(1, 4), (30, 32), (40, 41), (50, 50)]
    got = found(spark.createDataFrame(more, f"{ends}, length_m double").coalesce(1), pairs)
    assert got == paths_by_force([x for x in more if None not in x], known, pairs) and got[40, 41] == (2.0, [40, 99, 41]) and rounds == [{1, 40}]


def test_path_lengths_round_like_spark(spark):
    values = [0.1 + 0.2, 0.0000005, 1.0000015, 2.5, 123456.7890125, 1e11 + 0.1234565, 33.3333335, 7.0000004999]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", F.round("v", 6).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [G._rounded(v) for v in values]


def test_ingest_keeps_its_state_without_a_call_per_id(spark, tmp_path, monkeypatch):
    from ridewave.streaming import jobs

    def check(batch):
        return batch.withColumn("problem", F.when(F.col("row_index") % 11 == 0, "odd")).withColumn("stream", F.lit("s"))

    monkeypatch.setattr(jobs, "FirstPayload", None)  # one Python call an id was the whole time of the query
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen, want = {}, {"new": 0, "duplicate": 0, "conflict": 0, "rejected": 0}
    for part in range(3):
        rows = [(part * 200 + i, (part * 200 + i) * 7 % 90 if i % 13 else None, f"h{(part * 200 + i) % 4}") for i in range(200)]
        spark.createDataFrame(rows, "row_index long, id long, payload_hash string").repartition(3).write.mode("append").parquet(src)
        jobs.stream_ingest(spark.readStream.schema("row_index long, id long, payload_hash string").parquet(src), check, "id", out, out + "-cp")
        for index, key, payload in rows:
            if key is None or index % 11 == 0:
                want["rejected"] += 1
            else:
                want["new" if key not in seen else "duplicate" if seen[key] == payload else "conflict"] += 1
                seen.setdefault(key, payload)
    assert {r.verdict: r["count"] for r in jobs.ingest_rows(spark, out, "id").groupBy("verdict").count().collect()} == want


def test_learned_forecasts_read_the_events_once(spark):
    from ridewave.plans import learned as L
    from ridewave.queries import learned as Q
    from ridewave.queries import stops as QS
    from ridewave.queries.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for made in (Q.past(t), Q.future(t), QS.targets(t), QS.features(t), Q.stop_rows(t)):
        assert "events.parquet" not in plan(made)  # every join of theirs scanned all events again
    assert sorted(map(tuple, t.hourly_kept.collect())) == sorted(map(tuple, t.hourly_dense.collect()))
    train, _ = L._correction(Q.past(t), Q.EVENT_ORIGIN, Q.ORIGINS, 7, Q.EVENT_CAL, Q.SCALE)
    assert "Join" not in plan(train) and "Exchange" not in plan(train)  # each round of the fit reported on all of it to the driver


def test_nearest_clocks_read_their_events_twice(spark):
    events = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("duty"), (F.col("id") * 7919 % 200_000).alias("sec"))
    clocks = spark.createDataFrame([(i % 3, i % 2, i * 9000) for i in range(20)], "duty bigint, direction int, clock bigint")
    spans = spark.createDataFrame([(i % 3, i, i % 2, i * 9000, i * 9000 + 8000) for i in range(20)], "duty bigint, trip_id bigint, direction int, first_clock bigint, last_clock bigint")
    # two nested as-ofs read them four times, five of them over thirty; events without a key are a reading of their own
    assert plan(A.nearest_errors(events, clocks, ["duty"])).count("Range (") == 2
    assert plan(A.clock_directions(events, spans, clocks, ["duty"])).count("Range (") <= 3


def test_trip_windows_ask_once_for_both_neighbours(spark):
    rows = [(i % 3 if i % 11 else None, i, (i * 7919) % 90_000) for i in range(60)]
    rows = [(d, i, a, a + 300 + (i * 613) % 5000) for d, i, a in rows] + [(1, 500, 10_000, 10_000), (1, 500, 10_000, 10_000), (2, 501, 5, 9)]
    spans = spark.createDataFrame(rows, "duty int, trip_id bigint, first_clock bigint, last_clock bigint")
    out = M.trip_windows(spans)
    assert plan(out).count("LocalTableScan") + plan(out).count("Scan ExistingRDD") <= 4
    got = sorted((r["trip_id"], r["low"], r["high"]) for r in out.where("duty IS NOT NULL").collect())
    want = []
    for d, i, a, b in rows:
        if d is not None:
            ends, starts = [y for k, _, _, y in rows if k == d and y <= a], [x for k, _, x, _ in rows if k == d and x >= b]
            want.append((i, max(a - 900, (a + max(ends)) / 2) if ends else a - 900, min(b + 900, (b + min(starts)) / 2) if starts else b + 900))
    assert got == sorted(want)


def test_enrolment_stability_copies_seconds_not_trips(spark):
    rows = [(i % 4, i, i % 2, (i * 7919) % 60_000) for i in range(40)]
    rows = [(*r, r[3] + 200 + (r[1] * 613) % 6000) for r in rows]
    spans = spark.createDataFrame(rows, "duty int, trip_id bigint, direction int, first_clock bigint, last_clock bigint")
    events = [(i % 5, (i * 373) % 66_000) for i in range(300)] + [(1, 9000), (1, 9000), (None, 5), (1, None)]
    out = A.enroll_stability(spark.createDataFrame(events, "duty int, sec bigint"), spans, ["duty"])
    assert "_shift" in plan(out)  # seconds ask at each shift; trips came once a shift in a table of their own
    want = []
    for d, s in events:
        hits = [[x[2] for x in rows if d is not None and s is not None and x[0] == d and x[3] <= s + m <= x[4]] for m in (0, -300, 300, -900, 900)]
        one = lambda part: all(len(h) == 1 for h in part) and len({h[0] for h in part}) == 1
        want.append((d or -1, s or -1, len(hits[0]), one(hits[:3]), one(hits)))
    got = [(r["duty"] or -1, r["sec"] or -1, r["trips"], r["stable300"], r["stable900"]) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_synchrony_moves_stretches_not_seconds(spark):
    # devices with one payment in a crowded hour: each changes its rate in 440 of the paid seconds
    rows = spark.range(2000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("device"), (50_000 + F.col("id")).alias("sec"), F.lit(1).cast("bigint").alias("n"))
    assert S._ring_stretches(rows, ["key"]).count() <= 2 * 2000
    out = S.synchrony(rows, ["key"], [80])
    assert "_ring" not in plan(out) and out.count() == 2000


def test_synchrony_lays_stretches_at_paid_seconds_only(spark, monkeypatch):
    laid, real = [], S.scan_groups
    monkeypatch.setattr(S, "scan_groups", lambda *a: laid.append(real(*a)) or laid[-1])
    rows = spark.createDataFrame([(k, f"d{d}", 50_000 + 700 * i + 150 * d, 1) for k in "ab" for d in range(3) for i in range(9)] + [(None, "d", 60_000, 1), ("a", "d", None, 1)],
                                 "key string, device string, sec bigint, n bigint")
    out = S.synchrony(rows, ["key"], [80])
    lines = plan(out).splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    sent = [i for i, x in enumerate(lines) if "BroadcastExchange" in x]
    under = [next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)) for i in sent]
    assert "MapInPandas" in plan(out) and not [x for i, j in zip(sent, under, strict=True) for x in lines[i:j] if "MapInPandas" in x]
    paid = rows.where("key IS NOT NULL AND sec IS NOT NULL").select("key", "sec").distinct().count()
    assert laid[0].count() == out.count() == paid == 54  # each stretch covered up to 220 seconds


def test_names_and_places_meet_events_once(spark):
    visits = spark.createDataFrame([("r", 0, f"N{i % 2}", i, 50.0 + i % 2, 10.0) for i in range(60)] + [("r", 0, "N1", 1, 51.0, 10.0)],
                                   "route_id string, direction_id int, name string, stop_id bigint, lat double, lon double")
    events = spark.createDataFrame([(1, "r", 0, "N1", 51.0, 10.0), (2, "r", 0, "N0", 50.0, 10.0), (3, "r", 1, "N0", 50.0, 10.0), (4, "r", 0, "N9", 0.0, 0.0)],
                                   "event_id bigint, route_id string, direction_id int, stop_name string, latitude double, longitude double")
    for out, least, every in ((N.match_name(events, visits), "named_stop", "named"), (N.match_geo(events, visits, 60.0), "near_stop", "near")):
        assert {r["event_id"]: (r["candidates"], r[least], r[every]) for r in out.collect()} == {
            1: (30, 1, list(range(1, 60, 2))), 2: (30, 0, list(range(0, 60, 2)))}
        assert "sum(_n" in plan(out)  # an event joined every stop of its name or place


def test_points_meet_places_not_stops(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def flat(y, x, lat, lon):
        met.add(1)
        return None if None in (y, x, lat, lon) else math.hypot(lat - y, (lon - x) * math.cos(math.radians((lat + y) / 2))) * 111195.08

    stops = [(i, 55.5 + i % 3 * 0.004, 37.3) for i in range(90)] + [(7, 55.504, 37.3), (7, 55.52, 37.3), (None, 55.5, 37.3), (None, 55.5, 37.3), (95, None, 37.3)]
    points = [("d", i % 2, 55.5 + i * 0.002, 37.3 + i % 2 * 0.01) for i in range(12)] + [("d", 0, 55.5, 37.3), (None, 1, 55.5, 37.3), ("d", 0, None, 37.3)]
    want = {}
    for stop, lat, lon in stops:
        for day, hour, y, x in points:
            if None not in (lat, y) and flat(y, x, lat, lon) <= 1000:
                want[stop, day, hour] = want.get((stop, day, hour), 0) + 1
    monkeypatch.setattr(N, "planar", lambda *a: F.udf(flat, "double")(*a))
    met.value = 0
    rows = N.events_near_stops(spark.createDataFrame(points, "date string, hour int, lat double, lon double"),
                               spark.createDataFrame(stops, "stop_id bigint, lat double, lon double"), 1000.0).collect()
    assert {(r.stop_id, r.date, r.hour): r.events for r in rows} == want and len(rows) == len(want)
    assert met.value <= 7 * 14  # seven places of five kinds of stop; 95 stops met their points one by one


def test_problem_filters_stay_above_the_checks(spark):
    from ridewave.operators import ingest as I
    fields = [I.Field("id", "identifier"), I.Field("at", "timestamp"), I.Field("n", "sequence")]
    good, bad = ("a", "2024-01-01T10:00:00Z", "1"), [("a b", "2024-01-01T10:00:00Z", "1"), (None, None, None), ("a", "10:00", "x"), ("a", "2024-01-01T10:00:00Z", "x")]
    checked = I.check_fields(spark.createDataFrame([good, *bad], "id string, at string, n string").repartition(2), fields)
    right, wrong = checked.where("problem IS NULL"), checked.where("problem IS NOT NULL")
    # a filter pushed below the checks computed each text and clock again for every check
    for df in (right, wrong):
        assert not [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "RLIKE" in line]
    assert [r.id for r in right.collect()] == ["a"]
    assert sorted(tuple(r.problem) for r in wrong.collect()) == [
        ("invalid_timestamp", "at"), ("invalid_type", "n must be an integer"), ("invalid_value", "id is not a valid identifier"), ("missing_field", "id")]


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Partitions grow with the table where a task sorted or hashed a fixed share of it; results stay."""
    from ridewave.queries import base, load
    sf = "/root/testdata/sf0.001"
    for name in ("timetable_problems", "stop_bearings", "forecast_artifact_check"):
        run = load()[name].run
        small = run(base.Tables(spark, sf))
        monkeypatch.setattr(base, "PART_ROWS", 250)
        cut = run(base.Tables(spark, sf))
        monkeypatch.undo()
        parts = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 250)
        assert f", {parts}), REPARTITION_BY_NUM" in plan(cut) and "REPARTITION_BY_NUM" not in plan(small)
        assert sorted(map(repr, cut.collect())) == sorted(map(repr, small.collect()))


def test_forecast_points_are_not_dealt_by_bucket(spark):
    from ridewave.operators import evaluate as E
    pts = spark.range(40).selectExpr("CAST(id % 4 AS string) AS stop", "date_add(DATE '2024-01-01', CAST(id % 5 AS int)) AS bucket", "1.0 AS predicted", "0.0 AS lower", "2.0 AS upper")
    horizon = spark.range(3).selectExpr("explode(array(date_add(DATE '2024-01-01', CAST(id AS int)))) AS bucket").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = E.validate_forecast(pts, horizon, ["stop"], True)
        assert "SortMergeJoin" not in plan(out)
        assert sorted(tuple(r) for r in out.collect()) == [(str(s), 5, 2, 0, 0, 0, 0) for s in range(4)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
