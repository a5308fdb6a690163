"""Serving questions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ridewave.operators import serve as V
from ridewave.plans import forecast as M
from ridewave.queries.base import query, rnd
from ridewave.queries.scoring import rounded_all

c = F.col
PK = ["run_id", "route_id", "stop_id", "bucket"]
RUN_SQL = """pt AS (SELECT run_id || year(date) AS run_id, route_id, date FROM points), runs AS (SELECT run_id, max(date) AS generated_at, CASE WHEN CAST(substr(run_id,2) AS INT) % 2=0 THEN 'day' ELSE 'month' END AS horizon, CASE WHEN run_id LIKE 'R%' THEN 'draft' ELSE 'published' END AS state FROM pt GROUP BY ALL),
 act AS (SELECT DISTINCT route_id, 'month' AS horizon, 'A1999' AS run_id FROM points WHERE route_id < 'r4')"""


def run_points(t):
    return t.points.select(F.concat("run_id", F.year("date").cast("string")).alias("run_id"), "route_id", "date")


def runs(t):
    return run_points(t).groupBy("run_id").agg(F.max("date").alias("generated_at")).withColumn(
        "horizon", F.when(F.substring("run_id", 2, 4).cast("int") % 2 == 0, "day").otherwise("month")).withColumn(
        "state", F.when(c("run_id").startswith("R"), "draft").otherwise("published"))


def active(t):
    return t.points.where("route_id < 'r4'").select("route_id").distinct().select("route_id", F.lit("month").alias("horizon"), F.lit("A1999").alias("run_id"))


@query("active_run_resolution", "J28", f"""WITH {RUN_SQL}, nw AS (SELECT route_id, arg_max(run_id, (generated_at, run_id)) AS run_id FROM (SELECT DISTINCT run_id, route_id FROM pt) JOIN runs USING (run_id) WHERE horizon='month' AND state='published' GROUP BY ALL)
SELECT route_id, coalesce(act.run_id, nw.run_id) AS run_id, CASE WHEN act.run_id IS NOT NULL THEN 'active_pointer' ELSE 'newest_published' END AS basis FROM nw FULL JOIN act USING (route_id)""", "points")
def _(t):
    return V.resolve_run(runs(t), run_points(t), active(t), "month")


@query("pointer_upsert", "J29", f"""WITH {RUN_SQL}, nw AS (SELECT DISTINCT route_id, 'month' AS horizon, 'N2000' AS run_id FROM points WHERE route_id BETWEEN 'r2' AND 'r6')
SELECT route_id, horizon, coalesce(nw.run_id, act.run_id) AS run_id FROM act FULL JOIN nw USING (route_id, horizon)""", "points")
def _(t):
    new = t.points.where("route_id BETWEEN 'r2' AND 'r6'").select("route_id").distinct().select("route_id", F.lit("month").alias("horizon"), F.lit("N2000").alias("run_id"))
    return V.activate(active(t), new)


@query("latest_complete_runs", "J30", f"""WITH {RUN_SQL}, ok AS (SELECT run_id FROM pt GROUP BY run_id HAVING count(DISTINCT route_id)=10 AND count(*) % 2=0) SELECT route_id, horizon, arg_max(run_id, (generated_at, run_id)) AS run_id FROM (SELECT DISTINCT run_id, route_id FROM pt) JOIN runs USING (run_id) SEMI JOIN ok USING (run_id) WHERE state='published' GROUP BY ALL""", "points")
def _(t):
    ok = run_points(t).groupBy("run_id").agg(F.count_distinct("route_id").alias("d"), F.count(F.lit(1)).alias("n")).where("d = 10 AND n % 2 = 0")
    return V.latest_complete_runs(runs(t), run_points(t), ok)


ESTIMATE_SQL = """pr AS (SELECT p_type || '/' || p_brand || '/' || p_partkey//100 AS route, p_size AS pid, DATE '2024-01-01' + CAST(p_size * 3 % 10 AS INT) AS vf, DATE '2024-01-01' + CAST(p_size * 3 % 10 + 20 AS INT) AS vt, p_size % 3 AS wm, count(*) AS cyc FROM part GROUP BY ALL),
 fit AS (SELECT route, d.date, pid, cyc FROM pr, (SELECT DISTINCT date FROM validations) d WHERE (isodow(d.date)-1+wm) % 4=0 AND d.date BETWEEN vf AND vt), one AS (SELECT route, date, min(pid) AS pid, min(cyc) AS cycle FROM fit GROUP BY ALL HAVING count(*)=1)"""


@query("service_estimate", "J32", f"""WITH {ESTIMATE_SQL} SELECT a.route, a.date, a.cycle, list_transform(range(24), lambda h: (a.pid*7+h) % 5 + (CASE WHEN h<4 THEN (b.pid*7+h+24) % 5 ELSE 0 END)) AS departures FROM one a JOIN one b ON b.route=a.route AND b.date=a.date-1""", "validations")
def _(t):
    route = F.concat_ws("/", "p_type", "p_brand", F.floor(c("p_partkey") / 100).cast("string"))
    g = t.part.groupBy(route.alias("route"), c("p_size").alias("pid")).agg(F.count(F.lit(1)).alias("cycle"))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda w: F.when((w + c("pid") % 3) % 4 == 0, w))
    starts = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda h: F.when(h < 28, (c("pid") * 7 + h) % 5).otherwise(0))
    start = F.date_add(F.lit(date(2024, 1, 1)), (c("pid") * 3 % 10).cast("int"))
    profiles = g.select("route", "cycle", F.array_compact(days).alias("weekdays"), starts.alias("starts"), start.alias("valid_from"), F.date_add(start, 20).alias("valid_to"))
    return V.service_estimate(profiles, t.validations.select("date").distinct())


SNAP_SQL = """sn AS (SELECT run_id, route_id, stop_id, bucket, target, count(*) AS sources, CASE WHEN count(*)>1 AND target='occupancy' THEN 'target cannot be summed' WHEN count(*)>1 AND count(*) FILTER (d IS NULL)>0 THEN 'unspecified and explicit directions overlap' END AS conflict, sum(predicted) AS sp, min(predicted) AS mp, min(lower) AS lo, max(upper) AS up, min(capacity) AS cp, min(d) AS d0
  FROM (SELECT *, CASE WHEN stop_id % 13<>0 THEN direction END AS d FROM points) GROUP BY run_id, route_id, stop_id, bucket, target),
 snap AS (SELECT run_id, route_id, stop_id, bucket, target, sources, CASE WHEN conflict IS NULL THEN CASE WHEN sources=1 THEN mp ELSE sp END END AS predicted, CASE WHEN sources=1 THEN lo END AS lower, CASE WHEN sources=1 THEN up END AS upper, CASE WHEN sources=1 THEN cp END AS capacity, CASE WHEN sources=1 THEN d0 END AS direction, conflict FROM sn)"""


def snapshot(t):
    pts = t.points.withColumn("direction", F.when(c("stop_id") % 13 != 0, c("direction")))
    return V.forecast_snapshot(pts, PK, strict=False)


@query("forecast_snapshot", "A45", f"WITH {SNAP_SQL} SELECT run_id, route_id, stop_id, bucket, target, sources, round(predicted,6) AS predicted, round(lower,6) AS lower, round(upper,6) AS upper, capacity, direction, conflict FROM snap", "points")
def _(t):
    return rounded_all(snapshot(t))


@query("stop_loads", "A46", f"WITH {SNAP_SQL} SELECT run_id, route_id, stop_id, round(sum(predicted),6) AS predicted, count(*) AS buckets, CASE WHEN count(*)=1 AND max(capacity)>0 THEN round(sum(predicted)/max(capacity)*100,6) END AS load_percent FROM snap WHERE target='validation_count' GROUP BY ALL", "points")
def _(t):
    return rounded_all(V.stop_loads(snapshot(t).where("target = 'validation_count'"), ["run_id", "route_id", "stop_id"]))


@query("snapshot_peaks", "A46", f"WITH {SNAP_SQL} SELECT run_id, route_id, stop_id, max(predicted) AS peak_passengers, CASE WHEN count(*) FILTER (capacity IS NULL OR capacity<=0)=0 THEN round(max(predicted/capacity*100),6) END AS peak_load_percent FROM snap WHERE sources=1 GROUP BY ALL", "points")
def _(t):
    return rounded_all(V.peaks(snapshot(t).where("sources = 1"), ["run_id", "route_id", "stop_id"]))


@query("what_if", "F19", f"WITH {SNAP_SQL}, l AS (SELECT run_id, route_id, stop_id, bucket, predicted, predicted/nullif(capacity,0)*100 AS lp FROM snap WHERE sources=1) SELECT run_id, route_id, stop_id, bucket, predicted, round(lp,6) AS load_percent, round(predicted*1.12::DOUBLE,6) AS scenario_predicted, round(lp*1.12::DOUBLE/1.26::DOUBLE,6) AS scenario_load_percent, round(predicted*0.12::DOUBLE,6) AS passenger_delta, round(26.0::DOUBLE,6) AS capacity_delta FROM l", "points")
def _(t):
    one = snapshot(t).where("sources = 1").select(*PK, "predicted", F.try_divide("predicted", "capacity").alias("x")).withColumn(
        "load_percent", c("x") * 100).drop("x")
    return rounded_all(V.what_if(one, 12, 2, -10))


@query("daily_rows", "A44", "SELECT route, date, CAST(sum(boardings) AS BIGINT) AS boardings FROM hourly_dense GROUP BY ALL", "hourly_dense")
def _(t):
    return V.to_daily(t.hourly_dense, ["route"], "boardings")


@query("route_stop_order", "A47", "SELECT route, stop_id, min(seq) AS sequence, any_value(name) AS name FROM stop_times JOIN stops USING (stop_id) GROUP BY ALL", "stop_times stops")
def _(t):
    return V.route_stops(t.stop_times, t.stops).select("route", "stop_id", "sequence", "name")


@query("limit_guard", "T6", "SELECT route_id, count(*) AS points FROM points GROUP BY ALL", "points")
def _(t):
    return V.bounded(t.points.groupBy("route_id").agg(F.count(F.lit(1)).alias("points")), 366)


SHARE_SQL = """cells AS (SELECT route, CAST(isodow(date)-1 AS INT) AS dow, hour, stop_no AS stop_id, direction, sum(value) AS v FROM validations GROUP BY ALL), shares AS (SELECT route, dow, hour, stop_id, direction, v/sum(v) OVER (PARTITION BY route, dow, hour) AS share FROM cells)"""


def shares(t):
    rows = t.validations.select("route", "date", "hour", c("stop_no").alias("stop_id"), "direction", c("value").alias("predicted"))
    return V.planning_shares(rows)


@query("planning_shares", "A41", f"WITH {SHARE_SQL} SELECT route, dow, hour, stop_id, direction, round(share,6) AS share FROM shares", "validations")
def _(t):
    return rounded_all(shares(t))


PROJ_SQL = """pf AS (SELECT route, isodow(date)-1 AS dow, hour, avg(boardings) AS p FROM hourly_dense GROUP BY ALL), gd AS (SELECT route, date+1 AS date, hour FROM hourly_dense), pj AS (SELECT g.route, g.date, g.hour, CAST(isodow(g.date)-1 AS INT) AS dow, coalesce(h.boardings, pf.p)::DOUBLE AS value, h.boardings IS NULL AS projected FROM gd g LEFT JOIN hourly_dense h USING (route,date,hour) LEFT JOIN pf ON pf.route=g.route AND pf.hour=g.hour AND pf.dow=isodow(g.date)-1)"""


def projected(t):
    rows = t.hourly_dense.withColumnRenamed("boardings", "value")
    grid = t.hourly_dense.select("route", F.date_add("date", 1).alias("date"), "hour")
    return V.project_profile(rows, grid).withColumn("value", c("value").cast("double"))


@query("projected_profile", "A43", f"WITH {PROJ_SQL} SELECT route, date, hour, dow, round(value,6) AS value, projected FROM pj", "hourly_dense")
def _(t):
    return rounded_all(projected(t))


def plan_sql(show: str, filtered: bool) -> str:
    unknown = "0.0::DOUBLE" if filtered else "ru"
    return f"""WITH {SHARE_SQL}, {PROJ_SQL}, kn AS (SELECT * FROM shares WHERE stop_id<9), cv AS (SELECT route, dow, hour, sum(share) AS s FROM kn GROUP BY ALL), tt AS (SELECT pj.route, date, sum(value) AS rb, sum(greatest(value*(1-coalesce(s,0)),0)) AS ru FROM pj LEFT JOIN cv USING (route,dow,hour) GROUP BY ALL),
 ce AS (SELECT pj.route, date, stop_id, direction, sum(value*share) AS b FROM pj JOIN kn USING (route,dow,hour) GROUP BY ALL), vs AS (SELECT route, date, sum(b) AS b, count(*) AS n FROM ce WHERE {show} GROUP BY ALL)
SELECT tt.route, date AS bucket, round(rb,6) AS route_baseline, round(ru,6) AS route_unknown, coalesce(n,0) AS cells, round(coalesce(b,0)+{unknown},6) AS baseline, round({unknown},6) AS unallocated FROM tt LEFT JOIN vs USING (route,date)"""


def plan(t, stop=None, direction=None):
    catalog = t.validations.where("stop_no < 9").select("route", c("stop_no").alias("stop_id"), "direction")
    return rounded_all(V.planning_forecast(projected(t), shares(t), c("date"), catalog, stop, direction))


@query("planning_allocation", "A42", plan_sql("true", False), "validations hourly_dense")
def _(t):
    return plan(t)


@query("planning_filtered", "A42", plan_sql("stop_id=4 AND direction=0", True), "validations hourly_dense")
def _(t):
    return plan(t, 4, 0)


# Monthly planning buckets per route with per-stop rows.
BUCK_SQL = """sp AS (SELECT route_id, bucket, stop_id, direction, sum(predicted) AS baseline, sum(predicted)*1.25::DOUBLE AS scenario, day(last_day(bucket))*24 AS hours FROM points GROUP BY ALL), bp AS (SELECT route_id, bucket, hours, sum(baseline) AS baseline, sum(scenario) AS scenario FROM sp GROUP BY ALL)"""


def spatial(t):
    hours = F.dayofmonth(F.last_day("bucket")) * 24
    return t.points.groupBy("route_id", "bucket", "stop_id", "direction").agg(F.sum("predicted").alias("baseline")).withColumn(
        "scenario", c("baseline") * 1.25).withColumn("hours", hours)


def buckets(t):
    return spatial(t).groupBy("route_id", "bucket", "hours").agg(F.sum("baseline").alias("baseline"), F.sum("scenario").alias("scenario"))


@query("planning_insights", "A50 F20", f"""WITH {BUCK_SQL}, pk AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY scenario DESC, bucket) AS r FROM bp), bs AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY s DESC, stop_id, direction) AS r FROM (SELECT route_id, stop_id, direction, sum(scenario) AS s FROM sp GROUP BY ALL))
SELECT route_id, (SELECT round(sum(scenario),6) FROM bp WHERE bp.route_id=pk.route_id) AS total, bucket AS peak_bucket, round(scenario,6) AS peak_count, round(scenario/hours,6) AS peak_rate, bs.stop_id AS busiest_stop, round(bs.s,6) AS busiest_count FROM pk JOIN bs USING (route_id) WHERE pk.r=1 AND bs.r=1""", "points")
def _(t):
    return rounded_all(V.insights(buckets(t), spatial(t), ["route_id"]))


@query("hot_spots", "T2", f"WITH {BUCK_SQL} SELECT route_id, bucket, stop_id, direction, baseline, scenario, CAST(hours AS INT) AS hours, round(scenario/hours,6) AS rate FROM sp WHERE scenario/hours >= 0.05 ORDER BY scenario/hours DESC, bucket, stop_id, direction LIMIT 5", "points")
def _(t):
    return rounded_all(V.hot_spots(spatial(t), 0.05, 5))


@query("range_totals", "A51", f"""WITH {BUCK_SQL}, r AS (SELECT route_id, DATE '1997-03-01' AS a, max(bucket) AS b FROM bp GROUP BY ALL) SELECT bp.route_id, a AS "from", b AS "to", count(*) AS buckets, sum(baseline) AS baseline, round(sum(scenario),6) AS scenario FROM bp JOIN r USING (route_id) WHERE bucket BETWEEN a AND b GROUP BY ALL""", "points")
def _(t):
    return rounded_all(V.range_totals(buckets(t), date(1997, 3, 1), date(1980, 1, 1), ["route_id"]))


BUSY_SQL = """dp AS (SELECT r.route, h.hour, (h.hour*(length(r.route)+2)) % 7 + CASE WHEN h.hour BETWEEN 6 AND 20 THEN 2 ELSE 0 END AS departures FROM (SELECT DISTINCT route FROM hourly_dense WHERE route<>'view') r CROSS JOIN (SELECT CAST(range AS INT) AS hour FROM range(24)) h),
 x AS (SELECT h.route, h.date, h.hour, h.boardings, dp.departures FROM hourly_dense h LEFT JOIN dp USING (route,hour)), y AS (SELECT *, count(*) OVER w AS n, sum(boardings) OVER w AS b, CASE WHEN count(departures) OVER w=3 THEN sum(departures) OVER w END AS sc, count(*) FILTER (departures>0) OVER w AS bz FROM x WINDOW w AS (PARTITION BY route, date ORDER BY hour ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 z AS (SELECT *, CASE WHEN sc IS NOT NULL AND bz>=3 AND sc>=6 THEN b/sc END AS pr FROM y WHERE n=3), k AS (SELECT *, row_number() OVER (PARTITION BY route, date ORDER BY pr IS NOT NULL DESC, pr DESC, b DESC, hour) AS r FROM z),
 pk AS (SELECT *, row_number() OVER (PARTITION BY route, date ORDER BY boardings DESC, hour) AS r, sum(boardings) OVER (PARTITION BY route, date) AS dt FROM x),
 bw AS (SELECT k.route, k.date, k.hour AS window_start, k.hour+3 AS window_end, CAST(k.b AS BIGINT) AS window_boardings, CASE WHEN k.pr IS NOT NULL THEN CAST(k.sc AS BIGINT) END AS scheduled_departures, k.pr AS boardings_per_departure, pk.hour AS peak_hour, pk.boardings AS peak_boardings, coalesce(k.b/nullif(pk.dt,0),0) AS window_share FROM k JOIN pk USING (route,date) WHERE k.r=1 AND pk.r=1)"""


def windows(t):
    dep = t.hourly_dense.where("route <> 'view'").select("route", "hour").distinct().withColumn(
        "departures", c("hour") * (F.length("route") + 2) % 7 + F.when(c("hour").between(6, 20), 2).otherwise(0))
    return V.busiest_window(t.hourly_dense, dep)


@query("busiest_window", "W23", f"WITH {BUSY_SQL} SELECT route, date, window_start, window_end, window_boardings, scheduled_departures, round(boardings_per_departure,6) AS boardings_per_departure, peak_hour, peak_boardings, round(window_share,6) AS window_share FROM bw", "hourly_dense")
def _(t):
    return rounded_all(windows(t))


@query("route_priority", "T3", f"WITH {BUSY_SQL} SELECT date, route, CAST(row_number() OVER (PARTITION BY date ORDER BY boardings_per_departure DESC NULLS LAST, window_boardings DESC, route) AS INT) AS rank FROM bw", "hourly_dense")
def _(t):
    return V.rank_routes(windows(t), ["date"]).select("date", "route", "rank")


@query("service_scenario", "F18", f"""WITH {BUSY_SQL} SELECT route, date, window_boardings, round(10.0::DOUBLE,6) AS baseline_departures, round(14.0::DOUBLE,6) AS scenario_departures, round(120/14.0::DOUBLE,6) AS scenario_headway, round(12.0::DOUBLE,6) AS extra_departures, round(window_boardings/30.0::DOUBLE,6) AS baseline_per_departure, round(window_boardings/42.0::DOUBLE,6) AS scenario_per_departure, round(100*(1-10/14.0::DOUBLE),6) AS reduction_percent FROM bw""", "hourly_dense")
def _(t):
    out = V.simulate_service(windows(t), 12, 60, 2, 2)
    return rounded_all(out.select("route", "date", "window_boardings", "baseline_departures", "scenario_departures", "scenario_headway", "extra_departures",
                                  "baseline_per_departure", "scenario_per_departure", "reduction_percent"))


@query("pressure_tiers", "F17", f"""WITH {BUSY_SQL}, m AS (SELECT date, median(boardings_per_departure) AS md FROM bw GROUP BY ALL) SELECT route, date, CASE WHEN boardings_per_departure IS NULL OR md<=0 THEN 'unknown' WHEN boardings_per_departure>=1.5*md THEN 'high' WHEN boardings_per_departure>=1.15*md THEN 'elevated' ELSE 'regular' END AS tier FROM bw JOIN m USING (date)""", "hourly_dense")
def _(t):
    w = windows(t)
    medians = w.groupBy("date").agg(F.median("boardings_per_departure").alias("m"))
    return w.join(medians, "date").select("route", "date", V.pressure_tier(c("boardings_per_departure"), c("m")).alias("tier"))


@query("selection_checks", "P23", """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS a, CASE WHEN l_partkey % 9=0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) - 5 END AS b, CASE l_linenumber % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'week' END AS h FROM lineitem)
SELECT h AS horizon, CASE WHEN h='week' THEN 'unsupported horizon' WHEN b IS NULL THEN 'start and end must be supplied together' WHEN b-a<=0 OR b-a > CASE h WHEN 'day' THEN 1 WHEN 'month' THEN 31 ELSE 366 END THEN 'window must be positive and within the horizon limit' END AS problem, count(*) AS rows FROM s GROUP BY ALL""")
def _(t):
    a = F.to_date("l_shipdate")
    n = c("l_linenumber") % 4
    rows = t.lineitem.select(a.alias("a"), F.when(c("l_partkey") % 9 != 0, F.date_add(a, (c("l_quantity") - 5).cast("int"))).alias("b"),
                             F.when(n == 0, "day").when(n == 1, "month").when(n == 2, "year").otherwise("week").alias("horizon"))
    return rows.select("horizon", V.selection_problem(c("a"), c("b"), c("horizon")).alias("problem")).groupBy("horizon", "problem").agg(F.count(F.lit(1)).alias("rows"))


@query("stop_bearings", "W25", """WITH p AS (SELECT route, trip_id, seq, stop_id, floor(lat*20)/20 AS lat, floor(lon*20)/20 AS lon FROM stop_times JOIN stops USING (stop_id)), f AS (SELECT a.trip_id, a.seq, a.lat, a.lon, (SELECT arg_min((b.lat,b.lon), b.seq) FROM p b WHERE b.trip_id=a.trip_id AND b.seq>a.seq AND (b.lat<>a.lat OR b.lon<>a.lon)) AS nx, (SELECT arg_max((b.lat,b.lon), b.seq) FROM p b WHERE b.trip_id=a.trip_id AND b.seq<a.seq AND (b.lat<>a.lat OR b.lon<>a.lon)) AS pv FROM p a),
 g AS (SELECT trip_id, seq, CASE WHEN nx IS NOT NULL THEN lat WHEN pv IS NOT NULL THEN pv[1] END AS y1, CASE WHEN nx IS NOT NULL THEN lon WHEN pv IS NOT NULL THEN pv[2] END AS x1, CASE WHEN nx IS NOT NULL THEN nx[1] ELSE lat END AS y2, CASE WHEN nx IS NOT NULL THEN nx[2] ELSE lon END AS x2 FROM f)
SELECT trip_id, seq, round((degrees(atan2((x2-x1)*cos(radians((y1+y2)/2)), y2-y1))+360) % 360,4) AS bearing FROM g""", "stop_times stops")
def _(t):
    rows = t.stop_times.join(t.stops, "stop_id").select("trip_id", "seq", (F.floor(c("lat") * 20) / 20).alias("lat"), (F.floor(c("lon") * 20) / 20).alias("lon"))
    rows = t.spread(rows, "lineitem", "trip_id")
    return V.stop_bearings(rows, ["trip_id"], "seq").select("trip_id", "seq", rnd("bearing", 4).alias("bearing"))


@query("direction_names", "W26", "SELECT trip_id, direction, arg_max(name, seq) AS terminal FROM stop_times JOIN stops USING (stop_id) GROUP BY ALL", "stop_times stops")
def _(t):
    return V.direction_names(t.stop_times.join(t.stops, "stop_id"), ["trip_id", "direction"], "seq")


@query("natural_route_order", "T1", """WITH r AS (SELECT DISTINCT CASE WHEN p_size % 4=0 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS route FROM part) SELECT route, row_number() OVER (ORDER BY TRY_CAST(route AS BIGINT) IS NULL, TRY_CAST(route AS BIGINT), route) AS position FROM r""")
def _(t):
    from pyspark.sql import Window
    names = t.part.select(F.when(c("p_size") % 4 == 0, c("p_type")).otherwise(c("p_size").cast("string")).alias("route")).distinct()
    ranked = V.natural_sort(names, "route").withColumn("position", F.row_number().over(Window.orderBy(*V.natural_key("route"))).cast("bigint"))
    return ranked


@query("demand_mass", "A52", "SELECT strftime(v.date,'%Y-%m') AS month, v.route, v.hour, v.k AS stop_id, round(sum(v.value),4) AS mass, count(*) FILTER (s.lat IS NULL) AS unlocated_rows FROM validations v LEFT JOIN (SELECT * FROM stops WHERE stop_id % 7<>0) s ON s.stop_id=v.k GROUP BY ALL", "validations stops")
def _(t):
    pred = t.validations.select("date", "route", "hour", c("k").cast("bigint").alias("stop_id"), c("value").alias("predicted"))
    return V.demand_mass(pred, t.stops.where("stop_id % 7 <> 0")).withColumn("stop_id", c("stop_id").cast("int")).withColumn("mass", rnd("mass", 4))


@query("source_switches", "F24", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 1 = 1 THEN 'calendar' END, CASE WHEN p_size & 2 = 2 THEN 'weather' END, CASE WHEN p_size & 4 = 4 THEN 'traffic' END, CASE WHEN p_size & 8 = 8 THEN 'news' END], lambda x: x IS NOT NULL), ',') AS sources FROM part""")
def _(t):
    return t.part.select("p_partkey", F.array_join(V.enabled_sources(c("p_size"), ["calendar", "weather", "traffic", "news"]), ",").alias("sources"))


@query("scenario_mix", "M24", f"""WITH {BUCK_SQL}, br AS (SELECT route_id, bucket, baseline AS base, baseline*1.2::DOUBLE AS weather, baseline+hours/10.0::DOUBLE AS traffic FROM bp), r AS (SELECT route_id, bucket, (base*0.5+weather*0.25+traffic*0.25)/base AS ratio FROM br)
SELECT sp.route_id, sp.bucket, sp.stop_id, sp.direction, sp.baseline, round(ratio,6) AS ratio, round(sp.baseline*ratio,6) AS scenario FROM sp JOIN r USING (route_id,bucket)""", "points")
def _(t):
    b = buckets(t).select("route_id", "bucket", c("baseline").alias("base"), (c("baseline") * 1.2).alias("weather"), (c("baseline") + c("hours") / 10.0).alias("traffic"))
    weights = V.normalised_weights({"weather": 0.5, "traffic": 0.5})
    out = M.scenario_mix(spatial(t).drop("scenario", "hours"), b, weights, ["route_id", "bucket"])
    return rounded_all(out.select("route_id", "bucket", "stop_id", "direction", "baseline", "ratio", "scenario"))
