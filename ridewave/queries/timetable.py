"""Timetable, enrolment, assignment jobs, calibration and audits."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ridewave.functions.clock import clock_seconds
from ridewave.functions.clock import wall
from ridewave.operators import audits as A
from ridewave.operators import joins as J
from ridewave.operators import mapping as M
from ridewave.queries.base import big, query, rnd
from ridewave.queries.scoring import rounded_all
from ridewave.sources import timetable as G

c = F.col
DAY0 = "date_diff('day', DATE '1970-01-01', service_day)*86400"
ABS_SQL = f"""asp AS (SELECT trip_id, duty, route, direction, service_day, {DAY0}+first_clock AS first_clock, {DAY0}+last_clock AS last_clock FROM trip_spans),
 ast AS (SELECT trip_id, duty, direction, seq, stop_id, {DAY0}+clock AS clock FROM stop_times),
 en AS (SELECT v.event_id, count(a.trip_id) AS trips, CASE WHEN count(a.trip_id)=1 THEN max(a.trip_id) END AS trip_id FROM validations v LEFT JOIN asp a ON a.duty=v.device AND v.sec>=a.first_clock AND v.sec<=a.last_clock GROUP BY ALL)"""
USES = "validations stop_times trip_spans"


def spans(t):
    # read several times by each query
    return M.absolute(t.once("trip spans", lambda: t.trip_spans))


def clocks(t):
    return M.absolute(t.stop_times, columns=["clock"])


def nested(t):
    return G.nest_trips(clocks(t), ["trip_id", "direction"])


def events(t):
    return t.validations.withColumn("duty", c("device"))


@query("nested_timetable", "S8", """SELECT trip_id, direction, list(clock ORDER BY seq) AS clocks, list(stop_id ORDER BY seq) AS stop_ids FROM stop_times
 WHERE route IN ('1-URGENT','3-MEDIUM') GROUP BY ALL""", "stop_times")
def _(t):
    kept = t.stop_times.where(c("route").isin("1-URGENT", "3-MEDIUM"))
    return G.nest_trips(kept, ["trip_id", "direction"])


# Text clocks with some broken shapes.
@query("service_clocks", "F8", """SELECT trip_id, seq, CASE WHEN trip_id % 17 = 0 THEN NULL ELSE CAST(clock AS INT) END AS seconds FROM stop_times""", "stop_times")
def _(t):
    k = c("clock")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.concat_ws(":", two(F.floor(k / 3600)), two(F.floor(k / 60) % 60), two(k % 60))
    broken = F.concat_ws(":", two(F.floor(k / 3600)), F.lit("61"), F.lit("00"))
    return t.stop_times.select("trip_id", "seq", clock_seconds(F.when(c("trip_id") % 17 == 0, broken).otherwise(text)).alias("seconds"))


@query("duty_components", "F10", """SELECT o_orderkey AS trip_id, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey//10 AS VARCHAR) END AS duty FROM orders""")
def _(t):
    text = F.concat_ws("_", F.lit("7"), F.lit("12"), c("o_orderkey"), F.floor(c("o_custkey") / 10).cast("string"))
    odd = F.concat_ws("_", F.lit("7"), c("o_orderkey"), F.lit("x"))
    return t.orders.select(c("o_orderkey").alias("trip_id"), G.duty_component(F.when(c("o_orderkey") % 9 == 0, odd).otherwise(text)).alias("duty"))


@query("timetable_problems", "P19", """WITH st AS (SELECT trip_id, seq - CASE WHEN trip_id % 50=0 AND seq>0 THEN 1 ELSE 0 END AS seq, clock - CASE WHEN trip_id % 70=0 AND seq=1 THEN 3000 ELSE 0 END AS arrival, clock + CASE WHEN trip_id % 90=0 THEN 172800 ELSE 0 END AS departure, stop_id + CASE WHEN trip_id % 110=0 THEN 1000 ELSE 0 END AS stop_id FROM stop_times),
 p AS (SELECT trip_id, count(*) AS n, count(DISTINCT seq) AS d FROM st GROUP BY ALL), ba AS (SELECT DISTINCT trip_id FROM (SELECT *, lag(departure) OVER (PARTITION BY trip_id ORDER BY seq, clockkey) AS pd FROM (SELECT *, arrival AS clockkey FROM st)) WHERE arrival>departure OR pd>arrival)
SELECT 'unordered_stop_times' AS problem, CAST(trip_id AS VARCHAR) AS entity FROM p WHERE n<2 OR d<n UNION ALL SELECT 'clock_beyond_two_days', CAST(trip_id AS VARCHAR) FROM st WHERE departure>=172800 GROUP BY trip_id
UNION ALL SELECT DISTINCT 'unknown_stop', CAST(stop_id AS VARCHAR) FROM st WHERE stop_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'unknown_service', '5-LOW' WHERE EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT DISTINCT 'invalid_exception_type', CAST(n_nationkey % 4 AS VARCHAR) FROM nation WHERE n_nationkey % 3=0 UNION ALL SELECT DISTINCT 'duplicate_exception', CAST(n_nationkey % 4 AS VARCHAR) FROM nation""", "stop_times")
def _(t):
    tid, seq = c("trip_id"), c("seq")
    st = t.stop_times.select(
        "trip_id", (seq - F.when((tid % 50 == 0) & (seq > 0), 1).otherwise(0)).alias("seq"),
        (c("clock") - F.when((tid % 70 == 0) & (seq == 1), 3000).otherwise(0)).alias("arrival"),
        (c("clock") + F.when(tid % 90 == 0, 172800).otherwise(0)).alias("departure"),
        (c("stop_id") + F.when(tid % 110 == 0, 1000).otherwise(0)).alias("stop_id"))
    trips = t.spread(t.trips.select("trip_id", c("route").alias("service_id")), "orders", "trip_id")
    calendar = t.orders.select(c("o_orderpriority").alias("service_id")).distinct().where("service_id <> '5-LOW'")
    special = t.nation.select((c("n_nationkey") % 4).cast("string").alias("service_id"), F.lit("2024-01-01").alias("date"),
                              F.when(c("n_nationkey") % 3 == 0, "9").otherwise("1").alias("exception_type"))
    found = G.validate_timetable(trips, st, calendar, special, t.stops)
    return found.where("problem <> 'backward_clock'")


@query("split_trips", "P24", "SELECT trip_id, CASE WHEN last_clock+1800 < 43200 THEN 'early' WHEN first_clock-1800 >= 43200 THEN 'late' ELSE 'crossing' END AS part FROM trip_spans", "trip_spans")
def _(t):
    return G.split_trips(t.trip_spans, F.lit(43200)).select("trip_id", "part")


# Calendar of five services: digit of the priority decides weekdays and range.
CALENDAR_SQL = """sv AS (SELECT DISTINCT o_orderpriority AS service_id, CAST(substr(o_orderpriority,1,1) AS INT) AS dg FROM orders), dd AS (SELECT DISTINCT date FROM validations),
 fl AS (SELECT service_id, date, true AS f FROM sv, dd WHERE (dg + isodow(date)-1) % 3 <> 0 AND date <= DATE '2024-01-30' - dg), sp AS (SELECT service_id, date, (dg+day(date)) % 2 = 0 AS s FROM sv, dd WHERE (dg*3+day(date)) % 11 = 0),
 act AS (SELECT service_id, date AS service_day FROM fl FULL JOIN sp USING (service_id, date) WHERE coalesce(s, f))"""


def calendar(t):
    dg = F.substring("service_id", 1, 1).cast("int")
    sv = t.orders.select(c("o_orderpriority").alias("service_id")).distinct().withColumn("dg", dg)
    flags = F.array(*[((c("dg") + w) % 3 != 0).cast("int") for w in range(7)])
    cal = sv.select("service_id", flags.alias("weekdays"), F.lit(date(2024, 1, 1)).alias("start_date"),
                    F.date_sub(F.lit(date(2024, 1, 30)), c("dg")).alias("end_date"))
    days = t.validations.select("date").distinct()
    hits = F.filter(F.sequence(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 30))), lambda d: (c("dg") * 3 + F.dayofmonth(d)) % 11 == 0)
    special = sv.withColumn("date", F.explode(hits)).select(
        "service_id", "date", F.when((c("dg") + F.dayofmonth("date")) % 2 == 0, "1").otherwise("2").alias("exception_type"))
    return cal, special, days


@query("active_trips", "J19", f"""WITH {CALENDAR_SQL}, d2 AS (SELECT date AS day, date AS service_day FROM dd UNION ALL SELECT date, date-1 FROM dd)
SELECT day, service_day, service_id, count(*) AS trips FROM d2 JOIN act USING (service_day) JOIN orders ON o_orderpriority=service_id GROUP BY ALL""", "validations")
def _(t):
    cal, special, days = calendar(t)
    trips = t.trips.select("trip_id", c("route").alias("service_id"))
    return G.active_trips(trips, cal, special, days).groupBy("day", "service_day", "service_id").agg(F.count(F.lit(1)).alias("trips"))


@query("donor_day_transfer", "J20", f"""WITH {CALENDAR_SQL}, ds AS (SELECT DISTINCT o_custkey//10 AS duty, o_orderpriority AS service_id FROM orders), ty AS (SELECT *, CASE WHEN isodow(service_day)<6 THEN 0 WHEN isodow(service_day)=6 THEN 1 ELSE 2 END AS day_type FROM act),
 off AS (SELECT DISTINCT duty, service_day AS donor, day_type FROM ds JOIN ty USING (service_id)), tg AS (SELECT date AS service_day, CASE WHEN isodow(date)<6 THEN 0 WHEN isodow(date)=6 THEN 1 ELSE 2 END AS day_type FROM dd),
 wt AS (SELECT d.duty, tg.* FROM (SELECT DISTINCT duty FROM ds) d, tg WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.duty=d.duty AND off.donor=tg.service_day)),
 rk AS (SELECT wt.duty, wt.service_day, donor, row_number() OVER (PARTITION BY wt.duty, wt.service_day ORDER BY abs(date_diff('day', wt.service_day, donor)), donor>wt.service_day, donor) AS r FROM wt JOIN off USING (duty, day_type))
SELECT duty, service_day, donor, CAST(date_diff('day', service_day, donor) AS INT) AS gap_days FROM rk WHERE r=1""", "validations")
def _(t):
    from ridewave.functions.clock import day_type
    cal, special, days = calendar(t)
    on = G.active_services(cal, special, days).withColumn("day_type", day_type(c("service_day")))
    duties = t.trips.select("duty", c("route").alias("service_id")).distinct()
    targets = days.select(c("date").alias("service_day"), day_type(c("date")).alias("day_type"))
    return G.transfer_templates(duties, on, targets).select("duty", "service_day", "donor", "gap_days")


@query("trip_enrolment", "J14", f"WITH {ABS_SQL} SELECT event_id, trips, trip_id, CASE WHEN trips=0 THEN 'no_trip' WHEN trips=1 THEN 'unique' ELSE 'ambiguous' END AS status FROM en", USES)
def _(t):
    return M.enroll(events(t), spans(t)).select("event_id", "trips", "trip_id", M.enroll_status(c("trips")).alias("status"))


NEAR_SQL = f"""{ABS_SQL}, cs AS (SELECT e.event_id, s.seq, s.stop_id, s.direction, sh, abs(v.sec+sh-s.clock) AS k FROM en e JOIN validations v USING (event_id) JOIN ast s ON s.trip_id=e.trip_id, (SELECT unnest([0,-15,15]) AS sh) WHERE e.trips=1),
 bs AS (SELECT event_id, sh, min(k) AS b FROM cs GROUP BY ALL), pk AS (SELECT cs.event_id, cs.sh, min(seq) AS seq, count(*) AS ties, min(b) AS b FROM cs JOIN bs ON bs.event_id=cs.event_id AND bs.sh=cs.sh AND cs.k=bs.b GROUP BY ALL),
 ns AS (SELECT event_id, CASE WHEN bool_and(ties=1 AND b<=90) AND count(DISTINCT seq)=1 THEN CAST(max(seq) AS INT) END AS position FROM pk GROUP BY ALL)"""


@query("nearest_stable_stop", "J15", f"WITH {NEAR_SQL} SELECT event_id, position FROM ns", USES)
def _(t):
    one = M.enroll(events(t), spans(t)).where("trips = 1").join(nested(t).drop("direction"), "trip_id")
    return one.select("event_id", M.nearest_stable(c("clocks"), c("sec")).alias("position"))


@query("nearest_clock_error", "J16", f"""WITH {ABS_SQL} SELECT v.event_id, min(abs(v.sec-s.clock)) AS error FROM validations v LEFT JOIN ast s ON s.duty=v.device GROUP BY ALL""", USES)
def _(t):
    return A.nearest_errors(events(t).select("event_id", "duty", "sec"), clocks(t), ["duty"]).select("event_id", "error")


@query("previous_stop", "J17", f"""WITH {ABS_SQL} SELECT v.event_id, CAST(arg_max(s.seq, s.clock) AS INT) AS position FROM validations v JOIN en USING (event_id) JOIN ast s ON s.trip_id=en.trip_id AND s.clock<=v.sec WHERE trips=1 GROUP BY ALL""", USES)
def _(t):
    one = M.enroll(events(t), spans(t)).where("trips = 1").join(nested(t).drop("direction"), "trip_id")
    return one.select("event_id", M.previous_stop(c("clocks"), c("sec")).alias("position"))


WIN_SQL = f"""{ABS_SQL}, wn AS (SELECT a.trip_id, a.duty, a.direction, a.first_clock, a.last_clock, greatest(a.first_clock-900, coalesce((a.first_clock+(SELECT max(b.last_clock) FROM asp b WHERE b.duty=a.duty AND b.last_clock<=a.first_clock))/2, a.first_clock-900))::DOUBLE AS low,
  least(a.last_clock+900, coalesce((a.last_clock+(SELECT min(b.first_clock) FROM asp b WHERE b.duty=a.duty AND b.first_clock>=a.last_clock))/2, a.last_clock+900))::DOUBLE AS high FROM asp a)"""


@query("trip_windows", "J18", f"WITH {WIN_SQL} SELECT trip_id, low, high FROM wn", USES)
def _(t):
    return M.trip_windows(spans(t)).select("trip_id", "low", "high")


MAP_SQL = f"""{NEAR_SQL}, mp AS (SELECT v.event_id, v.route, v.date, v.hour, en.trip_id, CASE WHEN NOT EXISTS (SELECT 1 FROM asp WHERE asp.duty=v.device) THEN 'unknown_duty' WHEN trips=0 THEN 'no_trip' WHEN trips>1 THEN 'ambiguous_trip' WHEN ns.position IS NULL THEN 'stop_clock_unstable' ELSE 'assigned' END AS status, s.stop_id AS sid, s.direction AS sdir
  FROM validations v JOIN en USING (event_id) LEFT JOIN ns USING (event_id) LEFT JOIN ast s ON s.trip_id=en.trip_id AND s.seq=ns.position),
 mapped AS (SELECT event_id, route, date, hour, trip_id, status, CASE WHEN status='assigned' THEN CAST(sid AS VARCHAR) ELSE 'unallocated:' || route END AS stop_id, CASE WHEN status='assigned' THEN sdir ELSE -1 END AS stop_direction FROM mp)"""


def mapped(t):
    return M.map_events(t.validations.select("event_id", "sec", "date", "hour", "route", c("device").alias("duty")), spans(t), nested(t))


@query("event_stop_mapping", "J21", f"WITH {MAP_SQL} SELECT event_id, trip_id, status, stop_id, stop_direction FROM mapped", USES)
def _(t):
    return mapped(t).select("event_id", "trip_id", "status", "stop_id", "stop_direction")


ANCH_SQL = f"""{WIN_SQL}, e2 AS (SELECT v.event_id, v.route, v.sec, v.date, v.hour, v.stop_no AS "group", v.k % 23 = 0 AS cf, v.device, count(w.trip_id) AS trips, CASE WHEN count(w.trip_id)=1 THEN max(w.trip_id) END AS trip_id FROM validations v LEFT JOIN wn w ON w.duty=v.device AND v.sec>=w.low AND v.sec<w.high GROUP BY ALL),
 an AS (SELECT trip_id, "group", min(sec) AS t0, bool_or(cf) AS conflict FROM e2 WHERE trip_id IS NOT NULL GROUP BY ALL), s0 AS (SELECT trip_id, min(clock) AS c0 FROM ast GROUP BY ALL),
 ps AS (SELECT e.event_id, max(s.seq) AS position, max(a.t0) AS t0, bool_or(a.conflict) AS conflict, max(a.t0-s0.c0) AS shift, bool_or(s.seq IS NOT NULL) AS hit FROM e2 e JOIN an a ON a.trip_id=e.trip_id AND a."group"=e."group" JOIN s0 ON s0.trip_id=e.trip_id
   LEFT JOIN ast s ON s.trip_id=e.trip_id AND s.clock+a.t0-s0.c0 <= e.sec AND e.sec <= (SELECT max(clock) FROM ast z WHERE z.trip_id=e.trip_id)+a.t0-s0.c0 GROUP BY ALL),
 am AS (SELECT e.*, ps.t0, ps.position, CASE WHEN NOT EXISTS (SELECT 1 FROM asp WHERE asp.duty=e.device) THEN 'unknown_duty' WHEN trips=0 THEN 'no_trip' WHEN trips>1 THEN 'ambiguous_trip' WHEN conflict THEN 'identity_conflict' WHEN abs(shift)>900 THEN 'first_anchor_outside_bound' WHEN NOT hit THEN 'outside_corrected_trip_or_equal_clocks' ELSE 'assigned' END AS status FROM e2 e LEFT JOIN ps USING (event_id)),
 anchored AS (SELECT am.event_id, am.route, am.date, am.hour, am.status, CASE WHEN am.status='assigned' AND am.sec=am.t0 THEN 'mandatory_first_stop' WHEN am.status='assigned' THEN 'schedule_previous_stop' ELSE 'unallocated' END AS allocation_basis, CASE WHEN am.status='assigned' THEN CAST(s.stop_id AS VARCHAR) ELSE 'unallocated:' || am.route END AS stop_id, CASE WHEN am.status='assigned' THEN s.direction ELSE -1 END AS stop_direction FROM am LEFT JOIN ast s ON s.trip_id=am.trip_id AND s.seq=am.position)"""


def anchored(t, onsets=None):
    rows = t.validations.select("event_id", "sec", "date", "hour", "route", c("device").alias("duty"), c("stop_no").alias("group"), (c("k") % 23 == 0).alias("identity_conflict"))
    return M.map_events_anchored(rows, spans(t), nested(t), onsets=onsets)


@query("anchored_stop_mapping", "J22", f"WITH {ANCH_SQL} SELECT event_id, status, allocation_basis, stop_id, stop_direction FROM anchored", USES)
def _(t):
    return anchored(t).select("event_id", "status", "allocation_basis", "stop_id", "stop_direction")


@query("reanchored_stop_mapping", "W17 J22")
def _(t):
    base = M.enroll(events(t).select("duty", "sec", c("stop_no").alias("group")), M.trip_windows(spans(t)), second="sec", start="low", end="high", inclusive=False)
    onsets = base.where("trip_id IS NOT NULL").select("trip_id", "group", c("sec").alias("onset"))
    return anchored(t, onsets).groupBy("status", "allocation_basis").agg(F.count(F.lit(1)).alias("events"))


@query("stop_hour_counts", "A30", f"WITH {MAP_SQL} SELECT route, date, hour, stop_id, stop_direction, count(*) FILTER (status='assigned') AS weak_count, count(*)::DOUBLE AS soft_count FROM mapped GROUP BY ALL", USES)
def _(t):
    return M.stop_hour_counts(mapped(t))


@query("stop_target_export", "A31", f"WITH {MAP_SQL} SELECT CASE WHEN date < DATE '2024-01-15' THEN 'train' WHEN date < DATE '2024-01-22' THEN 'development' ELSE 'diagnostic' END AS split, NOT starts_with(stop_id,'unallocated:') AS applicable_pattern, CAST(sum(n) AS DOUBLE) AS mass, count(*) AS cells FROM (SELECT route, date, hour, stop_id, stop_direction, count(*) AS n FROM mapped GROUP BY ALL) GROUP BY ALL", USES)
def _(t):
    out = M.export_targets(M.stop_hour_counts(mapped(t)), date(2024, 1, 15), date(2024, 1, 22))
    return out.groupBy("split", "applicable_pattern").agg(F.sum("soft_count").alias("mass"), F.count(F.lit(1)).alias("cells"))


@query("flow_comparison", "A32", f"""WITH {MAP_SQL}, {ANCH_SQL[len(ABS_SQL) + 2:]}, fa AS (SELECT route, date, hour, stop_id, stop_direction, count(*)::DOUBLE AS a FROM mapped GROUP BY ALL), fb AS (SELECT route, date, hour, stop_id, stop_direction, count(*)::DOUBLE AS b FROM anchored GROUP BY ALL),
 j AS (SELECT route, date, hour, stop_id, stop_direction, coalesce(a,0) AS a, coalesce(b,0) AS b FROM fa FULL JOIN fb USING (route,date,hour,stop_id,stop_direction))
SELECT sum(a) AS mass, sum(abs(a-b))/2 AS moved, (SELECT count(*) FROM (SELECT 1 FROM j GROUP BY route,date,hour HAVING abs(sum(a)-sum(b))>1e-6)) AS broken_hours, (SELECT round(corr(a,b),6) FROM (SELECT sum(a) AS a, sum(b) AS b FROM j GROUP BY route, stop_id, stop_direction)) AS stop_correlation, round(sum(abs(a-b))/2/sum(a),6) AS moved_fraction FROM j""", USES)
def _(t):
    a = M.stop_hour_counts(mapped(t)).withColumnRenamed("soft_count", "v")
    b = M.stop_hour_counts(anchored(t)).withColumnRenamed("soft_count", "v")
    return rounded_all(A.compare_flows(a, b, ["route", "date", "hour"], ["stop_id", "stop_direction"], "v"))


@query("mapping_coverage_audit", "A33", f"""WITH {MAP_SQL}, {ANCH_SQL[len(ABS_SQL) + 2:]}, j AS (SELECT m.route, strftime(m.date,'%Y-%m') AS month, m.status='assigned' AS o, a.status='assigned' AS n FROM mapped m JOIN anchored a USING (event_id))
SELECT 'route' AS dimension, route AS member, count(*) AS total, round(count(*) FILTER (o)/count(*),6) AS old_coverage, round(count(*) FILTER (n)/count(*),6) AS new_coverage FROM j GROUP BY route
UNION ALL SELECT 'month', month, count(*), round(count(*) FILTER (o)/count(*),6), round(count(*) FILTER (n)/count(*),6) FROM j GROUP BY month""", USES)
def _(t):
    from ridewave.operators.counts import grouping_sets
    old = mapped(t).select("event_id", "route", F.date_format("date", "yyyy-MM").alias("month"), (c("status") == "assigned").alias("o"))
    both = old.join(anchored(t).select("event_id", (c("status") == "assigned").alias("n")), "event_id")
    n = F.count(F.lit(1))
    return grouping_sets(both, [["route"], ["month"]], {"total": n, "old_coverage": F.round(F.count_if("o") / n, 6),
                                                        "new_coverage": F.round(F.count_if("n") / n, 6)})


@query("notice_exclusions", "J25", """WITH nt AS (SELECT 'n' || n_nationkey AS notice_id, (SELECT list(DISTINCT route ORDER BY route) FROM validations)[n_nationkey % 5 + 1] AS route, TIMESTAMP '2024-01-02' + to_hours(n_nationkey*7) AS s,
   CASE WHEN n_nationkey % 6=0 THEN NULL ELSE TIMESTAMP '2024-01-02' + to_hours(n_nationkey*7+60) END AS e, ['none','weekends','night_after_23_30','night_after_00_20'][n_nationkey % 4 + 1] AS rec FROM nation),
 h AS (SELECT route, date, hour, CAST(date AS TIMESTAMP)+to_hours(hour) AS hs FROM hourly_dense),
 hit AS (SELECT h.route, h.date, h.hour, notice_id FROM h JOIN nt ON nt.route=h.route WHERE
  CASE rec WHEN 'none' THEN hs+INTERVAL 1 HOUR > s AND (e IS NULL OR hs < e) WHEN 'weekends' THEN isodow(date)>5 AND hs+INTERVAL 1 HOUR > s AND (e IS NULL OR hs < e)
   WHEN 'night_after_23_30' THEN (h.hour<5 OR h.hour>=23) AND (CASE WHEN h.hour<5 THEN date-1 ELSE date END + INTERVAL '23 hours 30 minutes') >= s AND (e IS NULL OR (CASE WHEN h.hour<5 THEN date-1 ELSE date END + INTERVAL '23 hours 30 minutes') < e)
   ELSE h.hour<5 AND CAST(date AS TIMESTAMP)+INTERVAL 20 MINUTE >= s AND (e IS NULL OR CAST(date AS TIMESTAMP)+INTERVAL 20 MINUTE < e) END)
SELECT h.route, h.date, h.hour, array_to_string(list(notice_id ORDER BY notice_id) FILTER (notice_id IS NOT NULL), ';') AS reasons, count(notice_id)=0 AS eligible FROM h LEFT JOIN hit USING (route,date,hour) GROUP BY ALL""", "hourly_dense")
def _(t):
    routes = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    n = c("n_nationkey")
    start = wall(datetime(2024, 1, 2)) + F.make_dt_interval(hours=n * 7)
    kinds = F.array(*[F.lit(x) for x in ("none", "weekends", "night_after_23_30", "night_after_00_20")])
    notices = t.nation.select(F.concat(F.lit("n"), n.cast("string")).alias("notice_id"), F.get(routes, n % 5).alias("route"), start.alias("start"),
                              F.when(n % 6 != 0, start + F.make_dt_interval(hours=F.lit(60))).alias("end"), F.get(kinds, n % 4).alias("recurrence"))
    out = A.apply_notices(t.hourly_dense.select("route", "date", "hour"), notices)
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query("assignment_comparison", "J26", """WITH a AS (SELECT event_id, CASE WHEN k % 7=0 THEN NULL ELSE stop_no END AS s, direction AS d FROM validations), b AS (SELECT event_id, CASE WHEN k % 5=0 THEN NULL ELSE (stop_no + CASE WHEN k%3=0 THEN 1 ELSE 0 END) % 10 END AS s, direction AS d FROM validations), j AS (SELECT a.s AS x, b.s AS y, a.d AS dx, b.d AS dy FROM a JOIN b USING (event_id))
SELECT count(*) AS events, count(*) FILTER (x IS NOT NULL AND y IS NULL) AS candidate_to_null, count(*) FILTER (x IS NULL AND y IS NOT NULL) AS null_to_candidate, count(*) FILTER (x IS NULL AND y IS NULL) AS both_null, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS comparable, count(*) FILTER (x=y AND dx=dy) AS same, round(count(*) FILTER (x=y AND dx=dy)/count(*) FILTER (x IS NOT NULL AND y IS NOT NULL),6) AS agreement FROM j""", "validations")
def _(t):
    k, s = c("k"), c("stop_no")
    a = t.validations.select(c("event_id").alias("event_key"), F.when(k % 7 != 0, s).alias("stop_id"), "direction")
    b = t.validations.select(c("event_id").alias("event_key"), F.when(k % 5 != 0, (s + F.when(k % 3 == 0, 1).otherwise(0)) % 10).alias("stop_id"), "direction")
    return rounded_all(A.compare_assignments(a, b))


@query("wrong_pair_control", "J33", """WITH m AS (SELECT DISTINCT route, duty FROM trips) SELECT route, duty, coalesce(lead(duty) OVER (PARTITION BY route ORDER BY duty), min(duty) OVER (PARTITION BY route)) AS control_key FROM m""", "trips")
def _(t):
    return A.shifted_pairs(t.trips, "duty", ["route"])


@query("circular_clock_evidence", "J34", """WITH d AS (SELECT DISTINCT duty, clock % 86400 AS dep FROM stop_times WHERE seq < 3), x AS (SELECT v.event_id, min(least(abs(ck-dep), 86400-abs(ck-dep))) AS delta FROM (SELECT *, (sod - 15 + 86400) % 86400 AS ck FROM validations) v LEFT JOIN d ON d.duty=v.device GROUP BY ALL)
SELECT event_id, delta, round(0.2::DOUBLE*ln(0.15::DOUBLE+0.85::DOUBLE*exp(-0.5::DOUBLE*pow(delta/180.0::DOUBLE,2))),6) AS evidence FROM x""", "validations stop_times")
def _(t):
    dep = t.stop_times.select("duty", (c("clock") % 86400).alias("departure"), (c("seq") < 3).alias("boardable"))
    out = A.clock_evidence(events(t).select("event_id", "duty", "sod"), dep, ["duty"])
    return out.select("event_id", big("delta").alias("delta"), rnd("evidence").alias("evidence"))


# Transitions between consecutive stop visits of a trip.
TR_SQL = """tl AS (SELECT *, lag(seq) OVER w AS pseq, lag(clock) OVER w AS pclock FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY seq)),
 tr AS (SELECT trip_id, service_day AS date, route, route || '/' || direction AS pattern_key, pseq AS from_state, seq AS to_state, CAST(seq-pseq + CASE WHEN trip_id % 9=0 THEN 1 WHEN trip_id % 31=0 THEN -2 WHEN trip_id % 37=0 THEN -1 ELSE 0 END AS BIGINT) AS steps, trip_id % 5 + 2 AS from_events, stop_id % 6 + 2 AS to_events, (trip_id % 10)/10.0::DOUBLE AS posterior,
  (stop_id % 10)/10.0::DOUBLE+0.4 AS agreement, clock-pclock AS observed_seconds, 560 AS expected_seconds, CASE WHEN duty % 12=0 THEN '' ELSE 'v' || (duty % 20) END AS vehicle_key, trip_id % 19=0 AS identity_conflict, trip_id % 23<>0 AS applicable_pattern FROM tl WHERE pseq IS NOT NULL),
 rj AS (SELECT *, CASE WHEN steps<>1 THEN 'not_adjacent' WHEN least(from_events,to_events)<3 THEN 'sparse_endpoints' WHEN posterior<0.5 THEN 'low_posterior' WHEN agreement<0.75 THEN 'scenario_disagreement' WHEN identity_conflict THEN 'identity_conflict' WHEN NOT applicable_pattern THEN 'inapplicable_pattern' WHEN vehicle_key='' THEN 'missing_vehicle' WHEN abs(observed_seconds-expected_seconds)>420 THEN 'large_local_residual' END AS reason FROM tr)"""


def transitions(t):
    from pyspark.sql import Window
    w = Window.partitionBy("trip_id").orderBy("seq")
    tid = c("trip_id")
    bump = F.when(tid % 9 == 0, 1).when(tid % 31 == 0, -2).when(tid % 37 == 0, -1).otherwise(0)
    rows = t.stop_times.withColumn("pseq", F.lag("seq").over(w)).withColumn("pclock", F.lag("clock").over(w)).where("pseq IS NOT NULL")
    return rows.select(
        "trip_id", c("service_day").alias("date"), "route", F.concat_ws("/", "route", c("direction").cast("string")).alias("pattern_key"),
        c("pseq").alias("from_state"), c("seq").alias("to_state"), (c("seq") - c("pseq") + bump).cast("bigint").alias("steps"),
        (tid % 5 + 2).alias("from_events"), (c("stop_id") % 6 + 2).alias("to_events"), ((tid % 10) / 10.0).alias("posterior"),
        ((c("stop_id") % 10) / 10.0 + 0.4).alias("agreement"), (c("clock") - c("pclock")).alias("observed_seconds"), F.lit(560).alias("expected_seconds"),
        F.when(c("duty") % 12 == 0, "").otherwise(F.concat(F.lit("v"), (c("duty") % 20).cast("string"))).alias("vehicle_key"),
        (tid % 19 == 0).alias("identity_conflict"), (tid % 23 != 0).alias("applicable_pattern"))


EDGE_SQL = f"""{TR_SQL}, f0 AS (SELECT *, median(observed_seconds) OVER (PARTITION BY pattern_key, from_state) AS m FROM rj WHERE reason IS NULL AND date < DATE '2024-01-21'), f1 AS (SELECT *, median(abs(observed_seconds-m)) OVER (PARTITION BY pattern_key, from_state) AS mad FROM f0),
 f2 AS (SELECT *, median(observed_seconds) OVER (PARTITION BY pattern_key, from_state) AS c2 FROM f1 WHERE abs(observed_seconds-m) <= greatest(30, 3*1.4826::DOUBLE*mad)),
 eg AS (SELECT pattern_key, from_state, count(*) AS support, count(DISTINCT date) AS dates, count(DISTINCT vehicle_key) AS vehicles, max(date) AS fitted_through, round(quantile_cont(observed_seconds,0.1),6) AS p10, median(observed_seconds) AS median_seconds, round(quantile_cont(observed_seconds,0.9),6) AS p90, median(abs(observed_seconds-c2)) AS mad_seconds, count(*)>=5 AND count(DISTINCT date)>=2 AND count(DISTINCT vehicle_key)>=2 AS supported FROM f2 GROUP BY ALL)"""


@query("robust_edge_fit", "A34", f"WITH {EDGE_SQL} SELECT * FROM eg", "stop_times")
def _(t):
    return rounded_all(A.fit_edges(transitions(t), date(2024, 1, 21)))


def trans_sql(dim: str, member: str) -> str:
    return f"""SELECT '{dim}' AS dimension, {member} AS member, count(*) AS transitions, count(*) FILTER (steps>0) AS moving, count(*) FILTER (steps<0) AS resets, count(*) FILTER (steps=0) AS same_visit, CAST(sum(CASE WHEN steps>0 THEN steps ELSE 0 END) AS BIGINT) AS advances,
 CAST(sum(CASE WHEN steps>0 THEN steps-1 ELSE 0 END) AS BIGINT) AS skipped, max(CASE WHEN steps>0 THEN steps-1 END) AS longest_skip, count(*) FILTER (steps>0 AND abs(observed_seconds-560)<=420) AS plausible, round(quantile_cont(CASE WHEN steps>0 THEN observed_seconds-560 END,0.1),6) AS residual_p10,
 round(quantile_cont(CASE WHEN steps>0 THEN observed_seconds-560 END,0.5),6) AS residual_p50, round(quantile_cont(CASE WHEN steps>0 THEN observed_seconds-560 END,0.9),6) AS residual_p90, round(count(*) FILTER (steps>0 AND abs(observed_seconds-560)<=420)/count(*) FILTER (steps>0),6) AS plausible_share FROM tr GROUP BY {member}"""


@query("transition_summary", "A35", f"WITH {TR_SQL} {trans_sql('route', 'route')} UNION ALL {trans_sql('pattern_key', 'pattern_key')}", "stop_times")
def _(t):
    return rounded_all(A.summarize_transitions(transitions(t), [["route"], ["pattern_key"]]))


@query("skip_histogram", "A35", f"WITH {TR_SQL} SELECT steps-1 AS skipped, count(*) AS transitions FROM tr WHERE steps>0 GROUP BY ALL", "stop_times")
def _(t):
    return A.skip_histogram(transitions(t))


@query("edge_holdout", "A36", f"""WITH {EDGE_SQL}, lt AS (SELECT * FROM tr WHERE date >= DATE '2024-01-21' AND vehicle_key<>''), fr AS (SELECT * FROM lt WHERE vehicle_key NOT IN (SELECT vehicle_key FROM rj WHERE reason IS NULL AND date < DATE '2024-01-21' AND route < '3'))
SELECT count(*) AS evaluated_rows, round(avg(abs(observed_seconds-560)),6) AS baseline_mae, round(avg(abs(observed_seconds-median_seconds)),6) AS profile_mae, (SELECT count(*) FROM lt) AS future_rows, (SELECT count(*) FROM fr) AS independent_rows FROM fr JOIN eg USING (pattern_key, from_state) WHERE supported AND date>fitted_through AND steps=1 AND NOT identity_conflict AND applicable_pattern""", "stop_times")
def _(t):
    rows = transitions(t)
    used = rows.where((c("date") < F.lit(date(2024, 1, 21))) & (c("route") < "3") & A.transition_rejection().isNull())
    return rounded_all(A.validate_holdout(rows, A.fit_edges(rows, date(2024, 1, 21)), date(2024, 1, 21), used))


@query("cohort_choice", "A37", """WITH d AS (SELECT DISTINCT date FROM validations), g AS (SELECT route, sum(boardings)/count(DISTINCT date) AS dn FROM hourly GROUP BY ALL), b AS (SELECT * FROM (VALUES ('train',DATE '2024-01-01',DATE '2024-01-13'),('development',DATE '2024-01-13',DATE '2024-01-24'),('diagnostic',DATE '2024-01-24',DATE '2024-01-29')) t(split,lo,hi)),
 f AS (SELECT split, min(d.date) FILTER (isodow(d.date)=5 AND d.date+3 < hi) AS fr, min(d.date) AS fd FROM b JOIN d ON d.date>=lo AND d.date<hi GROUP BY ALL)
SELECT split, coalesce(fr, fd) AS first_day, fr IS NOT NULL AS whole_block, (SELECT route FROM g ORDER BY dn, route LIMIT 1) AS lowest, (SELECT route FROM g ORDER BY dn DESC, route DESC LIMIT 1) AS highest FROM f""", "validations hourly")
def _(t):
    ledger = t.hourly.withColumnRenamed("boardings", "source_success")
    return A.select_cohort(ledger, [("train", date(2024, 1, 1), date(2024, 1, 13)), ("development", date(2024, 1, 13), date(2024, 1, 24)), ("diagnostic", date(2024, 1, 24), date(2024, 1, 29))])


@query("schedule_coverage", "A38", """WITH x AS (SELECT route, service_day, greatest(first_clock,0) AS a, least(last_clock,86400) AS b FROM trip_spans WHERE least(last_clock,86400)>greatest(first_clock,0)), y AS (SELECT *, coalesce(max(b) OVER (PARTITION BY route, service_day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS r FROM x)
SELECT route, service_day, count(*) AS trips, CAST(sum(greatest(b-greatest(r,a),0)) AS BIGINT) AS covered_seconds FROM y GROUP BY ALL""", "trip_spans")
def _(t):
    return G.schedule_coverage(t.trip_spans)


@query("cycle_times", "A39", """WITH ts AS (SELECT * REPLACE ((trip_id//30) % 2 AS direction) FROM trip_spans), s AS (SELECT *, lead(first_clock) OVER w AS f1, lead(last_clock) OVER w AS l1, lead(direction) OVER w AS d1, lead(first_clock,2) OVER w AS f2, lead(direction,2) OVER w AS d2 FROM ts WINDOW w AS (PARTITION BY duty % 6, service_day, route ORDER BY first_clock, trip_id)),
 cy AS (SELECT route, (f2-first_clock)/60.0::DOUBLE AS m FROM s WHERE direction<>d1 AND direction=d2 AND f1-last_clock BETWEEN 0 AND 7200 AND f2-l1 BETWEEN 0 AND 7200 AND (f2-first_clock)/60.0 BETWEEN 20 AND 240)
SELECT route, round(median(m),6) AS median, round(list_sort(list(m))[CAST(floor((count(*)-1)*0.1) AS INT)+1],6) AS p10, round(list_sort(list(m))[CAST(floor((count(*)-1)*0.9) AS INT)+1],6) AS p90, count(*) AS cycles FROM cy GROUP BY ALL""", "trip_spans")
def _(t):
    return rounded_all(G.cycle_times(
        t.trip_spans.withColumn("duty", c("duty") % 6).withColumn("direction", F.floor(c("trip_id") / 30) % 2), layover=7200))


@query("departure_histogram", "A40", """SELECT r.route, h.hour, coalesce(n,0) AS starts FROM (SELECT DISTINCT route FROM trips) r CROSS JOIN (SELECT CAST(range AS INT) AS hour FROM range(48)) h LEFT JOIN (SELECT route, CAST(first_clock//3600 AS INT) AS hour, count(*) AS n FROM trip_spans GROUP BY ALL) USING (route, hour)""", "trips trip_spans")
def _(t):
    return G.departure_histogram(t.trip_spans)


LOSS_SQL = f"""{ABS_SQL}, sh AS (SELECT unnest(range(-1800, 1801, 30)) AS shift), er AS (SELECT v.device AS duty, v.event_id, v.date, shift, least(coalesce(min(abs(v.sec-s.clock-shift)),300),300) AS e FROM validations v CROSS JOIN sh LEFT JOIN ast s ON s.duty=v.device AND abs(v.sec-s.clock-shift)<=300 GROUP BY ALL),
 ls AS (SELECT duty, shift, avg(e) AS loss, count(*) AS events FROM er GROUP BY ALL)"""


@query("shift_calibration", "A63", f"""WITH {LOSS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY duty ORDER BY loss, abs(shift), shift) AS r FROM ls), k AS (SELECT * FROM b WHERE r=1)
SELECT k.duty, CAST(k.shift AS INT) AS shift, round(k.loss,6) AS loss, k.events, CAST(min(l.shift) AS INT) AS near_low, CAST(max(l.shift) AS INT) AS near_high, count(*) AS near_count, abs(k.shift)=1800 AS at_bound FROM k JOIN ls l ON l.duty=k.duty AND l.loss<=k.loss+5 GROUP BY ALL""", USES)
def _(t):
    losses = A.calibration_losses(events(t), clocks(t), ["duty"])
    return rounded_all(A.calibrate_shift(losses, ["duty"]))


@query("guarded_shift", "A64", f"""WITH {LOSS_SQL}, ph AS (SELECT duty, date < DATE '2024-01-16' AS a, shift, avg(e) AS loss, count(*) AS n FROM er GROUP BY ALL), fb AS (SELECT *, row_number() OVER (PARTITION BY duty, a ORDER BY loss, abs(shift), shift) AS r FROM ph), fit AS (SELECT f.duty, f.a, f.shift, f.loss, f.n, (SELECT max(p.shift)-min(p.shift) FROM ph p WHERE p.duty=f.duty AND p.a=f.a AND p.loss<=f.loss+5) AS rng FROM fb f WHERE r=1),
 fu AS (SELECT duty, shift AS fs FROM (SELECT *, row_number() OVER (PARTITION BY duty ORDER BY loss, abs(shift), shift) AS r FROM ls) WHERE r=1),
 j AS (SELECT fu.duty, fs, x.shift AS sa, x.rng AS ra, coalesce(x.n,0) AS na, y.shift AS sb, y.rng AS rb, coalesce(y.n,0) AS nb, z.loss-m.loss AS gain FROM fu LEFT JOIN fit x ON x.duty=fu.duty AND x.a LEFT JOIN fit y ON y.duty=fu.duty AND NOT y.a LEFT JOIN ph z ON z.duty=fu.duty AND NOT z.a AND z.shift=0 LEFT JOIN ph m ON m.duty=fu.duty AND NOT m.a AND m.shift=x.shift),
 q AS (SELECT *, CASE WHEN na<10 OR nb<10 THEN 'insufficient_early_halves' WHEN ra>120 OR rb>120 THEN 'ambiguous_early_shift' WHEN abs(sa-sb)>60 OR abs(fs-sa)>60 THEN 'unstable_early_shift' WHEN coalesce(gain,0)<5 THEN 'no_early_validation_gain' ELSE 'accepted' END AS reason FROM j)
SELECT duty, CAST(CASE WHEN reason='accepted' THEN fs ELSE 0 END AS INT) AS shift, reason, na AS first_events, nb AS second_events, round(gain,6) AS gain FROM q""", USES)
def _(t):
    return rounded_all(A.guarded_shift(events(t), clocks(t), ["duty"], c("date") < F.lit(date(2024, 1, 16))))


@query("clock_directions", "A65", f"""WITH {ABS_SQL}, e0 AS (SELECT v.event_id, min(abs(v.sec-s.clock)) FILTER (s.direction=0) AS a, min(abs(v.sec-s.clock)) FILTER (s.direction=1) AS b FROM validations v LEFT JOIN ast s ON s.duty=v.device AND abs(v.sec-s.clock)<=100000000 GROUP BY ALL),
 tr AS (SELECT en.event_id, en.trips, a.direction AS td FROM en LEFT JOIN asp a ON a.trip_id=en.trip_id)
SELECT event_id, CASE WHEN trips=1 AND least(coalesce(a,1e9),coalesce(b,1e9))<=60 AND coalesce(a,1e9)<>coalesce(b,1e9) AND (CASE WHEN coalesce(a,1e9)<coalesce(b,1e9) THEN 0 ELSE 1 END)=td THEN td ELSE -1 END AS clock_direction FROM e0 JOIN tr USING (event_id)""", USES)
def _(t):
    return A.clock_directions(events(t).select("event_id", "duty", "sec"), spans(t), clocks(t), ["duty"]).select("event_id", "clock_direction")


@query("enrolment_stability", "A66", f"""WITH {ABS_SQL}, m AS (SELECT v.event_id, v.hour < 12 AS am, sh, count(a.trip_id) AS n, max(a.direction) AS d FROM validations v CROSS JOIN (SELECT unnest([0,-300,300,-900,900]) AS sh) LEFT JOIN asp a ON a.duty=v.device AND v.sec+sh>=a.first_clock AND v.sec+sh<=a.last_clock GROUP BY ALL),
 w AS (SELECT event_id, am, max(n) FILTER (sh=0) AS n0, bool_and(n=1) FILTER (abs(sh)<=300) AND count(DISTINCT d) FILTER (abs(sh)<=300)=1 AS s3, bool_and(n=1) AND count(DISTINCT d)=1 AS s9 FROM m GROUP BY ALL)
SELECT am, count(*) AS events, count(*) FILTER (n0=1) AS unique_trip, count(*) FILTER (n0=0) AS no_trip, count(*) FILTER (n0>1) AS ambiguous_trip, count(*) FILTER (s3) AS stable300, count(*) FILTER (s9) AS stable900 FROM w GROUP BY ALL""", USES)
def _(t):
    rows = A.enroll_stability(events(t).select("event_id", "duty", "sec", (c("hour") < 12).alias("am")), spans(t), ["duty"])
    n = c("trips")
    return rows.groupBy("am").agg(F.count(F.lit(1)).alias("events"), F.count_if(n == 1).alias("unique_trip"), F.count_if(n == 0).alias("no_trip"),
                                  F.count_if(n > 1).alias("ambiguous_trip"), F.count_if("stable300").alias("stable300"), F.count_if("stable900").alias("stable900"))


@query("direction_selection", "A67", """WITH k AS (SELECT o_custkey AS duty, CASE WHEN o_orderkey % 2=0 THEN 3 ELSE 6 END AS step, (o_orderkey//2) % 2 AS direction, min(o_totalprice)/1000 AS cost FROM orders GROUP BY ALL), p AS (SELECT duty, step, max(cost) FILTER (direction=0) AS c0, max(cost) FILTER (direction=1) AS c1 FROM k GROUP BY ALL),
 w AS (SELECT *, CASE WHEN abs(c1-c0)>1e-9 THEN CASE WHEN c1>c0 THEN 0 ELSE 1 END END AS win, abs(c1-c0)/4 AS mg FROM p), g AS (SELECT duty, count(*) FILTER (c0 IS NULL OR c1 IS NULL) AS gaps, count(*) FILTER (win IS NULL) AS tied, min(win) AS w0, max(win) AS w1, min(mg) AS lm FROM w GROUP BY ALL),
 r AS (SELECT *, CASE WHEN gaps>0 THEN 'missing_or_nonfinite_direction_cost' WHEN tied>0 THEN 'tied_costs' WHEN w0<>w1 THEN 'step_disagreement' WHEN lm<15 THEN 'insufficient_margin' ELSE 'selected' END AS reason FROM g)
SELECT duty, reason, CASE WHEN reason='selected' THEN w0 END AS direction, round(lm,7) AS least_margin FROM r""")
def _(t):
    rows = t.orders.groupBy(c("o_custkey").alias("duty"), F.when(c("o_orderkey") % 2 == 0, 3).otherwise(6).alias("step"),
                            (F.floor(c("o_orderkey") / 2) % 2).alias("direction")).agg((F.min("o_totalprice") / 1000).alias("cost")).withColumn("intervals", F.lit(4))
    return A.select_direction(rows, ["duty"]).withColumn("least_margin", rnd("least_margin", 7))


@query("bootstrap_interval", "A61", """WITH s AS (SELECT route, date, sum(value) AS s, count(value) AS n FROM validations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY route) AS k FROM s),
 d AS (SELECT k, r, unnest(range(k)) AS j FROM (SELECT DISTINCT k FROM r WHERE k>=2), (SELECT unnest(range(2000)) AS r)), w AS (SELECT k, r, CAST('0x' || substr(md5('7:' || r || ':' || j),1,8) AS BIGINT) % k AS i, count(*) AS w FROM d GROUP BY ALL),
 m AS (SELECT route, w.r, sum(w*s)/sum(w*n) AS m FROM r JOIN w ON w.k=r.k AND w.i=r.i GROUP BY ALL)
SELECT route, round(quantile_cont(m,0.025),6) AS low, round(quantile_cont(m,0.975),6) AS high, count(*) AS resamples FROM m GROUP BY route""", "validations")
def _(t):
    return rounded_all(A.cluster_bootstrap(t.validations, "date", "value", by=["route"]))


@query("paired_summary", "A62", """SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_linenumber<>7) AS paired, count(*) FILTER (l_linenumber<>7 AND l_quantity<l_partkey%50) AS wins, count(*) FILTER (l_linenumber<>7 AND l_quantity=l_partkey%50) AS ties, count(*) FILTER (l_linenumber<>7 AND l_quantity>l_partkey%50) AS losses,
 round(avg(least(CASE WHEN l_linenumber<>7 THEN l_quantity ELSE 40 END,40)),6) AS capped_a, round(avg(least(l_partkey%50,40)),6) AS capped_b FROM lineitem GROUP BY ALL""")
def _(t):
    rows = t.lineitem.select("l_returnflag", F.when(c("l_linenumber") != 7, c("l_quantity")).alias("a"), (c("l_partkey") % 50).cast("double").alias("b"))
    return rounded_all(A.paired_summary(rows, ["l_returnflag"], "a", "b", 40.0))


@query("calibration_summary", "A81", f"""WITH {LOSS_SQL}, b AS (SELECT duty, min(loss) AS fit, max(loss) FILTER (shift=0) AS zero, max(loss) FILTER (shift=600) AS wrong, max(events) AS ev FROM ls GROUP BY ALL)
SELECT duty % 3 AS band, count(*) AS groups, count(*) FILTER (zero-fit>=5) AS accepted, round(avg(zero-fit),6) AS mean_gain, round(avg(wrong-fit),6) AS wrong_key_contrast, round(avg(fit),6) AS group_mean_loss, round(sum(fit*ev)/sum(ev),6) AS event_weighted_loss FROM b GROUP BY ALL""", USES)
def _(t):
    losses = A.calibration_losses(events(t), clocks(t), ["duty"])
    rows = losses.groupBy("duty").agg(F.min("loss").alias("fitted_loss"), F.max(F.when(c("shift") == 0, c("loss"))).alias("zero_loss"),
                                      F.max(F.when(c("shift") == 600, c("loss"))).alias("wrong_loss"), F.max("events").alias("events"))
    rows = rows.withColumn("reason", F.when(c("zero_loss") - c("fitted_loss") >= 5, "accepted").otherwise("no_gain")).withColumn("band", c("duty") % 3)
    return rounded_all(A.calibration_summary(rows, ["band"]))


@query("envelope_summary", "A82", """WITH s AS (SELECT l_orderkey AS w, CASE WHEN l_linenumber%2=0 THEN 'a' ELSE 'o' END AS side, least(CASE WHEN l_partkey%11=0 THEN 45 ELSE l_quantity END,45) AS x FROM lineitem), p AS (SELECT w, avg(x) FILTER (side='a') AS am, min(x) FILTER (side='a') AS al, max(x) FILTER (side='a') AS ax, count(*) FILTER (side='a') AS an, avg(x) FILTER (side='o') AS om, min(x) FILTER (side='o') AS ol, max(x) FILTER (side='o') AS ox, count(*) FILTER (side='o') AS o_n FROM s GROUP BY ALL HAVING an>0 AND o_n>0)
SELECT count(*) AS windows, round(avg(am),6) AS assigned_mean, round(avg(om),6) AS opposite_mean, round(avg(ax-al),6) AS assigned_width, count(*) FILTER (an>1) AS assigned_ambiguous, count(*) FILTER (ax<ol) AS robust_assigned, count(*) FILTER (ox<al) AS robust_opposite FROM p""")
def _(t):
    rows = t.lineitem.select(c("l_orderkey").alias("w"), F.when(c("l_linenumber") % 2 == 0, "assigned").otherwise("opposite").alias("side"),
                             F.when(c("l_partkey") % 11 != 0, c("l_quantity")).alias("loss"))
    return rounded_all(A.envelope_summary(rows, ["w"], 45.0))


@query("uniform_control", "A83", f"""WITH {MAP_SQL}, vi AS (SELECT m.route, s.stop_id, s.direction, count(*) AS v FROM (SELECT DISTINCT route FROM mapped) m CROSS JOIN (SELECT stop_id, direction, seq FROM stop_times) s WHERE s.seq<3 GROUP BY ALL), tt AS (SELECT route, sum(v) AS t FROM vi GROUP BY ALL), ms AS (SELECT route, date, count(*) AS m FROM mapped GROUP BY ALL)
SELECT route, date, CAST(vi.stop_id AS VARCHAR) AS stop_id, direction AS stop_direction, round(m*v/t,6) AS soft_count FROM ms JOIN vi USING (route) JOIN tt USING (route)""", USES)
def _(t):
    flows = M.stop_hour_counts(mapped(t), keys=("route", "date"))
    visits = t.stop_times.select("stop_id", c("direction").alias("stop_direction"), (c("seq") < 3).alias("boardable")).join(
        t.validations.select("route").distinct(), how="cross").withColumn("stop_id", c("stop_id").cast("string"))
    return rounded_all(A.uniform_control(flows, visits, ["route", "date"], "soft_count"))


@query("trip_shapes", "A84", """WITH n AS (SELECT trip_id, direction, list(clock//200 ORDER BY seq) AS ck, list(stop_id % 2 ORDER BY seq) AS st FROM stop_times GROUP BY ALL), s AS (SELECT direction, list_transform(ck, lambda x: x-ck[1]) AS rel, st, count(*) AS trips FROM n GROUP BY ALL) SELECT direction, trips, count(*) AS shapes FROM s GROUP BY ALL""", "stop_times")
def _(t):
    rows = t.stop_times.withColumn("clock", F.floor(c("clock") / 200)).withColumn("stop_id", c("stop_id") % 2)
    shapes = G.trip_shapes(G.nest_trips(rows, ["trip_id", "direction"]))
    return shapes.groupBy("shape", "direction").agg(F.count(F.lit(1)).alias("trips")).groupBy("direction", "trips").agg(F.count(F.lit(1)).alias("shapes"))


@query("forecast_vectors", "A85", "SELECT route, date, list(boardings ORDER BY hour) AS vector FROM hourly_dense GROUP BY ALL", "hourly_dense")
def _(t):
    rows = t.hourly_dense.select("route", "date", c("hour").alias("slot"), c("boardings").alias("predicted"), F.lit("m1").alias("model_version"))
    return A.forecast_vectors(rows, ["route", "date"], 24)


@query("residual_stats", "A86", """SELECT p_type, count(*) AS sequences, count(*) FILTER (p_size%5<>0) AS feasible, round(avg(abs(p_size-25)) FILTER (p_size%5<>0),6) AS mean_abs, round(avg(CASE WHEN p_size%5<>0 THEN CASE WHEN abs(p_size-25)<=30 THEN 1 ELSE 0 END END),6) AS within30, median(abs(p_size-25)) FILTER (p_size%5<>0) AS median_abs FROM part GROUP BY ALL""")
def _(t):
    rows = t.part.select("p_type", F.when(c("p_size") % 5 != 0, c("p_size") - 25).alias("residual"))
    return rounded_all(A.residual_stats(rows, ["p_type"]))


@query("paired_dataset_check", "A87", """WITH a AS (SELECT route, stop_no, date, count(*)::DOUBLE AS v, count(*)>1 AS el FROM validations GROUP BY ALL), b AS (SELECT route, stop_no, date, count(*)::DOUBLE AS v, count(*)>2 AS el FROM validations WHERE event_id%400<>0 GROUP BY ALL)
SELECT (SELECT count(*) FROM (SELECT DISTINCT route, stop_no FROM a EXCEPT SELECT DISTINCT route, stop_no FROM b)) AS identity_differences, (SELECT count(*) FROM a FULL JOIN b USING (route,stop_no,date) WHERE a.el IS DISTINCT FROM b.el) AS mask_differences,
 (SELECT count(*) FROM (SELECT route, date, sum(v) AS x FROM a GROUP BY ALL) FULL JOIN (SELECT route, date, sum(v) AS y FROM b GROUP BY ALL) USING (route,date) WHERE abs(coalesce(x,0)-coalesce(y,0))>0.5) AS total_differences""", "validations")
def _(t):
    def cells(df, floor):
        n = F.count(F.lit(1))
        return df.groupBy("route", "stop_no", "date").agg(n.cast("double").alias("v"), (n > floor).alias("eligible"))
    return A.verify_pair(cells(t.validations, 1), cells(t.validations.where("event_id % 400 <> 0"), 2), ["route", "stop_no"], ["route", "date"], "v", 0.5)
