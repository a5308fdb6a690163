"""Counts, coverage, reconciliation and ledgers."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ridewave.operators import counts as C
from ridewave.operators import joins as J
from ridewave.operators.ingest import in_window
from ridewave.queries.base import big, query, rnd

CUT = datetime(2024, 1, 20, 12)
COVERAGE_SQL = """coverage AS (SELECT DISTINCT date, CASE WHEN dayofweek(date) <> 3 THEN CAST(date AS TIMESTAMP) + INTERVAL 30 HOUR END AS published_at FROM validations)"""


def coverage(t):
    stamp = F.date_add(F.col("date"), 1).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(6))
    return t.validations.select("date").distinct().withColumn(
        "published_at", F.when(F.weekday("date") != 2, stamp))


@query("hourly_counts", "A1", "SELECT * FROM hourly", "hourly")
def _(t):
    return C.hourly_counts(t.validations)


@query("hour_grid", "J1", "SELECT route, date, hour FROM hourly_dense", "hourly_dense")
def _(t):
    return J.hour_grid(t.validations.select("route"), J.span_days(t.validations))


@query("completed_labels", "J2", "SELECT * FROM hourly_dense", "hourly_dense")
def _(t):
    grid = J.hour_grid(t.validations.select("route"), J.span_days(t.validations))
    return J.complete_labels(t.hourly, grid, ["route", "date", "hour"], "boardings", missing_as_zero=True)


@query("checked_many_to_one", "J3", """SELECT l_orderkey, l_linenumber, l_partkey, n_name, s_acctbal FROM lineitem
 LEFT JOIN supplier ON l_suppkey=s_suppkey LEFT JOIN nation ON s_nationkey=n_nationkey""")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", F.col("s_nationkey").alias("n_nationkey"))
    with_supplier = J.merge_many_to_one(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), s, ["l_suppkey"])
    return J.merge_many_to_one(with_supplier, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "n_name", "s_acctbal")


# Second count source: the same events with a few clocks one hour late and some lost.
SHIFTED_SQL = """shifted AS (SELECT route, CAST(ts2 AS DATE) AS date, CAST(hour(ts2) AS INT) AS hour, count(*) AS boardings FROM
 (SELECT route, success, event_id, ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS ts2 FROM validations)
 WHERE success AND event_id % 211 <> 0 GROUP BY ALL)"""


def shifted(t):
    moved = F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.make_dt_interval(hours=F.lit(1))).otherwise(F.col("ts"))
    lossy = t.validations.withColumn("success", F.col("success") & (F.col("event_id") % 211 != 0))
    return C.hourly_counts(lossy.withColumn("ts", moved))


@query("label_reconciliation", "J4", f"""WITH {SHIFTED_SQL}
SELECT count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only,
 count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND a<>b) AS changed, count(*) FILTER (a=b) AS equal,
 CAST(sum(a) AS BIGINT) AS left_total, CAST(sum(b) AS BIGINT) AS right_total FROM
 (SELECT h.boardings AS a, s.boardings AS b FROM hourly h FULL JOIN shifted s USING (route,date,hour))""", "hourly")
def _(t):
    return J.reconcile(t.hourly, shifted(t), ["route", "date", "hour"], "boardings")


@query("grid_difference", "J5", f"""WITH {SHIFTED_SQL}
SELECT route,date,hour,'left_only' AS side FROM hourly h ANTI JOIN shifted s USING (route,date,hour)
UNION ALL SELECT route,date,hour,'right_only' FROM shifted s ANTI JOIN hourly h USING (route,date,hour)""", "hourly")
def _(t):
    return J.grid_difference(t.hourly, shifted(t), ["route", "date", "hour"])


@query("union_of_labels", "U1", """SELECT route, date, hour, boardings FROM hourly UNION ALL SELECT route, date, hour, boardings FROM order_hours""",
       "hourly order_hours")
def _(t):
    return J.union_frames([t.hourly, t.order_hours])


@query("key_set_sizes", "U2", f"""WITH {SHIFTED_SQL}, x AS (SELECT h.boardings AS a, s.boardings AS b FROM hourly h FULL JOIN shifted s USING (route,date,hour))
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both", count(*) FILTER (b IS NULL) AS left_only,
 count(*) FILTER (a IS NULL) AS right_only, count(*) AS either FROM x""", "hourly")
def _(t):
    return J.key_sets(t.hourly, shifted(t), ["route", "date", "hour"])


@query("bucket_counts_hourly", "A2", f"""WITH {COVERAGE_SQL}
SELECT route, stop_no, direction, date_trunc('hour', ts) AS bucket, count(*) AS value, 1::BIGINT AS covered_units, 1::BIGINT AS total_units
FROM validations JOIN coverage USING (date) WHERE published_at IS NULL OR published_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL""", "validations")
def _(t):
    return C.bucket_counts(t.validations, ["route", "stop_no", "direction"], "hourly", coverage(t), CUT)


@query("bucket_counts_monthly", "A2", f"""WITH {COVERAGE_SQL}, known AS (SELECT date, published_at IS NULL OR published_at <= TIMESTAMP '2024-01-20 12:00:00' AS ok FROM coverage)
SELECT route, CAST(date_trunc('month', ts) AS TIMESTAMP) AS bucket, count(*) AS value,
 (SELECT count(*) FILTER (ok) FROM known) AS covered_units, 31::BIGINT AS total_units
FROM validations JOIN known USING (date) WHERE ok GROUP BY ALL""", "validations")
def _(t):
    return C.bucket_counts(t.validations, ["route"], "monthly", coverage(t), CUT)


@query("horizon_buckets_month", "P11", """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS origin FROM orders)
SELECT origin, CASE WHEN day(origin) <> 1 THEN 'month and year origins start a month at midnight' END AS problem,
 CASE WHEN day(origin)=1 THEN b END AS bucket_start, CASE WHEN day(origin)=1 THEN b + INTERVAL 1 DAY END AS bucket_end FROM
 (SELECT origin, unnest(CASE WHEN day(origin)=1 THEN generate_series(origin, CAST(last_day(origin) AS TIMESTAMP), INTERVAL 1 DAY) ELSE [origin] END) AS b FROM o)""")
def _(t):
    origins = t.orders.select(F.col("o_orderdate").cast("timestamp_ntz").alias("origin")).distinct()
    return C.forecast_buckets(origins, "month")


@query("horizon_buckets_day_year", "P11", """WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS origin FROM validations), o AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS origin FROM orders)
SELECT 'day' AS horizon, count(*) AS buckets, min(b) AS first_start, max(b + INTERVAL 1 HOUR) AS last_end FROM (SELECT origin + to_hours(i) AS b FROM h, range(24) r(i))
UNION ALL SELECT 'year', count(*), min(b), max(b + INTERVAL 1 MONTH) FROM (SELECT origin + to_months(CAST(i AS INT)) AS b FROM o, range(12) r(i) WHERE day(origin)=1 AND month(origin)=1)""", "validations")
def _(t):
    from ridewave.functions.clock import bucket_start
    hours = t.validations.select(bucket_start(F.col("ts"), "hourly").alias("origin")).distinct()
    days = t.orders.select(F.col("o_orderdate").cast("timestamp_ntz").alias("origin")).distinct()
    both = C.forecast_buckets(hours, "day").withColumn("horizon", F.lit("day")).unionByName(
        C.forecast_buckets(days, "year").withColumn("horizon", F.lit("year")))
    return both.where("problem IS NULL").groupBy("horizon").agg(
        F.count(F.lit(1)).alias("buckets"), F.min("bucket_start").alias("first_start"), F.max("bucket_end").alias("last_end"))


@query("covered_prefix", "W27", f"""WITH {COVERAGE_SQL}, known AS (SELECT date, published_at IS NULL OR published_at <= TIMESTAMP '2024-01-20 12:00:00' AS ok FROM coverage)
SELECT date AS unit_day, ok AS covered, CAST(coalesce(sum(CAST(ok AS INT)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS covered_before FROM known""", "validations")
def _(t):
    return C.covered_prefix(C.available_dates(coverage(t), CUT), "daily")


@query("relation_spans", "A27", """SELECT date_trunc('hour', ts) AS event_hour, device, vehicle, route, min(ts) AS first, max(ts) AS last,
 count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS rejected FROM validations GROUP BY ALL""", "validations")
def _(t):
    return C.relation_spans(t.validations, ["device", "vehicle", "route"])


@query("identity_conflicts", "A26", """WITH r AS (SELECT date_trunc('hour', ts) AS h, device, k % 40 AS vehicle, route, direction FROM validations GROUP BY ALL)
SELECT 'device_hours' AS kind, count(*) AS conflicts FROM (SELECT 1 FROM r GROUP BY h, device HAVING count(DISTINCT vehicle)>1)
UNION ALL SELECT 'vehicle_hours', count(*) FROM (SELECT 1 FROM r GROUP BY h, vehicle HAVING count(DISTINCT route || ':' || direction)>1)
UNION ALL SELECT 'device_migrations', count(*) FROM (SELECT 1 FROM r GROUP BY device HAVING count(DISTINCT vehicle)>1)""", "validations")
def _(t):
    rows = t.validations.withColumn("vehicle", F.col("k") % 40).withColumn("exit", F.col("direction"))
    return C.identity_conflicts(C.relation_spans(rows, ["device", "vehicle", "route", "exit"]))


STATUS_SQL = """statused AS (SELECT *, CASE WHEN k >= 90 THEN 'out_of_scope' WHEN k % 7 = 0 THEN 'ambiguous' WHEN k % 3 = 0 THEN 'unassigned' ELSE 'assigned' END AS status FROM validations WHERE success)"""


def statused(t):
    k = F.col("k")
    return t.validations.where("success").withColumn("status", F.when(k >= 90, "out_of_scope").when(
        k % 7 == 0, "ambiguous").when(k % 3 == 0, "unassigned").otherwise("assigned"))


STATUSES = ["assigned", "ambiguous", "unassigned", "out_of_scope"]


@query("mass_ledger", "A28", f"""WITH {STATUS_SQL} SELECT route, date, hour, count(*) AS source_success, count(*) FILTER (status='assigned') AS assigned,
 count(*) FILTER (status='ambiguous') AS ambiguous, count(*) FILTER (status='unassigned') AS unassigned, count(*) FILTER (status='out_of_scope') AS out_of_scope FROM statused GROUP BY ALL""", "validations")
def _(t):
    return C.mass_ledger(statused(t), STATUSES)


@query("mass_check", "A29", f"""WITH {SHIFTED_SQL} SELECT route, date, hour, CAST(a AS DOUBLE) AS left_mass, CAST(b AS DOUBLE) AS right_mass, CAST(coalesce(a,0)-coalesce(b,0) AS DOUBLE) AS difference
FROM (SELECT route,date,hour,h.boardings AS a, s.boardings AS b FROM hourly h FULL JOIN shifted s USING (route,date,hour)) WHERE abs(coalesce(a,0)-coalesce(b,0)) > 0.5""", "hourly")
def _(t):
    as_mass = lambda df: df.withColumn("mass", F.col("boardings").cast("double"))
    return C.check_mass(as_mass(t.hourly), as_mass(shifted(t)), ["route", "date", "hour"], "mass", 0.5)


@query("label_rollups", "A69", """WITH e AS (SELECT *, strftime(date,'%Y-%m') AS month, isodow(date)-1 AS weekday FROM hourly_dense)
SELECT 'route+month' AS dimension, route || '/' || month AS member, count(*) AS rows, CAST(sum(boardings) AS BIGINT) AS total, count(DISTINCT date) AS days, count(*) FILTER (boardings>0) AS positive, max(boardings) AS highest FROM e GROUP BY route, month
UNION ALL SELECT 'date', CAST(date AS VARCHAR), count(*), CAST(sum(boardings) AS BIGINT), count(DISTINCT date), count(*) FILTER (boardings>0), max(boardings) FROM e GROUP BY date
UNION ALL SELECT 'hour', CAST(hour AS VARCHAR), count(*), CAST(sum(boardings) AS BIGINT), count(DISTINCT date), count(*) FILTER (boardings>0), max(boardings) FROM e GROUP BY hour
UNION ALL SELECT 'weekday', CAST(weekday AS VARCHAR), count(*), CAST(sum(boardings) AS BIGINT), count(DISTINCT date), count(*) FILTER (boardings>0), max(boardings) FROM e GROUP BY weekday""", "hourly_dense")
def _(t):
    return C.label_profile(t.hourly_dense)


@query("zero_days", "A69", "SELECT route, date FROM order_dense GROUP BY ALL HAVING sum(boardings)=0", "order_dense")
def _(t):
    return C.zero_days(t.order_dense)


@query("raw_value_counts", "A76", """WITH r AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 4 END AS place, strftime(o_orderdate,'%Y') AS year FROM orders)
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS rows FROM r GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'place', coalesce(CAST(place AS VARCHAR),'<NULL>'), count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'year', year, count(*) FROM r GROUP BY ALL""")
def _(t):
    rows = t.orders.select("o_orderstatus", "o_orderpriority", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 4).alias("place"),
                           F.date_format("o_orderdate", "yyyy").alias("year"))
    return C.raw_profile(rows, ["o_orderstatus", "o_orderpriority", "place", "year"])


@query("time_quality", "A78", """WITH m AS (SELECT *, sec - (event_id % 5) * 400 AS s2, event_id % 7 AS dev, event_id % 3 AS veh FROM validations)
SELECT 'negative_gaps' AS measure, CAST(count(*) FILTER (p > s2) AS BIGINT) AS value FROM (SELECT s2, lag(s2) OVER (PARTITION BY dev ORDER BY event_id) AS p FROM m)
UNION ALL SELECT 'same_second_excess', CAST(sum(c-1) AS BIGINT) FROM (SELECT count(*) AS c FROM m GROUP BY dev, s2)
UNION ALL SELECT 'vehicle_seconds_with_devices', count(*) FROM (SELECT 1 FROM m GROUP BY veh, s2 HAVING count(DISTINCT dev)>1)
UNION ALL SELECT 'seconds_with_vehicles', count(*) FROM (SELECT 1 FROM m GROUP BY s2 HAVING count(DISTINCT veh)>1)""", "validations")
def _(t):
    rows = t.validations.select("event_id", (F.col("sec") - (F.col("event_id") % 5) * 400).alias("sec"),
                                (F.col("event_id") % 7).alias("device"), (F.col("event_id") % 3).alias("vehicle"))
    return C.time_quality(rows, "event_id")


@query("status_coverage", "A79", f"""WITH {STATUS_SQL}
SELECT 'date+route' AS dimension, date || '/' || route AS member, count(*) AS rows, count(*) FILTER (status='assigned') AS assigned, round(count(*) FILTER (status='assigned')/count(*),6) AS share FROM statused GROUP BY date, route
UNION ALL SELECT 'route', route, count(*), count(*) FILTER (status='assigned'), round(count(*) FILTER (status='assigned')/count(*),6) FROM statused GROUP BY route""", "validations")
def _(t):
    assigned = F.count_if(F.col("status") == "assigned")
    return C.grouping_sets(statused(t), [["date", "route"], ["route"]], {
        "rows": F.count(F.lit(1)), "assigned": assigned, "share": F.round(assigned / F.count(F.lit(1)), 6)})


@query("supportability", "A25", """WITH s AS (SELECT route, min(ts) AS f, max(ts) AS l, count(DISTINCT date) AS d FROM validations GROUP BY route),
 g AS (SELECT route, d/(date_diff('day', f, l)+1) AS r, granularity, n, req FROM (
  SELECT *, 'hourly' AS granularity, date_diff('hour', date_trunc('hour', f), date_trunc('hour', l)) - CASE WHEN date_trunc('hour', f)=f THEN 0 ELSE 1 END AS n, 192 AS req FROM s
  UNION ALL SELECT *, 'daily', date_diff('day', f, l) - CASE WHEN date_trunc('day', f)=f THEN 0 ELSE 1 END, 395 FROM s
  UNION ALL SELECT *, 'monthly', date_diff('month', f, l) - CASE WHEN date_trunc('month', f)=f THEN 0 ELSE 1 END, 48 FROM s))
SELECT route, granularity, CAST(greatest(n,0) AS BIGINT) AS complete_buckets, CAST(req AS BIGINT) AS required_buckets, round(r,6) AS coverage_ratio,
 concat_ws(';', CASE WHEN greatest(n,0) < req THEN 'insufficient_history' END, CASE WHEN r < 0.9 THEN 'sparse_coverage' END) AS blockers,
 greatest(n,0) >= req AND r >= 0.9 AS supportable FROM g""", "validations")
def _(t):
    return C.supportability(t.validations, ["route"]).withColumn("coverage_ratio", rnd("coverage_ratio"))
