"""Lag, rolling and seasonal features."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ridewave.functions.clock import wall
from ridewave.operators import counts as C
from ridewave.operators import features as W
from ridewave.operators.joins import hour_grid, span_days
from ridewave.queries.base import query, rnd
from ridewave.queries.counting import COVERAGE_SQL, coverage

CUT = datetime(2024, 1, 22)
TS = "TIMESTAMP '2024-01-22'"
ENTITY = ["route", "stop_no"]
# Sparse visible cells, covered dates and targets of the hourly policy.
HOURLY_SQL = f"""{COVERAGE_SQL}, known AS (SELECT date FROM coverage WHERE published_at IS NULL OR published_at <= {TS}),
 cells AS (SELECT route, stop_no, date_trunc('hour', ts) AS bucket, count(*) AS value FROM validations JOIN known USING (date)
   WHERE ts < {TS} AND available_at <= {TS} GROUP BY ALL),
 ents AS (SELECT DISTINCT route, stop_no FROM validations),
 targets AS (SELECT route, stop_no, {TS} + to_hours(i) AS bucket FROM ents, range(24) r(i))"""


def lag_sql(offset: int) -> str:
    return f"""(SELECT CASE WHEN t.bucket - INTERVAL {offset} HOUR + INTERVAL 1 HOUR <= {TS} AND k.date IS NOT NULL THEN CAST(coalesce(c.value,0) AS DOUBLE) END)"""


def hourly_inputs(t):
    seen = t.validations.where((F.col("ts") < wall(CUT)) & (F.col("available_at") <= wall(CUT)))
    cells = C.bucket_counts(seen, ENTITY, "hourly", coverage(t), CUT)
    ents = t.validations.select(*ENTITY).distinct()
    targets = ents.withColumn("bucket", F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: (
        wall(CUT) + F.make_dt_interval(hours=i)))))
    return targets, cells


LAG_JOINS = "".join(f""" LEFT JOIN known k{o} ON k{o}.date = CAST(t.bucket - INTERVAL {o} HOUR AS DATE) AND t.bucket - INTERVAL {o - 1} HOUR <= {TS}
 LEFT JOIN cells c{o} ON c{o}.route=t.route AND c{o}.stop_no=t.stop_no AND c{o}.bucket = t.bucket - INTERVAL {o} HOUR""" for o in (1, 2, 24, 48, 168, 72, 96))


def lv(o: int) -> str:
    return f"CASE WHEN k{o}.date IS NOT NULL THEN CAST(coalesce(c{o}.value,0) AS DOUBLE) END"


SEASON = [lv(o) for o in (24, 48, 72, 96)]
SEASON_SQL = f"""round(list_avg([{', '.join(SEASON)}]),6) AS seasonal_4x24h_mean,
 list_count([{', '.join(SEASON)}])/4 AS seasonal_4x24h_coverage"""


@query("calendar_lags", "W1", f"""WITH {HOURLY_SQL} SELECT t.route, t.stop_no, t.bucket, {', '.join(f'{lv(o)} AS lag_{o}h' for o in (1, 2, 24, 48, 168))} FROM targets t {LAG_JOINS}""", "validations")
def _(t):
    targets, cells = hourly_inputs(t)
    out = W.lag_features(targets, cells, coverage(t), ENTITY, W.DAY_HOUR, CUT)
    return out.select(*ENTITY, "bucket", *[f"lag_{o}h" for o in (1, 2, 24, 48, 168)])


@query("seasonal_features", "W3", f"""WITH {HOURLY_SQL} SELECT t.route, t.stop_no, t.bucket, {SEASON_SQL} FROM targets t {LAG_JOINS}""", "validations")
def _(t):
    targets, cells = hourly_inputs(t)
    out = W.lag_features(targets, cells, coverage(t), ENTITY, W.DAY_HOUR, CUT)
    return out.select(*ENTITY, "bucket", rnd("seasonal_4x24h_mean").alias("seasonal_4x24h_mean"), "seasonal_4x24h_coverage")


ROLL_SQL = f"""{HOURLY_SQL}, hours AS (SELECT CAST(date AS TIMESTAMP) + to_hours(i) AS bucket FROM known, range(24) r(i)),
 dense AS (SELECT e.route, e.stop_no, h.bucket, coalesce(c.value,0) AS v FROM ents e CROSS JOIN hours h LEFT JOIN cells c ON c.route=e.route AND c.stop_no=e.stop_no AND c.bucket=h.bucket WHERE h.bucket < {TS}),
 roll AS (SELECT route, stop_no, CAST(sum(v) FILTER (bucket >= {TS} - INTERVAL 24 HOUR) AS DOUBLE) AS roll_24h_sum, round(avg(v) FILTER (bucket >= {TS} - INTERVAL 24 HOUR),6) AS roll_24h_mean,
   CAST(max(v) FILTER (bucket >= {TS} - INTERVAL 24 HOUR) AS DOUBLE) AS roll_24h_max, round(count(*) FILTER (bucket >= {TS} - INTERVAL 24 HOUR)/24,6) AS roll_24h_coverage,
   CAST(sum(v) FILTER (bucket >= {TS} - INTERVAL 168 HOUR) AS DOUBLE) AS roll_168h_sum, round(avg(v) FILTER (bucket >= {TS} - INTERVAL 168 HOUR),6) AS roll_168h_mean,
   CAST(max(v) FILTER (bucket >= {TS} - INTERVAL 168 HOUR) AS DOUBLE) AS roll_168h_max, round(count(*) FILTER (bucket >= {TS} - INTERVAL 168 HOUR)/168,6) AS roll_168h_coverage FROM dense GROUP BY ALL)"""
ROLLS = [f"roll_{w}h_{s}" for w in (24, 168) for s in ("sum", "mean", "max", "coverage")]


@query("rolling_features", "W2", f"WITH {ROLL_SQL} SELECT * FROM roll", "validations")
def _(t):
    targets, cells = hourly_inputs(t)
    out = W.rolling_features(targets, cells, coverage(t), ENTITY, W.DAY_HOUR, CUT)
    return out.select(*ENTITY, *[rnd(c).alias(c) for c in ROLLS])


@query("feature_table", "W4", f"""WITH {ROLL_SQL}, cap AS (SELECT route, stop_no, CAST(max_by(k, available_at) AS DOUBLE) AS entity_capacity FROM
  (SELECT route, stop_no, k, available_at, row_number() OVER (PARTITION BY route, stop_no ORDER BY available_at DESC, event_id DESC) AS r FROM validations WHERE available_at <= {TS}) WHERE r=1 GROUP BY ALL)
SELECT t.route, t.stop_no, t.bucket, CAST(hour(t.bucket) AS DOUBLE) AS hour_of_day, CAST((isodow(t.bucket)-1)*24+hour(t.bucket) AS DOUBLE) AS hour_of_week, CAST(hour(t.bucket) AS INT) AS horizon_index,
 {', '.join(f'{lv(o)} AS lag_{o}h' for o in (1, 24, 168))}, {SEASON_SQL}, {', '.join('r.' + c for c in ROLLS)}, cap.entity_capacity
FROM targets t {LAG_JOINS} LEFT JOIN roll r ON r.route=t.route AND r.stop_no=t.stop_no LEFT JOIN cap ON cap.route=t.route AND cap.stop_no=t.stop_no""", "validations")
def _(t):
    targets, cells = hourly_inputs(t)
    caps = t.validations.select(*ENTITY, F.struct("available_at", "event_id").alias("order"), F.col("k").alias("capacity"), "available_at")
    newest = caps.where(F.col("available_at") <= wall(CUT)).groupBy(*ENTITY).agg(F.max_by("capacity", "order").alias("capacity"), F.max("available_at").alias("available_at"))
    out = W.build_features(targets, cells, coverage(t), ENTITY, W.DAY_HOUR, CUT, newest)
    return out.select(*ENTITY, "bucket", "hour_of_day", "hour_of_week", "horizon_index", "lag_1h", "lag_24h", "lag_168h",
                      rnd("seasonal_4x24h_mean").alias("seasonal_4x24h_mean"), "seasonal_4x24h_coverage",
                      *[rnd(c).alias(c) for c in ROLLS], "entity_capacity")


@query("monthly_lag_units", "W1", """WITH cov AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), cells AS (SELECT o_orderpriority AS route, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY ALL),
 u AS (SELECT CAST(date_trunc('month', date) AS DATE) AS m, count(*) AS n FROM cov GROUP BY ALL), e AS (SELECT DISTINCT o_orderpriority AS route FROM orders),
 t AS (SELECT route, CAST(DATE '2001-01-01' + to_months(CAST(i AS INT)) AS DATE) AS m, CAST(i AS INT) AS i FROM e, range(12) r(i)),
 l AS (SELECT t.route, t.m, o, CAST(t.m - to_months(o) AS DATE) AS src FROM t, (SELECT unnest([1,2,3,12]) AS o))
SELECT route, CAST(l.m AS TIMESTAMP) AS bucket, max(CASE WHEN o=1 AND src < DATE '2001-01-01' AND u.n > 0 THEN CAST(coalesce(v,0) AS DOUBLE) END) AS lag_1m, max(CASE WHEN o=12 AND u.n > 0 THEN CAST(coalesce(v,0) AS DOUBLE) END) AS lag_12m,
 round(max(CASE WHEN o=1 THEN CASE WHEN src < DATE '2001-01-01' THEN coalesce(u.n,0) ELSE 0 END / day(last_day(src)) END),6) AS lag_1m_units, round(max(CASE WHEN o=12 THEN coalesce(u.n,0)/day(last_day(src)) END),6) AS lag_12m_units
FROM l LEFT JOIN u ON u.m=src LEFT JOIN cells c USING (route) WHERE c.m = src OR NOT EXISTS (SELECT 1 FROM cells c2 WHERE c2.route=l.route AND c2.m=l.src) GROUP BY route, l.m""")
def _(t):
    cut = datetime(2001, 1, 1)
    rows = t.orders.select(F.col("o_orderpriority").alias("route"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    cov = rows.select(F.to_date("ts").alias("date"), F.lit(None).cast("timestamp_ntz").alias("published_at")).distinct()
    cells = C.bucket_counts(rows.where(F.col("ts") < wall(cut)), ["route"], "monthly", cov, cut)
    targets = rows.select("route").distinct().withColumn("bucket", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(11)), lambda m: F.add_months(F.lit(cut.date()), m).cast("timestamp_ntz"))))
    out = W.lag_features(targets, cells, cov, ["route"], W.YEAR_MONTH, cut)
    return out.select("route", "bucket", "lag_1m", "lag_12m", rnd("lag_1m_units").alias("lag_1m_units"), rnd("lag_12m_units").alias("lag_12m_units"))


@query("route_hour_dataset", "W5", """SELECT a.route, a.date, a.hour, a.boardings AS target, b.boardings AS lag_24h, c.boardings AS lag_168h, d.boardings AS lag_336h,
 p.s AS prior_day_sum, coalesce(p.n,0) AS prior_day_observed_hours, CAST(isodow(a.date)-1 AS INT) AS weekday,
 CASE WHEN a.date < DATE '2024-01-15' THEN 'train' WHEN a.date < DATE '2024-01-25' THEN 'development' ELSE 'diagnostic' END AS split
FROM hourly a LEFT JOIN hourly b ON b.route=a.route AND b.date=a.date-1 AND b.hour=a.hour LEFT JOIN hourly c ON c.route=a.route AND c.date=a.date-7 AND c.hour=a.hour
LEFT JOIN hourly d ON d.route=a.route AND d.date=a.date-14 AND d.hour=a.hour LEFT JOIN (SELECT route, date+1 AS date, CAST(sum(boardings) AS BIGINT) AS s, count(*) AS n FROM hourly GROUP BY ALL) p ON p.route=a.route AND p.date=a.date""", "hourly")
def _(t):
    return W.route_hour_dataset(t.hourly, date(2024, 1, 15), date(2024, 1, 25))
