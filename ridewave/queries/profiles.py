"""Profiles, reducers and training frames."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ridewave.functions import clock as K
from ridewave.operators import profiles as P
from ridewave.operators.joins import span_days
from ridewave.queries.base import EVENT_ORIGIN, HOLIDAYS, OFF_DAYS, ORDER_ORIGIN, big, query, rnd

CAL = P.Calendar(off=tuple(OFF_DAYS), work=(date(2001, 6, 16),))
EVENT_CAL = P.Calendar(off=(date(2024, 1, 1), date(2024, 1, 8)), work=(date(2024, 1, 27),))
HOL = ", ".join(f"'{h}'" for h in HOLIDAYS)
# Calendar columns of the years-long labels and of the thirty-day labels.
ORDER_CAL = f"""oc AS (SELECT *, isodow(date)-1 AS dow, CASE WHEN month(date) IN (6,7,8) THEN 1 ELSE 0 END AS season,
 CASE WHEN date = DATE '2001-06-16' OR (isodow(date)<6 AND strftime(date,'%m-%d') NOT IN ({HOL})) THEN 0
  WHEN isodow(date)=6 AND strftime(date,'%m-%d') NOT IN ({HOL}) THEN 1 ELSE 2 END AS day_type,
 CASE WHEN date = DATE '2001-06-16' OR strftime(date,'%m-%d') IN ({HOL}) THEN 1 ELSE 0 END AS exception FROM order_dense)"""
EVENT_CALENDAR = """ec AS (SELECT *, isodow(date)-1 AS dow, 0 AS season,
 CASE WHEN date = DATE '2024-01-27' OR (isodow(date)<6 AND date NOT IN (DATE '2024-01-01', DATE '2024-01-08')) THEN 0
  WHEN isodow(date)=6 THEN 1 ELSE 2 END AS day_type,
 CASE WHEN date IN (DATE '2024-01-01', DATE '2024-01-08', DATE '2024-01-27') THEN 1 ELSE 0 END AS exception FROM hourly_dense)"""
OO, EO = "DATE '2001-06-01'", "DATE '2024-01-22'"


@query("profile_route_hour_28", "A4", f"SELECT route, hour, round(avg(boardings),6) AS route_hour_28 FROM order_dense WHERE date < {OO} AND date >= {OO} - 28 GROUP BY ALL", "order_dense")
def _(t):
    return P.profile_means(t.order_dense, ORDER_ORIGIN, "route_hour_28", calendar=CAL).withColumn("route_hour_28", rnd("route_hour_28"))


@query("profile_route_level_56", "A4", f"SELECT route, round(avg(boardings),6) AS route_day_56 FROM order_dense WHERE date < {OO} AND date >= {OO} - 56 GROUP BY ALL", "order_dense")
def _(t):
    return P.profile_means(t.order_dense, ORDER_ORIGIN, "route_day_56", calendar=CAL).withColumn("route_day_56", rnd("route_day_56"))


@query("profile_seasonal_weekday_hour", "A5", f"""WITH {ORDER_CAL} SELECT route, season, dow, hour, round(avg(boardings),6) AS route_dow_hour_same_season, count(*) AS same_season_support
FROM oc WHERE date < {OO} GROUP BY ALL""", "order_dense")
def _(t):
    return P.profile_means(t.order_dense, ORDER_ORIGIN, "route_dow_hour_same_season", calendar=CAL).withColumn(
        "route_dow_hour_same_season", rnd("route_dow_hour_same_season")).withColumn("dow", big("dow")).withColumn("dow", big("dow"))


@query("profile_day_type_hour", "A5", f"""WITH {ORDER_CAL} SELECT route, season, day_type, hour, round(avg(boardings),6) AS route_day_type_hour_same_season, count(*) AS day_type_support
FROM oc WHERE date < {OO} GROUP BY ALL""", "order_dense")
def _(t):
    return P.profile_means(t.order_dense, ORDER_ORIGIN, "route_day_type_hour_same_season", calendar=CAL).withColumn(
        "route_day_type_hour_same_season", rnd("route_day_type_hour_same_season"))


WEEKLY_SQL = f"""WITH {EVENT_CALENDAR}, p AS (SELECT * FROM ec WHERE date < {EO}),
 m AS (SELECT route, dow, hour, avg(boardings) FILTER (date >= {EO}-7) AS week1, avg(boardings) FILTER (date >= {EO}-14) AS week2,
   avg(boardings) FILTER (date >= {EO}-28) AS week4, avg(boardings) FILTER (date >= {EO}-56) AS week8, median(boardings) FILTER (date >= {EO}-28) AS median4 FROM p GROUP BY ALL),
 l AS (SELECT route, avg(total) FILTER (date >= {EO}-7) AS routelevel7, avg(total) FILTER (date >= {EO}-28) AS routelevel28 FROM (SELECT route, date, sum(boardings) AS total FROM p GROUP BY ALL) GROUP BY ALL)
SELECT route, dow, hour, round(week1,6) AS week1, round(week2,6) AS week2, round(week4,6) AS week4, round(week8,6) AS week8, median4, round(routelevel7,6) AS routelevel7,
 round(routelevel28,6) AS routelevel28, round(week1/greatest(week4,20.0::DOUBLE),6) AS ratio1, round(week2/greatest(week4,20.0::DOUBLE),6) AS ratio2, round(week8/greatest(week4,20.0::DOUBLE),6) AS ratio8
FROM m JOIN l USING (route)"""


@query("weekly_profiles", "A6", WEEKLY_SQL, "hourly_dense")
def _(t):
    out = P.weekly_profiles(t.hourly_dense, EVENT_ORIGIN)
    keys = ("route", "dow", "hour")
    return out.select("route", big("dow").alias("dow"), "hour", *[rnd(c).alias(c) for c in out.columns if c not in keys])


@query("median_profile", "A7", f"WITH {EVENT_CALENDAR} SELECT route, day_type, hour, median(boardings) AS median FROM ec WHERE date < {EO} GROUP BY ALL", "hourly_dense")
def _(t):
    past = P.with_calendar(P.history_before(t.hourly_dense, EVENT_ORIGIN), EVENT_CAL)
    return P.median_profile(past, ["route", "day_type", "hour"])


@query("trend_ratio", "A8", f"""WITH {EVENT_CALENDAR} SELECT route, day_type, round(least(greatest(coalesce(a/nullif(b,0),1),0.75),1.25),6) AS ratio FROM
 (SELECT route, day_type, avg(boardings) FILTER (date >= {EO}-7) AS a, avg(boardings) FILTER (date < {EO}-7 AND date >= {EO}-21) AS b FROM ec WHERE date < {EO} GROUP BY ALL) WHERE a IS NOT NULL""", "hourly_dense")
def _(t):
    return P.trend_ratio(t.hourly_dense, EVENT_ORIGIN, 7, EVENT_CAL).withColumn("ratio", rnd("ratio"))


@query("hour_shares", "A9", f"""WITH {EVENT_CALENDAR} SELECT route, day_type, hour, round(h/nullif(sum(h) OVER (PARTITION BY route, day_type),0),6) AS share
FROM (SELECT route, day_type, hour, sum(boardings) AS h FROM ec GROUP BY ALL)""", "hourly_dense")
def _(t):
    return P.hour_shares(P.with_calendar(t.hourly_dense, EVENT_CAL), ["route", "day_type"]).withColumn("share", rnd("share"))


@query("reducer_exp", "A10 F16", f"""SELECT route, dow, hour, round(sum(w*boardings)/sum(w),6) AS level FROM
 (SELECT route, isodow(date)-1 AS dow, hour, boardings, pow(2.0::DOUBLE, -date_diff('day', date, {EO})/14.0::DOUBLE) AS w FROM hourly_dense WHERE date < {EO}) GROUP BY ALL""", "hourly_dense")
def _(t):
    rows = t.hourly_dense.withColumn("dow", big(F.weekday("date")))
    return P.profile_reduce(rows, EVENT_ORIGIN, ["route", "dow", "hour"], "exp", half_life=14.0).withColumn("level", rnd("level"))


@query("reducer_quantiles", "A10", f"""SELECT route, hour, round(quantile_cont(boardings,0.4),6) AS q40, round(median(boardings),6) AS median, round(quantile_cont(boardings,0.6),6) AS q60
FROM hourly_dense WHERE date < {EO} AND date >= {EO}-14 GROUP BY ALL""", "hourly_dense")
def _(t):
    past = P.history_before(t.hourly_dense, EVENT_ORIGIN).where(P.recent(EVENT_ORIGIN, 14))
    from ridewave.operators.blocks import exact_quantiles
    out = exact_quantiles(past, ["route", "hour"], "boardings", {"q40": 0.4, "median": 0.5, "q60": 0.6})
    return out.select("route", "hour", *[rnd(c).alias(c) for c in ("q40", "median", "q60")])


@query("reducer_trim10", "A10", f"""SELECT route, hour, round(avg(boardings),6) AS level FROM (SELECT *, row_number() OVER (PARTITION BY route, hour ORDER BY boardings, date) AS r,
 count(*) OVER (PARTITION BY route, hour) AS n FROM hourly_dense WHERE date < {EO}) WHERE r > floor(n*0.1) AND r <= n - floor(n*0.1) GROUP BY ALL""", "hourly_dense")
def _(t):
    return P.profile_reduce(t.hourly_dense, EVENT_ORIGIN, ["route", "hour"], "trim10").withColumn("level", rnd("level"))


@query("reducer_months", "A10", f"""WITH m AS (SELECT route, hour, (2001-year(date))*12+6-month(date) AS age, avg(boardings) AS v FROM order_dense WHERE date < {OO} GROUP BY ALL)
SELECT route, hour, round(avg(v),6) AS month_equal, round(sum(v*pow(2.0::DOUBLE,-age/2.0::DOUBLE))/sum(pow(2.0::DOUBLE,-age/2.0::DOUBLE)),6) AS month_exp FROM m WHERE age > 0 GROUP BY ALL""", "order_dense")
def _(t):
    keys = ["route", "hour"]
    a = P.profile_reduce(t.order_dense, ORDER_ORIGIN, keys, "month_equal", name="month_equal")
    b = P.profile_reduce(t.order_dense, ORDER_ORIGIN, keys, "month_exp", half_life=2.0, name="month_exp")
    return a.join(b, keys).select(*keys, rnd("month_equal").alias("month_equal"), rnd("month_exp").alias("month_exp"))


SMOOTH_SQL = """WITH RECURSIVE d AS (SELECT route, date, sum(boardings)::DOUBLE AS total, row_number() OVER (PARTITION BY route ORDER BY date) AS i FROM hourly_dense GROUP BY route, date),
 s AS (SELECT route, i, total AS level, 0.0::DOUBLE AS trend FROM d WHERE i=1
  UNION ALL SELECT s.route, d.i, 0.3::DOUBLE*d.total + 0.7::DOUBLE*(s.level+0.8::DOUBLE*s.trend),
   0.05::DOUBLE*(0.3::DOUBLE*d.total + 0.7::DOUBLE*(s.level+0.8::DOUBLE*s.trend) - s.level) + (0.95::DOUBLE*0.8::DOUBLE)*s.trend
   FROM s JOIN d ON d.route=s.route AND d.i=s.i+1)
SELECT route, round(level,4) AS level, round(trend,4) AS trend FROM s WHERE i=(SELECT max(i) FROM d)"""


@query("smoothed_level", "A11", SMOOTH_SQL, "hourly_dense")
def _(t):
    daily = t.hourly_dense.groupBy("route", "date").agg(F.sum("boardings").alias("total"))
    return P.smooth_level(daily, 0.3, 0.8).select("route", rnd("level", 4).alias("level"), rnd("trend", 4).alias("trend"))


@query("training_frame", "M1 F5", f"""WITH {ORDER_CAL}, o AS (SELECT unnest([DATE '2001-03-01', DATE '2001-03-15', DATE '2001-04-01']) AS origin),
 f AS (SELECT o.origin, oc.* FROM oc JOIN o ON oc.date >= origin AND oc.date < origin + 14),
 s AS (SELECT origin, route, season, dow, hour, avg(boardings) AS v, count(*) AS n FROM oc JOIN o ON date < origin GROUP BY ALL),
 h AS (SELECT origin, route, hour, avg(boardings) AS v FROM oc JOIN o ON date < origin AND date >= origin - 28 GROUP BY ALL)
SELECT f.origin, f.route, f.date, f.hour, f.boardings, CAST(date_diff('day', f.origin, f.date)+1 AS INT) AS lead_day, CASE WHEN f.dow >= 5 THEN 1 ELSE 0 END AS is_weekend,
 round(coalesce(s.v,0),6) AS route_dow_hour_same_season, coalesce(s.n,0) AS same_season_support, round(coalesce(h.v,0),6) AS route_hour_28
FROM f LEFT JOIN s USING (origin, route, season, dow, hour) LEFT JOIN h USING (origin, route, hour)""", "order_dense")
def _(t):
    frame = P.training_frame(t.order_dense, [date(2001, 3, 1), date(2001, 3, 15), date(2001, 4, 1)], 14, CAL)
    return frame.select("origin", "route", "date", "hour", "boardings", "lead_day", "is_weekend",
                        rnd("route_dow_hour_same_season").alias("route_dow_hour_same_season"), "same_season_support",
                        rnd("route_hour_28").alias("route_hour_28"))


@query("day_types", "F1 F14", f"""WITH {ORDER_CAL} SELECT DISTINCT date, day_type, exception, CASE WHEN hour IN (7,8,9) THEN 'morning_peak' WHEN hour IN (17,18,19) THEN 'evening_peak' ELSE 'offpeak' END AS daypart FROM oc""", "order_dense")
def _(t):
    rows = P.with_calendar(t.order_dense, CAL)
    return rows.select("date", "day_type", "exception", K.daypart(F.col("hour")).alias("daypart")).distinct()


@query("calendar_columns", "F2 F3", """WITH d AS (SELECT DISTINCT CAST(date AS TIMESTAMP) AS start, date FROM order_dense)
SELECT date, CAST(isodow(date)-1 AS INT) AS day_of_week, CASE WHEN isodow(date)>5 THEN 1 ELSE 0 END AS is_weekend, CAST(day(date) AS INT) AS day_of_month, CAST(dayofyear(date) AS INT) AS day_of_year,
 CAST(month(date) AS INT) AS month_of_year, CAST(day(last_day(date)) AS INT) AS days_in_month, CASE WHEN day(date)=1 THEN 1 ELSE 0 END AS is_month_start,
 CASE WHEN date=last_day(date) THEN 1 ELSE 0 END AS is_month_end, 24 AS bucket_hours, round(sin((isodow(date)-1)*2*pi()/7),6) AS dow_sin, round(cos((isodow(date)-1)*2*pi()/7),6) AS dow_cos FROM d""", "order_dense")
def _(t):
    days = t.order_dense.select("date").distinct()
    cols = K.calendar_columns(F.col("date").cast("timestamp_ntz"), "daily")
    s, c = K.cyclic(F.weekday("date"), 7)
    return days.select("date", *[v.alias(k) for k, v in cols.items()], rnd(s).alias("dow_sin"), rnd(c).alias("dow_cos"))


@query("bucket_steps", "F6", """SELECT event_id, date_trunc('hour', ts) AS hour_start, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start,
 date_trunc('hour', ts) - INTERVAL 168 HOUR AS week_before, CAST(date_trunc('month', ts) AS TIMESTAMP) + INTERVAL 1 MONTH AS next_month, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS next_day FROM validations""", "validations")
def _(t):
    ts = F.col("ts")
    hour, month, day = (K.bucket_start(ts, g) for g in ("hourly", "monthly", "daily"))
    return t.validations.select("event_id", hour.alias("hour_start"), month.alias("month_start"), K.step(hour, "hourly", -168).alias("week_before"),
                                K.step(month, "monthly", 1).alias("next_month"), K.step(day, "daily", 1).alias("next_day"))


@query("history_guard", "P21", f"SELECT route, count(*) AS rows FROM hourly_dense WHERE date < {EO} GROUP BY ALL", "hourly_dense")
def _(t):
    guarded = P.assert_before(P.history_before(t.hourly_dense, EVENT_ORIGIN), EVENT_ORIGIN)
    return guarded.groupBy("route").agg(F.count(F.lit(1)).alias("rows"))
