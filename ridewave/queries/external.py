"""Weather, traffic texts, parking, network versions and city events."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ridewave.functions.clock import wall
from ridewave.operators import external as X
from ridewave.operators import joins as J
from ridewave.queries.base import EVENT_ORIGIN, OFF_DAYS, query, rnd
from ridewave.queries.scoring import rounded_all
from ridewave.sources import external as W

c = F.col
EO = "DATE '2024-01-22'"
WX_SQL = """wx AS (SELECT date, hour, round(avg(k),6) AS temperature_2m, CAST(sum(k % 3) AS DOUBLE) AS precipitation, max(k % 7) AS weather_code FROM validations GROUP BY ALL)"""


def weather(t):
    return t.validations.groupBy("date", "hour").agg(
        rnd(F.avg("k")).alias("temperature_2m"), F.sum(c("k") % 3).cast("double").alias("precipitation"), F.max(c("k") % 7).alias("weather_code"))


def route_weather(t):
    return W.broadcast_to_routes(weather(t), t.validations.select("route"))


@query("weather_grid_check", "S9", f"""WITH {WX_SQL}, y AS (SELECT date, hour FROM wx WHERE (hour*7+day(date)) % 50<>0 UNION ALL SELECT date, hour FROM wx WHERE (hour+day(date)) % 60=1)
SELECT 'duplicate_hour' AS problem, date, hour FROM y GROUP BY ALL HAVING count(*)>1 UNION ALL SELECT 'outside_range', date, hour FROM y WHERE date>=DATE '2024-01-29' UNION ALL SELECT 'missing_hour', d.date, CAST(h AS INT) FROM (SELECT DISTINCT date FROM wx WHERE date<DATE '2024-01-29') d CROSS JOIN range(24) r(h) WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.date=d.date AND y.hour=h)""", "validations")
def _(t):
    w = weather(t).select("date", "hour")
    rows = w.where((c("hour") * 7 + F.dayofmonth("date")) % 50 != 0).unionByName(w.where((c("hour") + F.dayofmonth("date")) % 60 == 1))
    return W.weather_problems(rows, date(2024, 1, 1), date(2024, 1, 28))


@query("city_series_per_route", "S10", f"WITH {WX_SQL} SELECT r.route, wx.* FROM wx CROSS JOIN (SELECT DISTINCT route FROM validations) r", "validations")
def _(t):
    return route_weather(t)


@query("weather_join", "J23", f"WITH {WX_SQL} SELECT h.route, h.date, h.hour, h.boardings, wx.temperature_2m, wx.precipitation FROM hourly_dense h JOIN wx USING (date, hour)", "validations hourly_dense")
def _(t):
    return X.join_weather(t.hourly_dense, weather(t), ["date", "hour"], ["temperature_2m", "precipitation"]).select(
        "route", "date", "hour", "boardings", "temperature_2m", "precipitation")


@query("aligned_accumulations", "W24", f"WITH {WX_SQL} SELECT date, hour, temperature_2m, lead(precipitation) OVER (ORDER BY date, hour) AS precipitation FROM wx", "validations")
def _(t):
    return W.align_accumulations(weather(t), ["precipitation"]).select("date", "hour", "temperature_2m", "precipitation")


ZONE_SQL = """zn AS (SELECT 'z' || (k % 3) AS zone, date, hour//6 AS hour, round(avg(value),6) AS temperature_2m, min(k % 5) AS weather_code FROM validations WHERE k % 3<>2 OR device % 9<>0 OR hour>3 GROUP BY ALL),
 ex AS (SELECT route, zone, count(DISTINCT stop_no) AS weight FROM (SELECT route, 'z' || (stop_no % 3) AS zone, stop_no FROM validations WHERE route<>'view' OR stop_no % 3<>1) GROUP BY ALL), nd AS (SELECT route, count(*) AS need FROM ex GROUP BY ALL)"""


@query("zone_weighted_weather", "A57", f"""WITH {ZONE_SQL}, g AS (SELECT route, date, hour, count(temperature_2m) AS k, sum(temperature_2m*weight)/sum(weight) AS t FROM zn JOIN ex USING (zone) GROUP BY ALL), v AS (SELECT route, date, hour, weather_code, sum(weight) AS s, count(*) AS k FROM zn JOIN ex USING (zone) GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY route, date, hour ORDER BY s DESC, weather_code) AS r, sum(k) OVER (PARTITION BY route, date, hour) AS kk FROM v)
SELECT g.route, g.date, g.hour, CASE WHEN g.k=need THEN round(t,4) END AS temperature_2m, CASE WHEN m.kk=need THEN weather_code END AS weather_code FROM g JOIN nd USING (route) JOIN m ON m.route=g.route AND m.date=g.date AND m.hour=g.hour AND r=1""", "validations")
def _(t):
    v = t.validations
    z = v.where("k % 3 <> 2 OR device % 9 <> 0 OR hour > 3").groupBy(
        F.concat(F.lit("z"), (c("k") % 3).cast("string")).alias("zone"), "date", F.floor(c("hour") / 6).cast("int").alias("hour")).agg(
        rnd(F.avg("value")).alias("temperature_2m"), F.min(c("k") % 5).alias("weather_code"))
    stops = v.where("route <> 'view' OR stop_no % 3 <> 1").groupBy(c("stop_no").alias("stop_id"), F.concat(F.lit("z"), (c("stop_no") % 3).cast("string")).alias("zone")).agg(
        F.collect_set("route").alias("routes"))
    return X.route_weather(z, X.exposure_weights(stops), ["temperature_2m"], ["weather_code"]).withColumn(
        "temperature_2m", rnd("temperature_2m", 4))


# Posts and articles: texts written from event columns.
POST_SQL = """ps AS (SELECT event_id, date, hour, k, CASE k % 6 WHEN 0 THEN k % 11 END AS score, CASE k % 6 WHEN 0 THEN k+1 END AS speed, k % 6=4 AS closure, k % 6=4 AS incident, k % 9=0 AS edited FROM validations)"""


def post_pages(t):
    """Channel pages of at most two posts."""
    k = c("k")
    s, v = (k % 11).cast("string"), (k + 1).cast("string")
    text = (F.when(k % 6 == 0, F.concat(F.lit("ЦОДД:&nbsp;на дорогах сейчас <b>"), s, F.lit("</b> баллов, средняя скорость движения "), v, F.lit(" км/ч")))
            .when(k % 6 == 1, F.concat(F.lit("На дорогах сейчас "), s, F.lit(" баллов")))
            .when(k % 6 == 2, F.lit("ЦОДД: на дорогах сейчас 3 балла, утром было 5 баллов"))
            .when(k % 6 == 3, F.lit("ЦОДД: ожидается 7 баллов на дорогах"))
            .when(k % 6 == 4, F.lit("ЦОДД: перекрытие улицы, ДТП")).otherwise("ЦОДД: ветер, скорость движения до 20 км/ч"))
    post = F.concat(
        F.lit('<div class="tgme_widget_message js" data-post="ch/'), c("event_id").cast("string"), F.lit('"><time class="t" datetime="'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+03:00"></time>'), F.when(k % 9 == 0, "<span>edited</span>").otherwise(""),
        F.lit('<div class="tgme_widget_message_text js-message_text" dir="auto">'), text, F.lit("</div></div>"))
    rows = t.validations.withColumn("_post", post)
    return rows.groupBy("date", "hour", F.floor(c("event_id") / 2).alias("page")).agg(F.concat_ws("", F.collect_list("_post")).alias("html"))


def posts(t):
    return W.extract_traffic_posts(post_pages(t))


@query("traffic_post_facts", "S18", f"WITH {POST_SQL} SELECT 'ch/' || event_id AS post, edited, CAST(score AS INT) AS congestion_score, CAST(speed AS INT) AS mean_speed_kmh, closure AS closure_notice, incident AS incident_notice FROM ps", "validations")
def _(t):
    return posts(t).select("post", "edited", "congestion_score", "mean_speed_kmh", "closure_notice", "incident_notice")


@query("traffic_article_facts", "S19", """SELECT event_id, CAST(k % 11 AS INT) AS congestion_score, CASE WHEN k % 4=0 THEN 'yandex' ELSE 'codd' END AS score_provider, CASE WHEN k % 5=0 THEN k + 0.5::DOUBLE END AS mean_speed_kmh FROM validations WHERE k % 3=0 AND date<DATE '2024-01-25'""", "validations")
def _(t):
    k = c("k")
    s = (k % 11).cast("string")
    title = F.concat(F.when(k % 3 == 1, "В Подмосковье").otherwise("В Москве"), F.lit(" пробки достигли "), s, F.lit(" баллов"),
                     F.when(k % 3 == 2, " , прогноз на вечер").otherwise(""))
    body = F.concat(F.lit("По данным "), F.when(k % 4 == 0, "Яндекса").otherwise("ЦОДД"), F.lit(", пробки достигли "), s, F.lit(" баллов. "),
                    F.when(k % 5 == 0, F.concat(F.lit("Сейчас в Москве средняя скорость движения составляет "), k.cast("string"), F.lit(",5 км/ч."))).otherwise("Других сведений нет."))
    rows = t.validations.select("event_id", title.alias("title"), body.alias("body"), c("ts").alias("published_at"))
    return W.extract_traffic_articles(rows, date(2024, 1, 1), date(2024, 1, 24)).select("event_id", "congestion_score", "score_provider", "mean_speed_kmh")


FEAT_SQL = f"""{WX_SQL}, {POST_SQL}, wm AS (SELECT hour, avg(temperature_2m) AS wt, avg(precipitation) AS wp FROM wx WHERE date<{EO} GROUP BY ALL), tm AS (SELECT isodow(date)-1 AS dow, hour, avg(score) AS cg, count(score) AS cs, avg(speed) AS sp, count(speed) AS ss FROM ps WHERE date<{EO} AND NOT edited GROUP BY ALL),
 nm AS (SELECT count(*) FILTER (closure)/28.0::DOUBLE AS cr, count(*) FILTER (incident)/28.0::DOUBLE AS ir, count(*) AS n FROM ps WHERE date<{EO} AND NOT edited)"""


@query("source_features", "A58", f"""WITH {FEAT_SQL} SELECT h.route, h.date, h.hour, round(wt,6) AS weather_temperature_2m, round(wp,6) AS weather_precipitation, round(coalesce(cg,-1),6) AS congestion, coalesce(cs,0) AS congestion_support, round(coalesce(sp,-1),6) AS speed, round(cr,6) AS closure_rate, round(ir,6) AS incident_rate, n AS posts
FROM hourly_dense h LEFT JOIN wm USING (hour) LEFT JOIN tm ON tm.hour=h.hour AND tm.dow=isodow(h.date)-1 CROSS JOIN nm WHERE h.date>={EO}""", "validations hourly_dense")
def _(t):
    grid = t.hourly_dense.where(c("date") >= F.lit(EVENT_ORIGIN)).select("route", "date", "hour")
    out = X.source_features(grid, EVENT_ORIGIN, route_weather(t), posts(t))
    return rounded_all(out.select("route", "date", "hour", "weather_temperature_2m", "weather_precipitation", "congestion", "congestion_support", "speed",
                                  "closure_rate", "incident_rate", "posts"))


@query("daily_source_inputs", "A59", f"""WITH {FEAT_SQL} SELECT h.route, h.date, (SELECT round(avg(temperature_2m),6) FROM wx WHERE date<={EO}-2) AS temperature_28, (SELECT count(DISTINCT date) FROM wx WHERE date<={EO}-2) AS weather_support, (SELECT round(avg(score),6) FROM ps WHERE date<{EO}) AS congestion_56, (SELECT count(score) FROM ps WHERE date<{EO}) AS traffic_support, (SELECT count(*) FILTER (incident) FROM ps WHERE date<{EO}) AS incident_28
FROM (SELECT DISTINCT route, date FROM hourly_dense WHERE date>={EO}) h""", "validations hourly_dense")
def _(t):
    daily = t.hourly_dense.where(c("date") >= F.lit(EVENT_ORIGIN)).select("route", "date").distinct()
    facts = posts(t)
    out = X.source_inputs(daily, EVENT_ORIGIN, "weather", weather=route_weather(t))
    out = X.source_inputs(X.source_inputs(out, EVENT_ORIGIN, "traffic", posts=facts), EVENT_ORIGIN, "events", posts=facts)
    return rounded_all(out.select("route", "date", "temperature_28", "weather_support", "congestion_56", "traffic_support", "incident_28"))


@query("holiday_distance", "F4", """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), f AS (SELECT make_date(y, CAST(substr(h,1,2) AS INT), CAST(substr(h,4,2) AS INT)) AS d FROM (SELECT unnest([1995,1996,1997,1998,1999,2000,2001]) AS y), (SELECT unnest(['01-01','01-07','02-23','03-08','05-01','05-09','06-12','11-04']) AS h))
SELECT date, CAST(least(90,coalesce(min(d-date) FILTER (d>=date),90)) AS INT) AS days_to_off, CAST(least(90,coalesce(min(date-d) FILTER (d<=date),90)) AS INT) AS days_since_off, CAST(count(*) FILTER (d=date-1)+count(*) FILTER (d=date+1) AS INT) AS adjacent_off FROM o, f GROUP BY date""")
def _(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    out = X.holiday_distance(days, OFF_DAYS)
    cap = lambda x: F.least(c(x), F.lit(90)).alias(x)
    return out.select("date", cap("days_to_off"), cap("days_since_off"), "adjacent_off")


@query("hour_to_day_reduction", "A60", "SELECT route, date, CAST(date_diff('day', DATE '2024-01-01', date) AS INT) AS lead_day, arg_min(boardings, hour) AS first_value, CAST(sum(boardings) AS BIGINT) AS total, round(sum(boardings*0.5::DOUBLE),6) AS anchor FROM hourly_dense GROUP BY ALL", "hourly_dense")
def _(t):
    rows = t.hourly_dense.select("route", "date", "hour", F.datediff("date", F.lit(date(2024, 1, 1))).alias("lead_day"), c("boardings").alias("first_value"),
                                 c("boardings").alias("total"), (c("boardings") * 0.5).alias("anchor"))
    return rounded_all(X.to_daily_frame(rows, ["first_value"], ["total", "anchor"]))


PARK_SQL = """pk AS (SELECT ts AS time, ts + INTERVAL 3 HOUR AS local_time, device AS parking_id, k - 3 AS free_spaces, value AS occupancy_rate, value<=100 AS occupancy_rate_valid, k-3>=0 AS counts_valid FROM validations WHERE ts>=TIMESTAMP '2024-01-03' AND ts<TIMESTAMP '2024-01-29 12:00:00')"""


def parking(t):
    rows = t.validations.select(c("ts").alias("time"), c("device").alias("parking_id"), (c("k") - 3).alias("free_spaces"), F.lit(1).alias("free_handicapped_spaces"), c("value").alias("occupancy_rate"))
    return W.read_parking(rows, datetime(2024, 1, 3), datetime(2024, 1, 29, 12), "Europe/Moscow")


@query("parking_scan", "S11", f"WITH {PARK_SQL} SELECT time, local_time, parking_id, occupancy_rate_valid, counts_valid FROM pk", "validations")
def _(t):
    return parking(t).select("time", "local_time", "parking_id", "occupancy_rate_valid", "counts_valid")


@query("parking_summary", "A73", f"WITH {PARK_SQL} SELECT count(*) AS rows, count(DISTINCT parking_id) AS lots, count(DISTINCT time) AS instants, count(DISTINCT date_trunc('hour', local_time)) AS hour_buckets, count(*) FILTER (NOT occupancy_rate_valid) AS invalid_rates, count(*) FILTER (NOT counts_valid) AS invalid_counts, (SELECT count(*) FROM (SELECT 1 FROM pk GROUP BY parking_id HAVING max(free_spaces)=0)) AS always_zero_lots FROM pk", "validations")
def _(t):
    return W.parking_summary(parking(t))


@query("parking_months", "A73", f"WITH {PARK_SQL} SELECT strftime(local_time,'%Y-%m') AS month, count(*) AS rows FROM pk GROUP BY ALL", "validations")
def _(t):
    return W.parking_months(parking(t))


VER_SQL = """vr AS (SELECT o_orderpriority AS route, o_custkey % 7 AS direction_id, CAST(o_orderdate AS DATE) AS available_at, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS valid_from, CAST(o_orderdate AS DATE) + 900 AS valid_to, o_orderkey % 20 AS stop_count, o_orderkey % 19 AS edge_count, CASE WHEN o_orderkey % 4<>0 THEN o_totalprice END AS length_m, 'v' || o_orderkey AS source_version, o_orderkey % 11<>0 AS active FROM orders),
 us AS (SELECT *, row_number() OVER (PARTITION BY route, direction_id ORDER BY available_at DESC, source_version DESC) AS r FROM vr WHERE available_at<DATE '2001-01-01' AND valid_from<=DATE '2001-01-01' AND valid_to>=DATE '2001-03-02')"""


def versions(t):
    n, d = c("o_orderkey"), F.to_date("o_orderdate")
    return t.orders.select(c("o_orderpriority").alias("route"), (c("o_custkey") % 7).alias("direction_id"), d.alias("available_at"), F.date_add(d, (n % 30).cast("int")).alias("valid_from"),
                           F.date_add(d, 900).alias("valid_to"), (n % 20).alias("stop_count"), (n % 19).alias("edge_count"), F.when(n % 4 != 0, c("o_totalprice")).alias("length_m"),
                           F.concat(F.lit("v"), n.cast("string")).alias("source_version"), (n % 11 != 0).alias("active"))


@query("asof_versions", "J6", f"WITH {VER_SQL} SELECT route, direction_id, available_at, source_version FROM us WHERE r=1 AND active")
def _(t):
    return J.asof_version(versions(t), ["route", "direction_id"], F.lit(date(2001, 1, 1)), F.lit(date(2001, 3, 2)), ["source_version"]).select("route", "direction_id", "available_at", "source_version")


@query("graph_version_features", "F25", f"WITH {VER_SQL} SELECT route, count(DISTINCT direction_id) AS direction_count, round(avg(stop_count),6) AS stop_count_mean, round(avg(edge_count),6) AS edge_count_mean, round(avg(CASE WHEN length_m IS NULL THEN 0 ELSE 1 END),6) AS length_available, round(avg(length_m),4) AS length_mean, round(max(length_m)-min(length_m),4) AS length_spread, 1 AS graph_available FROM us WHERE r=1 AND active GROUP BY ALL")
def _(t):
    out = X.graph_features(versions(t), F.lit(date(2001, 1, 1)), F.lit(date(2001, 3, 2)))
    out = out.withColumn("length_mean", rnd("length_mean", 4)).withColumn("length_spread", rnd("length_spread", 4))
    return rounded_all(out, skip=("length_mean", "length_spread"))


@query("daily_edit_versions", "J7", """WITH e AS (SELECT device AS relation, route, ts, event_id, date FROM validations), n AS (SELECT relation, date AS day, arg_max(route, (ts, event_id)) AS route, arg_max(event_id, (ts, event_id)) AS event_id FROM e GROUP BY ALL), l AS (SELECT *, lag(route) OVER (PARTITION BY relation ORDER BY day) AS old FROM n)
SELECT relation, day, route, event_id, true AS active FROM l UNION ALL SELECT relation, day, old, event_id, false FROM l WHERE old<>route""", "validations")
def _(t):
    edits = t.validations.select(c("device").alias("relation"), "route", "ts", "event_id", c("event_id").alias("tie"))
    return J.daily_versions(edits, "relation", "route", "ts", ["tie"], ["event_id"])


ORIGINS = [date(2024, 1, 10), date(2024, 1, 20)]


@query("snapshot_asof", "J8", """WITH o AS (SELECT unnest([DATE '2024-01-10', DATE '2024-01-20']) AS origin), b AS (SELECT event_id AS observation_id, device AS source_id, CAST(available_at AS DATE) AS available_at, k % 5 AS snapshot_id FROM validations), x AS (SELECT origin, source_id, arg_max(snapshot_id, (available_at, observation_id)) AS snapshot_id FROM b JOIN o ON available_at<=origin GROUP BY ALL)
SELECT x.*, 'content ' || snapshot_id AS content FROM x""", "validations")
def _(t):
    obs = t.validations.select(c("event_id").alias("observation_id"), c("device").alias("source_id"), F.to_date("available_at").alias("available_at"), (c("k") % 5).alias("snapshot_id"))
    snaps = obs.select("snapshot_id").distinct().withColumn("content", F.concat(F.lit("content "), c("snapshot_id").cast("string")))
    return J.asof_snapshot(obs, snaps, ORIGINS, ["content"]).select("origin", "source_id", "snapshot_id", "content")


REC_SQL = """rc AS (SELECT event_id, k, CAST(date AS VARCHAR) AS sd, date, epoch_us(date_trunc('minute', ts))//1000000 AS su, strftime(ts,'%H:%M') || ':00' AS st, epoch_us(date_trunc('minute', ts))//1000000 + (k % 9)*1800 AS eu FROM validations)"""


def date_records(t):
    k = c("k")
    minute = c("sec") - c("sec") % 60
    end = minute + (k % 9) * 1800
    epoch = F.lit(date(1970, 1, 1)).cast("timestamp_ntz")
    at = lambda s: epoch + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    return t.validations.select(
        "event_id", "k", c("date").cast("string").alias("start_date"), F.when(k % 7 != 0, F.date_format(at(minute), "HH:mm:ss")).alias("start_time"),
        F.when(k % 5 != 0, F.to_date(at(end)).cast("string")).alias("end_date"), F.when(k % 4 != 0, F.date_format(at(end), "HH:mm:ss")).alias("end_time"),
        F.when(k % 7 != 0, minute + F.when(k % 11 == 0, 3600).otherwise(0)).alias("start_unix"), F.when(k % 6 != 0, end + F.when(k % 11 == 0, 3600).otherwise(0)).alias("end_unix"),
        F.lit(False).alias("is_continuous"))


PREC_SQL = f"""{REC_SQL}, pr AS (SELECT event_id, date, k, su, eu, CASE WHEN k % 7<>0 AND k % 11=0 THEN 'unresolved' WHEN k % 7=0 THEN 'date_only' WHEN k % 4=0 OR (k % 5=0 AND (k % 6=0 OR k % 9=0)) OR k % 9=0 THEN 'start_only' ELSE 'exact_interval' END AS precision FROM rc)"""


@query("event_time_precision", "F23", f"WITH {PREC_SQL} SELECT event_id, precision, CASE WHEN precision='exact_interval' THEN eu-su END AS seconds FROM pr", "validations")
def _(t):
    out = X.classify_record(date_records(t), "UTC")
    gap = F.datediff("end_at", "start_at") * 86400 + (F.hour("end_at") - F.hour("start_at")) * 3600 + (F.minute("end_at") - F.minute("start_at")) * 60
    return out.select("event_id", "precision", gap.cast("bigint").alias("seconds"))


@query("occupied_hours", "F23", f"WITH {PREC_SQL} SELECT event_id, CAST((eu-1)//3600 - su//3600 + 1 AS BIGINT) AS hours FROM pr WHERE precision='exact_interval'", "validations")
def _(t):
    rows = X.occupied_hours(X.classify_record(date_records(t), "UTC"))
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("hours"))


WIN_SQL = """wi AS (SELECT DISTINCT route, device, date AS "start", date + CASE WHEN k % 3=0 THEN 2 ELSE 1 END AS "end" FROM validations)"""


def windows(t):
    return t.validations.select("route", "device", c("date").alias("start"), F.date_add("date", F.when(c("k") % 3 == 0, 2).otherwise(1)).alias("end")).distinct()


@query("merged_windows", "W28", f"""WITH {WIN_SQL}, r AS (SELECT *, max("end") OVER (PARTITION BY route, device ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM wi), g AS (SELECT *, sum(CASE WHEN p IS NULL OR "start">p THEN 1 ELSE 0 END) OVER (PARTITION BY route, device ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS i FROM r) SELECT route, device, min("start") AS "start", max("end") AS "end" FROM g GROUP BY route, device, i""", "validations")
def _(t):
    return X.merge_windows(windows(t), ["route", "device"])


@query("event_coverage", "A75", f"""WITH {PREC_SQL}, {WIN_SQL}, inw AS (SELECT DISTINCT pr.event_id, precision FROM pr JOIN (SELECT DISTINCT "start", "end" FROM wi) wi ON date>="start" AND date<"end") SELECT precision, count(*) AS numerator, (SELECT count(*) FROM inw) AS denominator, round(count(*)/(SELECT count(*) FROM inw),6) AS share FROM inw GROUP BY ALL""", "validations")
def _(t):
    occ = X.classify_record(date_records(t), "UTC").withColumn("date", c("start_date").cast("date"))
    return rounded_all(X.event_coverage(occ, windows(t).select("start", "end").distinct()))


@query("repeat_expansion", "F23", f"""WITH {WIN_SQL}, w AS (SELECT DISTINCT "start" AS s, "end" AS e FROM wi), r AS (SELECT event_id, date FROM validations) SELECT r.event_id, d.date, CAST(d.date AS TIMESTAMP) + INTERVAL 10 HOUR AS start_at, CAST(d.date AS TIMESTAMP) + INTERVAL 26 HOUR AS end_at FROM r JOIN (SELECT DISTINCT date FROM validations v JOIN w ON v.date>=s AND v.date<e UNION SELECT DISTINCT e-1 FROM w) d ON d.date>=r.date""", "validations")
def _(t):
    rows = t.validations.select("event_id", c("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit("10:00:00").alias("open_time"),
                                                   F.lit("02:00:00").alias("close_time"), F.array().cast("array<int>").alias("weekdays"))
    return X.expand_repeats(rows, windows(t).select("start", "end").distinct())
