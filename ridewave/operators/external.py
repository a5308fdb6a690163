"""Features from external sources, network versions and city events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.operators.joins import asof_version, merge_many_to_one, require
from ridewave.operators.profiles import recent

c = F.col


def join_weather(grid: DataFrame, weather: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Weather of every grid hour; a missing value in the horizon stops the run."""
    out = merge_many_to_one(grid, weather.select(*keys, *columns), keys)
    missing = F.lit(False)
    for x in columns:
        missing = missing | c(x).isNull()
    return require(out, missing, "weather has missing values in forecast horizon")


def graph_features(versions: DataFrame, origin: Column, end: Column) -> DataFrame:
    """Per route: directions, mean stops and edges, length availability, mean and spread."""
    usable = asof_version(versions, ["route", "direction_id"], origin, end, tie=["source_version"])
    return usable.groupBy("route").agg(
        F.count_distinct("direction_id").alias("direction_count"), F.avg("stop_count").alias("stop_count_mean"),
        F.avg("edge_count").alias("edge_count_mean"), F.avg(c("length_m").isNotNull().cast("int")).alias("length_available"),
        F.avg("length_m").alias("length_mean"), (F.max("length_m") - F.min("length_m")).alias("length_spread")).withColumn(
        "graph_available", F.lit(1))


def exposure_weights(stops: DataFrame) -> DataFrame:
    """Stops per route and weather zone (stop rows with ``zone`` and a ``routes`` array)."""
    return stops.select("stop_id", "zone", F.explode("routes").alias("route")).distinct().groupBy("route", "zone").agg(
        F.count(F.lit(1)).alias("weight"))


def route_weather(zones: DataFrame, weights: DataFrame, means: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """Zone weather to routes by stop exposure: weighted means, weighted modes for codes.

    An hour with any zone missing is NULL for the routes that use the zone.
    """
    need = weights.groupBy("route").agg(F.count(F.lit(1)).alias("_need"))
    rows = zones.join(weights, "zone").join(need, "route")
    w = c("weight")
    g = rows.groupBy("route", "date", "hour", "_need").agg(*[
        F.when(F.count(x) == c("_need"), F.sum(c(x) * w) / F.sum(w)).alias(x) for x in means])
    for x in codes:
        votes = rows.where(c(x).isNotNull()).groupBy("route", "date", "hour", x).agg(F.sum(w).alias("_v"), F.count(F.lit(1)).alias("_k"))
        mode = votes.groupBy("route", "date", "hour").agg(F.max_by(x, F.struct(c("_v"), -c(x))).alias(x), F.sum("_k").alias("_k_" + x))
        g = g.join(mode, ["route", "date", "hour"], "left").withColumn(x, F.when(c("_k_" + x) == c("_need"), c(x))).drop("_k_" + x)
    return g.drop("_need")


def holiday_distance(days: DataFrame, days_off: Sequence[date], cap: int = 90) -> DataFrame:
    """Days to and since the nearest exceptional date (at most ``cap``) and adjacent ones."""
    off = F.array(*[F.lit(d) for d in sorted(days_off)])
    gaps = F.transform(off, lambda d: F.datediff(d, c("date")))
    to = F.array_min(F.filter(gaps, lambda g: g >= 0))
    since = F.array_min(F.transform(F.filter(gaps, lambda g: g <= 0), lambda g: -g))
    near = F.array_contains(off, F.date_sub("date", 1)).cast("int") + F.array_contains(off, F.date_add("date", 1)).cast("int")
    top = F.lit(cap)
    return days.select("*", F.coalesce(to, top).alias("days_to_off"), F.coalesce(since, top).alias("days_since_off"), near.alias("adjacent_off"))


def traffic_features(posts: DataFrame, origin: date, days: int = 56) -> DataFrame:
    """Mean and support of score and speed per weekday and hour over unedited recent posts."""
    past = posts.where((c("date") < F.lit(origin)) & recent(origin, days) & ~c("edited"))
    return past.groupBy(F.weekday("date").alias("dow"), "hour").agg(
        F.avg("congestion_score").alias("congestion"), F.count("congestion_score").alias("congestion_support"),
        F.avg("mean_speed_kmh").alias("speed"), F.count("mean_speed_kmh").alias("speed_support"))


def news_features(posts: DataFrame, origin: date, days: int = 28) -> DataFrame:
    past = posts.where((c("date") < F.lit(origin)) & recent(origin, days) & ~c("edited"))
    return past.agg((F.count_if("closure_notice") / days).alias("closure_rate"), (F.count_if("incident_notice") / days).alias("incident_rate"),
                    F.count(F.lit(1)).alias("posts"))


def source_features(grid: DataFrame, origin: date, weather: DataFrame | None = None, posts: DataFrame | None = None,
                    weather_columns: Sequence[str] = ("temperature_2m", "precipitation")) -> DataFrame:
    """Grid rows with the enabled sources; a switched-off source adds no column.

    Sentinels (-999, -1) appear only here, at the model boundary.
    """
    out = require(grid, c("date") < F.lit(origin), "target dates must begin at the origin").withColumn("dow", F.weekday("date"))
    if weather is not None:
        past = weather.where((c("date") < F.lit(origin)) & recent(origin, 28))
        means = past.groupBy("route", "hour").agg(*[F.avg(x).alias("weather_" + x) for x in weather_columns], F.lit(1).alias("weather_available"))
        out = out.join(means, ["route", "hour"], "left").fillna(-999.0, ["weather_" + x for x in weather_columns]).fillna(0, ["weather_available"])
    if posts is not None:
        out = out.join(traffic_features(posts, origin), ["dow", "hour"], "left").fillna(-1.0, ["congestion", "speed"]).fillna(
            0, ["congestion_support", "speed_support"]).join(news_features(posts, origin), how="cross")
    return out


def source_inputs(daily: DataFrame, origin: date, family: str, weather: DataFrame | None = None, posts: DataFrame | None = None,
                  days_off: Sequence[date] = (), embargo: int = 2) -> DataFrame:
    """Daily inputs of one source family; weather keeps an embargo before the origin."""
    rows = require(daily, c("date") < F.lit(origin), "target dates must begin at the origin")
    if family == "calendar":
        return holiday_distance(rows, days_off)
    if family == "weather":
        past = weather.where((c("date") <= F.date_sub(F.lit(origin), embargo)) & recent(origin, 28))
        g = past.groupBy("route").agg(F.avg("temperature_2m").alias("temperature_28"), F.avg("precipitation").alias("precipitation_28"),
                                      F.count_distinct("date").alias("weather_support"))
        return rows.join(g, "route", "left").fillna(-999.0, ["temperature_28", "precipitation_28"]).fillna(0, ["weather_support"])
    past = posts.where((c("date") < F.lit(origin)) & recent(origin, 56 if family == "traffic" else 28))
    if family == "traffic":
        g = past.agg(F.coalesce(F.avg("congestion_score"), F.lit(-1.0)).alias("congestion_56"), F.count("congestion_score").alias("traffic_support"))
    elif family == "events":
        g = past.agg(F.count_if("incident_notice").alias("incident_28"), F.count_if("closure_notice").alias("closure_28"), F.count(F.lit(1)).alias("event_support"))
    else:
        raise ValueError(f"unknown source family {family!r}")
    return rows.join(g, how="cross")


def to_daily_frame(df: DataFrame, first: Sequence[str], sums: Sequence[str], keys: Sequence[str] = ("route", "date", "lead_day")) -> DataFrame:
    """Hours to days: attributes that hold all day are kept, anchor and target are summed."""
    return df.groupBy(*keys).agg(*[F.min_by(x, "hour").alias(x) for x in first], *[F.sum(x).alias(x) for x in sums])


def merge_windows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Touching or overlapping collection windows merged (start, end half open)."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    # one row per collected span
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", (reach.isNull() | (c("start") > reach)).cast("int"))
    rows = rows.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def _midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def classify_record(df: DataFrame, zone: str) -> DataFrame:
    """Precision of one date record: exact_interval, start_only, date_only or unresolved.

    Columns: start_date, start_time, end_date, end_time (text), start_unix, end_unix,
    is_continuous.  Unix and local fields must agree; a moment is never invented.
    """
    sd, ed = c("start_date").try_cast("date"), c("end_date").try_cast("date")

    def moment(day: Column, clock: Column) -> Column:
        return F.concat_ws(" ", day.cast("string"), clock).try_cast("timestamp_ntz")

    def local(unix: Column) -> Column:
        epoch = F.lit(date(1970, 1, 1)).cast("timestamp_ntz")
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), epoch + F.make_dt_interval(secs=unix.cast("decimal(18,6)")))

    us, ue = local(c("start_unix")), local(c("end_unix"))
    has_st, has_et = c("start_time").isNotNull(), c("end_time").isNotNull()
    start = F.when(has_st, moment(sd, c("start_time")))
    expected_unix = F.coalesce(start, _midnight(sd))
    conflict = c("start_unix").isNotNull() & (us != expected_unix)
    unix_end_day = F.when(c("end_unix").isNotNull() & (c("end_unix") > c("start_unix")), F.to_date(ue))
    end_day = F.coalesce(ed, F.when(has_et, unix_end_day))
    end = F.when(has_et & end_day.isNotNull(), moment(end_day, c("end_time")))
    end_conflict = end.isNotNull() & c("end_unix").isNotNull() & (c("end_unix") > c("start_unix")) & (ue != end)
    bad_date = (c("start_date").isNotNull() & sd.isNull()) | (c("end_date").isNotNull() & ed.isNull())
    multiday = start.isNotNull() & end.isNotNull() & (F.datediff(end, start) > 1) & ~F.coalesce("is_continuous", F.lit(False))
    rows = df.select("*", sd.alias("_sd"), start.alias("_s"), end.alias("_e"), bad_date.alias("_bad"),
                     F.coalesce(conflict | end_conflict, F.lit(False)).alias("_conflict"), F.coalesce(multiday, F.lit(False)).alias("_multi"))
    negative = c("_e") < c("_s")
    precision = (F.when(c("_bad") | negative, "quarantine").when(c("_sd").isNull(), "unresolved").when(c("_conflict"), "unresolved")
                 .when(c("_multi"), "unresolved").when(c("_s").isNull(), "date_only")
                 .when(c("_e").isNull() | (c("_e") == c("_s")), "start_only").otherwise("exact_interval"))
    flag = (F.when(c("_bad"), "malformed_date").when(negative, "negative_interval").when(c("_sd").isNull(), "empty_record")
            .when(c("_conflict"), "time_conflict").when(c("_multi"), "ambiguous_multiday")
            .when(c("_s").isNotNull() & c("_e").isNull() & has_et, "end_day_unknown")
            .when((c("_s").isNotNull()) & (F.datediff("_e", "_s") > 1), "continuous_span"))
    timed = precision.isin("exact_interval", "start_only")
    return rows.select(*df.columns, precision.alias("precision"), flag.alias("flag"), F.when(timed, c("_s")).alias("start_at"),
                       F.when(precision == "exact_interval", c("_e")).alias("end_at"))


def occupied_hours(sessions: DataFrame) -> DataFrame:
    """Whole hours an exact interval occupies; it ends before the hour that starts at its end."""
    exact = sessions.where("precision = 'exact_interval'")
    first = F.to_date("start_at").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("start_at"))
    last = c("end_at") - F.make_dt_interval(secs=F.lit(1).cast("decimal(18,6)"))
    hours = F.datediff(last, first) * 24 + F.hour(last) - F.hour(first)
    return exact.withColumn("_i", F.explode(F.sequence(F.lit(0), hours))).withColumn("hour_start", first + F.make_dt_interval(hours=c("_i"))).drop("_i")


def expand_repeats(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Daily sessions of unbounded repeats inside the collected windows.

    Columns: event_id, start_date, end_date (NULL: open), open_time, close_time, weekdays (array).
    A partial weekday set is refused because its first day is not documented.
    """
    spans = merge_windows(windows).withColumn("_m", F.explode(F.sequence(F.trunc("start", "month"), F.trunc(F.date_sub("end", 1), "month"), F.expr("interval 1 month"))))
    full = (F.size("weekdays") == 0) | (F.size(F.array_distinct("weekdays")) == 7)
    first, last = c("start_date"), F.coalesce("end_date", F.lit(date(2999, 12, 31)))
    top = windows.agg(F.max("end").alias("_top"))
    reach = records.where(full).join(top, how="cross").withColumn(
        "_day", F.explode(F.when(F.least(last, F.date_sub("_top", 1)) >= first, F.sequence(first, F.least(last, F.date_sub("_top", 1))))))
    inside = reach.withColumn("_m", F.trunc("_day", "month")).join(spans, "_m").where((c("_day") >= c("start")) & (c("_day") < c("end")))
    clock = lambda t: F.concat_ws(" ", c("_day").cast("string"), t).try_cast("timestamp_ntz")
    start, end = clock(c("open_time")), clock(c("close_time"))
    return inside.select("event_id", c("_day").alias("date"), start.alias("start_at"),
                         F.when(end > start, end).otherwise(end + F.make_dt_interval(days=F.lit(1))).alias("end_at"))


def event_coverage(occurrences: DataFrame, windows: DataFrame) -> DataFrame:
    """Shares by precision over sessions inside the collection windows, with their two numbers."""
    spans = merge_windows(windows)
    months = spans.withColumn("_m", F.explode(F.sequence(F.trunc("start", "month"), F.trunc(F.date_sub("end", 1), "month"), F.expr("interval 1 month"))))
    inside = occurrences.withColumn("_m", F.trunc("date", "month")).join(months, "_m").where((c("date") >= c("start")) & (c("date") < c("end")))
    total = inside.agg(F.count(F.lit(1)).alias("denominator"))
    return inside.groupBy("precision").agg(F.count(F.lit(1)).alias("numerator")).join(total, how="cross").withColumn(
        "share", F.try_divide("numerator", "denominator"))
