"""Timetable tables (a GTFS subset): scan, nesting, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridewave.functions.clock import clock_seconds

c = F.col
TABLES: dict[str, tuple[str, ...]] = {
    "routes": ("route_id", "route_short_name", "route_type"),
    "trips": ("trip_id", "route_id", "service_id", "direction_id"),
    "stop_times": ("trip_id", "stop_sequence", "arrival_time", "departure_time", "stop_id", "pickup_type"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
                 "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
}


def read_timetable(spark: SparkSession, folder: str, routes: Sequence[str]) -> dict[str, DataFrame]:
    """The six tables as text columns, trips and stop times restricted to the chosen routes."""
    def table(name: str) -> DataFrame:
        schema = T.StructType([T.StructField(x, T.StringType()) for x in TABLES[name]])
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(f"{folder}/{name}.txt")

    tables = {name: table(name) for name in TABLES}
    tables["routes"] = tables["routes"].where(c("route_short_name").isin(list(routes)))
    tables["trips"] = tables["trips"].join(tables["routes"].select("route_id"), "route_id", "left_semi")
    tables["stop_times"] = typed_stop_times(tables["stop_times"]).join(tables["trips"].select("trip_id"), "trip_id", "left_semi")
    return tables


def typed_stop_times(stop_times: DataFrame) -> DataFrame:
    return stop_times.select(
        "trip_id", c("stop_sequence").try_cast("int").alias("seq"), clock_seconds(c("arrival_time")).alias("arrival"),
        clock_seconds(c("departure_time")).alias("departure"), "stop_id", "pickup_type")


def nest_trips(stop_times: DataFrame, keys: Sequence[str] = ("trip_id",), clock: str = "clock") -> DataFrame:
    """Ordered stop visits per trip as parallel arrays; a trip holds at most some hundred stops."""
    visit = F.array_sort(F.collect_list(F.struct("seq", c(clock).alias("clock"), "stop_id")))
    return stop_times.groupBy(*keys).agg(visit.alias("_v")).select(
        *keys, F.transform("_v", lambda v: v["clock"]).alias("clocks"),
        F.transform("_v", lambda v: v["stop_id"]).alias("stop_ids"))


def validate_timetable(trips: DataFrame, stop_times: DataFrame, calendar: DataFrame, exceptions: DataFrame,
                       stops: DataFrame) -> DataFrame:
    """Problems by kind and entity; an empty result is a usable timetable.

    ``stop_times`` is typed: seq, arrival and departure in seconds.
    """
    order = Window.partitionBy("trip_id").orderBy("seq")
    seen = stop_times.withColumn("_prev", F.lag("departure").over(order))
    per = seen.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("d"),
        F.count_if((c("arrival") > c("departure")) | (c("_prev") > c("arrival"))).alias("back"),
        F.count_if(c("departure") >= 172800).alias("late"), F.count_if(c("arrival").isNull() | c("departure").isNull()).alias("bad"))

    def problem(df: DataFrame, kind: str, entity: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("problem"), entity.cast("string").alias("entity"))

    found = [
        problem(trips.groupBy("trip_id").count().where("count > 1"), "duplicate_trip", c("trip_id")),
        problem(per.where("n < 2 OR d < n"), "unordered_stop_times", c("trip_id")),
        problem(per.where("back > 0"), "backward_clock", c("trip_id")),
        problem(per.where("late > 0"), "clock_beyond_two_days", c("trip_id")),
        problem(per.where("bad > 0"), "invalid_clock", c("trip_id")),
        problem(stop_times.select("stop_id").distinct().join(stops.select("stop_id"), "stop_id", "left_anti"), "unknown_stop", c("stop_id")),
        problem(trips.select("service_id").distinct().join(calendar.select("service_id"), "service_id", "left_anti"),
                "unknown_service", c("service_id")),
        problem(exceptions.where(~c("exception_type").isin("1", "2")), "invalid_exception_type", c("service_id")),
        problem(exceptions.groupBy("service_id", "date").count().where("count > 1"), "duplicate_exception", c("service_id")),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def active_services(calendar: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """(service, day) pairs in force: weekday flag inside the range, exceptions override.

    ``calendar.weekdays`` is an array of seven flags, Monday first; all inputs are calendars.
    """
    span = calendar.withColumn("date", F.explode(F.sequence("start_date", "end_date"))).where(
        F.get("weekdays", F.weekday("date")) == 1).select("service_id", "date", F.lit(True).alias("_flag"))
    special = exceptions.select("service_id", "date", (c("exception_type") == "1").alias("_special"))
    both = span.join(special, ["service_id", "date"], "full")
    on = both.where(F.coalesce("_special", "_flag"))
    return on.join(days.select("date").distinct(), "date", "left_semi").select("service_id", c("date").alias("service_day"))


def active_trips(trips: DataFrame, calendar: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """Trip instances a day may see: its own service day and the one before (past midnight)."""
    both = days.select(c("date").alias("day"), c("date")).unionByName(
        days.select(c("date").alias("day"), F.date_sub("date", 1).alias("date")))
    on = active_services(calendar, exceptions, both)
    wanted = both.select("day", c("date").alias("service_day"))
    return trips.join(on, "service_id").join(wanted, "service_day")


def transfer_templates(duty_services: DataFrame, services: DataFrame, targets: DataFrame) -> DataFrame:
    """Donor day of a duty without service: nearest day of the same type, ties to the past.

    ``services`` has (service_id, service_day, day_type) for the whole calendar and ``targets``
    (service_day, day_type); per duty that is at most one row per calendar day.
    """
    offered = duty_services.join(services, "service_id").select("duty", c("service_day").alias("donor"), "day_type").distinct()
    wanted = duty_services.select("duty").distinct().join(targets, how="cross").join(
        offered.select("duty", c("donor").alias("service_day")), ["duty", "service_day"], "left_anti")
    gap = F.datediff("donor", "service_day")
    best = F.min_by(c("donor"), F.struct(F.abs(gap), c("donor") > c("service_day"), c("donor")))
    return wanted.join(offered, ["duty", "day_type"]).groupBy("duty", "service_day").agg(best.alias("donor")).withColumn(
        "gap_days", F.datediff("donor", "service_day"))


def split_trips(spans: DataFrame, cutoff: Column, bound: int = 1800) -> DataFrame:
    """``early``, ``late`` or ``crossing`` around a cutoff for every shift within the bound."""
    part = (F.when(c("last_clock") + bound < cutoff, "early").when(c("first_clock") - bound >= cutoff, "late")
            .otherwise("crossing"))
    return spans.withColumn("part", part)


def duty_component(trip_id: Column) -> Column:
    """Fourth numeric part of ``a_b_c_d``; NULL for any other shape."""
    return F.when(trip_id.rlike(r"^\d+_\d+_\d+_\d+$"), F.element_at(F.split(trip_id, "_"), 4))


def schedule_coverage(spans: DataFrame, day_start: int = 0, day_end: int = 86400) -> DataFrame:
    """Trips and union length of their clipped intervals per route and day."""
    clipped = spans.select("route", "service_day", F.greatest("first_clock", F.lit(day_start)).alias("a"),
                           F.least("last_clock", F.lit(day_end)).alias("b")).where("b > a")
    # distinct intervals of one route and day: bounded by the seconds of a day squared away by starts
    starts = clipped.groupBy("route", "service_day", "a").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("route", "service_day").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("b").over(order), F.lit(day_start))
    rows = starts.withColumn("_add", F.greatest(c("b") - F.greatest(reach, c("a")), F.lit(0)))
    return rows.groupBy("route", "service_day").agg(F.sum("n").alias("trips"), F.sum("_add").alias("covered_seconds"))


def cycle_times(spans: DataFrame, group: Sequence[str] = ("route",), shortest: int = 20, longest: int = 240,
                layover: int = 1800) -> DataFrame:
    """Out-back-out cycles of one duty and service day: median, index p10 and p90, count."""
    order = Window.partitionBy("duty", "service_day", *group).orderBy("first_clock", "trip_id")
    nxt, nxt2 = F.lead(F.struct("first_clock", "last_clock", "direction"), 1).over(order), F.lead(
        F.struct("first_clock", "last_clock", "direction"), 2).over(order)
    rows = spans.withColumn("_b", nxt).withColumn("_c", nxt2)
    wait1, wait2 = c("_b.first_clock") - c("last_clock"), c("_c.first_clock") - c("_b.last_clock")
    minutes = (c("_c.first_clock") - c("first_clock")) / 60.0
    cycles = rows.where(
        (c("direction") != c("_b.direction")) & (c("direction") == c("_c.direction")) & wait1.between(0, layover)
        & wait2.between(0, layover) & minutes.between(shortest, longest)).select(*group, minutes.alias("minutes"))
    # cycle lengths are whole seconds inside four hours: few distinct values per group
    counted = cycles.groupBy(*group, "minutes").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*group)
    upto = F.sum("k").over(w.orderBy("minutes").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("*", upto.alias("_upto"), F.sum("k").over(w).alias("_n"))

    def at(share: float) -> Column:
        index = F.floor((c("_n") - 1) * share)
        return F.min(F.when(c("_upto") > index, c("minutes")))

    return ranked.groupBy(*group).agg(
        F.percentile("minutes", F.lit(0.5), c("k")).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"),
        F.sum("k").alias("cycles"))


def departure_histogram(spans: DataFrame, group: Sequence[str] = ("route",), bins: int = 48) -> DataFrame:
    """Trip starts per service hour, zero hours included."""
    counts = spans.groupBy(*group, F.floor(c("first_clock") / 3600).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("starts"))
    grid = spans.select(*group).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("hour"))
    return grid.join(counts, [*group, "hour"], "left").withColumn("starts", F.coalesce("starts", F.lit(0)))


def trip_shapes(nested: DataFrame) -> DataFrame:
    """Trips with equal direction, relative clocks and stops merged; source ids kept.

    The ids of one shape stay one row per trip (``shape`` is the shared key), so a very common
    shape never becomes one long list.
    """
    relative = F.transform("clocks", lambda x: x - F.get("clocks", F.lit(0)))
    key = F.sha2(F.to_json(F.struct("direction", relative.alias("relative"), "stop_ids")), 256)
    return nested.select(key.alias("shape"), "direction", "trip_id", relative.alias("relative"), "stop_ids")


def parse_weekdays(row: Mapping[str, str]) -> list[int]:
    """Seven flags, Monday first, from one calendar record."""
    return [int(row[d]) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]
