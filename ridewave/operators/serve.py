"""Serving questions over published forecast points: snapshots, planning, rankings, what-if."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.operators.joins import require

c = F.col
# Count targets that may be summed, window limits in days per horizon.
ADDITIVE = ("synthetic_boardings", "validation_count", "boarding_count")
WINDOW_DAYS = {"day": 1, "month": 31, "year": 366}


def selection_problem(start: Column, end: Column, horizon: Column) -> Column:
    """Why a window cannot be served; NULL when it can."""
    limit = F.when(horizon == "day", WINDOW_DAYS["day"]).when(horizon == "month", WINDOW_DAYS["month"]).when(
        horizon == "year", WINDOW_DAYS["year"])
    days = F.datediff(end, start)
    return (F.when(limit.isNull(), "unsupported horizon").when(start.isNull() != end.isNull(), "start and end must be supplied together")
            .when((days <= 0) | (days > limit), "window must be positive and within the horizon limit"))


def resolve_run(runs: DataFrame, points: DataFrame, active: DataFrame, horizon: str) -> DataFrame:
    """Run of each route: the active pointer, else the newest published run with points for it."""
    served = points.select("run_id", "route_id").distinct()
    newest = served.join(runs.where((c("horizon") == horizon) & (c("state") == "published")), "run_id").groupBy("route_id").agg(
        F.max_by("run_id", F.struct("generated_at", "run_id")).alias("_newest"))
    pointer = active.where(c("horizon") == horizon).select("route_id", c("run_id").alias("_active"))
    both = newest.join(pointer, "route_id", "full")
    return both.select("route_id", F.coalesce("_active", "_newest").alias("run_id"),
                       F.when(c("_active").isNotNull(), "active_pointer").otherwise("newest_published").alias("basis"))


def activate(active: DataFrame, new: DataFrame) -> DataFrame:
    """Pointer table after an upsert: one run per route and horizon, the new one wins."""
    both = active.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("route_id", "horizon").agg(F.max_by("run_id", F.struct("_new", "run_id")).alias("run_id"))


def write_active(active: DataFrame, out: str) -> None:
    """Copy-on-write of the small pointer table, after the run partition is in place."""
    active.coalesce(1).write.mode("overwrite").parquet(out)


def latest_complete_runs(runs: DataFrame, points: DataFrame, complete: DataFrame) -> DataFrame:
    """Latest complete published run per route and horizon."""
    usable = runs.where("state = 'published'").join(complete.select("run_id"), "run_id", "left_semi")
    served = points.select("run_id", "route_id").distinct()
    return served.join(usable, "run_id").groupBy("route_id", "horizon").agg(
        F.max_by("run_id", F.struct("generated_at", "run_id")).alias("run_id"))


def forecast_snapshot(points: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Points per bucket with an exact decimal sum.

    Bounds, capacity and direction survive only when one source row feeds the bucket.  Rows that
    may not be summed (targets that are no counts, a mixture of unspecified and explicit
    directions) stop the run, or are reported as ``conflict`` when not strict.
    """
    exact = F.sum(c("predicted").cast("decimal(28,9)"))
    g = points.groupBy(*keys, "target").agg(
        exact.alias("_sum"), F.min("predicted").alias("_one"), F.min("lower").alias("_l"), F.max("upper").alias("_u"),
        F.min("capacity").alias("_c"), F.count(F.lit(1)).alias("sources"), F.min("direction").alias("_d"),
        F.count_if(c("direction").isNull()).alias("_free"))
    one = c("sources") == 1
    conflict = (F.when(~one & ~c("target").isin(list(ADDITIVE)), "target cannot be summed")
                .when(~one & (c("_free") > 0), "unspecified and explicit directions overlap"))
    if strict:
        g = require(g, conflict.isNotNull(), "forecast rows cannot be summed")
    fine = F.lit(True) if strict else conflict.isNull()
    return g.select(*keys, "target", "sources", F.when(fine, F.when(one, c("_one")).otherwise(c("_sum").cast("double"))).alias("predicted"),
                    F.when(one, c("_l")).alias("lower"), F.when(one, c("_u")).alias("upper"), F.when(one, c("_c")).alias("capacity"),
                    F.when(one, c("_d")).alias("direction"), conflict.alias("conflict"))


def stop_loads(snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Load per stop; a percentage only when one bucket with a known capacity stands behind it."""
    g = snapshot.groupBy(*keys).agg(F.sum("predicted").alias("predicted"), F.count(F.lit(1)).alias("buckets"),
                                    F.max("capacity").alias("_c"))
    usable = (c("buckets") == 1) & (c("_c") > 0)
    return g.select(*keys, "predicted", "buckets", F.when(usable, c("predicted") / c("_c") * 100).alias("load_percent"))


def peaks(snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak passengers, and peak load when every bucket has a capacity."""
    g = snapshot.groupBy(*keys).agg(
        F.max("predicted").alias("peak_passengers"), F.count_if(c("capacity").isNull() | (c("capacity") <= 0)).alias("_x"),
        F.max(F.try_divide("predicted", "capacity") * 100).alias("_p"))
    return g.select(*keys, "peak_passengers", F.when(c("_x") == 0, c("_p")).alias("peak_load_percent"))


def what_if(loads: DataFrame, demand_percent: float, vehicles: int, interval_percent: float) -> DataFrame:
    """Demand and capacity factors applied to predictions and loads."""
    demand = max(0.1, 1 + demand_percent / 100)
    capacity = max(0.25, 1 + vehicles * 0.08 - interval_percent / 100)
    return loads.select(
        "*", (c("predicted") * demand).alias("scenario_predicted"), (c("load_percent") * (demand / capacity)).alias("scenario_load_percent"),
        (c("predicted") * (demand - 1)).alias("passenger_delta"), F.lit((capacity - 1) * 100).alias("capacity_delta"))


def to_daily(hours: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return hours.groupBy(*keys, "date").agg(F.sum(value).alias(value))


def route_stops(visits: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops of each route by first visit."""
    first = visits.groupBy("route", "stop_id").agg(F.min("seq").alias("sequence"))
    return first.join(stops, "stop_id")


def bounded(df: DataFrame, limit: int, message: str = "selection exceeds the response limit") -> DataFrame:
    """The rows of an answer, or an error when there is one row too many: limit + 1 are read."""
    probe = df.limit(limit + 1)
    count = probe.agg(F.count(F.lit(1)).alias("_n"))
    return probe.join(require(count, c("_n") > limit, message), how="cross").drop("_n")


def planning_shares(predictions: DataFrame, value: str = "predicted") -> DataFrame:
    """Share of each stop and direction in its route, weekday and hour."""
    cells = predictions.groupBy("route", F.weekday("date").alias("dow"), "hour", "stop_id", "direction").agg(F.sum(value).alias("_v"))
    total = cells.groupBy("route", "dow", "hour").agg(F.sum("_v").alias("_t"))
    return cells.join(total, ["route", "dow", "hour"]).where("_t > 0").select(
        "route", "dow", "hour", "stop_id", "direction", (c("_v") / c("_t")).alias("share"))


def project_profile(rows: DataFrame, grid: DataFrame, value: str = "value") -> DataFrame:
    """Grid values, and the weekday-hour mean of the known ones beyond the grid."""
    profile = rows.groupBy("route", F.weekday("date").alias("dow"), "hour").agg(F.avg(value).alias("_p"))
    known = rows.select("route", "date", "hour", c(value).alias("_k"))
    out = grid.withColumn("dow", F.weekday("date")).join(known, ["route", "date", "hour"], "left").join(
        profile, ["route", "dow", "hour"], "left")
    return out.select("route", "date", "hour", "dow", F.coalesce("_k", "_p").alias(value), c("_k").isNull().alias("projected"))


def planning_forecast(hours: DataFrame, shares: DataFrame, bucket: Column, catalog: DataFrame, stop: int | None = None,
                      direction: int | None = None) -> DataFrame:
    """Hour values spread over stops by share and summed into buckets.

    Shares outside the catalogue and the unshared rest form the unknown remainder.  A stop or
    direction filter changes the rows shown, never the route totals.
    """
    keys = ["route", "bucket"]
    base = hours.withColumn("bucket", bucket)
    known = shares.join(catalog.select("route", "stop_id", "direction").distinct(), ["route", "stop_id", "direction"], "left_semi")
    cells = base.join(known, ["route", "dow", "hour"]).groupBy(*keys, "stop_id", "direction").agg(F.sum(c("value") * c("share")).alias("baseline"))
    covered = known.groupBy("route", "dow", "hour").agg(F.sum("share").alias("_s"))
    totals = base.join(covered, ["route", "dow", "hour"], "left").groupBy(*keys).agg(
        F.sum("value").alias("route_baseline"),
        F.sum(F.greatest(c("value") * (1 - F.coalesce("_s", F.lit(0.0))), F.lit(0.0))).alias("route_unknown"))
    shown = cells
    if stop is not None:
        shown = shown.where(c("stop_id") == stop)
    if direction is not None:
        shown = shown.where(c("direction") == direction)
    filtered = stop is not None or direction is not None
    visible = shown.groupBy(*keys).agg(F.sum("baseline").alias("_b"), F.count(F.lit(1)).alias("cells"))
    out = totals.join(visible, keys, "left")
    unknown = F.lit(0.0) if filtered else c("route_unknown")
    return out.select(*keys, "route_baseline", "route_unknown", F.coalesce("cells", F.lit(0)).alias("cells"),
                      (F.coalesce("_b", F.lit(0.0)) + unknown).alias("baseline"), unknown.alias("unallocated"))


def insights(points: DataFrame, spatial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, peak bucket with its hourly rate, and busiest stop."""
    hours = c("hours")
    total = points.groupBy(*keys).agg(
        F.sum("scenario").alias("total"),
        F.max_by(F.struct("bucket", "scenario", (c("scenario") / hours).alias("rate")), F.when(hours > 0, F.struct(
            c("scenario"), -F.datediff("bucket", F.lit("1970-01-01").cast("date"))))).alias("p"))
    stops = spatial.groupBy(*keys, "stop_id", "direction").agg(F.sum("scenario").alias("s"))
    busy = stops.groupBy(*keys).agg(F.max_by(F.struct("stop_id", "direction", "s"), F.struct("s", -c("stop_id"), -c("direction"))).alias("b"))
    return total.join(busy, list(keys), "left").select(
        *keys, "total", c("p.bucket").alias("peak_bucket"), c("p.scenario").alias("peak_count"), c("p.rate").alias("peak_rate"),
        c("b.stop_id").alias("busiest_stop"), c("b.s").alias("busiest_count"))


def hot_spots(spatial: DataFrame, rate: float, k: int) -> DataFrame:
    """The k stop buckets with the highest hourly rate at or above the threshold: a top-k report."""
    rows = spatial.withColumn("rate", c("scenario") / c("hours")).where(c("rate") >= rate)
    return rows.orderBy(F.desc("rate"), "bucket", "stop_id", "direction").limit(k)


def range_totals(points: DataFrame, a, b, keys: Sequence[str]) -> DataFrame:
    """Sums between two bucket starts, inclusive, in either order; an unknown bound falls back to
    the end of the period on its side."""
    ends = points.groupBy(*keys).agg(
        F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"),
        F.max(F.when(c("bucket") == F.lit(a), c("bucket"))).alias("_a"), F.max(F.when(c("bucket") == F.lit(b), c("bucket"))).alias("_b"))
    x, y = F.coalesce("_a", "_lo"), F.coalesce("_b", "_hi")
    bounds = ends.select(*keys, F.least(x, y).alias("from"), F.greatest(x, y).alias("to"))
    return points.join(bounds, list(keys)).where(c("bucket").between(c("from"), c("to"))).groupBy(*keys, "from", "to").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum("baseline").alias("baseline"), F.sum("scenario").alias("scenario"))


def hourly_rate(count: Column, hours: Column) -> Column:
    """Passengers per elapsed hour; NULL for a bad count or an empty bucket."""
    return F.when((count >= 0) & (hours > 0), count / hours)


def busiest_window(points: DataFrame, departures: DataFrame, hours: int = 3, by: Sequence[str] = ("route", "date")) -> DataFrame:
    """Busiest run of whole hours per route-day: boardings per departure where the timetable is
    usable there, plain boardings otherwise; the earliest start wins ties.
    """
    order = Window.partitionBy(*by).orderBy("hour")
    ahead = order.rowsBetween(0, hours - 1)
    rows = points.join(departures, ["route", "hour"], "left").withColumn("_n", F.count(F.lit(1)).over(ahead))
    rows = rows.withColumn("boardings_sum", F.sum("boardings").over(ahead)).withColumn(
        "scheduled", F.when(F.count("departures").over(ahead) == hours, F.sum("departures").over(ahead))).withColumn(
        "_busy", F.count_if(c("departures") > 0).over(ahead))
    need = -(-7 * hours // 10)
    usable = c("scheduled").isNotNull() & (c("_busy") >= need) & (c("scheduled") >= 2 * hours)
    full = rows.where(c("_n") == hours).withColumn("pressure", F.when(usable, F.try_divide("boardings_sum", "scheduled")))
    rank = F.struct(c("pressure").isNotNull(), F.coalesce("pressure", F.lit(0.0)), c("boardings_sum"), -c("hour"))
    best = full.groupBy(*by).agg(F.max_by(F.struct("hour", "boardings_sum", "scheduled", "pressure"), rank).alias("w"))
    day = points.groupBy(*by).agg(
        F.sum("boardings").alias("day_boardings"), F.max_by(F.struct("hour", "boardings"), F.struct(c("boardings"), -c("hour"))).alias("p"))
    return best.join(day, list(by)).select(
        *by, c("w.hour").alias("window_start"), (c("w.hour") + hours).alias("window_end"), c("w.boardings_sum").alias("window_boardings"),
        F.when(c("w.pressure").isNotNull(), c("w.scheduled")).alias("scheduled_departures"), c("w.pressure").alias("boardings_per_departure"),
        c("p.hour").alias("peak_hour"), c("p.boardings").alias("peak_boardings"),
        F.coalesce(F.try_divide("w.boardings_sum", "day_boardings"), F.lit(0.0)).alias("window_share"))


def rank_routes(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Priority order: pressure (unknown last), then window boardings, then route."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("boardings_per_departure"), F.desc("window_boardings"), "route")
    return windows.withColumn("rank", F.row_number().over(order))


def natural_key(column: str) -> list[Column]:
    """Numeric texts first by number, then the rest by text."""
    number = c(column).try_cast("bigint")
    return [number.isNull(), number, c(column)]


def natural_sort(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*natural_key(column))


def pressure_tier(value: Column, median: Column) -> Column:
    return (F.when(value.isNull() | F.isnan(value) | (median <= 0), "unknown").when(value >= median * 1.5, "high")
            .when(value >= median * 1.15, "elevated").otherwise("regular"))


def simulate_service(windows: DataFrame, headway: float, cycle: float, extra: int, directions: int) -> DataFrame:
    """Departures and boardings per departure before and after extra vehicles."""
    if not (2 <= headway <= 240 and 20 <= cycle <= 240 and 0 <= extra <= 5 and directions in (1, 2)):
        raise ValueError("service assumptions outside the supported range")
    before = directions * 60 / headway
    after = before + directions * extra * 60 / cycle
    span = c("window_end") - c("window_start")
    return windows.select(
        "*", F.lit(before).alias("baseline_departures"), F.lit(after).alias("scenario_departures"),
        F.lit(directions * 60 / after).alias("scenario_headway"), (span * (after - before)).alias("extra_departures"),
        (c("window_boardings") / (span * before)).alias("baseline_per_departure"), (c("window_boardings") / (span * after)).alias("scenario_per_departure"),
        F.lit(100 * (1 - before / after)).alias("reduction_percent"))


def service_estimate(profiles: DataFrame, days: DataFrame) -> DataFrame:
    """Departures of a day: exactly one profile must match it and one the day before, whose
    hours past midnight roll in."""
    valid = profiles.withColumn("date", F.explode(F.sequence("valid_from", "valid_to"))).where(
        F.array_contains("weekdays", F.weekday("date")))
    fit = valid.join(days.select("date").distinct(), "date", "left_semi")
    one = fit.groupBy("route", "date").agg(F.count(F.lit(1)).alias("_n"), F.first("starts").alias("starts"),
                                           F.first("cycle").alias("cycle")).where("_n = 1").drop("_n")
    day = Window.partitionBy("route").orderBy("date")  # one row a day; a join would collect the copied profiles to broadcast them
    both = one.where("route IS NOT NULL").withColumn("_late", F.when(F.lag("date").over(day) == F.date_sub("date", 1), F.lag("starts").over(day))).where("_late IS NOT NULL")
    return both.select("route", "date", "cycle", F.zip_with(
        F.slice("starts", 1, 24), F.slice("_late", 25, 24), lambda a, b: a + F.coalesce(b, F.lit(0))).alias("departures"))


def stop_bearings(stops: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Bearing to the next stop at another place, else from the previous one."""
    from ridewave.functions.geo import bearing

    w = Window.partitionBy(*by).orderBy(order)
    place = F.struct("lat", "lon")
    marked = stops.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn(
        "_new", F.coalesce((F.lag(place).over(w) != place).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spots = runs.groupBy(*by, "_run").agg(F.first("lat").alias("_lat"), F.first("lon").alias("_lon"))
    r = Window.partitionBy(*by).orderBy("_run")
    spots = spots.select(*by, "_run", "_lat", "_lon", F.lead(F.struct("_lat", "_lon")).over(r).alias("_n"), F.lag(F.struct("_lat", "_lon")).over(r).alias("_p"))
    ahead = bearing(c("_lat"), c("_lon"), c("_n._lat"), c("_n._lon"))
    back = bearing(c("_p._lat"), c("_p._lon"), c("_lat"), c("_lon"))
    value = F.when(c("_n").isNotNull(), ahead).when(c("_p").isNotNull(), back)
    return runs.join(spots.withColumn("bearing", value).select(*by, "_run", "bearing"), [*by, "_run"]).select(*stops.columns, "bearing")


def direction_names(stops: DataFrame, by: Sequence[str], order: str, name: str = "name") -> DataFrame:
    return stops.groupBy(*by).agg(F.max_by(name, c(order)).alias("terminal"))


def demand_mass(predictions: DataFrame, catalog: DataFrame, value: str = "predicted") -> DataFrame:
    """Month x route x hour x point sums with located and unlocated mass."""
    rows = predictions.join(catalog.select("stop_id", "lat", "lon"), "stop_id", "left")
    return rows.groupBy(F.date_format("date", "yyyy-MM").alias("month"), "route", "hour", "stop_id").agg(
        F.sum(value).alias("mass"), F.count_if(c("lat").isNull()).alias("unlocated_rows"))


def enabled_sources(mask: Column, names: Sequence[str]) -> Column:
    """Names of the set bits of a mask."""
    bits = [F.when(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1, F.lit(n)) for i, n in enumerate(names)]
    return F.array_compact(F.array(*bits))


def normalised_weights(factors: Mapping[str, float]) -> dict[str, float]:
    """Base weight one plus the enabled multipliers, scaled to one."""
    used = {n: v for n, v in factors.items() if v > 0}
    total = 1 + sum(used.values())
    return {"base": 1 / total, **{n: v / total for n, v in used.items()}}
