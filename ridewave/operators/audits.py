"""Clock calibration, paired comparisons, flows and edge fits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.operators.blocks import exact_quantiles, nearest_distance
from ridewave.operators.joins import require
from ridewave.operators.mapping import interval_edges, look_up, only_value

c = F.col
CAP = 300.0
BOUND = 1800
SHIFTS = tuple(range(-BOUND, BOUND + 1, 30))


def nearest_errors(events: DataFrame, clocks: DataFrame, keys: Sequence[str], second: str = "sec", clock: str = "clock",
                   shift: int = 0) -> DataFrame:
    """Distance of each event to the closest (shifted) schedule clock of its key."""
    moved = clocks.select(*keys, (c(clock) + shift).alias(clock)).distinct()
    return nearest_distance(events, moved, keys, second, clock, "error", block_seconds=86400)


def calibration_losses(events: DataFrame, clocks: DataFrame, keys: Sequence[str], shifts: Sequence[int] = SHIFTS,
                       second: str = "sec", clock: str = "clock", cap: float = CAP, within: Sequence[str] = ()) -> DataFrame:
    """Mean capped nearest error of every shift, per key and ``within`` (columns of the events alone).

    Only clocks within the cap of a shifted event can matter, so seconds meet the clocks within the cap and the largest
    shift through time buckets, and only such pairs are tried with the shifts; everything else counts as the cap.
    """
    reach, groups = int(cap), [*keys, *within]
    low, high = min(shifts) - reach, max(shifts) + reach
    span = high - low
    grid = F.array(*[F.lit(s) for s in sorted(set(shifts))])
    # events of one second are counted first: no event is copied, a second is
    counted = events.groupBy(*groups, second).agg(F.count(F.lit(1)).alias("n"))
    placed = counted.select(*groups, "n", c(second).alias("_sec"), F.floor(c(second) / span).alias("_k"))
    wide = clocks.select(*keys, c(clock).alias("_c")).distinct().withColumn("_k", F.explode(F.sequence(
        F.floor((c("_c") + low) / span), F.floor((c("_c") + high) / span))))
    # size estimates do not see explode: a merge join keeps the copies off the driver
    pairs = placed.hint("merge").join(wide, [*keys, "_k"]).where((c("_sec") - c("_c")).between(low, high))
    near = pairs.select(*groups, "_k", "_sec", "n", (c("_sec") - c("_c")).alias("_d"), F.explode(F.filter(
        grid, lambda s: F.abs(c("_sec") - c("_c") - s) < reach)).alias("shift")).groupBy(*groups, "_k", "_sec", "n", "shift").agg(
        F.min(F.abs(c("_d") - c("shift"))).alias("_e"))
    saved = near.select(*groups, "shift", F.lit(0).cast("bigint").alias("n"), ((reach - c("_e")) * c("n")).alias("_saved"))
    whole = counted.groupBy(*groups).agg(F.sum("n").alias("n")).select(*groups, F.explode(grid).alias("shift"), "n", F.lit(0).alias("_saved"))
    return whole.unionByName(saved).groupBy(*groups, "shift").agg(
        ((reach * F.sum("n") - F.sum("_saved")) / F.sum("n")).alias("loss"), F.sum("n").alias("events"))


def _with_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.where(reduce(and_, [c(k).isNotNull() for k in keys]))


def _least_loss(curve: Column) -> Column:
    """The entry (loss, size, shift, events) of least loss; ties: smaller size, then earlier."""
    return F.array_min(curve)


def _near(curve: Column, slack: float) -> Column:
    """Shifts whose loss is within the slack of the least."""
    return F.transform(F.filter(curve, lambda x: x["loss"] <= _least_loss(curve)["loss"] + slack), lambda x: x["shift"])


def _curve(loss: str, events: str) -> Column:
    """The losses of a key's shifts as one list, as long as the grid of shifts."""
    return F.collect_list(F.when(c(loss).isNotNull(), F.struct(
        c(loss).alias("loss"), F.abs("shift").alias("size"), c("shift").alias("shift"), c(events).alias("events"))))


def calibrate_shift(losses: DataFrame, keys: Sequence[str], slack: float = 5.0, bound: int = BOUND) -> DataFrame:
    """Shift of the least loss (ties: smaller size, then earlier) and the near-optimal range.  Rows without a key get none."""
    curves = _with_keys(losses, keys).groupBy(*keys).agg(_curve("loss", "events").alias("_l"))
    best = curves.where(F.size("_l") > 0).select(*keys, _least_loss(c("_l")).alias("b"), _near(c("_l"), slack).alias("_near"))
    return best.select(
        *keys, "b.shift", "b.loss", "b.events", F.array_min("_near").alias("near_low"), F.array_max("_near").alias("near_high"),
        F.size("_near").cast("bigint").alias("near_count"), (F.abs("b.shift") == bound).alias("at_bound"))


def guarded_shift(events: DataFrame, clocks: DataFrame, keys: Sequence[str], half: Column, shifts: Sequence[int] = SHIFTS,
                  minimum: int = 10, second: str = "sec") -> DataFrame:
    """Accept the early shift only when both early halves agree and the second half gains.

    One loss table with both halves; the full loss is their weighted mean.  Events without a key get no shift.
    """
    marked = events.withColumn("_half", F.when(half, "a").otherwise("b"))
    losses = calibration_losses(marked, clocks, keys, shifts, second, within=["_half"])
    side = lambda p, x: F.max(F.when(c("_half") == p, c(x)))
    both = _with_keys(losses, keys).groupBy(*keys, "shift").agg(
        (F.sum(c("loss") * c("events")) / F.sum("events")).alias("loss"), F.sum("events").alias("events"),
        *[side(p, x).alias(f"{p}_{x}") for p in ("a", "b") for x in ("loss", "events")])
    curves = both.groupBy(*keys).agg(
        _curve("loss", "events").alias("_full"), _curve("a_loss", "a_events").alias("_a"), _curve("b_loss", "b_events").alias("_b"))
    best = {p: F.when(F.size(f"_{p}") > 0, _least_loss(c(f"_{p}"))) for p in ("full", "a", "b")}
    span = lambda p: F.array_max(_near(c(p), 5.0)) - F.array_min(_near(c(p), 5.0))
    at = lambda s: F.array_max(F.transform(F.filter("_b", lambda x: x["shift"] == s), lambda x: x["loss"]))
    rows = curves.select(
        *keys, best["full"]["shift"].alias("full_shift"), best["a"]["shift"].alias("a_shift"), span("_a").alias("a_range"), best["a"]["events"].alias("a_n"),
        best["b"]["shift"].alias("b_shift"), span("_b").alias("b_range"), best["b"]["events"].alias("b_n"), "_b")
    rows = rows.withColumn("gain", at(F.lit(0)) - at(c("a_shift")))
    few = (F.coalesce("a_n", F.lit(0)) < minimum) | (F.coalesce("b_n", F.lit(0)) < minimum)
    reason = (F.when(few, "insufficient_early_halves").when((c("a_range") > 120) | (c("b_range") > 120), "ambiguous_early_shift")
              .when((F.abs(c("a_shift") - c("b_shift")) > 60) | (F.abs(c("full_shift") - c("a_shift")) > 60), "unstable_early_shift")
              .when(F.coalesce(c("gain"), F.lit(0.0)) < 5, "no_early_validation_gain").otherwise("accepted"))
    return rows.withColumn("reason", reason).select(
        *keys, F.when(c("reason") == "accepted", c("full_shift")).otherwise(0).alias("shift"), "reason",
        F.coalesce("a_n", F.lit(0)).alias("first_events"), F.coalesce("b_n", F.lit(0)).alias("second_events"), "gain")


def clock_directions(events: DataFrame, spans: DataFrame, clocks: DataFrame, keys: Sequence[str], shift: int = 0,
                     second: str = "sec") -> DataFrame:
    """Direction of an event from its only active trip when the closest clock (<= 60 s) agrees."""
    edges = interval_edges(spans.withColumns({x: c(x) + shift for x in ("first_clock", "last_clock")}), keys, "first_clock", "last_clock", "direction")
    at = c("clock") + shift
    sides = clocks.where(c("direction").isin(0, 1)).select(*keys, at.alias("at"), *[
        F.when(c("direction") == d, at).alias(f"_e{d}") for d in (0, 1)]).distinct()
    out = look_up(events, edges.unionByName(sides, allowMissingColumns=True), keys, second, near=["_e0", "_e1"])
    far = F.lit(10 ** 9)
    e0, e1 = (F.coalesce(F.least(c(second) - c(f"_e{d}_back"), c(f"_e{d}_next") - c(second)), far) for d in (0, 1))
    selected = F.when(e0 < e1, 0).otherwise(1)
    fine = (F.least(e0, e1) <= 60) & (e0 != e1) & (selected == only_value())
    return out.select(*events.columns, F.when(F.coalesce(fine, F.lit(False)), selected).otherwise(-1).alias("clock_direction"))


def enroll_stability(events: DataFrame, spans: DataFrame, keys: Sequence[str], second: str = "sec",
                     shifts: Sequence[int] = (0, -300, 300, -900, 900)) -> DataFrame:
    """Per event: trips at zero shift and whether trip and direction stay unique at +-300 and +-900 s.

    Each different second of a key asks at every shift; trips are not copied by shift, and events only meet their second's answer.
    """
    known = reduce(and_, [c(k).isNotNull() for k in keys])
    asks = events.where(known & c(second).isNotNull()).select(*keys, c(second).alias("_second")).distinct().withColumn("_shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    found = look_up(asks.withColumn("_at", c("_second") + c("_shift")), interval_edges(spans, keys, "first_clock", "last_clock", "direction"), keys, "_at")
    of = lambda s, x: F.max(F.when(c("_shift") == s, x))
    per = found.groupBy(*keys, "_second").agg(*[of(s, c("_n")).alias(f"_n{i}") for i, s in enumerate(shifts)],
                                              *[of(s, only_value()).alias(f"_d{i}") for i, s in enumerate(shifts)])
    same = lambda part: reduce(and_, [(c(f"_n{i}") == 1) & (c(f"_d{i}") == c("_d0")) for i in part])
    judged = per.select(*keys, c("_second").alias(second), c("_n0").alias("trips"), same(range(3)).alias("stable300"), same(range(5)).alias("stable900"))
    rows = events.where(known).join(judged, [*keys, second], "left").unionByName(events.where(~known), allowMissingColumns=True)
    return rows.select(*events.columns, F.coalesce("trips", F.lit(0)).cast("bigint").alias("trips"),
                       F.coalesce("stable300", F.lit(False)).alias("stable300"), F.coalesce("stable900", F.lit(False)).alias("stable900"))


def select_direction(costs: DataFrame, keys: Sequence[str], margin: float = 15.0) -> DataFrame:
    """Direction only when both have finite costs, both steps agree and every margin suffices.

    ``costs``: key, step (3 or 6), direction, cost and intervals of the prefix.
    """
    per = costs.groupBy(*keys, "step").agg(
        F.max(F.when(c("direction") == 0, c("cost"))).alias("c0"), F.max(F.when(c("direction") == 1, c("cost"))).alias("c1"),
        F.max("intervals").alias("_n"))
    diff = c("c1") - c("c0")
    one = per.withColumn("winner", F.when(F.abs(diff) > 1e-9, F.when(diff > 0, 0).otherwise(1))).withColumn(
        "margin", F.abs(diff) / c("_n"))
    g = one.groupBy(*keys).agg(
        F.count_if(c("c0").isNull() | c("c1").isNull()).alias("gaps"), F.count_if(c("winner").isNull()).alias("tied"),
        F.min("winner").alias("w0"), F.max("winner").alias("w1"), F.min("margin").alias("least_margin"))
    reason = (F.when(c("gaps") > 0, "missing_or_nonfinite_direction_cost").when(c("tied") > 0, "tied_costs")
              .when(c("w0") != c("w1"), "step_disagreement").when(c("least_margin") < margin, "insufficient_margin").otherwise("selected"))
    return g.select(*keys, reason.alias("reason"), F.when(reason == "selected", c("w0")).alias("direction"), "least_margin")


def apply_notices(hours: DataFrame, notices: DataFrame) -> DataFrame:
    """Whole hours with the ids of the service notices that exclude them.

    Notices: notice_id, route, start, end (NULL: open), recurrence ``none``, ``weekends`` or
    ``night_after_HH_MM``.  A night runs from its anchor clock to 05:00; the anchor day decides.
    """
    h = hours.withColumn("_at", c("date").cast("timestamp_ntz") + F.make_dt_interval(hours=c("hour")))
    near = h.join(notices, "route").where(
        (c("start") < F.date_add("date", 2).cast("timestamp_ntz")) & (c("end").isNull() | (c("end") > F.date_sub("date", 1).cast("timestamp_ntz"))))
    anchor_h = F.regexp_extract("recurrence", r"night_after_(\d\d)_", 1).try_cast("int")
    anchor_m = F.regexp_extract("recurrence", r"_(\d\d)$", 1).try_cast("int")
    early = anchor_h < 5
    day = F.when(early | (c("hour") >= 5), c("date")).otherwise(F.date_sub("date", 1))
    anchor = day.cast("timestamp_ntz") + F.make_dt_interval(hours=anchor_h, mins=anchor_m)
    in_night = F.when(early, c("hour") < 5).otherwise((c("hour") < 5) | (c("hour") >= 23))
    inside = lambda a, b: (b > c("start")) & (c("end").isNull() | (a < c("end")))
    night = in_night & (anchor >= c("start")) & (c("end").isNull() | (anchor < c("end")))
    hour_end = c("_at") + F.make_dt_interval(hours=F.lit(1))
    plain = inside(c("_at"), hour_end) & ((c("recurrence") != "weekends") | (F.weekday("date") >= 5))
    hit = F.when(c("recurrence").startswith("night_after_"), night).otherwise(plain)
    reasons = near.where(hit).groupBy("route", "date", "hour").agg(F.array_sort(F.collect_set("notice_id")).alias("reasons"))
    return hours.join(reasons, ["route", "date", "hour"], "left").withColumn("eligible", c("reasons").isNull())


def compare_assignments(before: DataFrame, after: DataFrame, key: str = "event_key") -> DataFrame:
    """1:1 comparison of stop assignments; repeated or lost keys stop the run."""
    both = before.select(key, c("stop_id").alias("a"), c("direction").alias("da"), F.lit(1).alias("_x")).join(
        after.select(key, c("stop_id").alias("b"), c("direction").alias("db"), F.lit(1).alias("_y")), key, "full")
    per = both.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_x").alias("_x"), F.max("_y").alias("_y"),
        *[F.max(x).alias(x) for x in ("a", "b", "da", "db")])
    per = require(per, (c("_n") > 1) | c("_x").isNull() | c("_y").isNull(), "paired comparison lost or repeated events")
    comparable = c("a").isNotNull() & c("b").isNotNull()
    same = comparable & (c("a") == c("b")) & (c("da") == c("db"))
    out = per.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(c("a").isNotNull() & c("b").isNull()).alias("candidate_to_null"),
        F.count_if(c("a").isNull() & c("b").isNotNull()).alias("null_to_candidate"), F.count_if(c("a").isNull() & c("b").isNull()).alias("both_null"),
        F.count_if(comparable).alias("comparable"), F.count_if(same).alias("same"))
    return out.withColumn("agreement", F.try_divide("same", "comparable"))


def shifted_pairs(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Wrong-pair control: each key of a group meets the next key of the group, cyclically."""
    members = df.select(*by, key).distinct()
    order = Window.partitionBy(*by).orderBy(key)
    first = F.first(key).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return members.withColumn("control_key", F.coalesce(F.lead(key).over(order), first))


def clock_evidence(events: DataFrame, departures: DataFrame, keys: Sequence[str], second: str = "sod", delay: int = 15,
                   sigma: float = 180.0, weight: float = 0.2) -> DataFrame:
    """Log-mixture weight of each boardable visit by the distance on the 24-hour circle.

    Departures are put at -24, 0 and +24 hours, which makes the circle a line.
    """
    day = 86400
    line = departures.where("boardable").select(*keys, F.explode(F.array(
        c("departure") - day, c("departure"), c("departure") + day)).alias("_d")).distinct()
    at = events.withColumn("_at", F.pmod(c(second) - delay, F.lit(day)))
    near = nearest_distance(at, line, keys, "_at", "_d", "delta", block_seconds=3600)
    mix = F.lit(0.15) + F.lit(0.85) * F.exp(F.lit(-0.5) * F.pow(c("delta") / sigma, 2))
    return near.drop("_at").withColumn("evidence", F.lit(weight) * F.log(mix))


def compare_flows(before: DataFrame, after: DataFrame, hour: Sequence[str], stop: Sequence[str], value: str) -> DataFrame:
    """Mass moved between two allocations of the same flow and the correlation of stop totals."""
    keys = [*hour, *stop]
    a = before.groupBy(*keys).agg(F.sum(value).alias("a"))
    b = after.groupBy(*keys).agg(F.sum(value).alias("b"))
    both = a.join(b, keys, "full").fillna(0.0, ["a", "b"])
    hours = both.groupBy(*hour).agg((F.abs(F.sum("a") - F.sum("b")) > 1e-6).alias("_off")).agg(F.count_if("_off").alias("broken_hours"))
    moved = both.agg(F.sum("a").alias("mass"), (F.sum(F.abs(c("a") - c("b"))) / 2).alias("moved"))
    by_stop = [k for k in keys if k not in hour or k == "route"]
    corr = both.groupBy(*by_stop).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.corr("a", "b").alias("stop_correlation"))
    return moved.join(hours, how="cross").join(corr, how="cross").withColumn("moved_fraction", F.try_divide("moved", "mass"))


def dense(row_from: str = "from_events", row_to: str = "to_events") -> Column:
    return F.least(row_from, row_to) >= 3


def transition_rejection() -> Column:
    """First reason a transition cannot teach an edge; NULL when it can."""
    o, e = c("observed_seconds"), c("expected_seconds")
    return (F.when(c("steps") != 1, "not_adjacent").when(~dense(), "sparse_endpoints").when(c("posterior") < 0.5, "low_posterior")
            .when(c("agreement") < 0.75, "scenario_disagreement").when(c("identity_conflict"), "identity_conflict")
            .when(~c("applicable_pattern"), "inapplicable_pattern").when(c("vehicle_key") == "", "missing_vehicle")
            .when(~((o > 0) & (e > 0)), "invalid_interval").when(F.abs(o - e) > F.greatest(F.lit(90.0), 0.75 * e), "large_local_residual"))


def fit_edges(transitions: DataFrame, cutoff) -> DataFrame:
    """Robust duration per pattern edge from transitions before the cutoff.

    Median and MAD come from value frequencies; rows beyond max(30, 3 x 1.4826 MAD) are left out.
    """
    keys = ["pattern_key", "from_state"]
    rows = transitions.where((c("date") < F.lit(cutoff)) & transition_rejection().isNull())
    center = exact_quantiles(rows, keys, "observed_seconds", {"_m": 0.5})
    spread = exact_quantiles(rows.join(center, keys).withColumn("_d", F.abs(c("observed_seconds") - c("_m"))), keys, "_d", {"_mad": 0.5})
    kept = rows.join(center, keys).join(spread, keys).where(
        F.abs(c("observed_seconds") - c("_m")) <= F.greatest(F.lit(30.0), 3 * 1.4826 * c("_mad")))
    support = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"), F.count_distinct("date").alias("dates"),
                                      F.count_distinct("vehicle_key").alias("vehicles"), F.max("date").alias("fitted_through"))
    shape = exact_quantiles(kept, keys, "observed_seconds", {"p10": 0.1, "median_seconds": 0.5, "p90": 0.9})
    final = exact_quantiles(kept.join(shape.select(*keys, c("median_seconds").alias("_c")), keys).withColumn(
        "_d", F.abs(c("observed_seconds") - c("_c"))), keys, "_d", {"mad_seconds": 0.5})
    fit = (c("support") >= 5) & (c("dates") >= 2) & (c("vehicles") >= 2)
    return support.join(shape, keys).join(final, keys).withColumn("supported", fit)


def summarize_transitions(rows: DataFrame, dims: Sequence[Sequence[str]]) -> DataFrame:
    """Resets, skips, residuals and plausibility per dimension, several dimensions at once."""
    axes = F.array(*[F.struct(F.lit("+".join(d) or "overall").alias("dimension"),
                              F.concat_ws("/", *[c(x).cast("string") for x in d]).alias("member")) for d in dims])
    moving = c("steps") > 0
    skipped = F.greatest(c("steps") - 1, F.lit(0))
    residual = c("observed_seconds") - c("expected_seconds")
    long = rows.withColumn("_k", F.explode(axes)).select("*", "_k.*")
    g = long.groupBy("dimension", "member").agg(
        F.count(F.lit(1)).alias("transitions"), F.count_if(moving).alias("moving"), F.count_if(c("steps") < 0).alias("resets"),
        F.count_if(c("steps") == 0).alias("same_visit"), F.sum(F.when(moving, c("steps")).otherwise(0)).alias("advances"),
        F.sum(F.when(moving, skipped).otherwise(0)).alias("skipped"), F.max(F.when(moving, skipped)).alias("longest_skip"),
        F.count_if(moving & (F.abs(residual) <= F.greatest(F.lit(90.0), 0.75 * c("expected_seconds")))).alias("plausible"))
    q = exact_quantiles(long.where(moving).withColumn("_r", residual), ["dimension", "member"], "_r",
                        {"residual_p10": 0.1, "residual_p50": 0.5, "residual_p90": 0.9})
    return g.join(q, ["dimension", "member"], "left").withColumn("plausible_share", F.try_divide("plausible", "moving"))


def skip_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("steps > 0").groupBy((F.greatest(c("steps") - 1, F.lit(0))).alias("skipped")).agg(F.count(F.lit(1)).alias("transitions"))


def validate_holdout(rows: DataFrame, edges: DataFrame, cutoff, fit_vehicles: DataFrame) -> DataFrame:
    """Errors of fitted edges on later dates and vehicles never used to fit."""
    later = rows.where((c("date") >= F.lit(cutoff)) & (c("vehicle_key") != ""))
    fresh = later.join(fit_vehicles.select("vehicle_key").distinct(), "vehicle_key", "left_anti")
    fit = fresh.where((c("steps") == 1) & ~c("identity_conflict") & c("applicable_pattern")
                      & (c("observed_seconds") > 0) & (c("expected_seconds") > 0))
    known = edges.where("supported").select("pattern_key", "from_state", "median_seconds", "fitted_through")
    judged = fit.join(known, ["pattern_key", "from_state"]).where(c("date") > c("fitted_through"))
    counts = later.agg(F.count(F.lit(1)).alias("future_rows")).join(fresh.agg(F.count(F.lit(1)).alias("independent_rows")), how="cross")
    return judged.agg(
        F.count(F.lit(1)).alias("evaluated_rows"), F.avg(F.abs(c("observed_seconds") - c("expected_seconds"))).alias("baseline_mae"),
        F.avg(F.abs(c("observed_seconds") - c("median_seconds"))).alias("profile_mae")).join(counts, how="cross")


def select_cohort(ledger: DataFrame, splits: Sequence[tuple[str, date, date]]) -> DataFrame:
    """Lowest and highest density route, and the first covered Friday-Monday block per split."""
    per = ledger.groupBy("route").agg((F.sum("source_success") / F.count_distinct("date")).alias("density"))
    ends = per.agg(F.min_by("route", F.struct("density", "route")).alias("lowest"), F.max_by("route", F.struct("density", "route")).alias("highest"))
    days = ledger.select("date").distinct()
    bands = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in splits])
    inside = days.withColumn("b", F.explode(F.filter(bands, lambda b: (c("date") >= b["lo"]) & (c("date") < b["hi"])))).select("date", "b.*")
    block = inside.where(F.weekday("date") == 4).select("split", "hi", c("date").alias("friday"), F.explode(F.sequence(
        "date", F.date_add("date", 3))).alias("day")).join(days.select(c("date").alias("day")), "day").where(c("day") < c("hi"))
    full = block.groupBy("split", "friday").agg(F.count(F.lit(1)).alias("n")).where("n = 4").groupBy("split").agg(F.min("friday").alias("friday"))
    first = inside.groupBy("split").agg(F.min("date").alias("_first"))
    return first.join(full, "split", "left").select("split", F.coalesce("friday", "_first").alias("first_day"),
                                                    c("friday").isNotNull().alias("whole_block")).join(ends, how="cross")


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, resamples: int = 2000, seed: int = 7,
                      by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the mean under resampling of whole clusters.

    Rows are first summed per cluster (a date).  A resample of k clusters draws k times; draw j of resample r is the md5 of (seed, r, j), so
    reruns and other engines agree.  How often a resample draws each cluster depends on k alone: these weights are made once for all
    groups of k clusters, and one aggregate applies them to the cluster sums.
    """
    sums = df.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    order = Window.partitionBy(*by).orderBy(cluster)
    ranked = sums.withColumn("_i", F.row_number().over(order).cast("bigint") - 1).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    name = F.concat_ws(":", F.lit(str(seed)), c("_r").cast("string"), c("_j").cast("string"))
    draw = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % c("_k")
    weights = ranked.select("_k").distinct().where("_k >= 2").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), (c("_k") - 1).cast("int")))).groupBy("_k", "_r", draw.alias("_i")).agg(F.count(F.lit(1)).alias("_w"))
    mean = ranked.join(weights, ["_k", "_i"]).groupBy(*by, "_r").agg(F.try_divide(F.sum(c("_w") * c("_s")), F.sum(c("_w") * c("_n"))).alias("_m"))
    return mean.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"),
                                 F.count(F.lit(1)).alias("resamples"))


def paired_summary(df: DataFrame, by: Sequence[str], a: str, b: str, cap: float) -> DataFrame:
    """Wins, ties and losses of a against b where both exist, and capped means of all rows."""
    both = c(a).isNotNull() & c(b).isNotNull()
    capped = lambda x: F.avg(F.least(F.coalesce(c(x).cast("double"), F.lit(cap)), F.lit(cap)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(both).alias("paired"), F.count_if(both & (c(a) < c(b) - 1e-9)).alias("wins"),
        F.count_if(both & (F.abs(c(a) - c(b)) <= 1e-9)).alias("ties"), F.count_if(both & (c(a) > c(b) + 1e-9)).alias("losses"),
        capped(a).alias("capped_a"), capped(b).alias("capped_b"))


def calibration_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gain over zero shift, controls, group-mean and event-weighted loss, refusals."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(c("reason") == "accepted").alias("accepted"),
        F.avg(c("zero_loss") - c("fitted_loss")).alias("mean_gain"), F.avg(c("wrong_loss") - c("fitted_loss")).alias("wrong_key_contrast"),
        F.avg("fitted_loss").alias("group_mean_loss"), F.try_divide(F.sum(c("fitted_loss") * c("events")), F.sum("events")).alias("event_weighted_loss"))


def envelope_summary(states: DataFrame, key: Sequence[str], cap: float) -> DataFrame:
    """Mean, least and most capped loss over tied states of the assigned and opposite direction;
    robust when one maximum is below the other minimum."""
    loss = F.least(F.coalesce(c("loss").cast("double"), F.lit(cap)), F.lit(cap))
    per = states.groupBy(*key).agg(*[f(F.when(c("side") == s, loss)).alias(f"{s}_{n}") for s in ("assigned", "opposite")
                                     for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))],
                                   *[F.count(F.when(c("side") == s, 1)).alias(f"{s}_states") for s in ("assigned", "opposite")])
    both = per.where("assigned_states > 0 AND opposite_states > 0")
    return both.agg(
        F.count(F.lit(1)).alias("windows"), F.avg("assigned_mean").alias("assigned_mean"), F.avg("opposite_mean").alias("opposite_mean"),
        F.avg(c("assigned_most") - c("assigned_least")).alias("assigned_width"),
        F.count_if(c("assigned_states") > 1).alias("assigned_ambiguous"),
        F.count_if(c("assigned_most") < c("opposite_least") - 1e-9).alias("robust_assigned"),
        F.count_if(c("opposite_most") < c("assigned_least") - 1e-9).alias("robust_opposite"))


def uniform_control(flows: DataFrame, visits: DataFrame, hour: Sequence[str], value: str) -> DataFrame:
    """The same route-hour mass spread evenly over the boardable visits of the route."""
    mass = flows.groupBy(*hour).agg(F.sum(value).alias("_m"))
    each = visits.where("boardable").groupBy("route", "stop_id", "stop_direction").agg(F.count(F.lit(1)).alias("_v"))
    total = each.groupBy("route").agg(F.sum("_v").alias("_t"))
    return mass.join(each.join(total, "route"), "route").select(
        *hour, "stop_id", "stop_direction", (c("_m") * c("_v") / c("_t")).alias(value))


def residual_stats(rows: DataFrame, by: Sequence[str], residual: str = "residual") -> DataFrame:
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sequences"), F.count(residual).alias("feasible"), F.avg(F.abs(residual)).alias("mean_abs"),
        F.avg(F.when(c(residual).isNotNull(), (F.abs(residual) <= 30).cast("int"))).alias("within30"))
    q = exact_quantiles(rows.withColumn("_a", F.abs(residual)), by, "_a", {"median_abs": 0.5})
    return g.join(q, list(by), "left")


def forecast_vectors(points: DataFrame, identity: Sequence[str], slots: int) -> DataFrame:
    """One ordered vector per identity; a missing or repeated slot or mixed model stops the run."""
    g = points.groupBy(*identity).agg(
        F.array_sort(F.collect_list(F.struct("slot", "predicted"))).alias("_v"), F.count_distinct("slot").alias("_d"),
        F.count_distinct("model_version").alias("_m"))
    g = require(g, (F.size("_v") != slots) | (c("_d") != slots) | (c("_m") != 1), "forecast vector is incomplete")
    return g.select(*identity, F.transform("_v", lambda v: v["predicted"]).alias("vector"))


def verify_pair(old: DataFrame, new: DataFrame, identity: Sequence[str], hour: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Differences of two datasets that must share identities, masks and route totals."""
    def only(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.select(*identity).distinct().join(b.select(*identity).distinct(), list(identity), "left_anti")

    ids = only(old, new).unionByName(only(new, old)).agg(F.count(F.lit(1)).alias("identity_differences"))
    cell = [*identity, *[h for h in hour if h not in identity]]
    masks = old.select(*cell, c("eligible").alias("a")).join(new.select(*cell, c("eligible").alias("b")), cell, "full").agg(
        F.count_if(~c("a").eqNullSafe(c("b"))).alias("mask_differences"))
    totals = old.groupBy(*hour).agg(F.sum(value).alias("a")).join(new.groupBy(*hour).agg(F.sum(value).alias("b")), list(hour), "full").agg(
        F.count_if(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) > tolerance).alias("total_differences"))
    return ids.join(masks, how="cross").join(totals, how="cross")
