"""Source identities to canonical routes, stops and visits; ambiguity is an outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.functions.geo import cell, cells_around, haversine, planar
from ridewave.operators.joins import range_join, require

c = F.col


def resolve_pattern(events: DataFrame, routes: DataFrame, directions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Canonical route and direction with ``reason`` when they cannot be named."""
    r = routes.select(c("source").alias("source_route"), c("target").alias("route_id"))
    d = directions.select(c("source").alias("source_direction"), c("target").alias("direction_id"))
    p = patterns.select("route_id", "direction_id").distinct().withColumn("_p", F.lit(True))
    out = events.join(r, "source_route", "left").join(d, "source_direction", "left").join(p, ["route_id", "direction_id"], "left")
    reason = (F.when(c("source_route").isNull(), "route_missing").when(c("route_id").isNull(), "unknown_route")
              .when(c("source_direction").isNull(), "direction_missing").when(c("direction_id").isNull(), "unknown_direction")
              .when(c("_p").isNull(), "unknown_pattern"))
    return out.withColumn("reason", reason).drop("_p")


def assignment_at(events: DataFrame, assignments: DataFrame, key: str = "event_id", second: str = "sec") -> DataFrame:
    """Route the vehicle was assigned to at the event; the earliest covering interval wins."""
    hits = range_join(events.select(key, "vehicle", second), assignments, ["vehicle"], second, "valid_from", "valid_to", bucket=86400)
    first = hits.groupBy(key).agg(F.min_by("assigned_route", "valid_from").alias("assigned_route"))
    return events.join(first, key, "left")


def match_name(events: DataFrame, visits: DataFrame, key: str = "event_id") -> DataFrame:
    """Candidates by stop name on the event's own pattern: how many, and the one when single."""
    one = ["route_id", "direction_id", "stop_name"]
    # stops of one name meet before the events do: an event joins one row, however many stops share the name
    names = visits.select("route_id", "direction_id", c("name").alias("stop_name"), c("stop_id").alias("_s")).distinct().groupBy(*one).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_least"), F.collect_set("_s").alias("_all"))
    return events.join(names, one).groupBy(key).agg(F.sum("_n").alias("candidates"), F.min("_least").alias("named_stop"),
                                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all")))).alias("named"))


def match_geo(events: DataFrame, visits: DataFrame, tolerance: float, key: str = "event_id") -> DataFrame:
    """Pattern stops within a closed tolerance of the event, through grid cells."""
    # stops of one place, such as platforms, are as far from any event: places meet the events
    spots = visits.select("route_id", "direction_id", c("stop_id").alias("_s"), c("lat").alias("_lat"), c("lon").alias("_lon")).distinct().groupBy(
        "route_id", "direction_id", "_lat", "_lon").agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_least"), F.collect_set("_s").alias("_all"))
    near = spots.withColumn("_cell", F.explode(cells_around(c("_lat"), c("_lon"), tolerance)))
    row, col = cell(c("latitude"), c("longitude"), tolerance)
    at = events.withColumn("_cell", F.struct(row.alias("row"), col.alias("col")))
    hit = at.join(near, ["route_id", "direction_id", "_cell"]).where(
        haversine(c("latitude"), c("longitude"), c("_lat"), c("_lon")) <= tolerance)
    return hit.groupBy(key).agg(F.sum("_n").alias("candidates"), F.min("_least").alias("near_stop"),
                                F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all")))).alias("near"))


def resolve_visit(events: DataFrame, visits: DataFrame, base: int = 0, key: str = "event_id") -> DataFrame:
    """Visit index of a matched stop: explicit sequence, the only visit, or the previous stop."""
    order = visits.select("route_id", "direction_id", "visit", c("stop_id").alias("_s"))
    before = order.select("route_id", "direction_id", (c("visit") + 1).alias("visit"), c("_s").alias("_before"))
    own = order.join(before, ["route_id", "direction_id", "visit"], "left").withColumnRenamed("_s", "stop_id")
    joined = events.join(own, ["route_id", "direction_id", "stop_id"])
    index = c("stop_sequence") - base
    g = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("visit").alias("_one"), F.max(F.when(c("visit") == index, c("visit"))).alias("_at"),
        F.count_if(c("_before") == c("previous_stop_id")).alias("_k"),
        F.min(F.when(c("_before") == c("previous_stop_id"), c("visit"))).alias("_after"),
        F.first("stop_sequence").alias("_seq"), F.first("previous_stop_id").alias("_prev"))
    status = (F.when(c("_seq").isNotNull(), F.when(c("_at").isNull(), "stop_sequence_mismatch"))
              .when(c("_n") == 1, None).when(c("_prev").isNull(), "ambiguous_visit")
              .when(c("_k") == 0, "previous_stop_mismatch").when(c("_k") > 1, "ambiguous_visit"))
    visit = (F.when(c("_seq").isNotNull(), c("_at")).when(c("_n") == 1, c("_one")).when(c("_k") == 1, c("_after")))
    return g.select(key, visit.alias("visit"), status.alias("visit_reason"))


def align_events(events: DataFrame, routes: DataFrame, directions: DataFrame, stops: DataFrame, names: DataFrame,
                 assignments: DataFrame, visits: DataFrame, tolerance: float, staleness: int, base: int = 0,
                 key: str = "event_id") -> DataFrame:
    """One outcome per event: matched (kind, stop, visit), unmatched (reason), ambiguous or stale.

    Stop by id, then by qualified name, then by name on the pattern, then by position.
    """
    placed = assignment_at(resolve_pattern(events, routes, directions, visits), assignments, key)
    ids = stops.select(c("source").alias("source_stop"), c("target").alias("_id_stop"))
    qualified = names.select("route_id", "direction_id", c("name").alias("stop_name"), c("stop_id").alias("_q_stop"))
    on_pattern = visits.select("route_id", "direction_id", c("stop_id").alias("_id_stop"), F.lit(True).alias("_on")).distinct()
    by_name = match_name(placed.where("stop_name IS NOT NULL"), visits, key).select(key, c("candidates").alias("_nc"), c("named_stop").alias("_n_stop"))
    geo_rows = placed.where("source_stop IS NULL AND stop_name IS NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    by_place = match_geo(geo_rows, visits, tolerance, key).select(key, c("candidates").alias("_gc"), c("near_stop").alias("_g_stop"))
    rows = (placed.join(ids, "source_stop", "left").join(on_pattern, ["route_id", "direction_id", "_id_stop"], "left")
            .join(qualified, ["route_id", "direction_id", "stop_name"], "left").join(by_name, key, "left").join(by_place, key, "left"))
    has_id, has_name = c("source_stop").isNotNull(), c("stop_name").isNotNull()
    lag = F.abs(c("fix_sec") - c("sec"))
    bad_position = (F.abs("latitude") > 90) | (F.abs("longitude") > 180)
    reason = (F.when(c("reason").isNotNull(), c("reason"))
              .when(c("assigned_route").isNotNull() & (c("assigned_route") != c("route_id")), "vehicle_route_conflict")
              .when(has_id & c("_id_stop").isNull(), "unknown_stop").when(has_id & c("_on").isNull(), "stop_not_on_pattern")
              .when(has_id, None)
              .when(has_name & c("_q_stop").isNull() & c("_nc").isNull(), "unknown_stop_name").when(has_name, None)
              .when(c("latitude").isNull() | c("longitude").isNull(), "stop_missing").when(bad_position, "invalid_position")
              .when(lag > staleness, None).when(c("_gc").isNull(), "no_stop_within_tolerance"))
    many = (~has_id & has_name & c("_q_stop").isNull() & (c("_nc") > 1)) | (~has_id & ~has_name & (c("_gc") > 1))
    late = ~has_id & ~has_name & c("latitude").isNotNull() & (lag > staleness)
    stop = (F.when(has_id, c("_id_stop")).when(has_name, F.coalesce("_q_stop", F.when(c("_nc") == 1, c("_n_stop"))))
            .when(c("_gc") == 1, c("_g_stop")))
    kind = F.when(has_id, "exact_id").when(has_name, "name_route_direction").otherwise("geo_nearest")
    judged = rows.withColumn("_reason", reason).withColumn("outcome", F.when(c("_reason").isNotNull(), "unmatched").when(
        F.coalesce(late, F.lit(False)), "stale").when(F.coalesce(many, F.lit(False)), "ambiguous").otherwise("matched"))
    judged = judged.withColumn("stop_id", F.when(c("outcome") == "matched", stop))
    visit = resolve_visit(judged.where("outcome = 'matched'"), visits, base, key)
    final = judged.join(visit, key, "left")
    broken = c("visit_reason").isNotNull()
    return final.select(
        key, "source_id", "route_id", "direction_id",
        F.when(broken & (c("visit_reason") == "ambiguous_visit"), "ambiguous").when(broken, "unmatched").otherwise(c("outcome")).alias("outcome"),
        F.when((c("outcome") == "matched") & ~F.coalesce(broken, F.lit(False)), kind).alias("kind"),
        F.when(broken & (c("visit_reason") != "ambiguous_visit"), c("visit_reason")).otherwise(c("_reason")).alias("reason"),
        F.when(~F.coalesce(broken, F.lit(False)), c("stop_id")).alias("stop_id"), "visit")


def join_quality(aligned: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Outcomes per source by kind and reason; the parts sum to the total."""
    label = F.coalesce("kind", "reason", "outcome")
    return aligned.groupBy(*by, "outcome", label.alias("label")).agg(F.count(F.lit(1)).alias("events"))


def validate_crosswalk(routes: DataFrame, known_routes: DataFrame, names: DataFrame, vehicles: DataFrame, positions: DataFrame) -> DataFrame:
    """Problems: unknown targets, repeated names, bad positions, unordered or overlapping vehicle intervals."""
    def problem(df: DataFrame, kind: str, entity: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("problem"), entity.cast("string").alias("entity"))

    a = vehicles.select("vehicle", c("valid_from").alias("f"), c("valid_to").alias("t"))
    from pyspark.sql import Window

    order = Window.partitionBy("vehicle").orderBy("f")
    # assignments of one vehicle: a short list of intervals
    overlap = a.withColumn("_prev", F.max("t").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(c("_prev") > c("f"))
    return (problem(routes.join(known_routes.select(c("route_id").alias("target")), "target", "left_anti"), "unknown_target", c("target"))
            .unionByName(problem(names.groupBy("name", "route_id", "direction_id").count().where("count > 1"), "repeated_name", c("name")))
            .unionByName(problem(positions.where((F.abs("lat") > 90) | (F.abs("lon") > 180) | F.isnan("lat") | F.isnan("lon")), "invalid_position", c("stop_id")))
            .unionByName(problem(a.where(c("t") <= c("f")), "reversed_interval", c("vehicle")))
            .unionByName(problem(overlap, "overlapping_interval", c("vehicle")))).distinct()


def catalog_features(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row per stop identity: geometry (a conflict stops the run), sequence range, ambiguity."""
    g = rows.groupBy(*identity).agg(
        F.count_distinct(F.struct("lat", "lon")).alias("_g"), F.min("lat").alias("lat"), F.min("lon").alias("lon"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct("seq").alias("positions"))
    checked = require(g, c("_g") > 1, "conflicting stop geometry")
    return checked.drop("_g").withColumn("ambiguous_position", c("positions") > 1)


def events_near_stops(points: DataFrame, stops: DataFrame, radius: float = 1000.0, keys: Sequence[str] = ("date", "hour")) -> DataFrame:
    """Dated points of interest within the radius of each stop, counted per stop and hour.

    Stops of the same place (or places, where an id has several) meet the points as one and part again with the counts, so the
    pairs of points and stops grow with places.
    """
    spots = stops.groupBy("stop_id", c("lat").alias("_lat"), c("lon").alias("_lon")).agg(F.count(F.lit(1)).alias("_copies"))
    placed = spots.groupBy("stop_id").agg(F.array_sort(F.collect_list(F.struct("_lat", "_lon", "_copies"))).alias("_places"))
    marks = placed.select("_places").distinct().select("_places", F.inline("_places")).withColumn(
        "_cell", F.explode(cells_around(c("_lat"), c("_lon"), radius)))
    row, col = cell(c("lat"), c("lon"), radius)
    at = points.groupBy(*keys, "lat", "lon").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_cell", F.struct(row.alias("row"), col.alias("col")))
    hit = at.join(marks, "_cell").where(planar(c("lat"), c("lon"), c("_lat"), c("_lon")) <= radius)
    return hit.groupBy("_places", *keys).agg(F.sum(c("_n") * c("_copies")).alias("events")).join(placed, "_places").select("stop_id", *keys, "events")


def map_geometry(entities: DataFrame, stop_links: DataFrame, route_links: DataFrame, network: DataFrame, network_routes: DataFrame) -> DataFrame:
    """Forecast entities on network stops: matched, unmatched with a reason, or ambiguous."""
    keys = ["route_id", "direction_id", "stop_id"]
    ids = stop_links.groupBy(*keys).agg(F.array_sort(F.collect_set("osm_id")).alias("ids"))
    refs = route_links.join(network_routes.select(c("route").alias("ref"), F.lit(True).alias("_k")), "ref", "left").groupBy("route_id").agg(
        F.collect_set("ref").alias("refs"), F.count_if(c("_k").isNull()).alias("_unknown"))
    spot = network.select(c("stop_id").alias("_one"), "lon", "lat", c("routes").alias("_routes"))
    rows = entities.select(*keys).distinct().join(ids, keys, "left").join(refs, "route_id", "left").withColumn(
        "_one", F.get("ids", F.lit(0))).join(spot, "_one", "left")
    size = F.coalesce(F.size("ids"), F.lit(0))
    reason = (F.when(size <= 0, "missing_stop_mapping").when(size > 1, "multiple_stop_candidates")
              .when(c("refs").isNull(), "missing_route_mapping").when(c("_unknown") > 0, "unknown_osm_route")
              .when(c("_routes").isNull(), "unknown_osm_stop").when(~F.arrays_overlap("refs", "_routes"), "stop_not_on_mapped_route")
              .otherwise("explicit_crosswalk"))
    status = F.when(reason == "multiple_stop_candidates", "ambiguous").when(reason == "explicit_crosswalk", "matched").otherwise("unmatched")
    done = status == "matched"
    return rows.select(*keys, status.alias("status"), reason.alias("reason"), F.when(done, c("_one")).alias("osm_stop_id"),
                       F.when(done, c("lon")).alias("lon"), F.when(done, c("lat")).alias("lat"))
