"""The stop network: checks, statistics, components and paths."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from heapq import heappop, heappush
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.functions.geo import haversine
from ridewave.operators.scan import Arrays, scan_groups
from ridewave.session import reliable_checkpoint

c = F.col
# Edges of a component that one task holds for a search at most, and sources it answers.
PATH_EDGES, PATH_SOURCES = 250_000, 512


def _problem(df: DataFrame, kind: str, entity: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("problem"), entity.cast("string").alias("entity"))


def edge_id() -> Column:
    return F.concat_ws("->", c("source").cast("string"), c("target").cast("string"))


def validate_network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repeated stops or edges, unknown endpoints, bad lengths and coordinates."""
    known = nodes.select("stop_id").distinct()
    bad_place = c("lat").isNull() | c("lon").isNull() | F.isnan("lat") | F.isnan("lon") | (F.abs("lat") > 90) | (F.abs("lon") > 180)
    ends = edges.select("source", "target", F.explode(F.array("source", "target")).alias("stop_id"))
    return (_problem(nodes.groupBy("stop_id").count().where("count > 1"), "duplicate_stop", c("stop_id"))
            .unionByName(_problem(nodes.where(bad_place), "invalid_coordinate", c("stop_id")))
            .unionByName(_problem(edges.groupBy("source", "target").count().where("count > 1"), "duplicate_edge", edge_id()))
            .unionByName(_problem(ends.join(known, "stop_id", "left_anti"), "unknown_endpoint", edge_id()))
            .unionByName(_problem(edges.where(c("length_m").isNull() | F.isnan("length_m") | (c("length_m") < 0)), "invalid_length", edge_id())))


def validate_extract(elements: DataFrame, references: DataFrame) -> DataFrame:
    """Way nodes and relation members that the extract does not hold.

    ``elements``: kind, id.  ``references``: kind, id, r_kind, ref - one row per reference, so a
    huge relation never becomes one long list.
    """
    held = elements.select(c("kind").alias("r_kind"), c("id").alias("ref")).distinct()
    asked = references.where("r_kind <> 'relation'").select("kind", "id", "r_kind", "ref").distinct()
    return asked.join(held, ["r_kind", "ref"], "left_anti").select("kind", "id", "r_kind", "ref")


def edges_from_members(members: DataFrame) -> DataFrame:
    """Directed edges between neighbouring stops of relations: least length and route set.

    ``members``: relation, pos, stop_id, lat, lon, route (one relation is one line's stop list).
    """
    w = Window.partitionBy("relation").orderBy("pos")
    nxt = F.lead(F.struct("stop_id", "lat", "lon")).over(w)
    pairs = members.withColumn("_n", nxt).where("_n IS NOT NULL").select(
        c("stop_id").alias("source"), c("_n.stop_id").alias("target"), "route",
        F.round(haversine(c("lat"), c("lon"), c("_n.lat"), c("_n.lon")), 1).alias("length_m"))
    return pairs.groupBy("source", "target").agg(F.min("length_m").alias("length_m"), F.array_sort(F.collect_set("route")).alias("routes"))


def chain_ways(ways: list[np.ndarray]) -> list[int]:
    """Ways joined into one node order: at the track's end where they touch it, else at its start, else after a gap."""
    track: deque[int] = deque()
    for way in ways:
        piece = deque(int(x) for x in way)
        tips = {piece[0], piece[-1]} if piece else set()
        if track and track[-1] in tips:
            if piece[0] != track[-1]:
                piece.reverse()
            piece.popleft()
            track.extend(piece)
        elif track and track[0] in tips:
            if piece[-1] == track[0]:
                piece.reverse()
            piece.popleft()
            track.extendleft(piece)
        else:
            track.extend(piece)
    return list(track)


def order_track(ways: DataFrame) -> DataFrame:
    """One node order per relation from its ways in member order (relation, pos, nodes)."""
    packed = ways.groupBy("relation").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nodes"))), lambda s: s["nodes"]).alias("ways"))
    kind = dict(packed.dtypes)["relation"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"relation": pdf["relation"], "track": [chain_ways(list(w)) for w in pdf["ways"]]})

    return packed.mapInPandas(run, f"relation {kind}, track array<bigint>")


def stop_neighbours(stops: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing and incoming neighbours of every stop with their names."""
    names = stops.select(c("stop_id").alias("neighbour"), "name")
    out = edges.select(c("source").alias("stop_id"), c("target").alias("neighbour"), "length_m", "routes", F.lit("out").alias("direction"))
    back = edges.select(c("target").alias("stop_id"), c("source").alias("neighbour"), "length_m", "routes", F.lit("in").alias("direction"))
    return out.unionByName(back).join(names, "neighbour")


def network_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, total length and segment lengths of the network."""
    routes = edges.select(F.explode("routes").alias("r")).agg(F.count_distinct("r").alias("routes"))
    seg = edges.agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.sum("length_m") / 1000, 2).alias("total_length_km"), F.round(F.min("length_m"), 1).alias("shortest"),
        F.round(F.median("length_m"), 1).alias("median"), F.round(F.avg("length_m"), 1).alias("mean"), F.round(F.max("length_m"), 1).alias("longest"))
    return nodes.agg(F.count(F.lit(1)).alias("stops")).join(seg, how="cross").join(routes, how="cross")


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stops per number of distinct neighbours in either direction."""
    both = edges.select(c("source").alias("stop_id"), c("target").alias("n")).unionByName(edges.select(c("target").alias("stop_id"), c("source").alias("n")))
    degree = both.distinct().groupBy("stop_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("stop_id").join(degree, "stop_id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree")).groupBy("degree").agg(
        F.count(F.lit(1)).alias("stops"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected components, numbered by size with the largest as 0.

    Each round takes the least label among neighbours, then jumps to the label's own label, so
    the number of rounds grows with the logarithm of the diameter.  The state is cut with a
    reliable checkpoint every round; a lost executor never replays the loop.  Rounds use merge
    joins: tables broadcast in every round pile up on the driver.
    """
    both = edges.select(c("source").alias("a"), c("target").alias("b")).unionByName(edges.select(c("target").alias("a"), c("source").alias("b")))
    both = reliable_checkpoint(both.where("a <> b").distinct())
    state = reliable_checkpoint(nodes.select("stop_id", c("stop_id").alias("label")).distinct())
    while True:
        near = both.hint("merge").join(state, both["b"] == state["stop_id"]).groupBy("a").agg(F.min("label").alias("_near"))
        stepped = state.hint("merge").join(near, state["stop_id"] == near["a"], "left").select(
            "stop_id", "label", F.least("label", F.coalesce("_near", "label")).alias("_new"))
        hop = state.select(c("stop_id").alias("_new"), c("label").alias("_jump"))
        following = reliable_checkpoint(stepped.hint("merge").join(hop, "_new", "left").select(
            "stop_id", F.least("_new", F.coalesce("_jump", "_new")).alias("label"), (c("label") != F.least("_new", F.coalesce("_jump", "_new"))).alias("_moved")))
        state = following.select("stop_id", "label")
        if following.where("_moved").limit(1).count() == 0:
            break
    sizes = state.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # one row per component
    ranked = sizes.withColumn("component", F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1)
    return state.join(ranked, "label").select("stop_id", "component", "size")


def search_paths(edges: DataFrame, pairs: DataFrame, band: float | None = None) -> DataFrame:
    """source, node, dist, hops, pred: the least label of the nodes that a search from each source had to reach.

    Labels are (length, number of edges); ``pred`` is the least node that gives the label, so paths are unique.  Each round
    a source expands its open nodes within one band of distance (four mean edge lengths by default), corrected nodes again.
    A source ends when no open node is nearer than its farthest asked target: nothing beyond is expanded.  Rounds use merge
    joins, so the driver holds nothing of them.
    """
    steps = reliable_checkpoint(edges.where("length_m IS NOT NULL").groupBy(c("source").alias("node"), c("target").alias("_to")).agg(F.min("length_m").alias("length_m")))
    if band is None:
        band = 4 * (steps.agg(F.avg("length_m")).first()[0] or 0.0)
    wide = F.lit(float(band or 1.0))
    asked = reliable_checkpoint(pairs.select("source", "target").distinct())
    state = asked.select("source", c("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops")).distinct().withColumn(
        "pred", F.lit(None).cast(dict(asked.dtypes)["source"])).withColumn("todo", F.lit(True))
    while True:
        found = state.select("source", c("node").alias("target"), "dist")
        limits = asked.hint("merge").join(found, ["source", "target"], "left").groupBy("source").agg(
            F.when(F.count("dist") == F.count(F.lit(1)), F.max("dist")).alias("_far"))
        pending = state.where("todo").hint("merge").join(limits, "source").where(c("_far").isNull() | (c("dist") <= c("_far")))
        near = pending.groupBy("source").agg(((F.floor(F.min("dist") / wide) + 1) * wide).alias("_band"))
        active = reliable_checkpoint(pending.hint("merge").join(near, "source").where(c("dist") < c("_band")).drop("_far", "_band"))
        if active.limit(1).count() == 0:
            break
        # rounded, so that equal sums of other orders stay equal
        tried = active.hint("merge").join(steps, "node").select("source", c("_to").alias("node"), F.round(c("dist") + c("length_m"), 6).alias("dist"),
                                                  (c("hops") + 1).alias("hops"), c("node").alias("pred"), F.lit(True).alias("todo"))
        expanded = active.select("source", "node", F.lit(True).alias("_x"))
        kept = state.hint("merge").join(expanded, ["source", "node"], "left").withColumn("todo", c("todo") & c("_x").isNull()).drop("_x")
        state = reliable_checkpoint(kept.unionByName(tried).groupBy("source", "node").agg(
            F.min(F.struct("dist", "hops", "pred")).alias("b"), F.min(F.struct("dist", "hops", "todo")).alias("t")).select(
            "source", "node", "b.dist", "b.hops", "b.pred", "t.todo"))
    return state.drop("todo")


def _rounded(x: float) -> float:
    """To six places, halves up, as Spark rounds."""
    scaled = x * 1e6
    if abs(scaled - math.floor(scaled) - 0.5) < 1e-3:
        return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return round(x, 6)


def _cheapest(near: dict[Any, list[tuple[Any, float]]], source: Any, targets: set) -> dict[Any, tuple[float, int, Any]]:
    """node: least (length, number of edges, predecessor) of the nodes settled until all targets are; lengths are not negative."""
    settled: dict[Any, tuple[float, int, Any]] = {}
    best: dict[Any, tuple[float, int, Any]] = {}
    left, heap = set(targets), [(0.0, 0, None, source)]
    while heap and left:
        dist, hops, pred, node = heappop(heap)
        if node in settled:
            continue
        settled[node] = (dist, hops, pred)
        left.discard(node)
        for to, length in near.get(node, ()):
            label = (_rounded(dist + length), hops + 1, node)
            if to not in settled and (to not in best or label < best[to]):
                best[to] = label
                heappush(heap, (*label, to))
    return settled


def _search_groups(steps: DataFrame, wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """source, node, dist, hops, pred of the nodes on the asked paths: a group holds the edges of a component and some of its sources."""
    none, kind = F.lit(None).cast("double"), dict(wanted.dtypes)["source"]
    edges = steps.join(groups.hint("merge"), "component").withColumn("_chunk", F.explode(F.sequence(F.lit(0), c("chunks") - 1))).select(
        "component", "_chunk", F.lit(0).alias("_asked"), "source", "target", c("length_m").cast("double").alias("length_m"))
    pairs = wanted.join(groups.hint("merge"), "component").select(
        "component", F.pmod(F.xxhash64("source"), c("chunks")).cast("int").alias("_chunk"), F.lit(1).alias("_asked"), "source", "target", none.alias("length_m"))

    def search(g: Arrays) -> Arrays:
        near: dict[Any, list[tuple[Any, float]]] = {}
        asked: dict[Any, set] = {}
        for to_ask, a, b, length in zip(g["_asked"].tolist(), g["source"].tolist(), g["target"].tolist(), g["length_m"].tolist(), strict=True):
            if to_ask:
                asked.setdefault(a, set()).add(b)
            else:
                near.setdefault(a, []).append((b, length))
        out = []
        for source, targets in asked.items():
            settled = _cheapest(near, source, targets)
            on_path: set = set()
            for node in targets & settled.keys():
                while node is not None and node not in on_path:
                    on_path.add(node)
                    node = settled[node][2]
            out += [(source, node, *settled[node]) for node in on_path]
        found = {}
        for name, values in zip(("source", "node", "dist", "hops", "pred"), zip(*out, strict=True) if out else [()] * 5, strict=True):
            found[name] = np.empty(len(out), object)
            found[name][:] = values
        return found

    return scan_groups(edges.unionByName(pairs), ["component", "_chunk"], ["_asked", "source"], search,
                       f"source {kind}, node {kind}, dist double, hops int, pred {kind}")


def component_paths(edges: DataFrame, wanted: DataFrame, parts: DataFrame, band: float | None = None) -> DataFrame:
    """Labels of the asked paths (source, target, component of both) as :func:`search_paths` gives them, on the paths at least.

    A component of up to ``PATH_EDGES`` edges is searched in one pass, a group for each ``PATH_SOURCES`` or so of its sources;
    rounds are left for larger components, and for those with an edge to an unknown stop, which may lead
    elsewhere, or with an odd length.
    """
    part = parts.select("stop_id", "component")
    a, b = part.select(c("stop_id").alias("source"), "component"), part.select(c("stop_id").alias("target"), c("component").alias("_cb"))
    whole = "source IS NOT NULL AND target IS NOT NULL AND length_m IS NOT NULL"
    steps = reliable_checkpoint(edges.where(whole).groupBy("source", "target").agg(F.min("length_m").alias("length_m")).join(
        a.hint("merge"), "source", "left").join(b.hint("merge"), "target", "left"))
    open_ = ~c("component").eqNullSafe(c("_cb")) | ~((c("length_m") >= 0) & (c("length_m") < 1e12))
    sizes = steps.groupBy(F.coalesce("component", "_cb").alias("component")).agg(F.count(F.lit(1)).alias("_edges"), F.bool_or(open_).alias("_open"))
    sources = wanted.groupBy("component").agg(F.ceil(F.count_distinct("source") / PATH_SOURCES).cast("int").alias("chunks"))
    groups = reliable_checkpoint(sources.hint("merge").join(sizes, "component", "left").select(
        "component", "chunks", ((F.coalesce("_edges", F.lit(0)) <= PATH_EDGES) & ~F.coalesce("_open", F.lit(False))).alias("_small")))
    labels = _search_groups(steps, wanted, groups.where("_small").drop("_small"))
    rest = groups.where("NOT _small").select("component")
    if rest.limit(1).count():
        labels = labels.unionByName(search_paths(edges, wanted.join(rest.hint("merge"), "component").select("source", "target"), band))
    return reliable_checkpoint(labels)


def path_nodes(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, hops, node: the nodes of each asked path, walked back over the predecessors of its source in a sorted scan."""
    # a source has no predecessor; itself instead keeps the column free of nulls
    held = labels.select("source", "node", F.coalesce("pred", "node").alias("pred"), "hops", F.lit(0).alias("_asked"))
    asked = pairs.where("source IS NOT NULL AND target IS NOT NULL").select(
        "source", c("target").alias("node"), c("target").alias("pred"), F.lit(0).alias("hops"), F.lit(1).alias("_asked"))

    def walk(g: Arrays) -> Arrays:
        cut = int(np.searchsorted(g["_asked"], 1))
        known, before, target = g["node"][:cut], g["pred"][:cut], g["node"][cut:]
        at = np.searchsorted(known, target)
        met = at < cut
        met[met] = known[at[met]] == target[met]
        at, target = at[met], target[met]
        hops = g["hops"][at]
        out = [(target, hops, known[at])]
        while len(at):
            more = hops > 0
            at, target, hops = np.searchsorted(known, before[at[more]]), target[more], hops[more] - 1
            out.append((target, hops, known[at]))
        found = {n: np.concatenate([x[i] for x in out]) for i, n in enumerate(("target", "hops", "node"))}
        return {"source": np.repeat(g["source"][:1], len(found["node"]))} | found

    kind = dict(pairs.dtypes)["source"]
    return scan_groups(held.unionByName(asked), ["source"], ["_asked", "node"], walk, f"source {kind}, target {kind}, hops int, node {kind}")


def shortest_path(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, parts: DataFrame, band: float | None = None) -> DataFrame:
    """Cheapest directed path of every asked pair (of equal ones that of fewest edges), or the reason there is none.

    ``parts`` is the output of :func:`components`; only pairs of known stops of one component are searched.
    """
    known = parts.join(nodes.select("stop_id").distinct(), "stop_id", "left_semi")
    a = known.select(c("stop_id").alias("source"), c("component").alias("_ca"))
    b = known.select(c("stop_id").alias("target"), c("component").alias("_cb"))
    asked = reliable_checkpoint(pairs.select("source", "target").distinct().join(a, "source", "left").join(b, "target", "left"))
    wanted = asked.where("_ca = _cb").select("source", "target", c("_ca").alias("component"))
    labels = component_paths(edges, wanted, known, band)
    length = labels.select("source", c("node").alias("target"), "dist")
    track = path_nodes(labels, wanted).groupBy("source", "target").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hops", "node"))), lambda s: s["node"]).alias("path"))
    out = asked.join(length, ["source", "target"], "left").join(track, ["source", "target"], "left")
    reason = (F.when(c("_ca").isNull() | c("_cb").isNull(), "unknown_stop").when(c("_ca") != c("_cb"), "different_components")
              .when(c("dist").isNull(), "wrong_direction"))
    return out.select("source", "target", reason.alias("reason"), F.when(reason.isNull(), F.round("dist", 1)).alias("length_m"),
                      F.when(reason.isNull(), c("path")).alias("path"))


def path_routes(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes used along each found path."""
    legs = paths.where("path IS NOT NULL").select("source", "target", F.explode(F.arrays_zip(
        F.expr("slice(path, 1, greatest(size(path) - 1, 0))").alias("a"), F.expr("slice(path, 2, greatest(size(path) - 1, 0))").alias("b"))).alias("leg")).select(
        "source", "target", c("leg.a").alias("_a"), c("leg.b").alias("_b"))
    e = edges.select(c("source").alias("_a"), c("target").alias("_b"), "routes")
    return legs.join(e, ["_a", "_b"]).groupBy("source", "target").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("routes")))).alias("routes"), F.count(F.lit(1)).alias("legs"))


def route_index(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Stops, edges, length and component of each route."""
    legs = edges.select("source", "target", "length_m", F.explode("routes").alias("route"))
    length = legs.groupBy("route").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length_m"), 1).alias("length_m"))
    touched = legs.select("route", F.explode(F.array("source", "target")).alias("stop_id")).distinct().join(
        nodes.select("stop_id").distinct(), "stop_id", "left_semi").join(parts, "stop_id")
    stops = touched.groupBy("route").agg(F.count(F.lit(1)).alias("stops"), F.min("component").alias("component"))
    return length.join(stops, "route", "left")


def routes_by_component(index: DataFrame) -> DataFrame:
    return index.groupBy("component").agg(F.array_sort(F.collect_list("route")).alias("routes"))


def geometry_quality(edges: DataFrame, geometry: DataFrame, synthetic: bool) -> DataFrame:
    """``provided`` (or ``synthetic``) where an edge has a polyline, else ``inferred``."""
    held = geometry.select("source", "target", F.lit(True).alias("_g")).distinct()
    value = F.when(c("_g").isNull(), "inferred").otherwise("synthetic" if synthetic else "provided")
    return edges.join(held, ["source", "target"], "left").select("source", "target", value.alias("quality"))


def search_stops(stops: DataFrame, text: str, limit: int) -> DataFrame:
    """First stops whose name holds the text, ignoring case."""
    return stops.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("stop_id").limit(limit)
