"""The stop network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridewave.operators import graph as G
from ridewave.queries.base import query, rnd
from ridewave.queries.places import HAV

c = F.col
CLOSE_SQL = """und AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), rc AS (SELECT stop_id AS a, stop_id AS b FROM stops UNION SELECT rc.a, und.b FROM rc JOIN und ON und.a=rc.b),
 lb AS (SELECT a AS stop_id, min(b) AS label FROM rc GROUP BY ALL), sz AS (SELECT label, count(*) AS size FROM lb GROUP BY ALL), rk AS (SELECT label, size, CAST(row_number() OVER (ORDER BY size DESC, label)-1 AS INT) AS component FROM sz), comp AS (SELECT stop_id, component, size FROM lb JOIN rk USING (label))"""


def parts(t):
    return G.components(t.stops, t.edges)


@query("network_components", "G1", f"WITH RECURSIVE {CLOSE_SQL} SELECT * FROM comp", "edges stops")
def _(t):
    return parts(t)


def pairs(t):
    from pyspark.sql import Window
    s = t.stops.select(c("stop_id").alias("source"), "nation")
    inside = s.withColumn("target", F.lead("source").over(Window.partitionBy("nation").orderBy("source"))).where("target IS NOT NULL")
    return inside.select("source", "target").unionByName(inside.select(c("target").alias("source"), c("source").alias("target"))).unionByName(
        s.where("source % 5 = 0").select("source", (c("source") + 1).alias("target"))).unionByName(
        s.where("source % 9 = 0").select("source", (c("source") + 100000).alias("target")))


def legs(t):
    """The edges, for plans that read them several times: each reading orders all stops of all trips."""
    return t.once("edges", lambda: t.edges)


def paths(t):
    return G.shortest_path(t.stops, legs(t), pairs(t), G.components(t.stops, legs(t)))


PAIR_SQL = f"""{CLOSE_SQL}, ins AS (SELECT * FROM (SELECT stop_id AS source, lead(stop_id) OVER (PARTITION BY nation ORDER BY stop_id) AS target FROM stops) WHERE target IS NOT NULL), pr AS (SELECT source, target FROM ins UNION SELECT target, source FROM ins UNION SELECT stop_id, stop_id+1 FROM stops WHERE stop_id % 5=0 UNION SELECT stop_id, stop_id+100000 FROM stops WHERE stop_id % 9=0),
 pa AS (SELECT stop_id AS source, stop_id AS node, 0.0::DOUBLE AS dist, [stop_id] AS path FROM stops UNION ALL SELECT pa.source, e.target, pa.dist+e.length_m, list_append(pa.path, e.target) FROM pa JOIN edges e ON e.source=pa.node WHERE NOT list_contains(pa.path, e.target)),
 be AS (SELECT source, node, min(dist) AS dist FROM pa GROUP BY ALL),
 an AS (SELECT pr.source, pr.target, CASE WHEN x.component IS NULL OR y.component IS NULL THEN 'unknown_stop' WHEN x.component<>y.component THEN 'different_components' WHEN be.dist IS NULL THEN 'wrong_direction' END AS reason, be.dist FROM pr LEFT JOIN comp x ON x.stop_id=pr.source LEFT JOIN comp y ON y.stop_id=pr.target LEFT JOIN be ON be.source=pr.source AND be.node=pr.target)"""


@query("shortest_paths", "G2", f"WITH RECURSIVE {PAIR_SQL} SELECT source, target, reason, CASE WHEN reason IS NULL THEN round(dist,1) END AS length_m FROM an", "edges stops")
def _(t):
    return paths(t).drop("path")


@query("path_routes", "G2", f"""WITH RECURSIVE {PAIR_SQL}, rp AS (SELECT source, node, path, row_number() OVER (PARTITION BY source, node ORDER BY round(dist,6), len(path), list_reverse(path)) AS i FROM pa),
 lg AS (SELECT an.source, an.target, unnest(list_zip(rp.path[:-2], rp.path[2:])) AS leg FROM an JOIN rp ON rp.source=an.source AND rp.node=an.target AND i=1 WHERE reason IS NULL),
 us AS (SELECT lg.source, lg.target, struct_extract(leg,1) AS a, struct_extract(leg,2) AS b, routes FROM lg JOIN edges e ON e.source=struct_extract(leg,1) AND e.target=struct_extract(leg,2))
SELECT source, target, list_sort(list_distinct(flatten(list(routes)))) AS routes, count(*) AS legs FROM us GROUP BY ALL""", "edges stops")
def _(t):
    return G.path_routes(paths(t), legs(t))


@query("route_index", "A49", f"""WITH RECURSIVE {CLOSE_SQL}, lg AS (SELECT source, target, length_m, unnest(routes) AS route FROM edges), tc AS (SELECT DISTINCT route, unnest([source, target]) AS stop_id FROM lg)
SELECT l.route, l.edges, l.length_m, s.stops, s.component FROM (SELECT route, count(*) AS edges, round(sum(length_m),1) AS length_m FROM lg GROUP BY ALL) l JOIN (SELECT route, count(*) AS stops, min(component) AS component FROM tc JOIN comp USING (stop_id) GROUP BY ALL) s USING (route)""", "edges stops")
def _(t):
    return G.route_index(t.stops, t.edges, parts(t))


@query("routes_by_component", "G3", f"""WITH RECURSIVE {CLOSE_SQL}, tc AS (SELECT route, min(component) AS component FROM (SELECT DISTINCT route, unnest([source, target]) AS stop_id FROM (SELECT source, target, unnest(routes) AS route FROM edges)) JOIN comp USING (stop_id) GROUP BY ALL) SELECT component, list(route ORDER BY route) AS routes FROM tc GROUP BY ALL""", "edges stops")
def _(t):
    return G.routes_by_component(G.route_index(t.stops, t.edges, parts(t)))


@query("geometry_quality", "G4", "SELECT source, target, CASE WHEN (source+target) % 3=0 THEN 'provided' ELSE 'inferred' END AS quality FROM edges", "edges")
def _(t):
    return G.geometry_quality(t.edges, t.edges.where("(source + target) % 3 = 0"), False)


@query("network_statistics", "A48", """SELECT (SELECT count(*) FROM stops) AS stops, count(*) AS edges, round(sum(length_m)/1000,2) AS total_length_km, min(length_m) AS shortest, round(median(length_m),1) AS median, round(avg(length_m),1) AS mean, max(length_m) AS longest, (SELECT count(DISTINCT r) FROM (SELECT unnest(routes) AS r FROM edges)) AS routes FROM edges""", "edges stops")
def _(t):
    return G.network_stats(t.stops, t.edges)


@query("degree_histogram", "A48", "SELECT degree, count(*) AS stops FROM (SELECT s.stop_id, count(DISTINCT n) AS degree FROM stops s LEFT JOIN (SELECT source AS stop_id, target AS n FROM edges UNION SELECT target, source FROM edges) USING (stop_id) GROUP BY ALL) GROUP BY ALL", "edges stops")
def _(t):
    return G.degree_histogram(t.stops, t.edges)


@query("stop_neighbours", "J31", "SELECT source AS stop_id, target AS neighbour, length_m, routes, 'out' AS direction, name FROM edges JOIN stops ON stop_id=target UNION ALL SELECT target, source, length_m, routes, 'in', name FROM edges JOIN stops ON stop_id=source", "edges stops")
def _(t):
    return G.stop_neighbours(t.stops, t.edges)


@query("network_problems", "P17", """WITH nd AS (SELECT stop_id, lat*(CASE WHEN stop_id % 31=0 THEN 2 ELSE 1 END) AS lat, lon FROM stops UNION ALL SELECT stop_id, lat, lon FROM stops WHERE stop_id % 17=0), ed AS (SELECT source, target, CASE WHEN (source+target) % 29=0 THEN -length_m ELSE length_m END AS length_m FROM edges UNION ALL SELECT source, target+CASE WHEN source % 4=0 THEN 100000 ELSE 0 END, length_m FROM edges WHERE source % 6=0)
SELECT 'duplicate_stop' AS problem, CAST(stop_id AS VARCHAR) AS entity FROM nd GROUP BY stop_id HAVING count(*)>1 UNION ALL SELECT 'invalid_coordinate', CAST(stop_id AS VARCHAR) FROM nd WHERE abs(lat)>90 UNION ALL SELECT 'duplicate_edge', source || '->' || target FROM ed GROUP BY source, target HAVING count(*)>1
UNION ALL SELECT 'unknown_endpoint', source || '->' || target FROM ed WHERE target>=100000 UNION ALL SELECT 'invalid_length', source || '->' || target FROM ed WHERE length_m<0""", "edges stops")
def _(t):
    s, e = t.stops.select("stop_id", "lat", "lon"), t.edges.select("source", "target", "length_m")
    nodes = s.withColumn("lat", c("lat") * F.when(c("stop_id") % 31 == 0, 2).otherwise(1)).unionByName(s.where("stop_id % 17 = 0"))
    bad = e.withColumn("length_m", F.when((c("source") + c("target")) % 29 == 0, -c("length_m")).otherwise(c("length_m")))
    more = e.where("source % 6 = 0").withColumn("target", c("target") + F.when(c("source") % 4 == 0, 100000).otherwise(0))
    return G.validate_network(nodes, bad.unionByName(more))


@query("extract_references", "P18", """SELECT 'way' AS kind, l_orderkey AS id, 'node' AS r_kind, l_suppkey AS ref FROM lineitem WHERE l_suppkey % 10=3 GROUP BY ALL UNION ALL SELECT 'relation', o_custkey, 'way', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL""")
def _(t):
    nodes = t.stops.where("stop_id % 10 <> 3").select(F.lit("node").alias("kind"), c("stop_id").alias("id"))
    ways = t.lineitem.select(F.lit("way").alias("kind"), c("l_orderkey").alias("id"))
    way_refs = t.lineitem.select(F.lit("way").alias("kind"), c("l_orderkey").alias("id"), F.lit("node").alias("r_kind"), c("l_suppkey").alias("ref"))
    rel_refs = t.orders.select(F.lit("relation").alias("kind"), c("o_custkey").alias("id"), F.lit("way").alias("r_kind"), c("o_orderkey").alias("ref"))
    return G.validate_extract(nodes.unionByName(ways), way_refs.unionByName(rel_refs))


@query("edges_from_members", "W29", f"""WITH m AS (SELECT trip_id, seq, p.stop_id, p.route, lat, lon FROM lineitem_steps p JOIN stops s ON s.stop_id=p.stop_id), n AS (SELECT *, lead(stop_id) OVER w AS t, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM m WINDOW w AS (PARTITION BY trip_id ORDER BY seq))
SELECT stop_id AS source, t AS target, min(round({HAV.format(a='lat', b='la', x='lon', y='lo')},1)) AS length_m, list_sort(list_distinct(list(route))) AS routes FROM n WHERE t IS NOT NULL GROUP BY ALL""", "lineitem_steps stops")
def _(t):
    m = t.lineitem_steps.join(t.stops, "stop_id").select(c("trip_id").alias("relation"), c("seq").alias("pos"), "stop_id", "lat", "lon", "route")
    return G.edges_from_members(m)


@query("ordered_tracks", "W30")
def _(t):
    ways = t.lineitem.select(c("l_orderkey").alias("relation"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
                             F.array(c("l_suppkey") % 5, c("l_partkey") + 1000, c("l_suppkey") % 3).alias("nodes"))
    return G.order_track(ways)


@query("stop_search", "T4", "SELECT stop_id, name FROM stops WHERE contains(lower(name), 'r#00000000') ORDER BY stop_id LIMIT 7", "stops")
def _(t):
    return G.search_stops(t.stops.select("stop_id", "name"), "R#00000000", 7)
