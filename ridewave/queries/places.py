"""Identity resolution and geometry."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ridewave.functions import clock as K
from ridewave.functions import geo as G
from ridewave.operators import identity as N
from ridewave.queries.base import query, rnd
from ridewave.queries.scoring import rounded_all

c = F.col
ROUTES = ("click", "error", "purchase", "signup", "view")
# Source events with an id, a name or a position, and the catalogue from the suppliers.
ID_SQL = """vis AS (SELECT CAST(s_suppkey % 5 AS INT) AS ri, CAST(s_suppkey//5 % 2 AS INT) AS direction_id, s_suppkey//10 AS visit, s_suppkey AS stop_id FROM supplier UNION ALL SELECT CAST(s_suppkey % 5 AS INT), CAST(s_suppkey//5 % 2 AS INT), 1000000+s_suppkey//10, s_suppkey FROM supplier WHERE s_suppkey//10 % 3 = 0),
 visits AS (SELECT ['click','error','purchase','signup','view'][ri+1] AS route_id, v.direction_id, v.visit, v.stop_id, 'N' || (v.stop_id % 70) AS name, s.lat, s.lon FROM vis v JOIN stops s ON s.stop_id=v.stop_id),
 src AS (SELECT v.event_id, 'src' || (v.event_id % 2) AS source_id, CASE WHEN v.event_id % 61=0 THEN NULL ELSE 'S-' || v.route END AS source_route, CASE WHEN v.event_id % 67=0 THEN 9 ELSE CAST(v.direction AS INT) END AS source_direction, v.vehicle, v.sec,
   CASE WHEN v.event_id % 3=0 THEN v.sid END AS source_stop, CASE WHEN v.event_id % 3=1 THEN 'N' || (v.sid % 75) END AS stop_name, CASE WHEN v.event_id % 3=2 AND v.event_id % 71<>0 THEN s.lat+0.0002::DOUBLE*(v.event_id % 5) END AS latitude, CASE WHEN v.event_id % 3=2 THEN s.lon END AS longitude,
   v.sec + CASE WHEN v.event_id % 29=0 THEN 500 ELSE 0 END AS fix_sec, CASE WHEN v.event_id % 7=0 THEN v.sid//10 END AS stop_sequence, CASE WHEN v.event_id % 5=0 THEN v.sid-10 END AS previous_stop_id
   FROM (SELECT *, (k*10+CASE route WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END+5*direction) % 110 AS sid FROM validations) v LEFT JOIN stops s ON s.stop_id=v.sid),
 veh AS (SELECT DISTINCT vehicle, 1704067200::BIGINT + (vehicle % 7)*86400 AS valid_from, 1704067200::BIGINT + (vehicle % 7+4)*86400 AS valid_to, ['click','error','purchase','signup','view'][vehicle % 5+1] AS assigned_route FROM validations),
 rp AS (SELECT src.*, CASE WHEN source_route IS NULL THEN NULL WHEN source_route='S-signup' AND vehicle % 20=0 THEN NULL ELSE substr(source_route,3) END AS route_id, CASE WHEN source_direction<9 THEN source_direction END AS direction_id FROM src),
 rr AS (SELECT *, CASE WHEN source_route IS NULL THEN 'route_missing' WHEN route_id IS NULL THEN 'unknown_route' WHEN direction_id IS NULL THEN 'unknown_direction' WHEN NOT EXISTS (SELECT 1 FROM visits v WHERE v.route_id=rp.route_id AND v.direction_id=rp.direction_id) THEN 'unknown_pattern' END AS reason FROM rp)"""


def visits(t):
    s = c("stop_id")
    names = F.array(*[F.lit(r) for r in ROUTES])
    base = t.stops.withColumn("direction_id", (F.floor(s / 5) % 2).cast("int")).withColumn("route_id", F.get(names, s % 5)).withColumn(
        "name", F.concat(F.lit("N"), (s % 70).cast("string")))
    keep = ["route_id", "direction_id", "visit", "stop_id", "name", "lat", "lon"]
    once = base.withColumn("visit", F.floor(s / 10)).select(*keep)
    again = base.where(F.floor(s / 10) % 3 == 0).withColumn("visit", F.floor(s / 10) + 1000000).select(*keep)
    return once.unionByName(again)


def source_events(t):
    n = c("event_id")
    index = F.when(c("route") == "click", 0).when(c("route") == "error", 1).when(c("route") == "purchase", 2).when(c("route") == "signup", 3).otherwise(4)
    v = t.validations.withColumn("sid", ((c("k") * 10 + index + 5 * c("direction")) % 110).cast("bigint"))
    spot = t.stops.select(c("stop_id").alias("sid"), c("lat").alias("_lat"), c("lon").alias("_lon"))
    v = v.join(spot, "sid", "left")
    return v.select(
        "event_id", F.concat(F.lit("src"), (n % 2).cast("string")).alias("source_id"),
        F.when(n % 61 != 0, F.concat(F.lit("S-"), "route")).alias("source_route"), F.when(n % 67 == 0, 9).otherwise(c("direction").cast("int")).alias("source_direction"),
        "vehicle", "sec", F.when(n % 3 == 0, c("sid")).alias("source_stop"), F.when(n % 3 == 1, F.concat(F.lit("N"), (c("sid") % 75).cast("string"))).alias("stop_name"),
        F.when((n % 3 == 2) & (n % 71 != 0), c("_lat") + 0.0002 * (n % 5)).alias("latitude"), F.when(n % 3 == 2, c("_lon")).alias("longitude"),
        (c("sec") + F.when(n % 29 == 0, 500).otherwise(0)).alias("fix_sec"), F.when(n % 7 == 0, F.floor(c("sid") / 10)).alias("stop_sequence"),
        F.when(n % 5 == 0, c("sid") - 10).alias("previous_stop_id"))


def crosswalk(t):
    ev = source_events(t)
    routes = t.validations.select("route").distinct().select(F.concat(F.lit("S-"), "route").alias("source"), c("route").alias("target"))
    directions = ev.select(c("source_direction").alias("source")).distinct().where("source < 9").withColumn("target", c("source"))
    stops = t.stops.select(c("stop_id").alias("source"), c("stop_id").alias("target"))
    names = visits(t).where("stop_id % 11 = 0").groupBy("route_id", "direction_id", "name").agg(F.min("stop_id").alias("stop_id"))
    start = F.lit(1704067200).cast("bigint") + (c("vehicle") % 7) * 86400
    vehicles = t.validations.select("vehicle").distinct().select(
        "vehicle", start.alias("valid_from"), (start + 4 * 86400).alias("valid_to"), F.get(F.array(*[F.lit(r) for r in ROUTES]), c("vehicle") % 5).alias("assigned_route"))
    return routes, directions, stops, names, vehicles


def resolved(t):
    routes, directions, *_ = crosswalk(t)
    ev = source_events(t)
    hidden = F.when(~((c("source_route") == "S-signup") & (c("vehicle") % 20 == 0)), c("source_route")).when(
        c("source_route").isNotNull(), F.lit("S-gone"))
    return N.resolve_pattern(ev.withColumn("source_route", hidden), routes, directions, visits(t))


@query("pattern_resolution", "J9", f"WITH {ID_SQL} SELECT event_id, route_id, CAST(direction_id AS INT) AS direction_id, reason FROM rr", "validations stops")
def _(t):
    return resolved(t).select("event_id", "route_id", "direction_id", "reason")


@query("name_matching", "J10", f"""WITH {ID_SQL} SELECT event_id, count(DISTINCT v.stop_id) AS candidates, min(v.stop_id) AS named_stop FROM rr JOIN visits v ON v.route_id=rr.route_id AND v.direction_id=rr.direction_id AND v.name=rr.stop_name GROUP BY ALL""", "validations stops")
def _(t):
    return N.match_name(resolved(t).where("stop_name IS NOT NULL"), visits(t)).select("event_id", "candidates", "named_stop")


HAV = "2*6371008.8::DOUBLE*asin(sqrt(least(pow(sin(radians({b}-{a})/2),2)+cos(radians({a}))*cos(radians({b}))*pow(sin(radians({y}-{x})/2),2),1)))"


@query("geo_matching", "J11 F9", f"""WITH {ID_SQL} SELECT event_id, count(DISTINCT v.stop_id) AS candidates, min(v.stop_id) AS near_stop FROM rr JOIN visits v ON v.route_id=rr.route_id AND v.direction_id=rr.direction_id AND {HAV.format(a='rr.latitude', b='v.lat', x='rr.longitude', y='v.lon')} <= 60 WHERE latitude IS NOT NULL GROUP BY ALL""", "validations stops")
def _(t):
    return N.match_geo(resolved(t).where("latitude IS NOT NULL"), visits(t), 60.0).select("event_id", "candidates", "near_stop")


@query("vehicle_assignment", "J13", f"WITH {ID_SQL} SELECT src.event_id, v.assigned_route FROM src LEFT JOIN veh v ON v.vehicle=src.vehicle AND src.sec>=v.valid_from AND src.sec<v.valid_to", "validations stops")
def _(t):
    return N.assignment_at(source_events(t), crosswalk(t)[4]).select("event_id", "assigned_route")


VISIT_SQL = f"""{ID_SQL}, own AS (SELECT a.*, b.stop_id AS bef FROM visits a LEFT JOIN visits b ON b.route_id=a.route_id AND b.direction_id=a.direction_id AND b.visit=a.visit-1),
 vx AS (SELECT e.event_id, count(*) AS n, min(o.visit) AS one, max(CASE WHEN o.visit=e.stop_sequence THEN o.visit END) AS hit, count(*) FILTER (bef=e.previous_stop_id) AS kk, min(o.visit) FILTER (bef=e.previous_stop_id) AS aft, max(e.stop_sequence) AS sq, max(e.previous_stop_id) AS pv FROM rr e JOIN own o ON o.route_id=e.route_id AND o.direction_id=e.direction_id AND o.stop_id=e.source_stop GROUP BY ALL),
 vr AS (SELECT event_id, CASE WHEN sq IS NOT NULL THEN hit WHEN n=1 THEN one WHEN kk=1 THEN aft END AS visit, CASE WHEN sq IS NOT NULL THEN CASE WHEN hit IS NULL THEN 'stop_sequence_mismatch' END WHEN n=1 THEN NULL WHEN pv IS NULL THEN 'ambiguous_visit' WHEN kk=0 THEN 'previous_stop_mismatch' WHEN kk>1 THEN 'ambiguous_visit' END AS visit_reason FROM vx)"""


@query("visit_resolution", "J12", f"WITH {VISIT_SQL} SELECT * FROM vr", "validations stops")
def _(t):
    rows = resolved(t).where("source_stop IS NOT NULL").withColumn("stop_id", c("source_stop"))
    return N.resolve_visit(rows, visits(t))


def aligned(t):
    routes, directions, stops, names, vehicles = crosswalk(t)
    ev = source_events(t)
    return N.align_events(ev, routes, directions, stops, names, vehicles, visits(t), 60.0, 300)


ALIGN_SQL = f"""{ID_SQL}, r2 AS (SELECT src.*, substr(source_route,3) AS route_id, CASE WHEN source_direction<9 THEN source_direction END AS direction_id FROM src), qn AS (SELECT route_id, direction_id, name, min(stop_id) AS q FROM visits WHERE stop_id % 11=0 GROUP BY ALL),
 b AS (SELECT r2.*, v.assigned_route, st.stop_id AS idst, EXISTS (SELECT 1 FROM visits w WHERE w.route_id=r2.route_id AND w.direction_id=r2.direction_id AND w.stop_id=st.stop_id) AS onp, qn.q,
   (SELECT count(DISTINCT w.stop_id) FROM visits w WHERE w.route_id=r2.route_id AND w.direction_id=r2.direction_id AND w.name=r2.stop_name) AS nc, (SELECT min(w.stop_id) FROM visits w WHERE w.route_id=r2.route_id AND w.direction_id=r2.direction_id AND w.name=r2.stop_name) AS nst,
   (SELECT count(DISTINCT w.stop_id) FROM visits w WHERE w.route_id=r2.route_id AND w.direction_id=r2.direction_id AND {HAV.format(a='r2.latitude', b='w.lat', x='r2.longitude', y='w.lon')} <= 60) AS gc, (SELECT min(w.stop_id) FROM visits w WHERE w.route_id=r2.route_id AND w.direction_id=r2.direction_id AND {HAV.format(a='r2.latitude', b='w.lat', x='r2.longitude', y='w.lon')} <= 60) AS gst
   FROM r2 LEFT JOIN veh v ON v.vehicle=r2.vehicle AND r2.sec>=v.valid_from AND r2.sec<v.valid_to LEFT JOIN stops st ON st.stop_id=r2.source_stop LEFT JOIN qn ON qn.route_id=r2.route_id AND qn.direction_id=r2.direction_id AND qn.name=r2.stop_name),
 rs AS (SELECT *, CASE WHEN source_route IS NULL THEN 'route_missing' WHEN direction_id IS NULL THEN 'unknown_direction' WHEN NOT EXISTS (SELECT 1 FROM visits w WHERE w.route_id=b.route_id AND w.direction_id=b.direction_id) THEN 'unknown_pattern' WHEN assigned_route<>route_id THEN 'vehicle_route_conflict' WHEN source_stop IS NOT NULL AND idst IS NULL THEN 'unknown_stop' WHEN source_stop IS NOT NULL AND NOT onp THEN 'stop_not_on_pattern' WHEN source_stop IS NOT NULL THEN NULL
   WHEN stop_name IS NOT NULL AND q IS NULL AND nc=0 THEN 'unknown_stop_name' WHEN stop_name IS NOT NULL THEN NULL WHEN latitude IS NULL OR longitude IS NULL THEN 'stop_missing' WHEN fix_sec-sec>300 THEN NULL WHEN gc=0 THEN 'no_stop_within_tolerance' END AS reason FROM b),
 oc AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unmatched' WHEN source_stop IS NULL AND stop_name IS NULL AND fix_sec-sec>300 THEN 'stale' WHEN source_stop IS NULL AND ((stop_name IS NOT NULL AND q IS NULL AND nc>1) OR (stop_name IS NULL AND gc>1)) THEN 'ambiguous' ELSE 'matched' END AS outcome, CASE WHEN source_stop IS NOT NULL THEN idst WHEN stop_name IS NOT NULL THEN coalesce(q, nst) ELSE gst END AS st FROM rs),
 own AS (SELECT a.*, p.stop_id AS bef FROM visits a LEFT JOIN visits p ON p.route_id=a.route_id AND p.direction_id=a.direction_id AND p.visit=a.visit-1),
 vx AS (SELECT e.event_id, count(*) AS n, min(o.visit) AS one, max(CASE WHEN o.visit=e.stop_sequence THEN o.visit END) AS hit, count(*) FILTER (bef=e.previous_stop_id) AS kk, min(o.visit) FILTER (bef=e.previous_stop_id) AS aft, max(e.stop_sequence) AS sq, max(e.previous_stop_id) AS pv FROM oc e JOIN own o ON o.route_id=e.route_id AND o.direction_id=e.direction_id AND o.stop_id=e.st WHERE outcome='matched' GROUP BY ALL),
 vr AS (SELECT event_id, CASE WHEN sq IS NOT NULL THEN hit WHEN n=1 THEN one WHEN kk=1 THEN aft END AS visit, CASE WHEN sq IS NOT NULL THEN CASE WHEN hit IS NULL THEN 'stop_sequence_mismatch' END WHEN n=1 THEN NULL WHEN pv IS NULL THEN 'ambiguous_visit' WHEN kk=0 THEN 'previous_stop_mismatch' WHEN kk>1 THEN 'ambiguous_visit' END AS vre FROM vx),
 al AS (SELECT oc.event_id, source_id, CASE WHEN vre='ambiguous_visit' THEN 'ambiguous' WHEN vre IS NOT NULL THEN 'unmatched' ELSE outcome END AS outcome, CASE WHEN outcome='matched' AND vre IS NULL THEN CASE WHEN source_stop IS NOT NULL THEN 'exact_id' WHEN stop_name IS NOT NULL THEN 'name_route_direction' ELSE 'geo_nearest' END END AS kind,
   CASE WHEN vre IS NOT NULL AND vre<>'ambiguous_visit' THEN vre ELSE reason END AS reason, CASE WHEN outcome='matched' AND vre IS NULL THEN st END AS stop_id, visit FROM oc LEFT JOIN vr USING (event_id))"""


@query("identity_alignment", "J9 J10 J11 J12 J13", f"WITH {ALIGN_SQL} SELECT event_id, outcome, kind, reason, stop_id, visit FROM al", "validations stops")
def _(t):
    return aligned(t).select("event_id", "outcome", "kind", "reason", "stop_id", "visit")


@query("identity_quality", "A20", f"WITH {ALIGN_SQL} SELECT source_id, outcome, coalesce(kind, reason, outcome) AS label, count(*) AS events FROM al GROUP BY ALL", "validations stops")
def _(t):
    return N.join_quality(aligned(t))


@query("crosswalk_problems", "P25", f"""WITH {ID_SQL}, v2 AS (SELECT vehicle, valid_from AS f, valid_to AS t FROM veh UNION ALL SELECT vehicle, valid_from+86400*3, valid_from+86400*(vehicle % 3+2) FROM veh WHERE vehicle % 4=0)
SELECT DISTINCT 'unknown_target' AS problem, route AS entity FROM validations WHERE route NOT IN (SELECT route_id FROM visits WHERE route_id<>'view') UNION ALL SELECT DISTINCT 'repeated_name', name FROM visits WHERE visit<1000000 GROUP BY name, route_id, direction_id HAVING count(*)>1
UNION ALL SELECT 'invalid_position', CAST(stop_id AS VARCHAR) FROM stops WHERE abs(lat*(CASE WHEN stop_id % 40=0 THEN 2 ELSE 1 END))>90 UNION ALL SELECT DISTINCT 'reversed_interval', CAST(vehicle AS VARCHAR) FROM v2 WHERE t<=f
UNION ALL SELECT DISTINCT 'overlapping_interval', CAST(vehicle AS VARCHAR) FROM (SELECT *, max(t) OVER (PARTITION BY vehicle ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v2) WHERE p>f""", "validations stops")
def _(t):
    routes, _, _, _, vehicles = crosswalk(t)
    known = visits(t).where("route_id <> 'view'").select("route_id").distinct()
    names = visits(t).where("visit < 1000000")
    f = c("valid_from")
    more = vehicles.where("vehicle % 4 = 0").select("vehicle", (f + 86400 * 3).alias("valid_from"), (f + 86400 * (c("vehicle") % 3 + 2)).alias("valid_to"))
    both = vehicles.select("vehicle", "valid_from", "valid_to").unionByName(more)
    spots = t.stops.select("stop_id", (c("lat") * F.when(c("stop_id") % 40 == 0, 2).otherwise(1)).alias("lat"), "lon")
    return N.validate_crosswalk(routes, known, names, both, spots)


@query("stop_catalogue_rollup", "A53", """SELECT st.route, st.direction, st.stop_id, s.lat, s.lon, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT seq) AS positions, count(DISTINCT seq)>1 AS ambiguous_position FROM stop_times st JOIN stops s ON s.stop_id=st.stop_id GROUP BY ALL""", "stop_times stops")
def _(t):
    rows = t.stop_times.join(t.stops, "stop_id")
    return N.catalog_features(rows, ["route", "direction", "stop_id"]).select("route", "direction", "stop_id", "lat", "lon", "first_seq", "last_seq", "positions", "ambiguous_position")


@query("interest_points_near_stops", "J24", """WITH p AS (SELECT date, hour, 55.5+(event_id % 500)/1000.0::DOUBLE AS lat, 37.3+(event_id*7 % 660)/1000.0::DOUBLE AS lon FROM validations)
SELECT stop_id, date, hour, count(*) AS events FROM p JOIN stops s ON sqrt(pow((s.lon-p.lon)*(6371008.8::DOUBLE*pi()/180)*cos(radians((p.lat+s.lat)/2)),2)+pow((s.lat-p.lat)*(6371008.8::DOUBLE*pi()/180),2)) <= 1000 GROUP BY ALL""", "validations stops")
def _(t):
    pts = t.validations.select("date", "hour", (F.lit(55.5) + (c("event_id") % 500) / 1000.0).alias("lat"), (F.lit(37.3) + (c("event_id") * 7 % 660) / 1000.0).alias("lon"))
    return N.events_near_stops(pts, t.stops)


GEOM_SQL = """en AS (SELECT DISTINCT route_id, direction AS direction_id, stop_id FROM points), ln AS (SELECT *, CAST(stop_id AS BIGINT) AS osm_id FROM en WHERE (stop_id+direction_id) % 6<>0 UNION ALL SELECT *, stop_id+1 FROM en WHERE stop_id % 9=0),
 ids AS (SELECT route_id, direction_id, stop_id, list_sort(list_distinct(list(osm_id))) AS ids FROM ln GROUP BY ALL), rl AS (SELECT DISTINCT route_id, CASE WHEN route_id='r8' THEN 'ZZ' ELSE ['A','N','R'][CAST(substr(route_id,2) AS INT) % 3+1] END AS ref FROM points WHERE route_id<>'r9'),
 nr AS (SELECT stop_id, list_sort(list_distinct(list(r))) AS routes FROM (SELECT source AS stop_id, unnest(routes) AS r FROM edges) GROUP BY ALL),
 j AS (SELECT en.*, ids.ids, rl.ref, nr.routes, s.lon, s.lat, ids.ids[1] AS one FROM en LEFT JOIN ids USING (route_id,direction_id,stop_id) LEFT JOIN rl USING (route_id) LEFT JOIN nr ON nr.stop_id=ids.ids[1] LEFT JOIN stops s ON s.stop_id=ids.ids[1]),
 rz AS (SELECT *, CASE WHEN ids IS NULL THEN 'missing_stop_mapping' WHEN len(ids)>1 THEN 'multiple_stop_candidates' WHEN ref IS NULL THEN 'missing_route_mapping' WHEN ref='ZZ' THEN 'unknown_osm_route' WHEN routes IS NULL THEN 'unknown_osm_stop' WHEN NOT list_contains(routes, ref) THEN 'stop_not_on_mapped_route' ELSE 'explicit_crosswalk' END AS reason FROM j)"""


@query("geometry_crosswalk", "J27", f"WITH {GEOM_SQL} SELECT route_id, direction_id, stop_id, CASE reason WHEN 'multiple_stop_candidates' THEN 'ambiguous' WHEN 'explicit_crosswalk' THEN 'matched' ELSE 'unmatched' END AS status, reason, CASE WHEN reason='explicit_crosswalk' THEN one END AS osm_stop_id FROM rz", "points edges stops")
def _(t):
    en = t.points.select("route_id", c("direction").alias("direction_id"), "stop_id").distinct()
    links = en.where((c("stop_id") + c("direction_id")) % 6 != 0).withColumn("osm_id", c("stop_id")).unionByName(
        en.where(c("stop_id") % 9 == 0).withColumn("osm_id", c("stop_id") + 1))
    ref = F.when(c("route_id") == "r8", "ZZ").otherwise(F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.substring("route_id", 2, 1).cast("int") % 3))
    route_links = t.points.select("route_id").distinct().where("route_id <> 'r9'").withColumn("ref", ref)
    served = t.edges.select(c("source").alias("stop_id"), F.explode("routes").alias("route"))
    nodes = served.groupBy("stop_id").agg(F.collect_set("route").alias("routes")).join(t.stops.select("stop_id", "lon", "lat"), "stop_id")
    return N.map_geometry(en, links, route_links, nodes, served.select("route").distinct()).select(
        "route_id", "direction_id", "stop_id", "status", "reason", "osm_stop_id")


@query("local_time_resolution", "F7", """WITH z AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS ts FROM orders),
 k AS (SELECT *, dayofweek(CAST(ts AS DATE)) AS dw, CASE WHEN month(ts)=3 AND dayofweek(ts)=0 AND day(ts)>=25 AND hour(ts)=2 THEN 'nonexistent' WHEN month(ts)=10 AND dayofweek(ts)=0 AND day(ts)>=25 AND hour(ts)=2 AND year(ts)>=1996 THEN 'ambiguous' WHEN year(ts)=1995 AND month(ts)=9 AND dayofweek(ts)=0 AND day(ts)>=24 AND hour(ts)=2 THEN 'ambiguous' ELSE 'ok' END AS s FROM z)
SELECT o_orderkey, ts, s AS status FROM k""")
def _(t):
    ts = c("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(c("o_orderkey") % 1440).cast("int"))
    return t.orders.select("o_orderkey", ts.alias("ts"), K.resolve_local(ts, "Europe/Berlin").alias("status"))


@query("great_circle_lengths", "F9", f"SELECT a.stop_id AS a, b.stop_id AS b, round({HAV.format(a='a.lat', b='b.lat', x='a.lon', y='b.lon')},3) AS metres FROM edges e JOIN stops a ON a.stop_id=e.source JOIN stops b ON b.stop_id=e.target", "edges stops")
def _(t):
    a = t.stops.select(c("stop_id").alias("source"), c("lat").alias("y1"), c("lon").alias("x1"))
    b = t.stops.select(c("stop_id").alias("target"), c("lat").alias("y2"), c("lon").alias("x2"))
    return t.edges.join(a, "source").join(b, "target").select(c("source").alias("a"), c("target").alias("b"), rnd(G.haversine(c("y1"), c("x1"), c("y2"), c("x2")), 3).alias("metres"))
