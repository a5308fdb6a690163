"""Sources, field checks, quarantine, deduplication, exports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridewave.functions.clock import normalize_timestamp, wall_instant, wall_seconds
from ridewave.operators import ingest as I
from ridewave.operators.joins import require
from ridewave.queries.base import big, query, rnd
from ridewave.sources import events as E
from ridewave.sources import exports as X
from ridewave.streaming.jobs import scratch

HASH_SALT = "ridewave-demo"

# Raw text rows: every 53rd device is unknown, every 41st rejected row has a broken clock.
RAW_SQL = """raw AS (SELECT event_id,
  CASE WHEN value < 1.0 AND event_id % 41 = 0 THEN 'bad clock' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS tran_date_time,
  CASE WHEN value >= 1.0 THEN '1' ELSE '0' END AS validation_result,
  CAST(user_id % 5 + 1 AS VARCHAR) || ' tram' AS ngpt_route,
  CASE WHEN event_id % 53 = 0 THEN '-1' ELSE CAST(user_id AS VARCHAR) END AS device_no,
  CAST(user_id % 40 AS VARCHAR) AS garage_number, event_type AS bus_exit_no FROM events)"""


def raw_rows(t):
    return t.events.select(
        "event_id",
        F.when((F.col("value") < 1.0) & (F.col("event_id") % 41 == 0), "bad clock").otherwise(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("tran_date_time"),
        F.when(F.col("value") >= 1.0, "1").otherwise("0").alias("validation_result"),
        F.concat((F.col("user_id") % 5 + 1).cast("string"), F.lit(" tram")).alias("ngpt_route"),
        F.when(F.col("event_id") % 53 == 0, "-1").otherwise(F.col("user_id").cast("string")).alias("device_no"),
        (F.col("user_id") % 40).cast("string").alias("garage_number"), F.col("event_type").alias("bus_exit_no"))


def raw_typed(t):
    return E.read_validations(raw_rows(t), date(2024, 1, 3), date(2024, 1, 29), r"^(\d+) tram$")


@query("raw_validation_scan", "S2", f"""WITH {RAW_SQL},
typed AS (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(tran_date_time, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}')
   THEN tran_date_time END AS TIMESTAMP) AS event_at, regexp_extract(ngpt_route,'^(\\d+) tram$',1) AS route FROM raw)
SELECT event_id, event_at, route, validation_result='1' AS success,
 event_at IS NOT NULL AS valid, coalesce(event_at >= TIMESTAMP '2024-01-03' AND event_at < TIMESTAMP '2024-01-29', false) AS in_range
FROM typed""")
def _(t):
    return raw_typed(t).select("event_id", "event_at", "route", "success", "valid", "in_range")


JSON_SQL = """lines AS (SELECT event_id, CASE
  WHEN event_id % 97 = 0 THEN '{"event_id":' || event_id || ',"route":"'
  WHEN event_id % 89 = 0 THEN '[' || event_id || ']'
  ELSE '{"event_id":' || event_id || ',"route":"' || event_type || '","device":' || user_id || '}' END AS value FROM events)"""


def json_lines(t):
    eid = F.col("event_id").cast("string")
    return t.events.select("event_id", F.when(F.col("event_id") % 97 == 0, F.concat(
        F.lit('{"event_id":'), eid, F.lit(',"route":"')))
        .when(F.col("event_id") % 89 == 0, F.concat(F.lit("["), eid, F.lit("]")))
        .otherwise(F.concat(F.lit('{"event_id":'), eid, F.lit(',"route":"'), "event_type",
                            F.lit('","device":'), F.col("user_id").cast("string"), F.lit("}"))).alias("value"))


@query("json_line_decode", "S3", f"""WITH {JSON_SQL}
SELECT event_id AS row_index, CASE WHEN event_id % 97 = 0 THEN 'invalid JSON'
  WHEN event_id % 89 = 0 THEN 'JSON value is not an object' END AS detail,
 CASE WHEN json_valid(value) AND value LIKE '{{%' THEN json_extract_string(value,'$.route') END AS route,
 CASE WHEN json_valid(value) AND value LIKE '{{%' THEN CAST(json_extract(value,'$.device') AS BIGINT) END AS device FROM lines""")
def _(t):
    schema = T.StructType([T.StructField("route", T.StringType()), T.StructField("device", T.LongType())])
    parsed = E.parse_jsonl(json_lines(t).withColumnRenamed("event_id", "row_index"), schema)
    ok = F.col("problem").isNull()
    return parsed.select("row_index", F.col("problem.detail").alias("detail"),
                         F.when(ok, F.col("route")).alias("route"), F.when(ok, F.col("device")).alias("device"))


@query("csv_line_decode", "S4", """WITH lines AS (SELECT event_id, CASE WHEN event_id % 71 = 0
   THEN event_id || ',' || event_type WHEN event_id % 73 = 0 THEN event_id || ',"a,b",' || user_id || ',x'
   ELSE event_id || ',' || event_type || ',' || user_id END AS value FROM events)
SELECT event_id AS row_index,
 CASE WHEN event_id % 71 = 0 THEN 'expected 3 columns, got 2' WHEN event_id % 73 = 0 THEN 'expected 3 columns, got 4' END AS detail,
 CASE WHEN event_id % 71 <> 0 AND event_id % 73 <> 0 THEN split_part(value, ',', 2) END AS route,
 CASE WHEN event_id % 71 <> 0 AND event_id % 73 <> 0 THEN split_part(value, ',', 3) END AS device FROM lines""")
def _(t):
    eid, dev = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    lines = t.events.select(F.col("event_id").alias("row_index"), F.when(
        F.col("event_id") % 71 == 0, F.concat_ws(",", eid, "event_type")).when(
        F.col("event_id") % 73 == 0, F.concat_ws(",", eid, F.lit('"a,b"'), dev, F.lit("x"))).otherwise(
        F.concat_ws(",", eid, "event_type", dev)).alias("value"))
    parsed = E.parse_csv_lines(lines, ["event_id", "route", "device"])
    ok = F.col("problem").isNull()
    return parsed.select("row_index", F.col("problem.detail").alias("detail"),
                         F.when(ok, F.col("route")).alias("route"), F.when(ok, F.col("device")).alias("device"))


# Contract rows as text: copies, bad identifiers, bad numbers, clocks without a zone.
CONTRACT_SQL = """contract AS (SELECT event_id AS row_index,
  CASE WHEN event_id % 101 = 0 THEN 'data.v0' ELSE 'data.v1' END AS schema_version, 'e1' AS entity_version,
  'ev-' || CAST(event_id - CASE WHEN event_id % 13 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS event_id,
  CASE WHEN event_id % 103 = 0 THEN 'bad route' ELSE event_type END AS route_id,
  CAST(k % 2 AS VARCHAR) AS direction_id, 's' || CAST(k % 10 AS VARCHAR) AS stop_id,
  CASE WHEN event_id % 107 = 0 THEN 'x' ELSE CAST(k % 10 AS VARCHAR) END AS stop_sequence,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 109 = 0 THEN '' ELSE '+03:00' END AS event_at,
  strftime(ts + to_seconds(CASE WHEN event_id % 113 = 0 THEN -60 ELSE event_id % 7200 END), '%Y-%m-%dT%H:%M:%S') || '+03:00' AS available_at,
  CASE WHEN event_id % 127 = 0 THEN 'maybe' ELSE 'False' END AS synthetic,
  CASE WHEN event_id % 131 = 0 THEN 'synthetic_boardings' ELSE 'validation_count' END AS target,
  CAST(value AS VARCHAR) AS longitude, ts, value, CASE WHEN event_id % 13 = 1 AND event_id % 26 = 1 THEN event_type ELSE 'p' END AS payload
 FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)),
 checked AS (SELECT c.*, CASE
  WHEN schema_version <> 'data.v1' THEN 'invalid_value:schema_version must be one of the allowed values'
  WHEN route_id = 'bad route' THEN 'invalid_value:route_id is not a valid identifier'
  WHEN stop_sequence = 'x' THEN 'invalid_type:stop_sequence must be an integer'
  WHEN event_at NOT LIKE '%+03:00' THEN 'invalid_timestamp:event_at'
  WHEN synthetic = 'maybe' THEN 'invalid_type:synthetic must be a boolean'
  WHEN value > 180 THEN 'invalid_value:longitude must be finite within the limit' END AS p1 FROM contract c),
 related AS (SELECT *, coalesce(p1, CASE WHEN available_at < event_at THEN 'availability_before_event:available_at precedes event_at'
  WHEN target = 'synthetic_boardings' THEN 'invalid_value:target must match synthetic provenance' END) AS p2 FROM checked),
 located AS (SELECT *, coalesce(p2, CASE WHEN stop_id = 's9' THEN 'unknown_entity:unknown stop for route/direction'
  WHEN route_id = 'signup' AND stop_id IN ('s7','s8') THEN 'unknown_entity:stop_sequence does not identify this stop visit' END) AS problem_text FROM related)"""

FIELDS = [I.Field("schema_version", "literal", ("data.v1",)), I.Field("entity_version", "identifier"),
          I.Field("event_id", "identifier"), I.Field("route_id", "identifier"), I.Field("direction_id", "identifier"),
          I.Field("stop_id", "identifier"), I.Field("stop_sequence", "sequence"), I.Field("event_at", "timestamp"),
          I.Field("available_at", "timestamp"), I.Field("synthetic", "boolean"),
          I.Field("target", "literal", ("synthetic_boardings", "validation_count")),
          I.Field("longitude", "coordinate", limit=180.0)]
DEMO_ADAPTER = I.register_adapter(I.Adapter("demo", {
    "event_id": "id", "route_id": "line", "event_at": "happened", "available_at": "published"},
    {"entity_version": "e1"}))


def contract_rows(t):
    n = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    lag = F.when(n % 113 == 0, -60).otherwise((n % 7200).cast("int")).cast("bigint")
    published = wall_instant(wall_seconds(F.col("ts")) + lag)
    shape = "yyyy-MM-dd'T'HH:mm:ss"
    source = t.events.select(
        n.alias("row_index"), F.when(n % 101 == 0, "data.v0").otherwise("data.v1").alias("schema_version"),
        F.concat(F.lit("ev-"), (n - F.when(n % 13 == 1, 1).otherwise(0)).cast("string")).alias("id"),
        F.when(n % 103 == 0, "bad route").otherwise(F.col("event_type")).alias("line"),
        (k % 2).cast("string").alias("direction_id"), F.concat(F.lit("s"), (k % 10).cast("string")).alias("stop_id"),
        F.when(n % 107 == 0, "x").otherwise((k % 10).cast("string")).alias("stop_sequence"),
        F.concat(F.date_format("ts", shape), F.when(n % 109 == 0, "").otherwise("+03:00")).alias("happened"),
        F.concat(F.date_format(published, shape), F.lit("+03:00")).alias("published"),
        F.when(n % 127 == 0, "maybe").otherwise("False").alias("synthetic"),
        F.when(n % 131 == 0, "synthetic_boardings").otherwise("validation_count").alias("target"),
        F.col("value").cast("string").alias("longitude"),
        F.when((n % 13 == 1) & (n % 26 == 1), F.col("event_type")).otherwise("p").alias("payload"))
    return I.adapt(source, DEMO_ADAPTER, [f.name for f in FIELDS], keep=["row_index", "payload"])


def patterns(t):
    stops = [F.lit(f"s{i}") for i in range(9)]
    swapped = [*stops[:7], F.lit("s8"), F.lit("s7")]
    pairs = t.events.select(F.col("event_type").alias("route_id")).distinct().select(
        "route_id", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("direction_id"))
    return pairs.withColumn("stop_ids", F.when(
        F.col("route_id") == "signup", F.array(*swapped)).otherwise(F.array(*stops)))


def checked_rows(t):
    rows = I.check_fields(contract_rows(t), FIELDS, keep=["row_index", "payload"])
    return I.check_location(I.check_relations(rows, "synthetic_boardings"), patterns(t), "e1")


@query("adapt_columns", "P1 E4", """SELECT event_id AS row_index, CASE WHEN event_id % 103 = 0 THEN 'bad route' ELSE event_type END AS route_id,
 'e1' AS entity_version, 'source_version' AS missing FROM events""")
def _(t):
    n = F.col("event_id")
    source = t.events.select(n.alias("row_index"), F.when(n % 103 == 0, "bad route").otherwise(F.col("event_type")).alias("line"))
    return I.adapt(source, DEMO_ADAPTER, ["entity_version", "route_id", "source_version"], keep=["row_index"]).select(
        "row_index", "route_id", "entity_version", "missing")


@query("field_checks", "P2 F12", f"""WITH {CONTRACT_SQL}
SELECT row_index, split_part(p1, ':', 1) AS reason, split_part(p1, ':', 2) AS detail FROM checked WHERE p1 IS NOT NULL""")
def _(t):
    rows = I.check_fields(contract_rows(t), FIELDS, keep=["row_index"])
    return rows.where("problem IS NOT NULL").select("row_index", "problem.reason", "problem.detail")


@query("timestamp_normalise", "P3", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL
   ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) + CASE WHEN event_id % 3 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 1 HOUR END END AS local_at,
   CAST(date_trunc('second', ts) AS TIMESTAMP) + CASE event_id % 3 WHEN 0 THEN INTERVAL 3 HOUR WHEN 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS assumed_berlin_at
FROM events""")
def _(t):
    n = F.col("event_id") % 3
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n == 0, "Z").when(n == 1, "+02:00").otherwise(""))
    return t.events.select("event_id", normalize_timestamp(text).alias("local_at"),
                           normalize_timestamp(text, assume_zone="Europe/Berlin").alias("assumed_berlin_at"))


@query("row_relations", "P4", f"""WITH {CONTRACT_SQL}
SELECT split_part(p2, ':', 1) AS reason, split_part(p2, ':', 2) AS detail, count(*) AS rows FROM related
WHERE p1 IS NULL AND p2 IS NOT NULL GROUP BY ALL""")
def _(t):
    rows = I.check_fields(contract_rows(t), FIELDS, keep=["row_index"]).where("problem IS NULL")
    return I.check_relations(rows, "synthetic_boardings").where("problem IS NOT NULL").groupBy(
        "problem.reason", "problem.detail").agg(F.count(F.lit(1)).alias("rows"))


@query("catalogue_check", "P5", f"""WITH {CONTRACT_SQL}
SELECT row_index, split_part(problem_text, ':', 2) AS detail FROM located WHERE p2 IS NULL AND problem_text IS NOT NULL""")
def _(t):
    return checked_rows(t).where("problem.reason = 'unknown_entity'").select("row_index", "problem.detail")


@query("quarantine_split", "P6", f"""WITH {CONTRACT_SQL}
SELECT CASE WHEN problem_text IS NULL THEN 'valid' ELSE split_part(problem_text, ':', 1) END AS outcome, count(*) AS rows
FROM located GROUP BY ALL""")
def _(t):
    valid, rejected = I.split_quarantine(checked_rows(t))
    return valid.select(F.lit("valid").alias("outcome")).unionByName(
        rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def verdicts(t):
    return I.dedup_exact(checked_rows(t), ["event_id"], ["row_index"], ["event_id", "payload"], F.col("problem").isNull())


VERDICT_SQL = CONTRACT_SQL + """, numbered AS (SELECT row_index, route_id, problem_text, CASE WHEN problem_text IS NULL THEN
   row_number() OVER (PARTITION BY event_id, problem_text IS NULL ORDER BY row_index) END AS rn,
   payload, first_value(payload) OVER (PARTITION BY event_id, problem_text IS NULL ORDER BY row_index) AS head FROM located),
 verdicts AS (SELECT row_index, route_id, problem_text, CASE WHEN problem_text IS NULL THEN
   CASE WHEN rn=1 THEN 'new' WHEN payload=head THEN 'duplicate' ELSE 'conflict' END END AS verdict FROM numbered)"""


@query("exact_dedup", "P7 F22", f"WITH {VERDICT_SQL} SELECT row_index, verdict FROM verdicts WHERE verdict IS NOT NULL")
def _(t):
    return verdicts(t).where("verdict IS NOT NULL").select("row_index", "verdict")


@query("ingest_ledger", "A3", f"""WITH {VERDICT_SQL} SELECT route_id, count(*) AS input_rows,
 count(*) FILTER (verdict='new') AS valid, count(*) FILTER (verdict='duplicate') AS duplicates,
 count(*) FILTER (problem_text IS NOT NULL OR verdict='conflict') AS quarantined, true AS reconciled FROM verdicts GROUP BY ALL""")
def _(t):
    return I.ingest_report(verdicts(t), ["route_id"])


@query("quarantine_reasons", "A3 S5", f"""WITH {VERDICT_SQL} SELECT route_id,
 CASE WHEN verdict='conflict' THEN 'conflicting_duplicate' ELSE split_part(problem_text, ':', 1) END AS reason, count(*) AS rows
FROM verdicts WHERE problem_text IS NOT NULL OR verdict='conflict' GROUP BY ALL""")
def _(t):
    return I.quarantine_reasons(verdicts(t), ["route_id"])


@query("catalogue_integrity", "P8", """WITH patterns AS (SELECT s_nationkey AS route_id, CAST(s_suppkey % 2 AS VARCHAR) AS direction_id, s_suppkey AS stop_id FROM supplier),
 visits AS (SELECT DISTINCT l_suppkey % 30 AS route_id, l_suppkey + l_linenumber AS stop_id FROM lineitem)
SELECT 'duplicate_pattern' AS problem, route_id || '/' || direction_id AS entity FROM
  (SELECT l_suppkey % 30 AS route_id, l_linenumber % 2 AS direction_id, l_linenumber FROM lineitem GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'unknown_route', CAST(route_id AS VARCHAR) FROM (SELECT DISTINCT route_id FROM visits) WHERE route_id NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'unknown_stop', CAST(stop_id AS VARCHAR) FROM (SELECT DISTINCT stop_id FROM visits) WHERE stop_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'duplicate_route', CAST(n_nationkey AS VARCHAR) FROM (SELECT n_nationkey FROM nation UNION ALL SELECT c_nationkey FROM customer) GROUP BY n_nationkey HAVING count(*) > 1 AND false""")
def _(t):
    routes = t.nation.select(F.col("n_nationkey").cast("bigint").alias("route_id"))
    stops = t.supplier.select(F.col("s_suppkey").alias("stop_id"))
    pattern = t.lineitem.groupBy((F.col("l_suppkey") % 30).alias("route_id"), F.col("l_linenumber")).agg(
        F.collect_set(F.col("l_suppkey") + F.col("l_linenumber")).alias("stop_ids")).select(
        "route_id", (F.col("l_linenumber") % 2).alias("direction_id"), "stop_ids")
    return I.validate_catalog(routes, stops, pattern)


@query("visible_at_cutoff", "P9 X5", """SELECT event_id, route FROM validations
WHERE ts < TIMESTAMP '2024-01-15 12:00:00' AND available_at <= TIMESTAMP '2024-01-15 12:00:00'""", "validations")
def _(t):
    rows = t.validations.withColumnRenamed("ts", "event_at")
    return I.visible_at(rows, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("event_id", "route")


@query("half_open_window", "P10", """SELECT route, count(*) AS events FROM validations
WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL""", "validations")
def _(t):
    rows = I.in_window(t.validations, "ts", datetime(2024, 1, 5, 6), datetime(2024, 1, 20))
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("events"))


@query("pseudonyms", "P12", f"""WITH {RAW_SQL} SELECT event_id, CASE WHEN device_no IN ('-1','0') THEN '' ELSE substr(sha256('{HASH_SALT}:device:' || device_no),1,24) END AS device_key,
 CASE WHEN garage_number='0' THEN '' ELSE substr(sha256('{HASH_SALT}:vehicle:' || garage_number),1,24) END AS vehicle_key FROM raw""")
def _(t):
    return raw_rows(t).select("event_id", I.opaque(F.col("device_no"), "device", HASH_SALT).alias("device_key"),
                              I.opaque(F.col("garage_number"), "vehicle", HASH_SALT).alias("vehicle_key"))


@query("stable_event_keys", "P13", f"""SELECT substr(sha256('{HASH_SALT}:' || event_type),1,24) || ':' || event_id AS event_key, value FROM events""")
def _(t):
    return I.event_keys(t.events, HASH_SALT, F.col("event_type"), F.col("event_id")).select("event_key", "value")


@query("content_hash_copies", "F22", """SELECT n AS copies, count(*) AS records FROM (SELECT event_type, user_id % 7 AS bucket, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL""")
def _(t):
    rows = t.events.select("event_type", (F.col("user_id") % 7).alias("bucket"))
    return rows.groupBy(I.content_hash(["event_type", "bucket"]).alias("h")).agg(F.count(F.lit(1)).alias("copies")).groupBy(
        "copies").agg(F.count(F.lit(1)).alias("records"))


@query("row_inventory", "S7")
def _(t):
    return E.row_inventory(t.lineitem)


@query("scored_text_check", "S13", """WITH scored AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS route, CASE WHEN l_linenumber=7 THEN '2000-13-01' ELSE strftime(l_shipdate,'%Y-%m-%d') END AS date,
 CAST(l_partkey % 25 AS VARCHAR) AS hour, CASE WHEN l_discount = 0.1 THEN CAST(l_quantity AS VARCHAR) ELSE CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) END AS prediction, l_discount, l_extendedprice, l_partkey, l_linenumber FROM lineitem)
SELECT CASE WHEN l_linenumber=7 THEN 'date' WHEN l_partkey % 25 = 24 THEN 'hour' WHEN l_discount = 0.1 THEN 'prediction'
 WHEN CAST(l_extendedprice AS BIGINT) >= 90000 THEN 'limit' ELSE 'ok' END AS problem, count(*) AS rows FROM scored GROUP BY ALL""")
def _(t):
    rows = t.lineitem.select(
        (F.col("l_suppkey") % 50).cast("string").alias("route"),
        F.when(F.col("l_linenumber") == 7, "2000-13-01").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        (F.col("l_partkey") % 25).cast("string").alias("hour"),
        F.when(F.col("l_discount") == 0.1, F.col("l_quantity").cast("string")).otherwise(
            F.rint("l_extendedprice").cast("bigint").cast("string")).alias("prediction"))
    return rows.select(F.coalesce(E.scored_problem(90000), F.lit("ok")).alias("problem")).groupBy("problem").agg(
        F.count(F.lit(1)).alias("rows"))


@query("submission_grid", "S12", """SELECT route, date, hour, CAST(round_even(greatest(boardings*0.75::DOUBLE, 0), 0) AS BIGINT) AS prediction
FROM hourly_dense""", "hourly_dense")
def _(t):
    rows = t.hourly_dense.withColumn("prediction", F.col("boardings") * 0.75)
    return E.submission_rows(rows, t.hourly_dense.select("route", "date", "hour"))


@query("report_export_guard", "S14", """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '=' || p_name WHEN p_size % 4 = 1 THEN '  -' || p_name ELSE p_name END AS name,
  CASE WHEN p_size % 6 = 0 THEN '@' || p_brand ELSE p_brand END AS brand, p_size, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 IN (0,1) THEN 'text:' || name ELSE name END AS name,
 CASE WHEN p_size % 6 = 0 THEN 'text:' || brand ELSE brand END AS brand, p_retailprice,
 concat_ws(';', CASE WHEN p_size % 4 IN (0,1) THEN 'name' END, CASE WHEN p_size % 6 = 0 THEN 'brand' END) AS escaped_text_columns FROM r""")
def _(t):
    size = F.col("p_size")
    rows = t.part.select("p_partkey", F.when(size % 4 == 0, F.concat(F.lit("="), "p_name")).when(
        size % 4 == 1, F.concat(F.lit("  -"), "p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(size % 6 == 0, F.concat(F.lit("@"), "p_brand")).otherwise(F.col("p_brand")).alias("brand"), "p_retailprice")
    return X.export_forecast(rows)


@query("planning_export_rows", "S15 S16", """WITH b AS (SELECT run_id, route_id, bucket, stop_id, sum(predicted) AS baseline FROM points GROUP BY ALL)
SELECT run_id, route_id, bucket, 'total' AS row_kind, CAST(NULL AS BIGINT) AS stop_id, sum(baseline) AS baseline, round(sum(baseline)*1.1::DOUBLE,6) AS scenario FROM b GROUP BY run_id, route_id, bucket
UNION ALL SELECT run_id, route_id, bucket, 'estimated_stop', stop_id, baseline, round(baseline*1.1::DOUBLE,6) FROM b""", "points")
def _(t):
    per_stop = t.points.groupBy("run_id", "route_id", "bucket", "stop_id").agg(F.sum("predicted").alias("baseline"))
    packed = per_stop.groupBy("run_id", "route_id", "bucket").agg(
        F.sum("baseline").alias("baseline"), (F.sum("baseline") * 1.1).alias("scenario"),
        F.collect_list(F.struct("stop_id", "baseline", (F.col("baseline") * 1.1).alias("scenario"))).alias("spatial"))
    whole = X.export_network([X.export_planning(packed, ["run_id", "route_id", "bucket"])])
    return whole.withColumn("scenario", rnd("scenario"))


@query("graph_export_rows", "S17", """SELECT 'node' AS kind, stop_id AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS length_m, '' AS routes FROM stops
UNION ALL SELECT 'edge', source, target, length_m, array_to_string(routes, ';') FROM edges""", "stops edges")
def _(t):
    return X.graph_rows(t.stops, t.edges).drop("geometry")


def day_shards(t):
    out = scratch(t.spark, "day-shards")
    rows = t.validations.select(F.col("event_id").cast("string").alias("event_key"), "event_id", "route", "hour", "success", "date")
    return out, E.write_day_shards(rows, out)


@query("day_shard_read", "S6", """SELECT event_id, route, hour FROM validations WHERE date = DATE '2024-01-10' AND route IN ('click','view')""", "validations")
def _(t):
    out, _ = day_shards(t)
    return E.read_day(t.spark, out, date(2024, 1, 10), ["click", "view"]).select("event_id", "route", "hour")


@query("day_shard_manifest", "S6", """SELECT date, count(*) AS events, count(*) FILTER (success) AS successful FROM validations GROUP BY ALL""", "validations")
def _(t):
    return day_shards(t)[1].select("date", "events", "successful")


@query("busy_days_read", "S6", """WITH d AS (SELECT date, count(*) AS n FROM validations GROUP BY ALL) SELECT date, route, count(*) AS events, count(*) FILTER (success) AS successful FROM validations
WHERE date IN (SELECT date FROM d WHERE n > (SELECT avg(n) FROM d)) GROUP BY ALL""", "validations")
def _(t):
    out, days = day_shards(t)
    mean = days.agg(F.avg("events").alias("mean"))
    busy = days.crossJoin(mean).where("events > mean")
    return E.read_days(t.spark, out, busy).groupBy("date", "route").agg(F.count(F.lit(1)).alias("events"), F.count_if("success").alias("successful"))


def ingest_outputs(t):
    rows = verdicts(t).withColumn("stream", F.coalesce("route_id", F.lit("unknown")))
    clash = F.col("verdict") == "conflict"
    bad = rows.where(F.col("problem").isNotNull() | clash)
    raw = F.to_json(F.struct("event_id", "route_id", "payload"))
    quarantine = bad.select("stream", "row_index", F.coalesce("problem.reason", F.lit("conflicting_duplicate")).alias("reason"),
                            F.coalesce("problem.detail", F.lit("payload differs from the first")).alias("detail"), raw.alias("raw"))
    out = scratch(t.spark, "ingest-outputs")
    return out, E.write_ingest(rows.where("verdict = 'new'").select("stream", "row_index", "event_id", "payload"), quarantine, out)


@query("ingest_output_manifest", "S5", f"""WITH {VERDICT_SQL} SELECT CASE WHEN verdict='new' THEN 'valid' ELSE 'quarantine' END AS kind, route_id AS stream, count(*) AS rows
FROM verdicts WHERE problem_text IS NOT NULL OR verdict IN ('new','conflict') GROUP BY ALL""")
def _(t):
    return ingest_outputs(t)[1].select("kind", "stream", "rows")


@query("quarantine_read", "S5", f"""WITH {VERDICT_SQL} SELECT row_index, route_id AS stream, CASE WHEN verdict='conflict' THEN 'conflicting_duplicate' ELSE split_part(problem_text, ':', 1) END AS reason
FROM verdicts WHERE problem_text IS NOT NULL OR verdict='conflict'""")
def _(t):
    out, _ = ingest_outputs(t)
    return E.read_quarantine(t.spark, out).select("row_index", "stream", "reason")


@query("file_inventory", "S7")
def _(t):
    return E.file_inventory(t.spark, f"{t.dir}/lineitem.parquet")
