"""Streaming jobs driven to completion over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridewave.functions.clock import wall_seconds
from ridewave.operators import mapping as M
from ridewave.operators.ingest import content_hash
from ridewave.queries.base import query
from ridewave.queries.timetable import MAP_SQL, USES, nested, spans
from ridewave.sources.events import parse_jsonl, read_labels
from ridewave.streaming import jobs as S

c = F.col


def stream(t):
    """The events file as a stream."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


def finish(t, df, keys, name, mode="update"):
    out = S.scratch(t.spark, name)
    S.write_updates(df, out, out + "-checkpoint", mode).awaitTermination()
    return S.read_latest(t.spark, out, keys)


DELIVERY_SQL = """deliveries AS (SELECT *, ts + to_seconds(event_id % 7200) AS published, CASE WHEN ts + to_seconds(event_id % 7200) < TIMESTAMP '2024-01-11' THEN 0
  WHEN ts + to_seconds(event_id % 7200) < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS delivery FROM events)"""


def deliveries(t, *columns):
    """The events in three deliveries by the time they are published, up to two hours after they happen."""
    published = c("ts") + F.make_dt_interval(secs=(c("event_id") % 7200).cast("decimal(18,6)"))
    number = F.when(published < F.lit("2024-01-11").cast("timestamp_ntz"), 0).when(published < F.lit("2024-01-21").cast("timestamp_ntz"), 1).otherwise(2)
    rows = t.events.select(*columns, number.alias("delivery"))
    return [rows.where(c("delivery") == n).drop("delivery") for n in range(3)]


def deliver(t, parts, name, run):
    """Puts each part into an inbox and runs the job on what is there: every delivery is a restart from the checkpoint."""
    out = S.scratch(t.spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{out}/inbox")
        run(t.spark.readStream.schema(part.schema).parquet(f"{out}/inbox"), out + "/out", out + "/checkpoint")
    return out + "/out"


@query("stream_ingest", "X1 X6", f"""WITH {DELIVERY_SQL}, r AS (SELECT delivery, event_id AS row_index, CASE WHEN event_id % 97=0 OR event_id % 89=0 THEN 'decode_error' END AS p, user_id * 100 + CAST(json_extract_string(props, '$.k') AS INT) AS id, event_type FROM deliveries),
n AS (SELECT *, row_number() OVER w AS rn, first_value(event_type) OVER w AS f FROM r WINDOW w AS (PARTITION BY id, p IS NULL ORDER BY delivery, row_index))
SELECT 'events' AS stream, count(*) AS input_rows, count(*) FILTER (p IS NULL AND rn=1) AS valid, count(*) FILTER (p IS NULL AND rn>1 AND event_type=f) AS duplicates, count(*) FILTER (p IS NOT NULL OR (rn>1 AND event_type<>f)) AS quarantined FROM n""")
def _(t):
    n = c("event_id")
    body = F.concat(F.lit('{"id":'), (c("user_id") * 100 + F.get_json_object("props", "$.k").cast("int")).cast("string"), F.lit(',"route":"'), "event_type", F.lit('"}'))
    text = F.when(n % 97 == 0, F.lit('{"id":')).when(n % 89 == 0, F.lit("[1]")).otherwise(body)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("route", T.StringType())])

    def check(batch):
        return parse_jsonl(batch, schema).withColumn("payload_hash", content_hash(["id", "route"])).withColumn("stream", F.lit("events"))

    parts = [p.select(n.alias("row_index"), text.alias("value")) for p in deliveries(t, "event_id", "event_type", "user_id", "props")]
    out = deliver(t, parts, "ingest", lambda lines, out, at: S.stream_ingest(lines, check, "id", out, at))
    return S.ingest_ledger(t.spark, out, "id", ["stream"])


@query("stream_dedup", "X2", "SELECT DISTINCT event_id//2 AS id FROM events")
def _(t):
    rows = stream(t).select(F.floor(c("event_id") / 2).alias("id"), c("ts").cast("timestamp").alias("ts"))
    out = S.scratch(t.spark, "dedup")
    S.write_updates(S.stream_dedup(rows, "id", "ts", "2 hours"), out, out + "-checkpoint", "append").awaitTermination()
    return t.spark.read.parquet(out).select("id")


@query("stream_conflicts", "X2", """WITH RECURSIVE r AS (SELECT user_id AS id, ts, event_type, sha256(event_type) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, sha256(event_type)) AS rn FROM events),
 j AS (SELECT id, rn, ts AS opened, event_type AS head, 'new' AS verdict FROM r WHERE rn=1
  UNION ALL SELECT r.id, r.rn, CASE WHEN r.ts > opened + INTERVAL 2 HOUR THEN r.ts ELSE opened END, CASE WHEN r.ts > opened + INTERVAL 2 HOUR THEN r.event_type ELSE head END,
   CASE WHEN r.ts > opened + INTERVAL 2 HOUR THEN 'new' WHEN r.event_type=head THEN 'duplicate' ELSE 'conflict' END FROM j JOIN r ON r.id=j.id AND r.rn=j.rn+1)
SELECT id, verdict, count(*) AS rows FROM j GROUP BY ALL""")
def _(t):
    rows = t.events.select(c("user_id").alias("id"), c("ts").cast("timestamp").alias("ts"), "event_type")
    early = c("ts") < F.lit("2024-01-13 05:00:00").cast("timestamp")  # deliveries in order of time: nothing is late
    out = deliver(t, [rows.where(early), rows.where(~early)], "conflicts", lambda df, out, at: S.write_conflicts(
        S.stream_conflicts(df, "id", "ts", c("event_type"), "2 hours"), out, at).awaitTermination())
    return t.spark.read.parquet(out).groupBy(c("id").cast("bigint").alias("id"), "verdict").agg(F.count(F.lit(1)).alias("rows"))


def closed_output(t, parts, name, job):
    """What an append-mode job has emitted once a closing row has followed the deliveries."""
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = deliver(t, [*parts, S.closing_row(whole, "ts", "2 DAYS")], name, lambda df, out, at: S.write_updates(job(df), out, at, "append").awaitTermination())
    return t.spark.read.parquet(out)


@query("stream_hourly_counts", "X3", "SELECT event_type AS route, date_trunc('hour', ts) AS hour_start, count(*) AS boardings FROM events WHERE value>=1.0 GROUP BY ALL")
def _(t):
    parts = [p.where("value >= 1.0").select(c("event_type").alias("route"), c("ts").cast("timestamp").alias("ts")) for p in deliveries(t, "ts", "event_type", "value")]
    out = closed_output(t, parts, "hourly", lambda df: S.stream_hourly(df, ["route"], "ts", "3 hours"))
    return out.select("route", c("hour_start").cast("timestamp_ntz").alias("hour_start"), "boardings")


@query("stream_sessions", "X4", """WITH l AS (SELECT event_type AS route, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts-p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT route, min(ts) AS first, max(ts) AS last, count(*) AS events FROM g GROUP BY route, s""")
def _(t):
    parts = [p.select(c("event_type").alias("route"), c("ts").cast("timestamp").alias("ts")) for p in deliveries(t, "ts", "event_type")]
    out = closed_output(t, parts, "sessions", lambda df: S.stream_sessions(df, "route", "ts", "30 minutes", "3 hours"))
    return out.select("route", c("first").cast("timestamp_ntz").alias("first"), c("last").cast("timestamp_ntz").alias("last"), "events")


@query("stream_visibility_ledger", "X5 X6", """SELECT route, CASE WHEN ts < TIMESTAMP '2024-01-15' AND available_at <= TIMESTAMP '2024-01-15' THEN 'visible' WHEN ts < TIMESTAMP '2024-01-15' THEN 'late' ELSE 'future' END AS status, count(*) AS rows FROM validations GROUP BY ALL""", "validations")
def _(t):
    lag = (c("event_id") % 7200).cast("decimal(18,6)")
    rows = stream(t).select(c("event_type").alias("route"), c("ts").alias("event_at"), (c("ts") + F.make_dt_interval(secs=lag)).alias("available_at"))
    marked = S.stream_late(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return finish(t, S.stream_ledger(marked, ["route", "status"]), ["route", "status"], "ledger")


@query("stream_day_mapping", "X7", f"WITH {MAP_SQL} SELECT date, status, count(*) AS events FROM mapped GROUP BY ALL", USES)
def _(t):
    rows = stream(t).select("event_id", wall_seconds(c("ts")).alias("sec"), F.to_date("ts").alias("date"), c("event_type").alias("route"), c("user_id").alias("duty"))
    trips, shapes = spans(t), nested(t)
    out = S.scratch(t.spark, "mapping")
    S.stream_map_days(rows, lambda batch: M.map_events(batch, trips, shapes), out, out + "-checkpoint").awaitTermination()
    return S.receipts(t.spark, out)


@query("label_csv_scan", "S1", """SELECT CAST(substr(o_orderpriority,1,1) AS INT) AS route, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 24 AS INT) AS hour, CAST(sum(floor(o_totalprice/10000)) AS BIGINT) AS boardings FROM orders GROUP BY ALL""")
def _(t):
    out = S.scratch(t.spark, "labels")
    rows = t.order_hours.withColumn("route", F.substring("route", 1, 1).cast("int"))
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    for name, part in (("train", rows.where(early)), ("test", rows.where(~early))):
        part.select("route", "date", "hour", "boardings").write.option("header", True).option("sep", ";").csv(f"{out}/{name}")
    return read_labels(t.spark, [f"{out}/train", f"{out}/test"])
