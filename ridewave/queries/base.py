"""The query registry and the domain tables derived from the given parquet tables.

``Tables`` builds each domain table with the DataFrame API; ``BASES`` holds the same
definition as SQL, used only by the comparison engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridewave.functions.clock import second_of_day, wall_seconds
from ridewave.operators.joins import hour_grid, span_days
from ridewave.session import reliable_checkpoint


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[["Tables"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None, uses: str = ""):
    def register(fn: Callable[["Tables"], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), fn, compose(sql, uses) if sql else None)
        return fn
    return register


# Rows of a table that one task sorts or hashes at most, where a key's rows allow it.
PART_ROWS = 250_000

# Fixed values of the stand-in data: forecast origins inside the date span of the tables.
EVENT_ORIGIN = date(2024, 1, 22)
ORDER_ORIGIN = date(2001, 6, 1)
HOLIDAYS = ("01-01", "01-07", "02-23", "03-08", "05-01", "05-09", "06-12", "11-04")
OFF_DAYS = [date(y, int(h[:2]), int(h[3:])) for y in range(1995, 2002) for h in HOLIDAYS]


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}
        self.counts: dict[str, int] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                    "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def validations(self) -> DataFrame:
        """Fare validations; ``available_at`` trails the event by up to two hours."""
        k = F.get_json_object("props", "$.k").cast("int")
        lag = (F.col("event_id") % 7200).cast("bigint")
        return self.events.select(
            "event_id", "ts", wall_seconds(F.col("ts")).alias("sec"),
            second_of_day(F.col("ts")).alias("sod"), F.to_date("ts").alias("date"),
            F.hour("ts").alias("hour"), F.col("event_type").alias("route"),
            F.col("user_id").alias("device"), (F.col("user_id") % 40).alias("vehicle"),
            (k % 10).alias("stop_no"), (k % 2).alias("direction"), k.alias("k"),
            (F.col("value") >= 1.0).alias("success"), "value",
            (F.col("ts") + F.make_dt_interval(secs=lag.cast("decimal(18,6)"))).alias("available_at"))

    @cached_property
    def hourly(self) -> DataFrame:
        """Hourly labels of 30 days: successful validations per route, date and hour."""
        return self.validations.where("success").groupBy("route", "date", "hour").agg(
            F.count(F.lit(1)).alias("boardings"))

    @cached_property
    def hourly_dense(self) -> DataFrame:
        grid = hour_grid(self.validations.select("route"), span_days(self.validations))
        return grid.join(self.hourly, ["route", "date", "hour"], "left").withColumn(
            "boardings", F.coalesce("boardings", F.lit(0)).cast("bigint"))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query reads many times, computed once and kept in the shared checkpoint folder."""
        if name not in self.kept:
            self.kept[name] = reliable_checkpoint(make())
        return self.kept[name]

    def spread(self, df: DataFrame, source: str, *keys: str) -> DataFrame:
        """``df``, about a row for each of table ``source``, dealt by ``keys`` over partitions in proportion to the table.

        A fixed number of shuffle partitions lets a task's sorts and hash maps grow with the input; fewer rows stay as they are.
        """
        if source not in self.counts:
            self.counts[source] = self.read(source).count()  # from the footers
        parts = -(-self.counts[source] // PART_ROWS)
        return df.repartition(parts, *keys) if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df

    @property
    def hourly_kept(self) -> DataFrame:
        """``hourly_dense`` for plans that read it many times: without it each reading scans all events."""
        return self.once("hourly dense", lambda: self.hourly_dense)

    @cached_property
    def order_hours(self) -> DataFrame:
        """Hourly labels over years."""
        return self.orders.groupBy(
            F.col("o_orderpriority").alias("route"), F.to_date("o_orderdate").alias("date"),
            (F.col("o_custkey") % 24).cast("int").alias("hour"),
        ).agg(F.sum(F.floor(F.col("o_totalprice") / 10000)).cast("bigint").alias("boardings"))

    @cached_property
    def order_dense(self) -> DataFrame:
        days = self.orders.select(F.to_date("o_orderdate").alias("date"))
        grid = hour_grid(self.orders.select(F.col("o_orderpriority").alias("route")), span_days(days))
        return grid.join(self.order_hours, ["route", "date", "hour"], "left").withColumn(
            "boardings", F.coalesce("boardings", F.lit(0)).cast("bigint"))

    @cached_property
    def scored(self) -> DataFrame:
        """Scored hourly points with baseline, interval, capacity and fold."""
        g = self.validations.groupBy("route", "direction", F.col("stop_no").alias("stop"), "date", "hour").agg(
            F.count(F.lit(1)).cast("double").alias("actual"), F.min("event_id").alias("lo"),
            F.max("event_id").alias("hi"), F.max("k").alias("k"))
        p = (F.col("lo") % 4).cast("double")
        return g.select(
            F.lit("day").alias("horizon"), F.concat(F.lit("w"), F.weekofyear("date").cast("string")).alias("fold"),
            "route", "direction", "stop", "date", "hour", "actual", p.alias("predicted"),
            F.when(F.col("stop") != 3, (F.col("hi") % 5).cast("double")).alias("baseline"),
            F.when(F.col("route") != "view", F.greatest(p - 1, F.lit(0.0))).alias("lower"),
            F.when(F.col("route") != "view", p + 1).alias("upper"),
            F.when(F.col("route") != "view", F.lit(0.8)).alias("level"),
            F.when(F.col("route") != "view", F.lit("quantile")).alias("method"),
            F.when(F.col("route").isin("click", "error"), F.lit(1.0)).alias("capacity"),
            F.when(F.col("route") != "error", "onboard_load").otherwise("boarding_count").alias("target"),
            F.when(F.col("date") == F.lit(date(2024, 1, 13)), "match").alias("event"))

    @cached_property
    def trips(self) -> DataFrame:
        """Timetable trips: one per order, run by a duty on one of thirty service days."""
        return self.orders.select(
            F.col("o_orderkey").alias("trip_id"), F.floor(F.col("o_custkey") / 10).alias("duty"),
            F.col("o_orderpriority").alias("route"),
            F.date_add(F.lit(date(2024, 1, 1)), (F.col("o_orderkey") % 30).cast("int")).alias("service_day"),
            (F.col("o_orderkey") * 7919 % 50000 + 14400).alias("start_sec"),
            (F.col("o_orderkey") % 2).cast("int").alias("direction"))

    @cached_property
    def stop_times(self) -> DataFrame:
        """Ordered stop clocks of a trip, from its order lines (a bounded group)."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        run = F.col("l_quantity").cast("bigint") * 20 + 60
        lines = self.spread(self.lineitem, "lineitem", "l_orderkey").select(
            F.col("l_orderkey").alias("trip_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"),
            F.col("l_suppkey").alias("stop_id"), F.sum(run).over(w).alias("_elapsed"))
        return lines.join(self.trips, "trip_id").select(
            "trip_id", "duty", "route", "direction", "service_day", "seq", "stop_id",
            (F.col("start_sec") + F.col("_elapsed")).alias("clock"))

    @cached_property
    def trip_spans(self) -> DataFrame:
        return self.stop_times.groupBy("trip_id", "duty", "route", "direction", "service_day").agg(
            F.min("clock").alias("first_clock"), F.max("clock").alias("last_clock"),
            F.count(F.lit(1)).alias("stops"))

    @cached_property
    def stops(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("nation"),
            (F.lit(55.5) + (F.col("s_suppkey") * 37 % 1000) / 2000.0).alias("lat"),
            (F.lit(37.3) + (F.col("s_suppkey") * 91 % 1000) / 1500.0).alias("lon"))

    @cached_property
    def edges(self) -> DataFrame:
        """Directed edges between consecutive stops of a trip inside one nation."""
        w = Window.partitionBy("trip_id").orderBy("seq")
        pairs = self.lineitem_steps.withColumn("target", F.lead("stop_id").over(w)).where("target IS NOT NULL")
        a = self.stops.select(F.col("stop_id"), F.col("nation"))
        b = self.stops.select(F.col("stop_id").alias("target"), F.col("nation").alias("nation_b"))
        return pairs.join(a, "stop_id").join(b, "target").where(
            "nation = nation_b AND stop_id <> target").groupBy(
            F.col("stop_id").alias("source"), "target").agg(
            F.min("qty").alias("length_m"), F.array_sort(F.collect_set("route")).alias("routes"))

    @cached_property
    def lineitem_steps(self) -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return self.lineitem.select(
            F.col("l_orderkey").alias("trip_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"),
            F.col("l_suppkey").alias("stop_id"), F.col("l_quantity").alias("qty"),
            F.col("l_returnflag").alias("route"))

    @cached_property
    def points(self) -> DataFrame:
        """Published forecast points: run x route x stop x month bucket."""
        q = F.col("l_quantity")
        return self.lineitem.select(
            F.col("l_returnflag").alias("run_id"),
            F.concat(F.lit("r"), F.col("l_partkey") % 10).alias("route_id"),
            F.col("l_suppkey").alias("stop_id"), (F.col("l_linenumber") % 2).alias("direction"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("bucket"),
            F.to_date("l_shipdate").alias("date"), q.alias("predicted"), (q * 0.8).alias("lower"),
            (q * 1.25).alias("upper"),
            F.when(F.col("l_tax") >= 0.01, q + 10).alias("capacity"),
            F.when(F.col("l_linestatus") == "O", "validation_count").otherwise("occupancy").alias("target"))


BASES = {
    "validations": ("", """SELECT event_id, ts, epoch_us(ts)//1000000 AS sec,
        CAST(hour(ts)*3600+minute(ts)*60+second(ts) AS INT) AS sod, CAST(ts AS DATE) AS date,
        CAST(hour(ts) AS INT) AS hour, event_type AS route, user_id AS device, user_id % 40 AS vehicle,
        k % 10 AS stop_no, k % 2 AS direction, k, value >= 1.0 AS success, value,
        ts + to_seconds(event_id % 7200) AS available_at
        FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)"""),
    "hourly": ("validations", """SELECT route, date, hour, count(*) AS boardings FROM validations
        WHERE success GROUP BY ALL"""),
    "hourly_dense": ("validations hourly", """SELECT r.route, d.date, h.hour,
        CAST(coalesce(x.boardings,0) AS BIGINT) AS boardings
        FROM (SELECT DISTINCT route FROM validations) r
        CROSS JOIN (SELECT CAST(unnest(generate_series(min(date),max(date),INTERVAL 1 DAY)) AS DATE) AS date
                    FROM validations) d
        CROSS JOIN (SELECT CAST(range AS INT) AS hour FROM range(24)) h
        LEFT JOIN hourly x ON x.route=r.route AND x.date=d.date AND x.hour=h.hour"""),
    "order_hours": ("", """SELECT o_orderpriority AS route, CAST(o_orderdate AS DATE) AS date,
        CAST(o_custkey % 24 AS INT) AS hour, CAST(sum(floor(o_totalprice/10000)) AS BIGINT) AS boardings
        FROM orders GROUP BY ALL"""),
    "order_dense": ("order_hours", """SELECT r.route, d.date, h.hour,
        CAST(coalesce(x.boardings,0) AS BIGINT) AS boardings
        FROM (SELECT DISTINCT o_orderpriority AS route FROM orders) r
        CROSS JOIN (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)),
                    max(CAST(o_orderdate AS DATE)),INTERVAL 1 DAY)) AS DATE) AS date FROM orders) d
        CROSS JOIN (SELECT CAST(range AS INT) AS hour FROM range(24)) h
        LEFT JOIN order_hours x ON x.route=r.route AND x.date=d.date AND x.hour=h.hour"""),
    "scored": ("validations", """SELECT 'day' AS horizon, 'w' || CAST(weekofyear(date) AS VARCHAR) AS fold, route, direction, stop, date, hour, actual,
        (lo % 4)::DOUBLE AS predicted, CASE WHEN stop<>3 THEN (hi % 5)::DOUBLE END AS baseline,
        CASE WHEN route<>'view' THEN greatest((lo%4)::DOUBLE-1,0) END AS lower, CASE WHEN route<>'view' THEN (lo%4)::DOUBLE+1 END AS upper,
        CASE WHEN route<>'view' THEN 0.8::DOUBLE END AS level, CASE WHEN route<>'view' THEN 'quantile' END AS method,
        CASE WHEN route IN ('click','error') THEN 1.0::DOUBLE END AS capacity,
        CASE WHEN route<>'error' THEN 'onboard_load' ELSE 'boarding_count' END AS target,
        CASE WHEN date=DATE '2024-01-13' THEN 'match' END AS event FROM
        (SELECT route, direction, stop_no AS stop, date, hour, count(*)::DOUBLE AS actual, min(event_id) AS lo, max(event_id) AS hi FROM validations GROUP BY ALL)"""),
    "trips": ("", """SELECT o_orderkey AS trip_id, o_custkey//10 AS duty, o_orderpriority AS route,
        DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS service_day,
        o_orderkey*7919 % 50000 + 14400 AS start_sec, CAST(o_orderkey % 2 AS INT) AS direction FROM orders"""),
    "lineitem_steps": ("", """SELECT l_orderkey AS trip_id, row_number() OVER w - 1 AS seq,
        l_suppkey AS stop_id, l_quantity AS qty, l_returnflag AS route FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey)"""),
    "stop_times": ("trips", """SELECT t.trip_id, t.duty, t.route, t.direction, t.service_day, l.seq, l.stop_id,
        CAST(t.start_sec + l.elapsed AS BIGINT) AS clock FROM (SELECT l_orderkey, row_number() OVER w - 1 AS seq,
        l_suppkey AS stop_id, sum(CAST(l_quantity AS BIGINT)*20+60) OVER w AS elapsed FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey)) l
        JOIN trips t ON t.trip_id=l.l_orderkey"""),
    "trip_spans": ("stop_times", """SELECT trip_id, duty, route, direction, service_day,
        min(clock) AS first_clock, max(clock) AS last_clock, count(*) AS stops FROM stop_times GROUP BY ALL"""),
    "stops": ("", """SELECT s_suppkey AS stop_id, s_name AS name, s_nationkey AS nation,
        55.5::DOUBLE + (s_suppkey*37%1000)/2000.0::DOUBLE AS lat,
        37.3::DOUBLE + (s_suppkey*91%1000)/1500.0::DOUBLE AS lon FROM supplier"""),
    "edges": ("lineitem_steps stops", """SELECT p.stop_id AS source, p.target, min(p.qty) AS length_m,
        list_sort(list_distinct(list(p.route))) AS routes
        FROM (SELECT *, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS target FROM lineitem_steps) p
        JOIN stops a ON a.stop_id=p.stop_id JOIN stops b ON b.stop_id=p.target
        WHERE a.nation=b.nation AND p.stop_id<>p.target GROUP BY ALL"""),
    "points": ("", """SELECT l_returnflag AS run_id, 'r' || (l_partkey % 10) AS route_id, l_suppkey AS stop_id,
        l_linenumber % 2 AS direction, CAST(date_trunc('month', l_shipdate) AS DATE) AS bucket,
        CAST(l_shipdate AS DATE) AS date, l_quantity AS predicted, l_quantity*0.8::DOUBLE AS lower,
        l_quantity*1.25::DOUBLE AS upper,
        CASE WHEN l_tax >= 0.01 THEN l_quantity+10 END AS capacity,
        CASE WHEN l_linestatus='O' THEN 'validation_count' ELSE 'occupancy' END AS target FROM lineitem"""),
}


def compose(body: str, uses: str) -> str:
    """Prefix a statement with the derived tables it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in BASES[name][0].split():
                visit(dep)
            ordered.append(name)

    for name in uses.split():
        visit(name)
    body = body.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({BASES[n][1]})" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
