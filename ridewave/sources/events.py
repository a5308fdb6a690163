"""Event and label sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridewave.operators.joins import require
from ridewave.session import reliable_checkpoint

LABEL_SCHEMA = T.StructType([
    T.StructField("route", T.IntegerType()), T.StructField("date", T.DateType()),
    T.StructField("hour", T.IntegerType()), T.StructField("boardings", T.LongType())])


def read_labels(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Hourly labels from ``;`` separated members; a header that differs stops the read."""
    return (spark.read.schema(LABEL_SCHEMA).option("header", True).option("sep", ";")
            .option("enforceSchema", False).option("mode", "FAILFAST").csv(list(paths)))


def read_validations(df: DataFrame, start: date, end: date, route_pattern: str,
                     strict: bool = True) -> DataFrame:
    """Raw fare validations, typed.

    ``valid`` needs the exact timestamp shape and the route pattern (its first group is the
    route).  A successful row that is not valid would lose passengers, so it stops the run.
    """
    text = F.col("tran_date_time")
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    event_at = F.when(shaped, text).try_cast("timestamp_ntz")
    route = F.regexp_extract("ngpt_route", route_pattern, 1)
    success = F.col("validation_result") == "1"
    typed = df.select(
        "*", event_at.alias("event_at"), F.when(route != "", route).alias("route"),
        F.coalesce(success, F.lit(False)).alias("success"))
    valid = F.col("event_at").isNotNull() & F.col("route").isNotNull()
    day = F.to_date("event_at")
    inside = valid & (day >= F.lit(start)) & (day < F.lit(end))
    flagged = typed.withColumn("valid", valid).withColumn("in_range", F.coalesce(inside, F.lit(False)))
    if strict:
        return require(flagged, F.col("success") & ~F.col("valid"),
                       "invalid successful timestamp or route")
    return flagged


def parse_jsonl(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Event fields of JSON lines; ``problem`` explains a line that is not a JSON object."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    raw = F.col(column)
    parsed = F.from_json(raw, whole, {"columnNameOfCorruptRecord": "_corrupt"})
    trimmed = F.trim(raw)
    broken = F.col("_doc._corrupt").isNotNull()
    problem = (F.when(trimmed.startswith("{") & broken, "invalid JSON")
               .when(~trimmed.startswith("{") & F.get_json_object(raw, "$").isNull(), "invalid JSON")
               .when(~trimmed.startswith("{"), "JSON value is not an object"))
    keep = [c for c in lines.columns if c != column]
    packed = F.when(problem.isNotNull(), F.struct(F.lit("decode_error").alias("reason"), problem.alias("detail")))
    return lines.withColumn("_doc", parsed).select(
        *keep, raw.alias("raw"), *[F.col("_doc")[f.name].alias(f.name) for f in schema.fields],
        packed.alias("problem"))


def read_events_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines from files; ``raw`` is readable text even where the bytes are not UTF-8."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = parse_jsonl(lines, schema)
    damaged = F.struct(F.lit("decode_error").alias("reason"), F.lit("invalid UTF-8").alias("detail"))
    return parsed.withColumn("problem", F.when(~F.is_valid_utf8("raw"), damaged).otherwise(
        F.col("problem"))).withColumn("raw", F.make_valid_utf8("raw"))


def parse_csv_lines(lines: DataFrame, header: Sequence[str], column: str = "value", sep: str = ",") -> DataFrame:
    """Event fields of CSV lines; a wrong field count becomes a reason, not a failure."""
    names = [h.lstrip("﻿") for h in header]
    if "" in names or len(set(names)) != len(names):
        raise ValueError("CSV header needs unique non-empty names")
    spare = [*names, *[f"_extra{i}" for i in range(8)]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in spare])
    row = F.from_csv(F.col(column), schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "mode": "PERMISSIVE"})
    quoted = F.regexp_replace(F.col(column), r'"(?:[^"]|"")*"', "q")
    fields = F.size(F.split(quoted, sep.replace("|", r"\|")))
    bad = F.when(fields != len(names), F.struct(
        F.lit("decode_error").alias("reason"),
        F.concat(F.lit(f"expected {len(names)} columns, got "), fields.cast("string")).alias("detail")))
    keep = [c for c in lines.columns if c != column]
    return lines.withColumn("_row", row).select(
        *keep, F.col(column).alias("raw"), *[F.col("_row")[n].alias(n) for n in names], bad.alias("problem"))


def read_events_csv(spark: SparkSession, path: str, header: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV lines from files; the header line (with or without a byte order mark) is dropped."""
    first = sep.join(header)
    lines = spark.read.text(path).where(F.regexp_replace("value", "^﻿", "") != first)
    return parse_csv_lines(lines, header, sep=sep)


def write_ingest(valid: DataFrame, quarantine: DataFrame, out: str) -> DataFrame:
    """Valid rows per stream, and quarantine rows with reason, detail and raw text, as JSON lines; then a manifest of what stands there.

    The manifest (kind, stream, files, rows) is counted from the written files and compared with the rows handed in; any
    difference stops the run before the manifest is written, so a folder with a manifest is whole.
    """
    spark = valid.sparkSession
    valid.write.mode("overwrite").partitionBy("stream").json(f"{out}/valid")
    quarantine.select("stream", "row_index", "reason", "detail", "raw").write.mode("overwrite").partitionBy("stream").json(f"{out}/quarantine")
    parts = []
    for kind, given in (("valid", valid), ("quarantine", quarantine)):
        # a folder without any row has no partition to find the stream in
        lines = spark.read.schema(T.StructType([*[f for f in given.schema.fields if f.name != "stream"], T.StructField("stream", given.schema["stream"].dataType)])).json(f"{out}/{kind}")
        stored = lines.select("stream", F.col("_metadata.file_name").alias("file")).groupBy("stream").agg(
            F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("rows"))
        handed = given.groupBy("stream").agg(F.count(F.lit(1)).alias("handed"))
        both = stored.withColumnRenamed("stream", "_s").join(handed, F.col("_s").eqNullSafe(F.col("stream")), "full")
        both = require(both, ~F.col("rows").eqNullSafe(F.col("handed")), "written rows differ from the rows handed in")
        parts.append(both.select(F.lit(kind).alias("kind"), "stream", "files", "rows"))
    parts[0].unionByName(parts[1]).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def read_quarantine(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("row_index bigint, reason string, detail string, raw string, stream string").json(f"{out}/quarantine")


def write_day_shards(df: DataFrame, out: str, expected: DataFrame | None = None, spread: int = 16) -> DataFrame:
    """Event store partitioned by date, with a manifest; the source-hour mass is compared after the write.

    Rows are dealt by date and a hash of the event key, so one busy day is written by ``spread`` tasks.  Route-hours whose stored
    mass differs from ``expected`` (the rows themselves by default) stop the run.  Returns the manifest: date, files, events, successful and
    an order-free digest of the day's event keys.
    """
    parts = F.pmod(F.xxhash64("event_key"), F.lit(spread))
    df.withColumn("_spread", parts).repartition("date", "_spread").drop("_spread").write.mode("overwrite").partitionBy("date").parquet(f"{out}/days")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{out}/days")
    mass = lambda rows, name: rows.groupBy("route", "date", "hour").agg(F.sum(F.col("success").cast("bigint")).alias(name))
    wanted = (mass(df, "source") if expected is None else expected).withColumnsRenamed({x: "_" + x for x in ("route", "date", "hour")})
    same = F.col("route").eqNullSafe(F.col("_route")) & F.col("date").eqNullSafe(F.col("_date")) & F.col("hour").eqNullSafe(F.col("_hour"))
    wrong = mass(stored, "stored").join(wanted, same, "full").agg(
        F.count_if(F.coalesce("stored", F.lit(0)) != F.coalesce("source", F.lit(0))).alias("wrong"))
    days = stored.groupBy("date").agg(F.count_distinct("_metadata.file_name").alias("files"), F.count(F.lit(1)).alias("events"), F.count_if("success").alias("successful"),
                                      F.sum(F.xxhash64("event_key").cast("decimal(38,0)")).cast("string").alias("key_digest"))
    checked = days.crossJoin(require(wrong, F.col("wrong") > 0, "source-hour conservation failed"))  # one row
    checked.drop("wrong").write.mode("overwrite").parquet(f"{out}/manifest")
    return df.sparkSession.read.parquet(f"{out}/manifest")


def read_day(spark: SparkSession, out: str, day: date, routes: Sequence[str] = ()) -> DataFrame:
    """One day of the event store: one partition directory, route filter pushed to the scan."""
    rows = spark.read.parquet(f"{out}/days").where(F.col("date") == F.lit(day))
    return rows.where(F.col("route").isin(list(routes))) if routes else rows


def read_days(spark: SparkSession, out: str, days: DataFrame) -> DataFrame:
    """The days that ``days`` (date) names, found while the query runs: Spark prunes the other partitions dynamically."""
    return spark.read.parquet(f"{out}/days").join(days.select("date").distinct(), "date")


def file_inventory(spark: SparkSession, path: str, glob: str = "*", fanout: int = 1024) -> DataFrame:
    """Bytes, lines and a tree digest (SHA-256) of each file of any size.

    Files are read in byte ranges, each by a task of its own.  The leaves of a file's tree are the digests of its lines (anything between
    line feeds, so binary files have lines too) in order; a node digests ``fanout`` digests below it, whatever ranges
    they were read in; the file's digest is that of its root and length.  So no task holds more than a line or a node.  Spark
    lists no empty files, so they have no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("bytes"))
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    leaves = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                          F.monotonically_increasing_id().alias("place"), F.sha2(F.col("value").cast("binary"), 256).alias("digest"))
    leaves = reliable_checkpoint(leaves)  # the places are those of one reading
    ranges = leaves.groupBy("path", "at").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counted = ranges.groupBy("path").agg(F.sum("n").alias("lines"))
    most = counted.agg(F.max("lines")).first()[0] or 1
    nodes = leaves.join(ranges.join(counted, "path"), ["path", "at"]).select(
        "path", (F.col("place") + F.col("base") - F.col("first")).alias("number"), F.col("lines").alias("left"), "digest")
    first = True
    while first or most > 1:
        below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"]), "")
        node = F.sha2(below, 256) if first else F.when(F.max("left") > 1, F.sha2(below, 256)).otherwise(below)  # a root stays
        nodes = nodes.groupBy("path", F.floor(F.col("number") / fanout).alias("up")).agg(
            node.alias("digest"), F.max(F.ceil(F.col("left") / fanout)).alias("left")).withColumnRenamed("up", "number")
        most, first = -(-most // fanout), False
    whole = files.join(counted.join(nodes.select("path", "digest"), "path").withColumnRenamed("path", "_path"),
                       F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("_path", "^file:/+", "/"), "left")
    root = F.concat(F.coalesce("digest", F.lit("")), F.lit(":"), F.col("bytes").cast("string"))
    return whole.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"), F.sha2(root, 256).alias("tree_sha256"))


def row_inventory(df: DataFrame) -> DataFrame:
    """Rows and an order-free content digest per file of any readable table."""
    columns = [F.col(c) for c in df.columns]
    return df.select(F.col("_metadata.file_name").alias("file"), F.xxhash64(*columns).alias("h")).groupBy(
        "file").agg(F.count(F.lit(1)).alias("rows"),
                    F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("row_digest"))


def submission_rows(df: DataFrame, grid: DataFrame, keys: Sequence[str] = ("route", "date", "hour")) -> DataFrame:
    """Rounded nonnegative integers on exactly the given grid, each key once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("prediction").alias("prediction"))
    both = grid.select(*keys).withColumn("_grid", F.lit(True)).join(counted, list(keys), "full")
    both = require(both, F.col("_n").isNull() | F.col("_grid").isNull() | (F.col("_n") > 1),
                   "submission must hold every grid key once")
    return both.select(*keys, F.rint(F.greatest(F.col("prediction"), F.lit(0.0))).cast("bigint").alias("prediction"))


def write_submission(df: DataFrame, grid: DataFrame, out: str) -> None:
    submission_rows(df, grid).orderBy("route", "date", "hour").write.mode("overwrite").option(
        "header", True).option("sep", ";").csv(out)


def scored_problem(limit: int, keys: Sequence[str] = ("route", "date", "hour")) -> Column:
    """First shape problem of a scored text row."""
    number = r"^[0-9]+$"
    return (F.when(~F.coalesce(F.col("route").rlike(number), F.lit(False)), "route")
            .when(~F.coalesce(F.col("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))
                  | F.col("date").try_cast("date").isNull(), "date")
            .when(~F.coalesce(F.col("hour").rlike(number), F.lit(False))
                  | (F.col("hour").try_cast("int") > 23), "hour")
            .when(~F.coalesce(F.col("prediction").rlike(number), F.lit(False)), "prediction")
            .when(F.coalesce(F.col("prediction").try_cast("bigint"), F.lit(limit)) >= limit, "limit"))


def read_scored(df: DataFrame, limit: int, expected_keys: int | None = None) -> DataFrame:
    """Typed scored rows; any bad text, repeated key or wrong key count stops the run."""
    checked = require(df.withColumn("_p", scored_problem(limit)), F.col("_p").isNotNull(), "invalid scored row")
    typed = checked.select(F.col("route").cast("int").alias("route"), F.col("date").cast("date").alias("date"),
                           F.col("hour").cast("int").alias("hour"), F.col("prediction").cast("bigint").alias("prediction"))
    unique = typed.groupBy("route", "date", "hour").agg(
        F.count(F.lit(1)).alias("_n"), F.max("prediction").alias("prediction"))
    unique = require(unique, F.col("_n") > 1, "duplicate forecast key").drop("_n")
    if expected_keys is None:
        return unique
    total = unique.agg(F.count(F.lit(1)).alias("_all"))
    return unique.join(require(total, F.col("_all") != expected_keys, "scored keys missing"), how="cross").drop("_all")
