"""Contract checks, quarantine, exact deduplication and the ingestion ledger."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.functions.clock import normalize_timestamp, wall

# The event contract.
IDENTIFIER_PATTERN = r"^[A-Za-z0-9_.:/-]+$"
IDENTIFIER_LENGTH = 128
TRUE_WORDS = ("true", "1")
FALSE_WORDS = ("false", "0")
MISSING_IDS = ("", "0", "-1", "null", "NULL", "None", "nan")


@dataclass(frozen=True)
class Field:
    """One typed field of an event contract."""

    name: str
    kind: str
    allowed: tuple[str, ...] = ()
    limit: float = 0.0
    zone: str | None = None
    fmt: str | None = None


@dataclass(frozen=True)
class Adapter:
    """Canonical field -> source column, constants for fields the source lacks."""

    name: str
    columns: Mapping[str, str]
    constants: Mapping[str, object]


ADAPTERS: dict[str, Adapter] = {}


def register_adapter(adapter: Adapter) -> Adapter:
    ADAPTERS[adapter.name] = adapter
    return adapter


def adapt(df: DataFrame, adapter: Adapter, fields: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """Canonical columns from source columns; ``missing`` names the first field without one."""
    picked, missing = [], []
    for name in fields:
        source = adapter.columns.get(name, name)
        if source in df.columns:
            picked.append(F.col(source).alias(name))
        elif name in adapter.constants:
            picked.append(F.lit(adapter.constants[name]).alias(name))
        else:
            picked.append(F.lit(None).cast("string").alias(name))
            missing.append(name)
    first = F.lit(missing[0]) if missing else F.lit(None).cast("string")
    return df.select(*keep, *picked, first.alias("missing"))


def _problem(bad: Column, reason: str, detail: str) -> Column:
    return F.when(bad, F.struct(F.lit(reason).alias("reason"), F.lit(detail).alias("detail")))


def _typed(field: Field) -> Column:
    raw = F.col(field.name)
    if field.kind == "sequence":
        return F.when(raw.rlike(r"^\d+$"), raw).try_cast("int")
    if field.kind == "boolean":
        word = F.lower(raw)
        return F.when(word.isin(list(TRUE_WORDS)), True).when(word.isin(list(FALSE_WORDS)), False)
    if field.kind == "timestamp":
        return normalize_timestamp(raw, fmt=field.fmt, assume_zone=field.zone)
    if field.kind == "coordinate":
        return raw.try_cast("double")
    if field.kind in ("identifier", "literal"):
        return raw
    raise ValueError(f"unknown field kind {field.kind!r}")


def _faults(field: Field, raw: Column, value: Column) -> list[tuple[Column, str, str]]:
    """Ordered (condition, reason, detail) of one field."""
    name = field.name
    found = [(raw.isNull(), "missing_field", name)]
    if field.kind == "identifier":
        bad = (F.length(raw) > IDENTIFIER_LENGTH) | ~raw.rlike(IDENTIFIER_PATTERN)
        return [*found, (bad, "invalid_value", f"{name} is not a valid identifier")]
    if field.kind == "literal":
        return [*found, (~raw.isin(list(field.allowed)), "invalid_value",
                         f"{name} must be one of the allowed values")]
    if field.kind == "timestamp":
        return [*found, (value.isNull(), "invalid_timestamp", name)]
    noun = {"sequence": "an integer", "boolean": "a boolean", "coordinate": "a number"}[field.kind]
    found.append((value.isNull(), "invalid_type", f"{name} must be {noun}"))
    if field.kind == "coordinate":
        outside = F.isnan(value) | (F.abs(value) > field.limit)
        found.append((outside, "invalid_value", f"{name} must be finite within the limit"))
    return found


def check_fields(df: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """Typed fields plus ``problem``: the first failing check in field order, or NULL."""
    typed = df.select(*keep, *[F.col(f.name).alias("raw_" + f.name) for f in fields],
                      *[_typed(f).alias(f.name) for f in fields])
    faults = [fault for f in fields for fault in _faults(f, F.col("raw_" + f.name), F.col(f.name))]
    ladder = F
    for number, (bad, _, _) in enumerate(faults):
        ladder = ladder.when(bad, number)
    reasons = F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(d).alias("detail")) for _, r, d in faults])
    # a generator keeps later filters on the problem above the checks: below them every text and clock would be computed again for each check
    numbered = typed.select("*", F.explode(F.array(ladder)).alias("_fault"))
    return numbered.select(*keep, *[f.name for f in fields],
                           F.when(F.col("_fault").isNotNull(), F.get(reasons, F.col("_fault"))).alias("problem"))


def check_relations(df: DataFrame, synthetic_target: str) -> DataFrame:
    """Checks across fields: availability after the event, target agrees with provenance."""
    early = _problem(F.col("available_at") < F.col("event_at"), "availability_before_event",
                     "available_at precedes event_at")
    clash = _problem(F.col("synthetic") != (F.col("target") == synthetic_target), "invalid_value",
                     "target must match synthetic provenance")
    return df.withColumn("problem", F.coalesce("problem", early, clash))


def check_location(df: DataFrame, patterns: DataFrame, version: str) -> DataFrame:
    """Catalogue membership; ``patterns`` has one row per route and direction with ``stop_ids``."""
    known = patterns.select("route_id", "direction_id", "stop_ids")
    joined = df.join(known, ["route_id", "direction_id"], "left")
    stops = F.col("stop_ids")
    detail = (
        F.when(F.col("entity_version") != version, "entity_version does not match catalog")
        .when(stops.isNull(), "unknown route/direction")
        .when(~F.array_contains(stops, F.col("stop_id")), "unknown stop for route/direction")
        .when(~F.coalesce(F.get(stops, F.col("stop_sequence")) == F.col("stop_id"), F.lit(False)),
              "stop_sequence does not identify this stop visit"))
    place = F.when(detail.isNotNull(), F.struct(F.lit("unknown_entity").alias("reason"), detail.alias("detail")))
    return joined.withColumn("problem", F.coalesce("problem", place)).drop("stop_ids")


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows; each rejected row carries one reason."""
    valid = df.where("problem IS NULL").drop("problem")
    rejected = df.where("problem IS NOT NULL").select("*", "problem.*").drop("problem")
    return valid, rejected


def content_hash(columns: Iterable[str]) -> Column:
    """Digest of a record in canonical key order; NULL fields are written out as null."""
    ordered = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def dedup_exact(df: DataFrame, key: Sequence[str], order: Sequence[str], payload: Sequence[str],
                eligible: Column | None = None) -> DataFrame:
    """``verdict`` per row: ``new`` for the first row of a key, ``duplicate`` for an equal
    payload, ``conflict`` for another one; NULL for rows that are not ``eligible``.

    The first row is an aggregate joined back, not a window: a key with very many copies is
    combined before the shuffle and its rows stay spread over the join.
    """
    takes_part = F.lit(True) if eligible is None else eligible
    hashed = df.withColumn("payload_hash", F.when(takes_part, content_hash(payload)))
    position = F.struct(*[F.col(o) for o in order])
    heads = hashed.where(takes_part).groupBy(*key).agg(
        F.min(F.struct(position.alias("position"), F.col("payload_hash").alias("hash"))).alias("_head"))
    joined = hashed.join(heads, list(key), "left")
    verdict = F.when(takes_part, F.when(position == F.col("_head.position"), "new")
                     .when(F.col("payload_hash") == F.col("_head.hash"), "duplicate").otherwise("conflict"))
    return joined.withColumn("verdict", verdict).drop("_head")


def ingest_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ledger: input = valid + duplicates + quarantined; ``reconciled`` states that it holds."""
    rejected = F.col("problem").isNotNull()
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(~rejected & (F.col("verdict") == "new")).alias("valid"),
        F.count_if(~rejected & (F.col("verdict") == "duplicate")).alias("duplicates"),
        F.count_if(rejected | (F.col("verdict") == "conflict")).alias("quarantined"))
    total = F.col("valid") + F.col("duplicates") + F.col("quarantined")
    return counted.withColumn("reconciled", F.col("input_rows") == total)


def quarantine_reasons(df: DataFrame, by: Sequence[str]) -> DataFrame:
    reason = F.coalesce(F.col("problem.reason"), F.when(F.col("verdict") == "conflict", "conflicting_duplicate"))
    return df.select(*by, reason.alias("reason")).where("reason IS NOT NULL").groupBy(*by, "reason").agg(
        F.count(F.lit(1)).alias("rows"))


def visible_at(df: DataFrame, cutoff) -> DataFrame:
    """Rows a forecast made at ``cutoff`` may use: happened before it, published by it."""
    cut = wall(cutoff)
    return df.where((F.col("event_at") < cut) & (F.col("available_at") <= cut))


def in_window(df: DataFrame, column: str, start, end) -> DataFrame:
    if start >= end:
        raise ValueError("window must have start before end")
    return df.where((F.col(column) >= wall(start)) & (F.col(column) < wall(end)))


def opaque(column: Column, field: str, salt: str) -> Column:
    """Salted pseudonym of an identifier; sentinel identifiers become empty."""
    text = column.cast("string")
    key = F.substring(F.sha2(F.concat(F.lit(f"{salt}:{field}:"), text), 256), 1, 24)
    return F.when(text.isNull() | text.isin(list(MISSING_IDS)), "").otherwise(key)


def event_keys(df: DataFrame, source: str, member: Column, ordinal: Column) -> DataFrame:
    """Stable keys from source, member and row ordinal: no shuffle, no ranking."""
    prefix = F.substring(F.sha2(F.concat(F.lit(source + ":"), member), 256), 1, 24)
    return df.withColumn("event_key", F.concat(prefix, F.lit(":"), ordinal.cast("string")))


def validate_catalog(routes: DataFrame, stops: DataFrame, patterns: DataFrame) -> DataFrame:
    """Integrity problems of a catalogue: repeated ids, repeated patterns, dangling references."""
    def repeats(df: DataFrame, keys: Sequence[str], problem: str) -> DataFrame:
        text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            F.lit(problem).alias("problem"), text.alias("entity"))

    visits = patterns.select("route_id", F.explode("stop_ids").alias("stop_id"))
    dangling_routes = patterns.select("route_id").distinct().join(routes, "route_id", "left_anti").select(
        F.lit("unknown_route").alias("problem"), F.col("route_id").cast("string").alias("entity"))
    dangling_stops = visits.select("stop_id").distinct().join(stops, "stop_id", "left_anti").select(
        F.lit("unknown_stop").alias("problem"), F.col("stop_id").cast("string").alias("entity"))
    return (repeats(routes, ["route_id"], "duplicate_route")
            .unionByName(repeats(stops, ["stop_id"], "duplicate_stop"))
            .unionByName(repeats(patterns, ["route_id", "direction_id"], "duplicate_pattern"))
            .unionByName(dangling_routes).unionByName(dangling_stops))
