"""Structured Streaming jobs: resumable ingest, deduplication, counts, sessions, ledgers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

c = F.col


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the cluster's shared checkpoints; a local one only in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base or tempfile.mkdtemp(prefix='ridewave-')}/{name}-{uuid.uuid4().hex}"


def write_updates(df: DataFrame, out: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Changed rows of every micro-batch, each batch in its own partition.

    A replayed batch overwrites its own partition, so a restart never counts twice.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


def read_latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Last state of each key over the written batches."""
    rows = spark.read.option("basePath", out).parquet(out)
    values = [x for x in rows.columns if x not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")


class FirstPayload(StatefulProcessor):
    """The first payload of each id, in keyed state: one small value an id, read and written only when the id appears.

    A batch of the ingest brings at most one row an id (its head); several batches may arrive together, in any order.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "payload_hash string, batch_id bigint", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heads = pd.concat(list(rows)).sort_values("batch_id", ignore_index=True)
        known = self.first.get() if self.first.exists() else None
        if known is None:
            known = (heads["payload_hash"].iloc[0], int(heads["batch_id"].iloc[0]))
            self.first.update(known)
        yield pd.DataFrame({"id": key[0], "batch_id": heads["batch_id"], "first_hash": known[0], "first_batch": int(known[1])})

    def close(self) -> None:
        pass


def _with_state_store(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query whose state lives in RocksDB and whose changes go to the checkpoint folder; the session keeps its own setting."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stream_ingest(lines: DataFrame, check: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str, keep: str | None = None) -> None:
    """Runs the ingest over all lines that are there and returns when they are done; call it again for more, or after a failure.

    ``check`` returns rows with ``problem``, the key, ``row_index`` and ``payload_hash``.  Two queries run in turn: the first checks each batch and
    writes its rows and its heads, one row an id, so an id that holds a third of all rows is combined before it moves; the second
    brings the heads to keyed state, a running least (batch, payload) an id.  Both write a batch into a partition of its own that a
    replay overwrites, so an interrupted ingest ends like an uninterrupted one.  ``keep`` (a time span) lets ids expire after it;
    such state is that of :class:`FirstPayload`, which asks for each id on its own.
    """
    spark = lines.sparkSession

    def stage(batch: DataFrame, number: int) -> None:
        # a row without an id can't be deduplicated: it is quarantined, not lost
        rows = check(batch).withColumn("usable", c("problem").isNull() & c(key).isNotNull())
        path = f"{out}/rows/batch_id={number}"
        rows.write.mode("overwrite").parquet(path)
        heads = spark.read.parquet(path).where("usable").groupBy(c(key).cast("string").alias("id")).agg(F.min(F.struct("row_index", "payload_hash")).alias("head"))
        heads.select("id", "head.payload_hash", F.lit(number).cast("bigint").alias("batch_id")).write.mode("overwrite").parquet(f"{out}/heads/{number}")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/known/state_batch={number}")

    def save_first(batch: DataFrame, number: int) -> None:
        path = f"{out}/first/state_batch={number}"
        batch.write.mode("overwrite").parquet(path)
        first = spark.read.schema(batch.schema).parquet(path)
        before = spark.read.option("basePath", f"{out}/known").parquet(f"{out}/known").where(c("state_batch") < number).agg(
            F.max("batch_id")).first()[0] if number else None
        low, high = -1 if before is None else before, first.agg(F.max("last_batch")).first()[0]
        came = [f"{out}/heads/{n}" for n in range(low + 1, (low if high is None else high) + 1)]  # each batch of rows has its folder
        heads = spark.read.schema(head).parquet(*came) if came else spark.createDataFrame([], head)
        save(heads.select("id", "batch_id").join(first, "id").select(
            "id", "batch_id", c("first.payload_hash").alias("first_hash"), c("first.batch_id").alias("first_batch")), number)

    head = "id string, payload_hash string, batch_id bigint"
    lines.writeStream.option("checkpointLocation", f"{checkpoint}/rows").trigger(availableNow=True).foreachBatch(stage).start().awaitTermination()
    heads = spark.readStream.schema(head).parquet(f"{out}/heads/*").groupBy("id")
    if keep is None:
        known, mode, put = heads.agg(F.min(F.struct("batch_id", "payload_hash")).alias("first"), F.max("batch_id").alias("last_batch")), "update", save_first
    else:
        known, mode, put = heads.transformWithStateInPandas(
            FirstPayload(int(pd.Timedelta(keep).total_seconds() * 1000)), "id string, batch_id bigint, first_hash string, first_batch bigint",
            "append", "processingTime"), "append", save
    _with_state_store(spark, lambda: known.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/ids").trigger(
        availableNow=True).foreachBatch(put).start()).awaitTermination()


def ingest_rows(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Every row of an ingest with its verdict: new, duplicate, conflict or rejected.

    Rows meet the state of their id in an equi join by batch, which Spark may split for a hot id.
    """
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").withColumn("batch_id", c("batch_id").cast("bigint"))
    usable = rows.where("usable").withColumn("_id", c(key).cast("string"))
    known = spark.read.parquet(f"{out}/known").select(c("id").alias("_id"), "batch_id", c("first_hash").alias("_hash"), c("first_batch").alias("_batch"))
    order = F.struct("row_index", "payload_hash")
    heads = usable.groupBy("_id", "batch_id").agg(F.min(order).alias("_head"))
    judged = usable.join(heads.join(known, ["_id", "batch_id"]), ["_id", "batch_id"]).withColumn("verdict", F.when(
        (c("_batch") == c("batch_id")) & (order == c("_head")), "new").when(c("payload_hash") == c("_hash"), "duplicate").otherwise("conflict"))
    return judged.drop("_id", "_head", "_hash", "_batch").unionByName(rows.where("NOT usable").withColumn("verdict", F.lit("rejected")))


def ingest_ledger(spark: SparkSession, out: str, key: str, by: Sequence[str]) -> DataFrame:
    """Running ledger of an ingest: input, valid, duplicate, quarantined."""
    return ingest_rows(spark, out, key).groupBy(*by).agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(c("verdict") == "new").alias("valid"),
        F.count_if(c("verdict") == "duplicate").alias("duplicates"),
        F.count_if(c("verdict").isin("conflict", "rejected")).alias("quarantined"))


def stream_dedup(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First row per id inside the watermark horizon; the state of old ids is dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class HorizonVerdicts(StatefulProcessor):
    """The payload that opened an id's horizon, until event time has passed its end.

    All rows of a batch are judged in order of (time, hash), however they arrive: the first row, or the first one later than the
    horizon, opens it; rows inside compare with its payload.  A timer drops the state once no row on time can fall inside.
    """

    def __init__(self, horizon_us: int):
        self.horizon = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at bigint, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_us", "hash"], ignore_index=True)
        at, hashes = batch["at_us"].to_numpy(np.int64), batch["hash"].to_numpy()
        verdict = np.empty(len(batch), object)
        start, now = 0, tuple(self.opened.get()) if self.opened.exists() else None
        while start < len(at):
            if now is None or at[start] > now[0] + self.horizon:
                now = (int(at[start]), hashes[start])
                verdict[start] = "new"
                start += 1
            end = int(np.searchsorted(at, now[0] + self.horizon, "right"))
            verdict[start:end] = np.where(hashes[start:end] == now[1], "duplicate", "conflict")
            start = max(start, end)
        self.opened.update(now)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((now[0] + self.horizon) // 1000 + 1)
        yield pd.DataFrame({"id": key[0], "at_us": at, "verdict": verdict})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.opened.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_conflicts(df: DataFrame, key: str, ts: str, payload: Column, delay: str, horizon: str | None = None) -> DataFrame:
    """id, at, verdict per row: new, duplicate or conflict, against the payload that opened the ``horizon`` (``delay`` by default).

    Rows later than the watermark allows are left out.  The state store must be RocksDB: see :func:`write_conflicts`.
    """
    rows = df.select(c(key).cast("string").alias("id"), c(ts).cast("timestamp").alias("at"), F.sha2(payload, 256).alias("hash")).withWatermark(
        "at", delay).withColumn("at_us", F.unix_micros("at"))
    span = int(pd.Timedelta(horizon or delay).total_seconds() * 1_000_000)
    judged = rows.groupBy("id").transformWithStateInPandas(HorizonVerdicts(span), "id string, at_us bigint, verdict string", "append", "eventTime")
    return judged.select("id", F.timestamp_micros("at_us").alias("at"), "verdict")


def write_conflicts(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return _with_state_store(df.sparkSession, lambda: write_updates(df, out, checkpoint, "append"))


def stream_hourly(df: DataFrame, entity: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Tumbling hour counts; data later than the delay is not counted."""
    counted = df.withWatermark(ts, delay).groupBy(*entity, F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("boardings"))
    return counted.select(*entity, c("w.start").alias("hour_start"), "boardings")


def stream_sessions(df: DataFrame, device: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions of each device that are closed: a silence longer than the gap follows, and no row on time can bridge it.

    For append mode: state holds open sessions only, merges those that a late row joins, and emits each once.  The window ends a
    microsecond after the gap, since a silence of exactly the gap does not split.
    """
    counted = df.withWatermark(ts, delay).groupBy(device, F.session_window(ts, f"{gap} 1 microsecond").alias("w")).agg(
        F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))
    return counted.select(device, c("w.start").alias("first"), "last", "events")


def closing_row(rows: DataFrame, ts: str, after: str) -> DataFrame:
    """One row, ``after`` behind the last time, with all else null: delivered last, it lets the watermark close what is open."""
    last = rows.agg((F.max(c(ts).cast("timestamp")) + F.expr(f"INTERVAL {after}")).alias(ts))
    return last.select(*[(c(ts) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def stream_late(df: DataFrame, cutoff) -> DataFrame:
    """Every row with its visibility at the cutoff: late rows are kept, not dropped."""
    seen = (c("event_at") < cutoff) & (c("available_at") <= cutoff)
    late = (c("event_at") < cutoff) & (c("available_at") > cutoff)
    return df.withColumn("status", F.when(seen, "visible").when(late, "late").otherwise("future"))


def stream_ledger(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running counts per stream and status, in update mode."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def stream_map_days(events: DataFrame, assign: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Day micro-batches through an assignment job, with a receipt per day and batch."""
    def process(batch: DataFrame, number: int) -> None:
        mapped = assign(batch).persist()
        mapped.write.mode("overwrite").partitionBy("date").parquet(f"{out}/mapped/batch_id={number}")
        mapped.groupBy("date", "status").agg(F.count(F.lit(1)).alias("events")).write.mode("overwrite").parquet(
            f"{out}/receipts/batch_id={number}")
        mapped.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(process).start()


def receipts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/receipts").groupBy("date", "status").agg(F.sum("events").alias("events"))
