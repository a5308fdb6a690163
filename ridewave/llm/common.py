"""Helpers of the corpus operators: scratch tables, word arrays and word hashes.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D, the same set that
``bytes.split()`` uses.  Word sequences are compared through 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; a local one only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "ridewave-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition) if partition else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (null: the smallest 64-bit integer), ``text`` (null: empty) and nothing else but ``more``."""
    return df.select(F.coalesce(df["doc_id"].cast("long"), F.lit(-2**63).cast("long")).alias("doc_id"),
                     F.coalesce(df["text"], F.lit("")).alias("text"), *[df[c] for c in more])


def restored_id(column: str = "doc_id") -> Column:
    """Undoes the stand-in of a null id."""
    return F.when(F.col(column) != F.lit(-2**63).cast("long"), F.col(column)).alias("doc_id")


def text_key() -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64("text").alias("text_key")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) > 1 << 20:  # a worker keeps no more than that between tasks
            return have[:n]
        _POWERS[base] = have
    return have[:n]


class RangeHash:
    """Hashes of ranges [a, b) of a sequence of 64-bit values from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(BASE, n), dtype=U64, out=self.sums[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


class Words:
    """The words of a list of UTF-8 texts: byte ranges in ``data``, and word ranges of each text in ``first``."""

    def __init__(self, texts: list[bytes], fold: bytes | None = None):
        joined = b" ".join(texts) + b" "
        if fold:
            joined = joined.translate(fold)
        self.data = np.frombuffer(joined, np.uint8)
        blank = BLANK[self.data]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(lengths)]))

    def hashes(self) -> np.ndarray:
        return RangeHash(BYTE_VALUE[self.data]).of(self.start, self.end)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about ``most`` text bytes (a longer text comes alone), to bound memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            raise ValueError("texts must not be null here")
        size = np.cumsum(np.asarray(pc.binary_length(column), np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def small_batches(spark: SparkSession, most: int = 4 << 20) -> SparkSession:
    """Sets the session's Arrow batches to about ``most`` bytes, unless they are smaller already: batches of whole texts
    are held several times over, in Python and outside the JVM's heap, by every task of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
    if now is None or int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] > most:
        spark.conf.set(key, f"{most}b")
    return spark


def give_back() -> None:
    """Returns freed memory to the system (where the C library can), since idle Python workers keep theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)), np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
