"""Periodic runs of words, by seeds on diagonals that are extended once.

A run is a stretch of consecutive words whose smallest period is q, of max(``LEAST``, ``REPEATS`` * q) words or more, that no
neighbouring word extends.  Words q apart are equal in it, so the diagonal of lag q holds a stretch of at least
max(LEAST, REPEATS * q) - q equal words.  Lags are taken in classes (2**(j-1), 2**j], and the least such overlap of a class is
the length of its k-grams.  Two facts keep the pairs few:

* k is at least every lag of its class, so inside a run equal k-grams stand exactly one period apart (two periods of one
  stretch of that length would have a common, smaller one).  The pairs of *consecutive* occurrences in a document
  therefore seed every run, and there are at most as many as words.
* a k-gram that occurs twice starts with a shorter one that does, so each class indexes only the positions that the class
  before found twice.  Ordinary text is sorted once.

Seeds are extended to both sides along their diagonal; a table of the furthest covered word per lag drops every later
seed of a stretch that is extended already.  All work on a document stays in its task, and its memory is a few numbers a
word; documents share slices of bounded size and no rows are shuffled.

Defined results: a null or empty text has no words and no runs; repeated rows give equal results; a null doc_id stays null;
runs are in order of start, then period; an empty table gives no rows; other columns are ignored.  Words compare through 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import U64, WORD, RangeHash, Words, give_back, mix, slices, small_batches, utf8

LEAST, REPEATS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least lag, greatest lag, length of k-grams) of each class that a document of ``longest`` words can hold."""
    low, high = 1, 1
    while max(LEAST, REPEATS * low) <= longest:
        yield low, high, max(LEAST, REPEATS * low) - low
        low, high = high + 1, 2 * high


def seeds(words: Words, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each class: k, and the positions and lags of its pairs of consecutive equal k-grams, by lag and position."""
    lengths = np.diff(words.first)
    document = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(words.first[1:], lengths)
    ranges, salt = RangeHash(hashes), mix(document.astype(U64) + U64(1))
    at = np.arange(len(hashes))
    for low, high, k in lag_classes(int(lengths.max(initial=0))):
        at = at[at + k <= end[at]]
        if not len(at):
            return
        keys = ranges.of(at, at + k) ^ salt[at]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        first, second = at[order[:-1][same]], at[order[1:][same]]
        lag = second - first
        fits = (lag >= low) & (lag <= high)
        if fits.any():
            first, lag = first[fits], lag[fits]
            by = np.lexsort((first, lag))
            yield k, first[by], lag[by]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]


def reach(hashes: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """The end of the equal stretch on the diagonal ``lag`` that starts at ``at`` and runs towards ``stop`` (exclusive)."""
    size = 16
    while at != stop:
        to = min(at + size, stop) if step > 0 else max(at - size, stop)
        here = slice(at, to) if step > 0 else slice(to + 1, at + 1)
        there = slice(here.start + lag, here.stop + lag)
        wrong = np.flatnonzero(hashes[here] != hashes[there])
        if len(wrong):
            return at + int(wrong[0]) if step > 0 else to + 1 + int(wrong[-1])
        at, size = to, size * 2
    return stop


def find_runs(words: Words) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period."""
    hashes = words.hashes()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.first) - 1)]
    for k, positions, lags in seeds(words, hashes):
        # of neighbouring seeds on a diagonal only the first can open a stretch
        opens = np.ones(len(positions), bool)
        opens[1:] = (lags[1:] != lags[:-1]) | (positions[1:] != positions[:-1] + 1)
        covered: dict[int, int] = {}
        for at, lag in zip(positions[opens].tolist(), lags[opens].tolist(), strict=True):
            if at < covered.get(lag, -1):
                continue
            text = int(np.searchsorted(words.first, at, "right")) - 1
            low, high = int(words.first[text]), int(words.first[text + 1])
            start = reach(hashes, at - 1, lag, low - 1, -1) + 1 if at > low else low
            end = reach(hashes, at + k, lag, high - lag, 1)
            covered[lag] = end
            if end + lag - start >= max(LEAST, REPEATS * lag):
                out[text].append((start - low, end + lag - start, lag))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    words = text.split()
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period) and collapsed, its text with one period of each run."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch)
            words = Words(texts)
            found = find_runs(words)
            flat = np.array([run for runs in found for run in runs], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(runs) for runs in found])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            kept = pa.array([collapse(t, r) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.record_batch([batch.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(offsets, items), kept],
                                  names=["doc_id", "n_words", "runs", "collapsed"])
        give_back()
    small_batches(documents.sparkSession)
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce(documents["text"], F.lit("")).alias("text")).mapInArrow(
        rows, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def looped(documents: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, chosen by the crc32 of their id, repeat a stretch of their words to the end.

    With h the crc32 of the decimal id, g = h div 10 and n words: where h mod 10 = 0, each word from a = g mod n on is word
    a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8).  A null id changes nothing.
    """
    number = F.crc32(documents["doc_id"].cast("string").cast("binary"))
    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select(documents["doc_id"].alias("doc_id"), text.alias("text"), F.floor(number / 10).cast("long").alias("g"),
                            F.coalesce(number % 10 == 0, F.lit(False)).alias("chosen"))
    words = F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("words", place), " ")).otherwise(F.col("text")).alias("text"))


def run_digest(documents: DataFrame) -> DataFrame:
    """The runs of the looped documents: their number, the greatest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(looped(documents))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    length: Column = -F.col("best.by")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
