"""SimHash near-dedup by multi-index hashing.

A fingerprint has a bit set where over half of its shingles' XXH64 values have it set.  To find fingerprints at
``distance`` or fewer differing bits, the 64 bits are cut into ``parts`` segments: some segment then differs in
at most distance // parts bits (later segments in one bit less).  Each distinct fingerprint enters a table under
each segment and asks for every value of the Hamming ball around its own segment; of a value and its
counterpart only the one with the lowest changed bit unset asks, so a pair meets once a segment.  Matches are
verified on all 64 bits inside the join, so only links leave it.  Copies meet as one fingerprint.

Defined results: a text without words has fingerprint zero and links like any other; fewer words than a shingle
give one shingle of all of them; repeated rows are copies; a null doc_id counts as the smallest id (component_id
is null where that id is the smallest); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import give_back, input_documents, longs, restored_id, signed, slices, small_batches, text_key, utf8, written
from ridewave.llm.components import components

BITS = 64


def simhash(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fingerprint (the 64 bits as a signed long); documents: doc_id and text without nulls, and text_key."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8_000_000):
            prints = np.array([simhash(t, shingle) for t in utf8(batch)], np.uint64)
            yield pa.record_batch([longs(batch, "doc_id"), longs(batch, "text_key"), signed(prints)], names=["doc_id", "text_key", "fingerprint"])
            give_back()
    small_batches(documents.sparkSession)
    return documents.select("doc_id", "text_key", "text").mapInArrow(rows, "doc_id long, text_key long, fingerprint long")


def _segments(parts: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _radii(parts: int, distance: int) -> list[int]:
    """Ball radius by segment: the usual tightened pigeonhole; -1 leaves a segment out."""
    radius, rest = divmod(distance, parts)
    return [radius if i <= rest else radius - 1 for i in range(parts)]


def _value(at: int, width: int) -> Column:
    return F.shiftrightunsigned("fingerprint", at).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else F.col("fingerprint")


def _ball(part: int, at: int, width: int, radius: int) -> Column:
    """The values asked for in a segment: itself, and those within ``radius`` bits whose lowest changed bit is unset here."""
    masks = [0] + [sum(1 << b for b in bits) for n in range(1, radius + 1) for bits in combinations(range(width), n)]
    signed_bits = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    flips = F.array(*[F.struct(F.lit(signed_bits(m)).cast("long").alias("mask"), F.lit(signed_bits(m & -m)).cast("long").alias("lowest")) for m in masks])
    own = _value(at, width)
    asked = F.filter(flips, lambda f: own.bitwiseAND(f["lowest"]) == 0)
    return F.transform(asked, lambda f: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(f["mask"]).alias("value"), (f["mask"] == 0).alias("same")))


def links(prints: DataFrame, distance: int = 2, parts: int = 2) -> DataFrame:
    """a, b: all pairs of distinct fingerprints (column fingerprint) at ``distance`` or fewer bits."""
    table, asked = [], []
    for i, ((at, width), radius) in enumerate(zip(_segments(parts), _radii(parts, distance), strict=True)):
        if radius >= 0:
            table.append(F.struct(F.lit(i).alias("part"), _value(at, width).alias("value")))
            asked.append(_ball(i, at, width, radius))
    held = prints.select(F.col("fingerprint").alias("b"), F.explode(F.array(*table)).alias("t")).select("b", "t.part", "t.value")
    asks = prints.select(F.col("fingerprint").alias("a"), F.explode(F.concat(*asked)).alias("t")).select("a", "t.part", "t.value", "t.same")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return asks.join(held, (asks["part"] == held["part"]) & (asks["value"] == held["value"]) & near & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")


def labelled(documents: DataFrame, shingle: int, distance: int, parts: int) -> DataFrame:
    """doc_id, text_key, fingerprint, least: the smallest (doc_id, text_key) of the component."""
    texts = input_documents(documents).withColumn("text_key", text_key())
    marked = written(fingerprints(texts, shingle), "fingerprints")
    prints = marked.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    roots = components(links(marked.select("fingerprint").distinct(), distance, parts))
    placed = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return marked.join(placed.join(least, "root").select("fingerprint", "least"), "fingerprint")


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 2, parts: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that links of near fingerprints reach."""
    return labelled(documents, shingle, distance, parts).withColumn("component_id", F.col("least.doc_id")).select(
        restored_id(), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        restored_id("component_id").alias("component_id"))


def keep_first(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are ``least`` (doc_id, text_key) of a label; of repeated rows the least in column order."""
    first = labels.select(F.col("least.*")).distinct().select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    marked = documents.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63).cast("long")),
                                    "_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = marked.join(first, ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.min(F.struct(*documents.columns)).alias("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in documents.columns])


def keep_one(documents: DataFrame, shingle: int = 3, distance: int = 2, parts: int = 2) -> DataFrame:
    """One document of each group of near duplicates stays: its smallest doc_id, and of repeated rows the least in column order."""
    return keep_first(documents, labelled(documents, shingle, distance, parts))
