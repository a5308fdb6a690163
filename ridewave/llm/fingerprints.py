"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each weighted by its count.  For each of ``samples`` draws every word gets gamma
variates r, c ~ Gamma(2, 1) and a uniform shift, all from hashes of the word; the word with the least
ln a = ln c - r (t - shift) - r, where t = floor(ln weight / r + shift), is the sample, and (word, t) is kept as 16 bits.
Two texts agree in a draw with the probability of their generalised Jaccard similarity (sum of minima over sum
of maxima of the weights).

The query also needs each document's successor in doc_id order.  Documents are dealt once, by ranges of doc_id,
and the first document of each range is dealt to the range before it as well, so a sorted stream through a range
always meets the successor.

Defined results: a null or empty text has no words, and the fingerprint of zeros; equal texts have equal
fingerprints; repeated rows follow each other (doc_id, then a hash of the text); a null doc_id is the smallest; the only
document of a table is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import U64, Words, input_documents, mix, restored_id, shuffle_partitions, small_batches, text_key
from ridewave.llm.ordering import order_ranges

SAMPLES = 64


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits & U64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24)


def _gamma(bits: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) from two 24-bit uniforms."""
    return -np.log(_uniform(bits) * _uniform(bits >> U64(32)) + np.float32(1e-30))


def term_samples(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each term, weight and draw: order-preserving bits of ln a above 32 bits that name (term, t)."""
    distinct, back = np.unique(terms, return_inverse=True)
    draw = mix(np.arange(1, samples + 1, dtype=U64) * U64(0xA24BAED4963EE407))
    seed = mix(distinct)[:, None] ^ draw[None, :]
    r, log_c, shift = _gamma(mix(seed)), np.log(_gamma(mix(seed ^ U64(0x5851F42D4C957F2D)))), _uniform(mix(seed ^ U64(0x14057B7EF767814F)))
    r, shift = r[back], shift[back]
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + shift)
    log_a = (log_c[back] - r * (t - shift) - r).astype(np.float32)
    bits = log_a.view(np.uint32)
    ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U64)
    name = mix(seed[back] ^ mix(t.astype(np.int64).view(U64) + U64(77)))
    return ordered << U64(32) | name >> U64(32)


def signatures(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 16-bit values for each text."""
    out = np.zeros((len(texts), samples), np.uint16)
    words = Words(texts)
    hashes = words.hashes()
    if not len(hashes):
        return out
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(text)))
    text, hashes = text[heads], hashes[heads]
    by = np.lexsort((counts, hashes))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by[1:]] != hashes[by[:-1]]) | (counts[by[1:]] != counts[by[:-1]])
    pair = np.empty(len(by), np.int64)
    pair[by] = np.cumsum(new) - 1
    chosen = by[new]
    first = np.searchsorted(text, np.arange(len(texts)))
    filled = np.flatnonzero(np.diff(np.append(first, len(text))))
    best = np.full((len(texts), samples), np.iinfo(np.uint64).max, U64)
    # word by word in slices, so that memory does not follow the number of distinct words
    step = 20_000
    for at in range(0, len(chosen), step):
        table = term_samples(hashes[chosen[at:at + step]], counts[chosen[at:at + step]], samples)
        rows = np.flatnonzero((pair >= at) & (pair < at + step))
        for begin in range(0, len(rows), step):
            part = rows[begin:begin + step]
            starts = np.flatnonzero(np.diff(text[part], prepend=-1))
            found = np.minimum.reduceat(table[pair[part] - at], starts, axis=0)
            owners = text[part[starts]]
            best[owners] = np.minimum(best[owners], found)
    out[filled] = (best[filled] & U64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(samples: int, most: int = 2_000_000):
    def finish(rows: list[tuple[int, str]], last_next: str | None) -> pa.RecordBatch:
        """Rows of one range in order; the last one only serves as a successor unless its successor is given."""
        texts = [t for _, t in rows] + ([last_next] if last_next is not None else [])
        n = len(texts) - 1
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            cut = len(text) // 4
            edited.append((text[:len(text) - cut] + after[:cut]).encode())
        prints = signatures([t.encode() for t in texts] + edited, samples)
        own, changed = prints[:n], prints[n + 1:]
        return pa.record_batch(
            [pa.array([d for d, _ in rows[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
             pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(_hex(own), pa.string()),
             pa.array(_hex(changed), pa.string()), likeness(own, changed), likeness(own, prints[1:n + 1])],
            names=[f.split()[0] for f in FIELDS.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size, range_now, done = 0, None, False
        for batch in batches:
            for where, tail, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if where != range_now:
                    held, size, range_now, done = [], 0, where, False
                if done:
                    continue
                if tail:
                    done = True
                    if held:
                        yield finish(held, text)
                    held = []
                    continue
                held.append((doc, text))
                size += len(text)
                if size >= most and len(held) > 1:
                    yield finish(held, None)
                    held, size = held[-1:], len(text)
    return rows


def document_fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    spark = small_batches(documents.sparkSession)
    texts = input_documents(documents).withColumn("text_key", text_key())
    parts = shuffle_partitions(spark)
    placed = texts.withColumn("_range", order_ranges(texts.select("doc_id"), parts))
    # one row for each range: its first document, and the range before it (the last one for the first)
    found = placed.groupBy("_range").agg(F.min(F.struct("doc_id", "text_key")).alias("h")).orderBy("_range").collect()
    before = [(r["h"]["doc_id"], r["h"]["text_key"], found[i - 1]["_range"]) for i, r in enumerate(found)]
    heads = spark.createDataFrame(before, "doc_id long, text_key long, _before int")
    dealt = placed.join(F.broadcast(heads), ["doc_id", "text_key"], "left").select(
        "doc_id", "text_key", "text", F.explode(F.array_compact(F.array(
            F.struct(F.col("_range").alias("at"), F.lit(0).alias("tail")),
            F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("at"), F.lit(1).alias("tail")))))).alias("p"))
    ordered = dealt.select("p.at", "p.tail", "doc_id", "text", "text_key").repartition(parts, "at").sortWithinPartitions(
        "at", "tail", "doc_id", "text_key").select("at", "tail", "doc_id", "text")
    out = ordered.mapInArrow(_compare(samples), FIELDS)
    return out.select(restored_id(), *out.columns[1:])
