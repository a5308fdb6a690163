"""Substring dedup: every window of words that also starts earlier is removed.

1. *Route by content.*  A window of ``window`` words belongs to its anchor: the smallest hash among its
   runs of ``gram`` words, leftmost on ties.  Equal windows have equal anchors, and neighbouring windows
   mostly share one, so a document becomes a list of short segments (about one for eight words) of which only
   hashes, the document and the start are shuffled.  Equal segments of one batch are combined before the
   shuffle, so a passage that a third of the documents hold arrives once per batch.
2. *First occurrences.*  The rows of an anchor are read in sorted order.  All but the first occurrence of a
   segment are repeats as a whole.  Where an anchor has several different segments, the first occurrences of
   these go on as candidates.
3. *Compressed FM-index per shard.*  The candidates' words are dealt out by anchor.  A task indexes whole
   anchors up to a bounded number of words and streams the segments against the index by backward search;
   the windows that match in full and share their suffix range are equal, and all but the earliest of them are repeats.
   An anchor with more than ``busy`` different segments is dealt out window by window instead.
4. The repeats of a document are joined to its text, which is cut there.

Defined results: a null text has no words; texts shorter than the window lose nothing; repeated rows (same
doc_id, same text) are one document and all keep the same words; different texts under one doc_id compare by
start; a null doc_id counts as the smallest id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import (RangeHash, U64, Words, input_documents, longs, mix, restored_id, signed, shuffle_partitions,
                                 slices, small_batches, text_key, utf8, written)
from ridewave.llm.fm_index import FMIndex

GRAM = 6
SEGMENT = "route long, kind int, anchor long, segment long, doc_id long, text_key long, start long, windows int"
REPEAT = "kind int, anchor long, doc_id long, text_key long, start long, windows int"


def leftmost_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value of each run of ``width`` values, and its leftmost place (by doubling)."""
    low, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = low[:len(low) - step], low[step:]
        left = a <= b
        at = np.where(left, at[:len(a)], at[step:])
        low = np.where(left, a, b)
        span += step
    return low, at


def segments(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Segments of the texts whose words are words[first[i]:first[i+1]]: text, start, windows, anchor and hash."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(U64), none.astype(U64)
    run = RangeHash(words)
    at = np.arange(n - gram + 1)
    low, place = leftmost_minima(run.of(at, at + gram), window - gram + 1)
    length = np.diff(first)
    text = np.repeat(np.arange(len(length)), length)[:len(low)]
    inside = at[:len(low)] + window <= first[text + 1]
    new = np.ones(len(low), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    heads = np.flatnonzero(new & inside)
    group = np.cumsum(new & inside) - 1
    windows = np.bincount(group[inside], minlength=len(heads))
    return text[heads], heads - first[text[heads]], windows, low[heads], run.of(heads, heads + windows + window - 1)


def _segment_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8_000_000):
            texts = Words(utf8(batch))
            text, start, windows, anchor, segment = segments(texts.hashes(), texts.first, window, gram)
            if not len(text):
                continue
            doc, key = longs(batch, "doc_id")[text], longs(batch, "text_key")[text]
            order = np.lexsort((start, doc, segment))
            again = np.zeros(len(order), bool)
            again[order[1:]] = segment[order[1:]] == segment[order[:-1]]
            # the same occurrence of a repeated row is no repeat of itself
            head = np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order))))
            same = np.zeros(len(order), bool)
            same[order] = (doc[order] == doc[order[head]]) & (start[order] == start[order[head]])
            again &= ~same
            route = np.where(again, mix(signed(key).view(U64) + start.astype(U64)), mix(anchor))
            yield pa.record_batch([signed(route), again.astype(np.int32), signed(anchor), signed(segment), doc, key,
                                   start.astype(np.int64), windows.astype(np.int32)], names=[c.split()[0] for c in SEGMENT.split(", ")])
    return rows


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by kind, anchor, segment, doc_id, start; keeps repeats (0) and candidates (1)."""
    names = [c.split()[0] for c in REPEAT.split(", ")]
    last = None  # anchor, segment, doc, start of the last first occurrence; its row while it is the anchor's only one

    for batch in batches:
        if not batch.num_rows:
            continue
        known, anchor, segment, doc, key, start, windows = (np.asarray(batch.column(i)) for i in range(1, 8))
        free = known == 1
        n = len(known)
        new_anchor, new_segment = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = (anchor[1:] != anchor[:-1]) | (known[1:] != known[:-1])
        new_segment[1:] = new_anchor[1:] | (segment[1:] != segment[:-1])
        if last is not None and not free[0]:
            new_anchor[0] = anchor[0] != last["anchor"]
            new_segment[0] = new_anchor[0] or segment[0] != last["segment"]
        head = np.maximum.accumulate(np.where(new_segment, np.arange(n), -1))
        head_doc = np.where(head >= 0, doc[head], last["doc"] if last else 0)
        head_start = np.where(head >= 0, start[head], last["start"] if last else 0)
        same = (doc == head_doc) & (start == head_start)  # repeated rows of one document
        repeat = free | (~same)
        firsts = ~free & same
        # candidates: first occurrences of anchors with several segments
        group = np.cumsum(new_anchor) - int(new_anchor[0])
        kinds = np.bincount(group[new_segment & ~free], minlength=group[-1] + 1)
        pending, more = None, False
        if last is not None:
            if not new_anchor[0] and not free[0]:
                more = last["many"] or kinds[0] > 0
                if kinds[0] > 0 and last["only"]:
                    pending = last["only"]
        many = kinds > 1
        many[0] |= more
        candidate = firsts & many[group]
        out_kind = np.where(repeat, 0, 1).astype(np.int32)
        keep = repeat | candidate
        if pending:
            yield pa.record_batch([pa.array(c) for c in zip(*pending, strict=True)], schema=_REPEAT_SCHEMA)
        if keep.any():
            yield pa.record_batch([out_kind[keep], anchor[keep], doc[keep], key[keep], start[keep], windows[keep]], names=names)
        if free[-1]:
            last = None
            continue
        tail = group == group[-1]
        only = [] if many[-1] else [(1, int(anchor[i]), int(doc[i]), int(key[i]), int(start[i]), int(windows[i])) for i in np.flatnonzero(tail & firsts)]
        if not many[-1] and group[-1] == 0 and last is not None and not new_anchor[0]:
            only = last["only"] + only
        last = {"anchor": anchor[-1], "segment": segment[-1], "doc": head_doc[-1], "start": head_start[-1],
                "many": bool(many[-1]), "only": only}


_REPEAT_SCHEMA = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
                            ("start", pa.int64()), ("windows", pa.int32())])
PIECE = "kind int, route long, doc_id long, text_key long, start long, words binary"


def _candidate_words(window: int):
    names = [c.split()[0] for c in PIECE.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4_000_000):
            texts = Words(utf8(batch))
            words = texts.hashes()
            doc, key = longs(batch, "doc_id"), longs(batch, "text_key")
            out: list[tuple] = []
            for i, (begin, found) in enumerate(zip(texts.first, batch.column(batch.schema.get_field_index("found")).to_pylist(), strict=False)):
                own = words[begin:texts.first[i + 1]]
                for x in found:
                    piece = own[x["start"]:x["start"] + x["windows"] + window - 1]
                    if not x["busy"]:
                        out.append((1, x["anchor"], doc[i], key[i], x["start"], piece.tobytes()))
                        continue
                    at = np.arange(x["windows"])
                    route = signed(RangeHash(piece).of(at, at + window))
                    out += [(1, int(route[j]), doc[i], key[i], x["start"] + j, piece[j:j + window].tobytes()) for j in range(x["windows"])]
            # equal single windows of one batch arrive once
            out.sort(key=lambda r: (r[1], r[5], r[2], r[4]))
            rows_out, head = [], None
            for r in out:
                if head and r[1] == head[1] and r[5] == head[5] and (r[2], r[4]) != (head[2], head[4]):
                    rows_out.append((0, r[3] ^ r[4], *r[2:5], len(r[5]).to_bytes(4, "little")))
                else:
                    head = r
                    rows_out.append(r)
            if rows_out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows_out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)
    return rows


def _index_shards(window: int, most_words: int):
    """Indexes whole routes up to ``most_words`` words at a time and reports the windows that start earlier in the index."""
    def report(pieces: list[tuple]) -> pa.RecordBatch | None:
        pieces.sort(key=lambda p: (p[0], p[2]))  # doc_id, start
        words = [np.frombuffer(p[3], U64) for p in pieces]
        lengths = np.array([len(w) for w in words])
        flat = np.concatenate(words)
        index = FMIndex(flat, lengths, window)
        first = np.concatenate([[0], np.cumsum(lengths)])
        piece = np.repeat(np.arange(len(pieces)), lengths - window + 1)
        at = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(first, first[1:], strict=False)])
        matched, low, _ = index.search(index.symbols(flat), at + window, window)
        if (matched < window).any():
            raise AssertionError("the index must hold its own windows")
        doc, start = np.array([p[0] for p in pieces])[piece], np.array([p[2] for p in pieces])[piece] + at - first[piece]
        order = np.lexsort((start, doc, low))  # windows of one suffix range are equal
        new = np.ones(len(order), bool)
        new[1:] = low[order[1:]] != low[order[:-1]]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        repeat = (doc[order] != doc[head]) | (start[order] != start[head])
        hit = order[repeat]
        if not len(hit):
            return None
        key = np.array([p[1] for p in pieces])[piece]
        hit = hit[np.lexsort((start[hit], key[hit], doc[hit]))]
        new = np.ones(len(hit), bool)
        new[1:] = (doc[hit[1:]] != doc[hit[:-1]]) | (key[hit[1:]] != key[hit[:-1]]) | (start[hit[1:]] != start[hit[:-1]] + 1)
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(hit)))
        h = hit[heads]
        return pa.record_batch([doc[h], key[h], start[h], count.astype(np.int32)], names=["doc_id", "text_key", "start", "windows"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, route = 0, None
        for batch in batches:
            kind, routes, doc, key, start, words = (batch.column(i).to_pylist() for i in range(6))
            known = [i for i, k in enumerate(kind) if not k]
            if known:
                yield pa.record_batch([[doc[i] for i in known], [key[i] for i in known], [start[i] for i in known],
                                       pa.array([int.from_bytes(words[i], "little") // 8 - window + 1 for i in known], pa.int32())],
                                      names=["doc_id", "text_key", "start", "windows"])
            for i, k in enumerate(kind):
                if not k:
                    continue
                if routes[i] != route and size >= most_words:
                    if (out := report(held)) is not None:
                        yield out
                    held, size = [], 0
                route = routes[i]
                held.append((doc[i], key[i], start[i], words[i]))
                size += len(words[i]) // 8
        if held and (out := report(held)) is not None:
            yield out
    return rows


def repeats(documents: DataFrame, window: int = 20, gram: int = GRAM, most_words: int = 400_000, busy: int = 50_000) -> DataFrame:
    """doc_id, text_key, start, windows: runs of ``windows`` starts whose windows also start earlier.

    ``documents``: doc_id and text without nulls, and text_key.
    """
    spark = small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text_key", "text").mapInArrow(_segment_rows(window, gram), SEGMENT)
    sorted_rows = rows.repartition(shuffle_partitions(spark), "route").sortWithinPartitions("kind", "anchor", "segment", "doc_id", "start")
    found = written(sorted_rows.mapInArrow(_first_occurrences, REPEAT), "repeats")
    candidates = found.where("kind = 1").drop("kind")
    # a short table as a rule; written, so that Spark knows its size when it joins
    crowded = written(candidates.groupBy("anchor").count().where(F.col("count") > busy).select("anchor", F.lit(True).alias("busy")), "crowded-anchors")
    by_text = (candidates.join(crowded, "anchor", "left").groupBy("doc_id", "text_key")
               .agg(F.collect_list(F.struct("anchor", "start", "windows", F.coalesce("busy", F.lit(False)).alias("busy"))).alias("found")))
    pieces = documents.select("doc_id", "text_key", "text").join(by_text, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "found").mapInArrow(_candidate_words(window), PIECE)
    dealt = pieces.repartition(shuffle_partitions(spark), "route").sortWithinPartitions("route", "doc_id", "start")
    matched = dealt.mapInArrow(_index_shards(window, most_words), "doc_id long, text_key long, start long, windows int")
    return found.where("kind = 0").select("doc_id", "text_key", "start", "windows").unionByName(matched)


CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(window: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4_000_000):
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for doc, text, runs in zip(ids, utf8(batch), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                removed = 0
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    at = np.array([r["start"] for r in runs])
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + np.array([r["windows"] for r in runs]) + window - 1, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    removed = len(words) - int(keep.sum())
                    words_kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    words_kept = words
                kept = b" ".join(words_kept)
                out.append((doc, len(words), removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            fields = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, fields, strict=False)], names=names[:len(cols)])
    return rows


def substring_dedup(documents: DataFrame, window: int = 20, with_text: bool = False, **settings) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept, its text, ``with_text``)."""
    texts = input_documents(documents).withColumn("text_key", text_key())
    runs = (repeats(texts, window, **settings).groupBy("doc_id", "text_key")
            .agg(F.collect_list(F.struct("start", "windows")).alias("runs")))
    cut = texts.join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs").mapInArrow(
        _cut(window, with_text), CUT + (", kept string" if with_text else ""))
    return cut.select(restored_id(), *cut.columns[1:])
