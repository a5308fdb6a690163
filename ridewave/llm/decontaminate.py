"""Benchmark decontamination with a generalised suffix automaton.

The normalised items form one automaton (or one for each ``most_words`` words of items, so it stays bounded;
documents then pass each in turn).  A document's words are streamed through it while the longest match is
tracked; where the match reaches the window, the last ``window`` words are an item's words, and the suffix
links lead to the items that hold them.  Items shorter than the window count as a whole.  Words that no item has
send the automaton to its root, so only runs of known words are streamed.

Removal cuts the hit spans out of the text; a document of which more than ``most_coverage`` of the words are hit goes.

Defined results: a null text or item has no words; items without words are ignored; items that share an item_id
count once; a null item_id is named null; repeated rows give equal results; an empty benchmark hits nothing; a null doc_id
stays null; other columns are kept (removal) or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ridewave.llm.common import give_back, small_batches

WINDOW = 10
# ASCII letters and digits and everything outside ASCII are words, A-Z in lower case.
FOLD = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32
             for b in range(256))
COUNT_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # upper case not folded yet


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over words: ``items`` maps a name to its words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.words: dict[bytes, int] = {}
        self.names: list[str] = sorted({n for n, w in items if w})
        order = {n: i for i, n in enumerate(self.names)}
        prefixes: list[tuple[int, int]] = []
        whole: dict[int, set[int]] = {}
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            last = 0
            for word in words:
                last = self._extend(last, self.words.setdefault(word, len(self.words)))
                prefixes.append((last, order[name]))
            if len(words) < window:
                whole.setdefault(last, set()).add(order[name])
                self.shortest = min(self.shortest, len(words))
        # names of the items that hold a state's words, for states as long as a window
        self.items: dict[int, set[int]] = {}
        for state, name in prefixes:
            while state > 0 and self.length[state] >= window and name not in self.items.setdefault(state, set()):
                self.items[state].add(name)
                state = self.link[state]
        self.whole = whole

    def _extend(self, last: int, word: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:
            to = nexts[last][word]
            return to if length[to] == length[last] + 1 else self._clone(last, word, to)
        new = len(length)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and word not in nexts[at]:
            nexts[at][word] = new
            at = link[at]
        if at != -1:
            to = nexts[at][word]
            link[new] = to if length[to] == length[at] + 1 else self._clone(at, word, to)
        return new

    def _clone(self, at: int, word: int, to: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(length)
        nexts.append(dict(nexts[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = copy
        while at != -1 and nexts[at].get(word) == to:
            nexts[at][word] = copy
            at = link[at]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of words (merged) and the numbers of the items with occurring windows."""
        known = np.fromiter(map(self.words.get, words, _MINUS), np.int64, len(words))
        edge = np.flatnonzero(np.diff(known >= 0, prepend=False, append=False))
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                self._stream(known[begin:end].tolist(), begin, hits, found)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, found

    def _stream(self, words: list[int], begin: int, hits: list, found: set[int]) -> None:
        nexts, link, length, window, whole = self.next, self.link, self.length, self.window, self.whole
        state, match = 0, 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                match = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                match += 1
            if match >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
                hits.append((begin + i + 1 - window, begin + i + 1))
            if whole:
                at = state
                while at > 0:
                    if at in whole and length[at] <= match:
                        found |= whole[at]
                        hits.append((begin + i + 1 - length[at], begin + i + 1))
                    at = link[at]


class _Minus:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_MINUS = _Minus()
_BUILT: dict[str, SuffixAutomaton] = {}


def automaton(key: str, items: list[tuple[str, bytes]], window: int) -> SuffixAutomaton:
    """Built once in a worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton([(n, normal_words(t)) for n, t in items], window)
    return _BUILT[key]


HITS = "n_words long, ranges array<struct<a:int,b:int>>, items array<string>"


def _scanner(items, key: str, window: int):
    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        machine = automaton(key, items.value, window)
        out = []
        for text in texts:
            words = normal_words(text.encode())
            ranges, found = machine.scan(words)
            out.append((len(words), [{"a": a, "b": b} for a, b in ranges], [machine.names[i] for i in sorted(found)]))
        give_back()
        return pd.DataFrame(out, columns=["n_words", "ranges", "items"])
    return scan


def with_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = 2_000_000) -> DataFrame:
    """``documents`` with _hits: a struct for each block of the benchmark (n_words, ranges, items)."""
    spark = small_batches(documents.sparkSession)
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    words = named.agg(F.sum(F.regexp_count("text", F.lit(COUNT_WORDS)))).first()[0] or 0
    blocks = max(1, -(-2 * words // most_words))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    columns: list[Column] = []
    for k in range(blocks):
        rows = named.where(block == k).collect()  # about most_words / 2 words
        items = sorted((r["item_id"], r["text"].encode()) for r in rows)
        key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
        columns.append(_scanner(spark.sparkContext.broadcast(items), key, window)(F.coalesce("text", F.lit(""))))
    return documents.withColumn("_hits", F.array(*columns))


def _summary() -> Column:
    """n_words, merged ranges, items of all blocks."""
    ordered = F.array_sort(F.flatten(F.col("_hits.ranges")))
    merged = F.aggregate(
        ordered, F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["b"]).alias("b"))))
        ).otherwise(F.concat(acc, F.array(x))))
    ranges = F.when(F.size("_hits") > 1, merged).otherwise(F.col("_hits")[0]["ranges"])
    return F.struct(F.col("_hits")[0]["n_words"].alias("n_words"), ranges.alias("ranges"), F.array_sort(F.flatten(F.col("_hits.items"))).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit ranges of words."""
    hits = with_hits(documents.select("doc_id", "text"), benchmark, window, **settings).select("doc_id", _summary().alias("h"))
    n_hit = F.aggregate("h.ranges", F.lit(0).cast("long"), lambda a, r: a + (r["b"] - r["a"]).cast("long"))
    return hits.select("doc_id", "h.n_words", n_hit.alias("n_hit"), F.size("h.items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("h.items", ","), 256).alias("items_sha256"), (F.size("h.items") > 0).alias("contaminated"))


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    out = []
    for text, runs in zip(texts, ranges, strict=True):
        if text is None or runs is None or not len(runs):
            out.append(text)
            continue
        raw = text.encode()
        known = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
        edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        parts, at = [], 0
        for r in runs:
            parts.append(raw[at:start[r["a"]]])
            at = end[r["b"] - 1]
        out.append(b"".join([*parts, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.8, **settings) -> DataFrame:
    """The documents without hit spans, n_chars (if there) following; documents hit in more than ``most_coverage`` of their words are left out."""
    marked = with_hits(documents, benchmark, window, **settings).withColumn("_h", _summary())
    n_hit = F.aggregate("_h.ranges", F.lit(0).cast("long"), lambda a, r: a + (r["b"] - r["a"]).cast("long"))
    kept = marked.where(n_hit <= most_coverage * F.col("_h.n_words")).withColumn(
        "text", F.when(F.size("_h.ranges") > 0, _cut("text", "_h.ranges")).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kept = kept.withColumn("n_chars", F.when(F.size("_h.ranges") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(documents.columns)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(words)) AS k, array_to_string(words[s:s + least(10, len(words)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM i WHERE len(words) > 0)),
p AS (SELECT doc_id, s, k, array_to_string(words[s:s + k - 1], ' ') AS gram
  FROM (SELECT w.*, k, unnest(range(1, len(words) - k + 2)) AS s FROM w, (SELECT DISTINCT k FROM g) WHERE len(words) >= k)),
m AS (SELECT p.doc_id, p.s, p.k, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
h AS (SELECT doc_id, count(DISTINCT word_no) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS word_no FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id IS NOT DISTINCT FROM h.doc_id LEFT JOIN n ON w.doc_id IS NOT DISTINCT FROM n.doc_id
"""
