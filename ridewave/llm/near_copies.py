"""Near copies by word shingles: SimHash and MinHash bands find candidate pairs, the exact Jaccard similarity decides them.

All pairs that op4 links (its SimHash of ``PRINT_SHINGLE`` words, at ``DISTANCE`` bits or fewer by multi-index hashing) are candidates; texts
of one fingerprint meet its least one.  At a similarity of 0.8 some ten bits differ, so the rest of the candidates comes from the bands.

A document's set holds the hashes of its runs of ``SHINGLE`` words.  ``BANDS`` bands of ``ROWS`` MinHash values each put it into
buckets; two sets of similarity j share a bucket with chance 1 - (1 - j**ROWS)**BANDS, which is 0.9999 at 0.8, and a pair
links where its similarity is exactly ``similarity`` or more.  Documents of equal words meet as one before that.  The pairs
of a bucket with its least member are decided first, with those of SimHash; what they connect in a few steps needs no further pair.  Sets in buckets that hold several
roots by then meet where they share one of their rarest shingles, as any two sets of the similarity must: documents of
one template below the similarity share only frequent ones and make no pairs.  The components are those of all pairs, without their number.

Texts never travel with pairs: a pair compares sorted shingle hashes, long sets in pieces of bounded size, and adds up what they share.

Defined results: words compare without the case of ASCII letters; fewer words than a shingle give one shingle of all of them;
texts without words are copies of each other; repeated rows are copies; a null doc_id counts as the smallest id; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridewave.llm.common import RangeHash, U64, Words, give_back, input_documents, longs, mix, signed, slices, small_batches, text_key, utf8, written
from ridewave.llm.components import components
from ridewave.llm.simhash import keep_first, links, simhash

SHINGLE, BANDS, ROWS = 5, 24, 5
PRINT_SHINGLE, DISTANCE, PARTS = 3, 2, 2
PIECE = 4096
FOLD = bytes(range(256)).lower()
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BAND_MARKS = mix(np.arange(7001, 7001 + BANDS, dtype=U64))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, the first one of each text (and the end), and a hash of each text's words."""
    words = Words(texts, FOLD)
    ranges = RangeHash(words.hashes())
    low, high = words.first[:-1], words.first[1:]
    counts = np.maximum(1, high - low - SHINGLE + 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(first[-1]) + np.repeat(low - first[:-1], counts)
    return ranges.of(start, np.minimum(start + SHINGLE, np.repeat(high, counts))), first, ranges.of(low, high)


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bucket of each text (row) in each band (column)."""
    keys = np.empty((len(first) - 1, BANDS), U64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(first) - 1, BAND_MARKS[band], U64)
            for factor in FACTORS[band * ROWS:(band + 1) * ROWS]:
                key = mix(key + np.minimum.reduceat(hashes * factor, first[:-1]))
            keys[:, band] = key
    return keys


def _signatures(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, words (hash of the word sequence), n (different shingles), buckets and fingerprint."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, first, words = shingles(utf8(batch))
            prints = signed(np.array([simhash(t, PRINT_SHINGLE) for t in utf8(batch)], U64))
            keys = pa.array(signed(band_keys(hashes, first).reshape(-1)))
            sizes = np.fromiter((len(np.unique(hashes[a:b])) for a, b in zip(first, first[1:], strict=False)), np.int64, batch.num_rows)
            lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), keys)
            yield pa.record_batch([longs(batch, "doc_id"), longs(batch, "text_key"), signed(words), sizes, lists, prints],
                                  names=["doc_id", "text_key", "words", "n", "buckets", "fingerprint"])
            give_back()
    small_batches(texts.sparkSession)
    return texts.select("doc_id", "text_key", "text").mapInArrow(rows, "doc_id long, text_key long, words long, n long, buckets array<long>, fingerprint long")


def _pieces(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """words, n, level, range, hashes: the distinct shingle hashes of the texts of ``wanted`` (words, doc_id, text_key).

    A set of more than ``PIECE`` hashes is cut into 2**level ranges by the upper bits, so no row grows with its text.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, first, words = shingles(utf8(batch))
            for key, a, b in zip(signed(words).tolist(), first, first[1:], strict=False):
                one = np.unique(hashes[a:b])
                level = max(0, -(-len(one) // PIECE) - 1).bit_length()
                edges = np.searchsorted(one, np.arange(1, 1 << level, dtype=U64) << U64(64 - level)) if level else np.empty(0, np.int64)
                parts = np.split(one, edges)
                for at in range(0, len(parts), 64):  # a long text comes in several batches
                    some = parts[at:at + 64]
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
                    yield pa.record_batch([np.full(len(some), key), np.full(len(some), len(one)), np.full(len(some), level, np.int32), np.arange(at, at + len(some)),
                                           pa.ListArray.from_arrays(offsets, pa.array(signed(np.concatenate(some))))], names=["words", "n", "level", "range", "hashes"])
            give_back()
    small_batches(texts.sparkSession)
    return texts.join(wanted.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi").select("text").mapInArrow(
        rows, "words long, n long, level int, range long, hashes array<long>")


def _may(n: str, m: str, similarity: float) -> Column:
    """Sets of these sizes can reach the similarity."""
    return F.least(n, m) >= similarity * F.greatest(n, m)


def _alike(pairs: DataFrame, pieces: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, n, m: words and sizes) whose sets reach the similarity; shared hashes are counted by range and added up.

    Sets of such pairs differ by one level at most, so a range of one meets itself, its half or its double in the other.
    """
    x = pieces.select(F.col("words").alias("a"), F.col("level").alias("up"), F.col("range").alias("r"), F.col("hashes").alias("mine"))
    y = pieces.select(F.col("words").alias("b"), F.col("level").alias("down"), F.col("range").alias("q"), F.col("hashes").alias("theirs"))
    meet = F.expr("shiftright(r, up - least(up, down)) = shiftright(q, down - least(up, down))")
    shared = pairs.join(x, "a").join(y, "b").where(meet & (F.abs(F.col("up") - F.col("down")) <= 1)).groupBy("a", "b", "n", "m", "r", "q").agg(
        F.max(F.size(F.array_intersect("mine", "theirs"))).alias("shared"))  # repeated rows give a piece twice
    total = shared.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    return total.where(F.col("shared") >= similarity * (F.col("n") + F.col("m") - F.col("shared"))).select("a", "b")


def _rare_meetings(open_sets: DataFrame, pieces: DataFrame, similarity: float) -> DataFrame:
    """a, b, n, m: pairs of different roots that may share enough, judged by the place of a shared hash among their rarest.

    Sets of n <= m hashes at the similarity share c = ceil(similarity / (1 + similarity) * (n + m)) or more.  In any fixed order of hashes
    the first shared one is then among the first n - c + 1 of the one and m - c + 1 of the other.  The order is by frequency among the
    open sets, so what a whole template shares comes last: sets that differ in more than a pair may are not even proposed.
    """
    cells = written(pieces.join(open_sets, "words").select("words", "root", "n", F.explode("hashes").alias("hash")).distinct(), "near-cells")
    often = cells.groupBy("hash").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    order = Window.partitionBy("words").orderBy("sets", "hash")
    # hashes of a single set come first and meet nobody: their number is known from the others
    ranked = cells.join(often, "hash").withColumn("place", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("words")))
    each, both = similarity, similarity / (1 + similarity)
    first = written(ranked.where(F.col("place") <= F.col("n") - F.ceil(each * F.col("n") - 1e-9) + 1).select("words", "root", "n", "hash", "place"), "near-rare")
    # the smaller set asks with fewer of its hashes: no partner of its size or more needs the rest
    x, y = first.where(F.col("place") <= F.col("n") - F.ceil(2 * both * F.col("n") - 1e-9) + 1).alias("x"), first.alias("y")
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    order = F.struct("x.n", "x.words") < F.struct("y.n", "y.words")
    return x.join(y, (F.col("x.hash") == F.col("y.hash")) & order & (F.col("x.root") != F.col("y.root")) & _may("x.n", "y.n", similarity)
                  & (left >= both * (F.col("x.n") + F.col("y.n")) - 1e-9)).select(
        F.col("x.words").alias("a"), F.col("y.words").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).distinct()


def _roots(links: DataFrame, steps: int = 3) -> DataFrame:
    """node, root: the least node that a few links reach.  Equal roots are connected; connected nodes may still differ."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    for _ in range(steps - 1):
        further = both.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
        roots = further.unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
    return written(roots, "near-roots")


def _print_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b, n, m: sets of one fingerprint with its least set, and the least sets of fingerprints that op4 links."""
    prints = sets.groupBy("fingerprint").agg(F.min(F.struct("words", "n")).alias("least"))
    alike = sets.join(prints, "fingerprint").select("least", F.struct("words", "n").alias("other"))
    x, y = prints.select(F.col("fingerprint").alias("a"), F.col("least").alias("x")), prints.select(F.col("fingerprint").alias("b"), F.col("least").alias("y"))
    near = links(prints.select("fingerprint"), DISTANCE, PARTS).join(x, "a").join(y, "b").select(F.least("x", "y").alias("least"), F.greatest("x", "y").alias("other"))
    return alike.unionByName(near).where((F.col("least.words") != F.col("other.words")) & _may("least.n", "other.n", similarity)).select(
        F.col("least.words").alias("a"), F.col("other.words").alias("b"), F.col("least.n").alias("n"), F.col("other.n").alias("m"))


def near_links(sets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: links whose components are those of all pairs that share a bucket or that op4 links, and reach the similarity."""
    members = sets.select("words", "n", F.explode("buckets").alias("bucket"))
    full = members.groupBy("bucket").agg(F.min(F.struct("words", "n")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "least")
    shared = written(members.join(full, "bucket"), "near-buckets")
    proposed = written(_print_pairs(sets, similarity), "near-prints")
    wanted = sets.join(shared.select("words").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("words"))).distinct(), "words", "left_semi")
    pieces = written(_pieces(texts, wanted.select("first.doc_id", "first.text_key")), "near-pieces")
    stars = written(shared.where((F.col("words") != F.col("least.words")) & _may("n", "least.n", similarity)).select(
        F.col("least.words").alias("a"), F.col("words").alias("b"), F.col("least.n").alias("n"), F.col("n").alias("m")).unionByName(proposed).distinct(), "near-stars")
    found = written(_alike(stars, pieces, similarity), "near-links")
    placed = shared.join(_roots(found), shared["words"] == F.col("node"), "left").select("bucket", "words", F.coalesce("root", "words").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    open_sets = written(placed.join(split, "bucket", "left_semi").select("words", "root").distinct(), "near-open")
    met = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = _rare_meetings(open_sets, pieces, similarity).join(met, ["a", "b"], "left_anti")
    return found.unionByName(_alike(written(pairs, "near-pairs"), pieces, similarity))


def near_copies(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, least: the smallest (doc_id, text_key) of the component."""
    texts = input_documents(documents).withColumn("text_key", text_key())
    marked = written(_signatures(texts), "near-signatures")
    sets = written(marked.groupBy("words").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.max("n").alias("n"), F.first("buckets").alias("buckets"), F.min("fingerprint").alias("fingerprint")), "near-sets")
    roots = components(near_links(sets, texts, similarity))
    placed = sets.select("words", "first").join(roots, F.col("words") == F.col("node"), "left").select("words", "first", F.coalesce("root", "words").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return marked.select("doc_id", "text_key", "words").join(placed.join(least, "root").select("words", "least"), "words").select("doc_id", "text_key", "least")


def keep_one_near(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies stays: its smallest doc_id, and of repeated rows the least in column order."""
    return keep_first(documents, near_copies(documents, similarity))
