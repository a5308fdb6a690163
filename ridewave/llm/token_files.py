"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus' frequency order (ties by id), so frequent tokens take one byte.
A block keeps four values' byte lengths in one control byte (two bits each) and the bytes themselves in a second
stream; decoding looks control bytes up in a 256-row table.  Blocks stand in Parquet files (binary columns) of ascending
doc_id, written by Spark's committer, so lost executors and retried tasks leave no partial files.

1. Texts are encoded once, through a bounded cache of pre-tokens (see Encoder).
2. Counts by token are aggregates; ranks are bounded by the vocabulary.
3. Documents are dealt by ranges of doc_id, so a file's first position is the sum of the ranges before it.

Defined results: a null or empty text is the end id alone; repeated rows stay and follow each other (doc_id, then a hash
of the text); a null doc_id is the smallest; an empty table writes no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridewave.llm.common import BYTE_VALUE, RangeHash, give_back, input_documents, restored_id, scratch_path, shuffle_partitions, slices, small_batches, text_key
from ridewave.llm.ordering import order_ranges

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
# The letters that stand for bytes in a byte-level vocabulary.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTER = {b: b for b in SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
BREAK = chr(BYTE_LETTER[0xFF])
SEPARATOR, LETTER, DIGIT, SPACE_KIND, BREAK_KIND, SIGN, OTHER = range(7)
BLANK_KINDS = [SEPARATOR, SPACE_KIND, BREAK_KIND]
# bytes 0xC3-0xC9 with their continuations are Latin letters, but for two signs that are looked for apart
KIND = np.array([SEPARATOR if b == 0xFF else LETTER if chr(b).isalpha() and b < 0x80 or 0x80 <= b < 0xC0 or 0xC3 <= b <= 0xC9
                 else DIGIT if b < 0x80 and chr(b).isdigit() else SPACE_KIND if b == 32 else BREAK_KIND if 9 <= b <= 13
                 else SIGN if 33 <= b < 127 and b != 39 else OTHER for b in range(256)], np.uint8)
CACHE = 400_000  # units kept in a worker
RANGES = 2  # ranges of doc_id to a shuffle partition: a task sorts and holds less
ROW_GROUP = str(16 << 20)  # bytes of a row group that a writer holds


def pack(values: np.ndarray, most: int = 1 << 18) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values; long runs in pieces of ``most`` (a multiple of four)."""
    if len(values) > most:
        pieces = [pack(values[at:at + most]) for at in range(0, len(values), most)]
        return b"".join(c for c, _ in pieces), b"".join(d for _, d in pieces)
    values = values.astype("<u4")
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = length - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    end = np.cumsum(length)
    begin = end - length
    octets = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = np.zeros(count, np.uint32)
    for i in range(4):
        has = length > i
        out[has] |= octets[begin[has] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


class Encoder:
    """Encodes texts through a cache of their pre-tokens, found for whole batches at once.

    A text is cut at its single spaces; there the byte-level pre-tokenizer cuts too.  Pieces of plain characters (ASCII without
    apostrophe and control characters, and Latin letters) are cut further where letters, digits, signs and white space meet,
    as its pattern does.  Units are told apart by 64-bit hashes; new ones go to the tokenizer as already cut, in
    batches.  Pieces of other characters are units as they are and take the tokenizer's whole path; texts with spaces
    beside other white space are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.code = "u4" if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 else "u2"
        self.words_only = Tokenizer(self.tokenizer.model)  # shares the model, without pre-tokenizer and added tokens
        self.forget()

    def forget(self) -> None:
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of units, and their numbers
        self.flat, self.begin, self.size = np.zeros(0, self.code), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.code)

    def learn(self, units: list[bytes], plain: list[bool]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of new units, one after the other, and their counts."""
        flat: list[np.ndarray] = []
        sizes: list[int] = []
        at = 0
        while at < len(units):
            to = at
            while to < len(units) and plain[to] == plain[at] and to - at < 1000:
                to += 1
            if plain[at]:
                letters = b"\xff".join(units[at:to]).decode("latin-1").translate(BYTE_LETTER).split(BREAK)
                got = self.words_only.encode(letters, is_pretokenized=True, add_special_tokens=False)
                flat.append(np.array(got.ids, self.code))
                sizes += np.bincount(np.array(got.word_ids), minlength=to - at).tolist()
            else:
                for unit in units[at:to]:
                    flat.append(self.whole(unit.decode()))
                    sizes.append(len(flat[-1]))
            at = to
        return flat, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        joined = b"\xff" + b"\xff".join(raw) + b"\xff"
        data = np.frombuffer(joined, np.uint8)
        kind = KIND[data]
        after = np.append(kind[1:], SEPARATOR)
        sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        piece = np.cumsum((kind == SPACE_KIND) | (kind == SEPARATOR))
        odd_piece = np.zeros(piece[-1] + 2, bool)
        odd_piece[piece[kind == OTHER]] = True
        odd_piece[piece[:-1][sign]] = True
        odd_piece[piece[(kind == BREAK_KIND) & (after == BREAK_KIND)]] = True
        start = np.ones(len(data), bool)
        start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE_KIND) & ~odd_piece[piece[1:]] | (kind[1:] == SPACE_KIND) | (kind[:-1] == SEPARATOR)
        start &= kind != SEPARATOR
        begin = np.flatnonzero(start)
        stop = np.flatnonzero(start | (kind == SEPARATOR))
        end = stop[np.searchsorted(stop, begin) + 1]
        lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        edge = np.concatenate([[0], np.cumsum(lengths)])
        first = np.searchsorted(begin, edge)
        space = np.flatnonzero(kind == SPACE_KIND)
        beside = np.isin(kind[space - 1], BLANK_KINDS) | np.isin(after[space], BLANK_KINDS)
        odd_text = set((np.searchsorted(edge, space[beside], "right") - 1).tolist())
        codes, distinct = pd.factorize(RangeHash(BYTE_VALUE[data]).of(begin, end))
        if len(self.hash) > CACHE:
            self.forget()
        spot = np.searchsorted(self.hash, distinct)
        held = np.append(self.hash, np.uint64(0))[spot] == distinct
        held &= spot < len(self.hash)
        number = np.append(self.number, -1)[spot]
        new = np.flatnonzero(~held)
        if len(new):
            example = np.zeros(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            at = example[new]
            plain = ~odd_piece[piece[begin[at]]]
            new, at = np.concatenate([new[plain], new[~plain]]), np.concatenate([at[plain], at[~plain]])
            flat, sizes = self.learn([joined[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)],
                                     [True] * int(plain.sum()) + [False] * int((~plain).sum()))
            number[new] = len(self.size) + np.arange(len(new))
            order = np.argsort(distinct[new])
            into = np.searchsorted(self.hash, distinct[new][order])
            self.hash = np.insert(self.hash, into, distinct[new][order])
            self.number = np.insert(self.number, into, number[new][order])
            self.size = np.concatenate([self.size, sizes])
            self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
            self.flat = np.concatenate([self.flat, *flat])
        unit = number[codes] if len(codes) else np.zeros(0, np.int64)
        size = self.size[unit]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(to[-1]) + np.repeat(self.begin[unit] - to[:-1], size)]
        bounds = to[first].tolist()
        return [self.whole(texts[i]) if i in odd_text else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def wide(vocabulary: str) -> bool:
    return encoder(vocabulary).code == "u4"


def encode_texts(texts: list[str], vocabulary: str) -> list[np.ndarray]:
    """The ids of each text as 16-bit words (32 for a vocabulary of over 65,536)."""
    return encoder(vocabulary).encode(texts)


ENCODED = "kind int, doc_id long, text_key long, n long, low binary, high binary, token array<int>, seen array<long>"


def _encode(vocabulary: str, end: int):
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("low", pa.binary()),
                        ("high", pa.binary()), ("token", pa.list_(pa.int32())), ("seen", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u4" if wide(vocabulary) else "<u2"
        tail = np.array([end], kind)
        seen = np.zeros(1, np.int64)
        for batch in slices(batches, most=1_000_000):
            coded = [np.append(x, tail) for x in encode_texts(batch.column(2).to_pylist(), vocabulary)]
            count = np.bincount(np.concatenate(coded))
            if len(count) > len(seen):
                count[:len(seen)] += seen
                seen = count
            else:
                seen[:len(count)] += count
            n = len(coded)
            # low and high bytes apart compress better
            yield pa.record_batch([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array([len(c) for c in coded], pa.int64()),
                                   pa.array([(c & 0xFF).astype(np.uint8).tobytes() for c in coded], pa.binary()),
                                   pa.array([(c >> 8).astype("<u4" if kind == "<u4" else np.uint8).tobytes() for c in coded], pa.binary()),
                                   pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
            give_back()
        used = np.flatnonzero(seen)
        if len(used):
            yield pa.record_batch([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                   pa.nulls(1, pa.binary()), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([seen[used].tolist()], pa.list_(pa.int64()))], schema=schema)
    return rows


BLOCK = "part int, block int, start long, doc_id array<long>, n array<long>, control binary, data binary"


def _blocks(ranks, starts: dict[int, int], high: str, most: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
                        ("control", pa.binary()), ("data", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        part, block, at, size = None, 0, 0, 0
        docs: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, at, size, docs, held
            control, data = pack(np.concatenate(held))
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([at], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                                   pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema=schema)
            block, at, size, docs, held = block + 1, at + size, 0, [], []
            return out

        for where, doc, low, top in rows_in(batches):
            if where != part:
                if held:
                    yield flush()
                part, block, at, size = where, 0, starts[where], 0
            ids = np.frombuffer(low, np.uint8).astype(np.uint32) | np.frombuffer(top, high).astype(np.uint32) << np.uint32(8)
            docs.append(doc)
            held.append(rank[ids])
            size += len(ids)
            if size >= most:
                yield flush()
        if held:
            yield flush()
    return rows


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def write_token_files(documents: DataFrame, path: str, vocabulary: str, end: int = 2, block_tokens: int = 100_000) -> str:
    """Writes ``documents`` in the format above under ``path``; returns the folder of blocks, beside the folder of ranks."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = input_documents(documents).withColumn("text_key", text_key()).select("doc_id", "text_key", "text")
    raw = f"{path}/raw"
    texts.mapInArrow(_encode(vocabulary, end), ENCODED).write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).partitionBy("kind").parquet(raw)
    coded = spark.read.schema(ENCODED).parquet(raw)
    counts = coded.where("kind = 1").select(F.explode(F.arrays_zip("token", "seen")).alias("t")).groupBy("t.token").agg(F.sum("t.seen").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "token").collect()  # at most a row for each token of the vocabulary
    spark.createDataFrame([(i, r["token"], r["n"]) for i, r in enumerate(ranked)] or [], "rank int, token int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    table = np.zeros(max((r["token"] for r in ranked), default=0) + 1, np.uint32)
    for i, r in enumerate(ranked):
        table[r["token"]] = i
    ranks = spark.sparkContext.broadcast(table)
    parts = RANGES * shuffle_partitions(spark)
    docs = coded.where("kind = 0")
    placed = docs.withColumn("part", order_ranges(docs.select("doc_id"), parts))
    sums = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part], total = total, total + n
    high = "<u4" if wide(vocabulary) else "u1"
    ordered = placed.select("part", "doc_id", "low", "high", "text_key").repartition(parts, "part").sortWithinPartitions("part", "doc_id", "text_key")
    ordered.select("part", "doc_id", "low", "high").mapInArrow(_blocks(ranks, starts, high, block_tokens), BLOCK).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    return f"{path}/blocks"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of the documents under ``path``."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # bounded by the vocabulary
    tokens = spark.sparkContext.broadcast(np.array([r["token"] for r in ranks], np.uint32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, docs, n, control, data in rows_in(batches):
            ids = tokens.value[unpack(control, data, sum(n))]
            end = np.cumsum(n)
            yield pa.record_batch([pa.array(docs, pa.int64()), start + end - np.array(n), pa.array(n, pa.int64()),
                                   pa.array([ids[b - k:b].tobytes() for b, k in zip(end.tolist(), n, strict=True)], pa.binary())],
                                  names=["doc_id", "start", "n_tokens", "ids"])
        give_back()
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("start", "doc_id", "n", "control", "data")
    return blocks.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(documents: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(documents, path, vocabulary, end)
    return read_token_files(spark, path).select(restored_id(), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
