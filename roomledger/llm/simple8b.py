"""Token-id files in Simple-8b coding.

A 64-bit word holds a 4-bit selector and as many ids as fit at the selector's width.
Ids are coded in blocks of ``BLOCK``; every block begins a new word, and the offset of
its first word is kept, so any block can be decoded alone and all blocks at once with
array operations. An id of more than 60 bits is an escape: a word with its low 60 bits
and one with its high 4. Selectors are marked in every word, so a decoder never has to
look back.

Files are Parquet, so Spark's committer makes a write whole or absent on any store. A
row is a run of whole documents of one shard:

    shard, seq            position: shards in order, rows in order within a shard
    first                 ids of the shard before this row
    doc_ids, lengths      the documents and their numbers of ids
    n_ids, words, blocks  Simple-8b words (8 bytes each, little-endian) and, per block,
                          the 32-bit number of its first word

Documents are range-sorted by (doc_id, text hash), so shards follow each other in
ascending doc_id order, nulls first; an id that holds any share of the rows is spread
over several shards. Ids across shards need one row per shard. After the write the
table is the only source, so a lost executor cannot change the order.

Defined cases: null or empty text is only its end id; repeated rows are coded once per
row; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from roomledger.llm import tokens
from roomledger.llm import words as w
from roomledger.session import scratch_path

BLOCK = 128
ROW_BYTES = 1 << 20
END_ID = 2

# Ids per word by selector, from 2 on; 0 and 1 are the escape's halves.
COUNTS = (1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_COUNT = np.array(COUNTS, dtype=np.int64)
_BITS = np.array([60, 60, *[60 // c for c in COUNTS[2:]]], dtype=np.uint64)
_U = np.uint64
_LOW = _U((1 << 60) - 1)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of every id, 0 for 0."""
    if ids.dtype.itemsize <= 4:
        return np.frexp(ids.astype(np.float64))[1].astype(np.int16)  # exact below 2 ** 53
    out = np.zeros(len(ids), dtype=np.int16)
    rest = ids.astype(_U)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= _U(1 << step)
        out += high * np.int16(step)
        rest = np.where(high, rest >> _U(step), rest)
    return out + (rest > 0)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of every block."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.uint32)
    width = np.zeros(blocks * BLOCK, dtype=np.int16)
    width[:n] = _widths(ids)
    width = width.reshape(blocks, BLOCK)
    place = np.arange(BLOCK, dtype=np.int16)
    choice = np.zeros((blocks, BLOCK), dtype=np.int8)
    least = int(width.max())
    for selector in range(15, 1, -1):
        bits, count = int(_BITS[selector]), COUNTS[selector]
        if bits >= least:
            wide = None  # everything fits
            ok = np.ones((1, 1), dtype=bool)
        else:
            wide = np.where(width > bits, place, np.int16(BLOCK + 64))
            wide = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1]
            ok = wide - place >= count
        choice = np.where(ok, np.int8(selector), choice)
    # All blocks take a step at a time: from the start of a word to that of the next.
    begins = np.zeros((blocks, BLOCK), dtype=bool)
    row, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    while len(row):
        begins[row, at] = True
        at = at + _COUNT[choice[row, at]]
        on = at < BLOCK
        row, at = row[on], at[on]
    flat = begins.ravel()[:n]
    start = np.flatnonzero(flat)
    selector = choice.ravel()[start]
    bits = _BITS[selector]
    within = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    spread = np.repeat(bits, np.diff(np.append(start, n)))
    value = (ids.astype(_U) & _LOW) << (within.astype(_U) * spread)
    words = np.bitwise_or.reduceat(value, start) | (selector.astype(_U) << _U(60))
    first = np.searchsorted(start, np.arange(blocks) * BLOCK)
    escaped = np.flatnonzero(selector == 0)
    if len(escaped):
        high = (ids[start[escaped]].astype(_U) >> _U(60)) | (_U(1) << _U(60))
        words = np.insert(words, escaped + 1, high)
        first = first + np.searchsorted(escaped, first)
    return words, first.astype(np.uint32)


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """All ids; ``blocks`` is the first word of every block and ``n`` the number of ids."""
    if not n:
        return np.zeros(0, dtype=_U)
    selector = (words >> _U(60)).astype(np.int64)
    count, bits = _COUNT[selector], _BITS[selector]
    spread = np.repeat(np.arange(len(words)), count)
    place = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
    value = (words[spread] & _LOW) >> (place.astype(_U) * bits[spread])
    value &= (_U(1) << bits[spread]) - _U(1)
    escaped = np.flatnonzero(selector == 1)
    if len(escaped):
        at = np.cumsum(count)[escaped] - 1
        value[at] |= (words[escaped] & _U(15)) << _U(60)
    # A block's last word may have room for more ids than the block holds.
    before = np.concatenate([[0], np.cumsum(count)])[blocks]
    sizes = np.diff(np.append(before, len(value)))
    wanted = np.minimum(np.full(len(blocks), BLOCK), n - np.arange(len(blocks)) * BLOCK)
    inside = np.arange(len(value)) - np.repeat(before, sizes) < np.repeat(wanted, sizes)
    return value[inside]


SCHEMA = "shard int, seq int, first bigint, doc_ids array<{id}>, lengths array<int>, n_ids int, words binary, blocks binary"


def write_ids(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end: int = END_ID,
) -> None:
    """Encodes every whole text, appends ``end``, and writes the table at ``path``."""
    file = tokenizer or tokens.tokenizer_file()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("h"))
    id_type = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, first, seq = tokens.encoder(file), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in w.slices(batch, "text", ROW_BYTES):
                ids, at = tokens.with_end(*encoder.encode(part.column(1)), end)
                words, blocks = encode(ids)
                one = np.array([0, part.num_rows], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()),
                        pa.array([seq], pa.int32()),
                        pa.array([first], pa.int64()),
                        pa.ListArray.from_arrays(one, part.column(0)),
                        pa.ListArray.from_arrays(one, pa.array(np.diff(at).astype(np.int32))),
                        pa.array([len(ids)], pa.int32()),
                        pa.array([words.tobytes()], pa.binary()),
                        pa.array([blocks.tobytes()], pa.binary()),
                    ],
                    names=["shard", "seq", "first", "doc_ids", "lengths", "n_ids", "words", "blocks"],
                )
                first, seq = first + len(ids), seq + 1

    ordered.mapInArrow(run, SCHEMA.format(id=id_type)).write.option("compression", "zstd").parquet(path)


def read_ids(
    spark: SparkSession, path: str, name: str, kind: str, value: Callable[[np.ndarray, np.ndarray], pa.Array]
) -> DataFrame:
    """``doc_id, start, n_tokens`` and a value made of the decoded ids of every document.

    ``value`` gets the ids of a row's documents as unsigned 32-bit numbers with their
    offsets and returns one entry per document, of Spark type ``kind``.
    """
    table = spark.read.parquet(path)
    id_type = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, docs, sizes, n, words, blocks = (batch.column(k)[i] for k in range(7))
                ids = decode(
                    np.frombuffer(words.as_py(), dtype="<u8"), np.frombuffer(blocks.as_py(), dtype="<u4"), n.as_py()
                ).astype("<u4")
                length = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(length), shard.as_py(), dtype=np.int32)),
                        docs.values,
                        pa.array(first.as_py() + at[:-1]),
                        pa.array(length),
                        value(ids, at),
                    ],
                    names=["shard", "doc_id", "start", "n_tokens", name],
                )

    rows = table.select("shard", "first", "doc_ids", "lengths", "n_ids", "words", "blocks").mapInArrow(
        run, f"shard int, doc_id {id_type}, start bigint, n_tokens bigint, {name} {kind}"
    )
    sizes = table.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n"))
    # One row per shard.
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = sizes.select(F.col("shard").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(shards), F.col("shard") == F.col("s")).select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", name
    )


def crc32(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(ids).view(np.uint8))
    return pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` to the shared folder and returns what the files say per document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "simple8b")
    write_ids(docs, path, key, text)
    return read_ids(spark, path, "ids_crc32", "bigint", crc32)
