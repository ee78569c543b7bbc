"""Token counts by a scan for separators in flat token files.

A flat file is a stream of 32-bit ids without lengths or offsets; a document ends at the
end-of-document id. The stream is cut into blocks of ``BLOCK`` ids anywhere, also inside
a document. Every block is searched with array operations on its own; what a block
cannot know (how many ids came before it, and where the last separator before it was)
comes from a prefix scan over blocks: inside each shard first, then over one row per
shard. Blocks are never moved, only the positions of their separators are.

Texts travel to the range of their key in compressed packs, one or more for each task and
range; there Spark's sort puts them in order.

Files are Parquet rows ``shard, seq, ids (bytes), ends_of``; ``ends_of`` names the
documents that end in a block, in order, and carries no position. The search reads
``ids`` alone and finds the boundaries; the names are matched to them afterwards, and a
block whose separators and names differ in number fails the job.

Defined cases: null or empty text is its separator only (one id); special tokens' names
inside a text are read as plain text, so no text holds a separator; ids after the last
separator belong to no document and are not counted; a null key is a key like any other;
repeated rows are counted once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.llm import tokens
from roomledger.llm import words as w
from roomledger.session import checkpoint_dir, scratch_path

BLOCK = 1 << 16
LEAST_ROWS = 16  # rows per shard, on average at least
SAMPLED = 100  # keys per shard that its limits are taken from
PACK = 4 << 20  # bytes of text, about, that travel as one
HELD = 64 << 20  # bytes of text that a task collects before it sends them in packs
END_ID = 49_407  # the end-of-text id of the default tokenizer; no plain text encodes to it


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, collected per shard and compressed together."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()  # else the texts are there twice while they are packed
        shard = rows["shard"].to_numpy()
        order = np.argsort(shard, kind="stable")
        codec = pa.Codec("zstd", compression_level=3)
        for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            # A pack ends before the document that no longer fits.
            texts = [x.as_py() or b"" for x in rows["text"].take(pa.array(some))]
            full = np.cumsum([len(x) for x in texts]) // PACK
            for mine in np.split(np.arange(len(some)), np.flatnonzero(np.diff(full)) + 1):
                keys = rows["id"].take(pa.array(some[mine])).combine_chunks()
                columns = [
                    pa.array([shard[some[0]]], pa.int32()),
                    pa.ListArray.from_arrays([0, len(mine)], keys),
                    pa.array([rows["h"].to_numpy()[some[mine]]], pa.list_(pa.int64())),
                    pa.array([[len(texts[i]) for i in mine]], pa.list_(pa.int64())),
                    pa.array([codec.compress(b"".join(texts[i] for i in mine), asbytes=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "id", "h", "n", "packed"])

    for batch in batches:
        for part in w.slices(batch, "text", 1 << 20):
            columns = [part.column(c) for c in ("shard", "id", "h")] + [part.column("text").cast(pa.binary())]
            held.append(pa.RecordBatch.from_arrays(columns, names=["shard", "id", "h", "text"]))
            size += held[-1].nbytes
            if size >= HELD:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        for shard, keys, h, sizes, packed in zip(*batch.columns, strict=True):
            n = np.array(sizes.as_py())
            data = codec.decompress(packed.as_py(), int(n.sum()), asbytes=True)
            texts = [data[a:b].decode() for a, b in zip(np.cumsum(n) - n, np.cumsum(n), strict=True)]
            columns = [pa.array([shard.as_py()] * len(n), pa.int32()), keys.values, h.values, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "id", "h", "text"])


def _ranged(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``shard``, the number of their range of ``id, h``, and the number of ranges."""
    spark, count = rows.sparkSession, rows.count()
    checkpoint_dir(spark)
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // LEAST_ROWS))
    some = rows.select("id", "h").sample(min(1.0, SAMPLED * n / max(count, 1)), seed=7)
    parts = some.repartitionByRange(n, "id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "h")).alias("low"))
    # The ranges in groups of about the root of their number, so that a row is compared with few.
    lows = parts.agg(F.sort_array(F.collect_list("low")).alias("lows"))
    step = math.isqrt(n) + 1
    groups = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // step)), lambda i: F.slice("lows", i * step + 1, step))
    bounds = lows.select(F.filter(groups, lambda g: F.size(g) > 0).alias("groups")).checkpoint()
    key = F.struct("id", "h")
    group = F.greatest(F.size(F.filter("groups", lambda g: g[0] <= key)) - 1, F.lit(0))
    inside = F.size(F.filter(F.coalesce(F.get("groups", F.col("group")), F.array()), lambda low: low <= key)) - 1
    found = rows.crossJoin(F.broadcast(bounds)).withColumn("group", group)
    return found.withColumn("shard", F.greatest(F.col("group") * step + inside, F.lit(0))).drop("group", "groups"), n


def write_flat(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end: int = END_ID,
    block: int = BLOCK,
) -> None:
    """Writes the ids of all whole texts in ascending key order, nulls first; a shard is a range of keys."""
    file = tokenizer or tokens.tokenizer_file()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("h"))
    id_type = rows.schema["id"].dataType.simpleString()
    ranged, n_shards = _ranged(rows)
    packs = ranged.select("shard", "id", "h", "text").mapInArrow(
        _pack, f"shard int, id array<{id_type}>, h array<bigint>, n array<bigint>, packed binary"
    )
    whole = packs.repartitionById(n_shards, F.col("shard")).mapInArrow(_unpack, f"shard int, id {id_type}, h bigint, text string")
    ordered = whole.sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = tokens.encoder(file, plain=True), TaskContext.get().partitionId(), 0
        held = np.zeros(0, dtype="<u4")
        names: list[tuple[int, object]] = []  # position of the separator in ``held``, document

        def cut(n: int, kind: pa.DataType) -> pa.RecordBatch:
            nonlocal held, seq, names
            mine = [k for at, k in names if at < n]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([held[:n].tobytes()], pa.binary()),
                    pa.array([mine], pa.list_(kind)),
                ],
                names=["shard", "seq", "ids", "ends_of"],
            )
            held, names, seq = held[n:], [(at - n, k) for at, k in names[len(mine) :]], seq + 1
            return out

        kind = pa.null()
        for batch in batches:
            for part in w.slices(batch, "text", 1 << 20):
                kind = part.column(0).type
                ids, at = tokens.with_end(*encoder.encode(part.column(1)), end)
                names += zip((at[1:] - 1 + len(held)).tolist(), part.column(0).to_pylist(), strict=True)
                held = np.concatenate([held, ids.astype("<u4")])
                while len(held) >= block:
                    yield cut(block, kind)
        if len(held):
            yield cut(len(held), kind)

    schema = f"shard int, seq int, ids binary, ends_of array<{id_type}>"
    flat = ordered.mapInArrow(run, schema).write.option("compression", "zstd")
    flat.option("parquet.compression.codec.zstd.level", "6").parquet(path)


def separators(ids: np.ndarray, end: int = END_ID) -> np.ndarray:
    """Positions just after every separator of a block."""
    return np.flatnonzero(ids == end) + 1


def scan(blocks: DataFrame, end: int = END_ID) -> DataFrame:
    """``shard, seq, start, n_tokens``: a row per document that ends in a block, with ``ends_of`` if given.

    ``blocks`` has ``shard, seq, ids``. Shards and blocks are numbered in the order of the stream.
    """
    named = "ends_of" in blocks.columns
    source = blocks.select("shard", "seq", "ids", *(["ends_of"] if named else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py() or b"", dtype="<u4") for x in batch.column(2)]
            found = [separators(x, end) for x in ids]
            cuts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *found]).astype(np.int64)
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n, pa.ListArray.from_arrays(cuts, pa.array(flat)), *batch.columns[3:]],
                names=["shard", "seq", "n", "ends", *(["ends_of"] if named else [])],
            )

    more = f", ends_of {blocks.schema['ends_of'].dataType.simpleString()}" if named else ""
    checkpoint_dir(blocks.sparkSession)
    seen = source.mapInArrow(run, f"shard int, seq int, n bigint, ends array<bigint>{more}").checkpoint()
    order = Window.partitionBy("shard").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", F.lit(-1)))
    based = seen.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last", last)
    inside = based.withColumn("prev", F.max("last").over(before))
    # One row per shard.
    shards = based.groupBy("shard").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.withColumn("s_base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    carry = carry.select(
        F.col("shard").alias("s"),
        "s_base",
        F.coalesce(F.max(F.col("s_base") + F.col("last")).over(earlier), F.lit(0)).alias("s_prev"),
    )
    placed = inside.join(F.broadcast(carry), F.col("shard") == F.col("s")).select(
        "shard",
        "seq",
        F.coalesce(F.col("s_base") + F.col("prev"), F.col("s_prev")).alias("prev"),
        F.transform("ends", lambda e: e + F.col("s_base") + F.col("base")).alias("upto"),
        *(["ends_of"] if named else []),
    )
    if named:
        wrong = F.size("ends_of") != F.size("upto")
        placed = placed.withColumn("upto", F.when(wrong, F.raise_error(F.lit("separators and documents differ"))).otherwise(F.col("upto")))
    begins = F.concat(F.array("prev"), F.slice("upto", 1, F.greatest(F.size("upto") - 1, F.lit(0))))
    spans = F.arrays_zip(
        F.when(F.size("upto") > 0, begins).otherwise(F.array().cast("array<bigint>")).alias("start"),
        F.col("upto").alias("upto"),
        *([F.col("ends_of")] if named else []),
    )
    return placed.select("shard", "seq", F.inline(spans)).select(
        "shard", "seq", "start", (F.col("upto") - F.col("start")).alias("n_tokens"), *(["ends_of"] if named else [])
    )


def flat_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``shard, seq, ids`` of raw little-endian 32-bit files; a shard is a file, in path order.

    Spark hands a binary file over whole, so a file must stay below 2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    paths = files.select("path").distinct()
    numbered = paths.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("shard"))  # one row per file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                parts = [data[a : a + 4 * block] for a in range(0, len(data), 4 * block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                    names=["shard", "seq", "ids"],
                )

    return files.join(numbered, "path").select("shard", "content").mapInArrow(run, "shard int, seq int, ids binary")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes flat files in the shared folder and returns ``doc_id, start, n_tokens`` read off them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "flat")
    write_flat(docs, path, key, text)
    found = scan(spark.read.parquet(path))
    return found.select(F.col("ends_of").alias("doc_id"), "start", "n_tokens")
