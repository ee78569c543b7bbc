"""Removal of repeated word windows by super-k-mers, packed strings dealt by minimiser.

A *window* is ``window`` consecutive words of one document; its *minimiser* is the least
hash among the runs of ``gram`` words inside it. Equal windows have equal minimisers, so
they meet in one bucket. Neighbouring windows mostly share their minimiser; such a stretch
is a *super-k-mer* and travels to its bucket as one string of packed words instead of a
string per window. In its bucket the windows of all strings are sorted, and each distinct
window gets the least document id that holds it. A word goes if a window over it is also
in a document with a smaller id.

Steps, each spread by Spark:

1. Per document the minimisers of its super-k-mers. Those seen under one document id only
   are settled: none of their windows is repeated elsewhere, and their words never travel.
2. The shared ones are marked in their documents, which pack their strings. Equal strings
   of a batch are merged before the shuffle, so a group of copies sends each string once
   per batch, not once per copy.
3. Buckets are read in sorted order, some megabytes at a time. A string's result is its
   owner (the least id that holds it) and the windows whose least id is smaller still.
4. Each occurrence looks its string up: under a greater id than the owner's all its windows
   are repeated, under the owner's own those that the bucket found. Ranges of windows come
   back to their documents, which drop the words.

A minimiser of ``hot`` or more super-k-mers does not share one bucket: its windows travel
one by one, each in a bucket of its own, where only equal strings meet and are merged as
they are read. So no group is held whole, however many documents share a passage.

Words are compared as bytes in the buckets. A string is named by 128 bits of hash between
steps 3 and 4, a document by its id and a 64-bit hash of its text.

Defined cases: null and empty text has no words and keeps an empty text; a null id counts
as greater than every other id; rows with one id do not remove windows from each other,
and equal rows give equal results; other columns are not read; an empty table gives an
empty result. Ids may be integers or strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm import words as w
from roomledger.session import checkpoint_dir

WINDOW = 50
GRAM = 12
LONGEST = 256  # windows in one packed string
HOT = 50_000
CHUNK = 8 << 20  # bytes of packed strings sorted at a time
BROADCAST_CELLS = 2_000_000  # rows and list entries of a side that is broadcast

_U = np.uint64
_SECOND = 0xD1342543DE82EF95
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)


class Strings(NamedTuple):
    """Super-k-mers of a batch: first word and windows of each, its minimiser, the rows' places."""

    first: np.ndarray
    count: np.ndarray
    least: np.ndarray
    rows: np.ndarray


def super_kmers(seg: w.Segments, window: int, gram: int) -> Strings:
    """Stretches of at most ``LONGEST`` windows of one row with one minimiser."""
    hashes, begin = w.windows(seg.hash, seg.rows, gram)
    span = window - gram + 1
    at_word = np.full(len(seg.hash) + 1, np.iinfo(np.uint64).max, dtype=_U)
    at_word[begin] = hashes
    # Least of ``span`` neighbours, by doubling.
    least, width = at_word[:-1], 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    of = w.row_of(seg.rows)
    starts = np.flatnonzero(np.arange(len(of)) + window <= seg.rows[1:][of]) if len(of) else np.zeros(0, dtype=np.int64)
    least = least[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    # Long stretches, as in periodic texts, are cut.
    head = np.flatnonzero(new)
    offset = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    new |= offset % LONGEST == 0
    head = np.flatnonzero(new)
    first = starts[head]
    return Strings(first, np.diff(np.append(head, len(starts))), least[head].view(np.int64), np.searchsorted(first, seg.rows))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def names_of(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of words, from running sums."""
    out = []
    with np.errstate(over="ignore"):
        for base, inverse, salt in ((w._BASE, w._INVERSE, 0), (_SECOND, _SECOND_INVERSE, 0x5851F42D4C957F2D)):
            total = np.zeros(len(hashes) + 1, dtype=_U)
            np.cumsum((hashes ^ _U(salt)) * _powers(base, len(hashes)), out=total[1:])
            down = _powers(inverse, len(hashes))
            got = (total[first + size] - total[first]) * down[np.minimum(first, len(down) - 1)]
            out.append(w.mix(got + size.astype(_U)).view(np.int64))
    return out[0], out[1]


def _packed(data: np.ndarray, seg: w.Segments, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words of each run, joined by one space."""
    # All words once, each with a space behind it; a run is a slice without its last byte.
    length = seg.end - seg.start
    at = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[seg.start] += 1
    inside[seg.end] -= 1
    keep = np.ones(len(out), dtype=bool)
    keep[at[1:] - 1] = False
    out[keep] = data[np.cumsum(inside[:-1]).astype(bool)]
    raw = out.tobytes()
    lo, hi = at[first].tolist(), (at[first + size] - 1).tolist()
    return pa.array([raw[a:b] for a, b in zip(lo, hi, strict=True)], pa.binary())


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text")
    )


def minimisers(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Per document with a window: id, text hash and the minimisers of its super-k-mers, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                seg = w.segments(*w.buffers(part.column(2)))
                found = super_kmers(seg, window, gram)
                some = pa.array(np.flatnonzero(np.diff(found.rows)))
                lists = pa.ListArray.from_arrays(pa.array(found.rows.astype(np.int32)), pa.array(found.least))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(some), part.column(1).take(some), lists.take(some)], names=["id", "h", "least"]
                )

    schema = T.StructType([rows.schema["id"], rows.schema["h"], T.StructField("least", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def shared(mins: DataFrame, hot: int) -> DataFrame:
    """Minimisers under two ids or more, and whether they are hot."""
    rows = mins.select("id", F.explode("least").alias("least"))
    seen = rows.groupBy("least").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("unnamed"), F.count("*").alias("n")
    )
    several = (F.col("lo") != F.col("hi")) | (F.col("unnamed") & F.col("lo").isNotNull())
    return seen.filter(several).select("least", (F.col("n") >= hot).alias("hot"))


def _with(rows: DataFrame, side: DataFrame, entries: str, how: str) -> DataFrame:
    """Documents with the stored narrow row of the same id and text.

    The side is broadcast, so that texts stay where they are, only if all its rows and
    list entries are few; else both sides are shuffled.
    """
    cells = side.agg(F.sum(F.size(entries) + 1)).first()[0] or 0
    side = side.withColumnsRenamed({"id": "__id", "h": "__h"})
    if cells <= BROADCAST_CELLS:
        side = F.broadcast(side)
    return rows.join(side, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), how)


def marked(mins: DataFrame, several: DataFrame) -> DataFrame:
    """Per document: places of its shared super-k-mers, negative minus one where hot."""
    rows = mins.select("id", "h", F.posexplode("least").alias("at", "least"))
    return (
        rows.join(several, "least")
        .groupBy("id", "h")
        .agg(F.collect_set(F.when(F.col("hot"), -F.col("at") - 1).otherwise(F.col("at"))).alias("marks"))
    )


class _Marked(NamedTuple):
    seg: w.Segments
    data: np.ndarray
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    least: np.ndarray
    hot: np.ndarray


def _strings(part: pa.RecordBatch, window: int, gram: int) -> _Marked:
    """The marked super-k-mers of a batch (id, h, text, marks); hot ones window by window."""
    data, at = w.buffers(part.column(2))
    seg = w.segments(data, at)
    found = super_kmers(seg, window, gram)
    marks = part.column(3)
    sizes = marks.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    mark = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    hot = mark < 0
    k = found.rows[row] + np.where(hot, -mark - 1, mark)
    first, count, least = found.first[k], found.count[k], found.least[k]
    times = np.where(hot, count, 1)
    begin = np.repeat(np.cumsum(times) - times, times)
    inner = np.arange(len(begin)) - begin
    again = lambda x: np.repeat(x, times)
    return _Marked(seg, data, again(row), again(first) + inner, again(np.where(hot, 1, count)), again(least), again(hot))


def _order(ids: pa.Array) -> np.ndarray:
    """Ranks of ids, nulls last."""
    values = ids.to_pylist()
    rank = {x: k for k, x in enumerate(sorted({x for x in values if x is not None}))}
    return np.array([len(rank) if x is None else rank[x] for x in values], dtype=np.int64)


def packed(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Packed strings on their way to the buckets: one per batch, with the least id of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                x = _strings(part, window, gram)
                if not len(x.row):
                    continue
                size = x.count + window - 1
                a, b = names_of(x.seg.hash, x.first, size)
                rank = _order(part.column(0))[x.row]
                order = np.lexsort((rank, b, a))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
                one = order[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x.least[one]),
                        pa.array(np.where(x.hot[one], a[one], 0)),
                        pa.array(a[one]),
                        pa.array(b[one]),
                        part.column(0).take(pa.array(x.row[one])),
                        _packed(x.data, x.seg, x.first[one], size[one]),
                    ],
                    names=["least", "sub", "a", "b", "id", "words"],
                )

    longs = [T.StructField(x, T.LongType()) for x in ("least", "sub", "a", "b")]
    schema = T.StructType([*longs, rows.schema["id"], T.StructField("words", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def occurrences(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Where each string stands: narrow rows, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                x = _strings(part, window, gram)
                a, b = names_of(x.seg.hash, x.first, x.count + window - 1)
                row = pa.array(x.row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row),
                        part.column(1).take(row),
                        pa.array(a),
                        pa.array(b),
                        pa.array((x.first - x.seg.rows[x.row]).astype(np.int32)),
                        pa.array(x.count.astype(np.int32)),
                    ],
                    names=["id", "h", "a", "b", "start", "count"],
                )

    fields = [rows.schema["id"], rows.schema["h"], T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]
    ints = [T.StructField(x, T.IntegerType()) for x in ("start", "count")]
    return rows.mapInArrow(run, T.StructType([*fields, *ints]))


def _merge_equal(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Each string of a bucket once, with its least id's rank; rows arrive sorted by bucket and name."""
    rank = _order(table.column("id").combine_chunks())
    keys = [table.column(x).to_numpy() for x in ("least", "sub", "a", "b")]
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(new)
    lowest = np.minimum.reduceat(rank, head)
    # The row that holds the least id stands for the string.
    group = np.cumsum(new) - 1
    at = np.flatnonzero(rank == lowest[group])
    pick = at[np.unique(group[at], return_index=True)[1]]
    return table.take(pa.array(pick)), rank[pick]


def repeats(table: pa.Table, window: int) -> tuple[pa.Table, list[np.ndarray]]:
    """Strings of whole buckets, and for each the windows that a smaller id than its owner's holds."""
    table, owner = _merge_equal(table)
    data, at = w.buffers(table.column("words").combine_chunks())
    seg = w.segments(data, at)
    hashes, begin = w.windows(seg.hash, seg.rows, window)
    string = w.row_of(seg.rows)[begin] if len(begin) else begin
    bucket = np.zeros(table.num_rows, dtype=np.int64)
    least, sub = table.column("least").to_numpy(), table.column("sub").to_numpy()
    bucket[1:] = np.cumsum((least[1:] != least[:-1]) | (sub[1:] != sub[:-1]))
    order = np.lexsort((owner[string], hashes, bucket[string]))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (bucket[string[order]][1:] == bucket[string[order]][:-1])
    raw = data.tobytes()
    group = np.cumsum(~same) - 1
    head = np.flatnonzero(~same)
    found: list[list[int]] = [[] for _ in range(table.num_rows)]
    lo, hi = seg.start, seg.end
    # Only windows that two owners hold, by their hash, are compared as bytes.
    least_owner = owner[string[order[head]]]
    several = np.zeros(len(head), dtype=bool)
    several[group[owner[string[order]] > least_owner[group]]] = True
    content: dict[bytes, int] = {}
    last = -1
    for k in np.flatnonzero(several[group]).tolist():
        if group[k] != last:
            last, content = group[k], {}
        at_window, s = order[k], string[order[k]]
        value = raw[lo[begin[at_window]] : hi[begin[at_window] + window - 1]]
        if content.setdefault(value, owner[s]) < owner[s]:
            found[s].append(begin[at_window] - seg.rows[s])
    return table, [np.array(x, dtype=np.int64) for x in found]


def owners(strings: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """Per string its name, owner, and the windows that are repeated even for the owner."""
    kind = strings.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("a", T.LongType()),
            T.StructField("b", T.LongType()),
            T.StructField("owner", kind),
            T.StructField("windows", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            table, found = repeats(table, window)
            return pa.RecordBatch.from_arrays(
                [
                    table.column("a").combine_chunks(),
                    table.column("b").combine_chunks(),
                    table.column("id").combine_chunks(),
                    pa.array([x.tolist() for x in found], pa.list_(pa.int32())),
                ],
                names=schema.names,
            )

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < chunk:
                continue
            # Equal strings are merged first, so that a bucket of copies stays small.
            table = pa.Table.from_batches(held)
            least, sub = table.column("least").to_numpy(), table.column("sub").to_numpy()
            open_ = int(np.flatnonzero((least != least[-1]) | (sub != sub[-1])).max(initial=-1)) + 1
            if open_:
                yield solve(table.slice(0, open_))
            rest, _ = _merge_equal(table.slice(open_))
            held, size = rest.to_batches(), 0
        if held:
            yield solve(pa.Table.from_batches(held))

    ordered = strings.repartition("least", "sub").sortWithinPartitions("least", "sub", "a", "b")
    return ordered.select("least", "sub", "a", "b", "id", "words").mapInArrow(run, schema)


def repeated_ranges(places: DataFrame, owned: DataFrame) -> DataFrame:
    """Per document the windows to act on: structs of first word, windows, and those meant (null: all)."""
    rows = places.join(owned, ["a", "b"])
    greater = F.col("owner").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("owner")))
    windows = F.when(~greater, F.col("windows"))
    return (
        rows.filter(greater | (F.size("windows") > 0))
        .select("id", "h", F.struct("start", "count", windows.alias("windows")).alias("range"))
        .groupBy("id", "h")
        .agg(F.collect_set("range").alias("ranges"))
    )


def _removed(n: int, ranges: list[dict], window: int) -> np.ndarray:
    steps = np.zeros(n + 1, dtype=np.int64)
    for r in ranges:
        if r["windows"] is None:
            steps[r["start"]] += 1
            steps[r["start"] + r["count"] - 1 + window] -= 1
        else:
            at = r["start"] + np.array(r["windows"], dtype=np.int64)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + window, -1)
    return np.cumsum(steps[:-1]) > 0


def dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    hot: int = HOT,
    chunk: int = CHUNK,
) -> DataFrame:
    """Key, ``n_words``, ``n_removed``, ``removed`` (word ranges, end exclusive) and ``kept``, one row per document."""
    checkpoint_dir(docs.sparkSession)
    rows = _documents(docs, key, text)
    mins = minimisers(rows, window, gram).checkpoint()
    several = shared(mins, hot).checkpoint()
    marks = marked(mins, several).checkpoint()
    chosen = _with(rows, marks, "marks", "inner").select("id", "h", "text", "marks")
    owned = owners(packed(chosen, window, gram), window, chunk).checkpoint()
    ranges = repeated_ranges(occurrences(chosen, window, gram), owned).checkpoint()
    found = _with(rows, ranges, "ranges", "left").select("id", "text", "ranges")
    span = pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])
    schema = T.StructType(
        [
            found.schema["id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField(
                "removed",
                T.ArrayType(T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "end")]), False),
            ),
            T.StructField("kept", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                sizes, gone, spans, texts = [], [], [], []
                for value, todo in zip(part.column(1), part.column(2), strict=True):
                    buffer = value.as_buffer()
                    words = buffer.to_pybytes().split() if buffer is not None else []
                    mine: list[dict] = []
                    kept, lost = words, 0
                    if todo.is_valid:
                        flags = np.concatenate([[False], _removed(len(words), todo.as_py(), window), [False]])
                        edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
                        mine = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                        lost = int(flags.sum())
                        kept = [words[k] for k in np.flatnonzero(~flags[1:-1]).tolist()]
                    sizes.append(len(words))
                    gone.append(lost)
                    spans.append(mine)
                    texts.append(b" ".join(kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(spans, pa.list_(pa.field("element", span, False))),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return found.mapInArrow(run, schema).withColumnRenamed("id", key)
