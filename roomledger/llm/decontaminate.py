"""Benchmark decontamination: documents that repeat a benchmark item up to a few edits.

A document is contaminated by an item if one of its runs of words is within
``floor(MAX_EDITS * words of the item)`` word edits of the item (A-Z read as a-z).

The search embeds runs of words by a CGK random walk: a pointer starts at the run's first
word, each step writes the word under the pointer and then, by a random bit of (step,
word), moves on or stays. Few edits change few of the written symbols, as the walks fall
into step again, so edit distance becomes Hamming distance. Sampling a few steps of the
walk gives a hash; equal hashes in any of ``REPEATS`` independent walks make a candidate.
Windows have a size for the item's class, start at every item offset, and at every
``stride``-th word of a document, so every full-size passage is met by windows that are
aligned with one of the item's; an item has several, so one edit cannot hide it. Sizes,
strides and samples are set per class so that an item with the most edits allowed, at
random places, is found with a chance of at least ``TARGET_RECALL``.
Candidates are verified by the exact edit distance of the item to the surrounding words.

One pass over the documents, no shuffle: each task holds the items' keys. Those are
bounded by ``MAX_WORDS`` item words per pass; a larger benchmark is split by item over as
many passes as it needs. Nothing is capped.

Defined cases: null or empty documents and items match nothing; repeated rows are judged
alike; items with the same text or id are kept apart; an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from roomledger.llm import words as w

MAX_EDITS = 0.2
REPEATS = 4
TARGET_RECALL = 0.95  # least recall at the edit limit for every item size; the test measures it
MAX_WORDS = 500_000
SEED = 90_001


class Class(NamedTuple):
    """Items of at least ``least`` words are found by windows of ``size`` words."""

    least: int
    size: int
    stride: int
    steps: int
    samples: int


CLASSES = (Class(18, 8, 2, 16, 6), Class(12, 6, 2, 12, 5), Class(4, 3, 1, 6, 3), Class(1, 1, 1, 2, 1))

_U = np.uint64


class Items(NamedTuple):
    ids: list
    hashes: np.ndarray
    rows: np.ndarray
    tables: list[tuple[Class, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]


def walk(hashes: np.ndarray, starts: np.ndarray, kind: Class, repeat: int) -> np.ndarray:
    """The sampled hash of the walk from every start; beyond the window all symbols are 0."""
    picks = np.random.default_rng([SEED, kind.size, repeat])
    sampled = set(picks.choice(kind.steps, kind.samples, replace=False).tolist())
    coins = w.mix(hashes + _U(SEED + 131 * repeat + kind.size))
    at = starts.copy()
    end = starts + kind.size
    key = np.full(len(starts), _U(repeat * len(CLASSES) + kind.size))
    last = len(hashes) - 1
    with np.errstate(over="ignore"):
        for step in range(max(sampled) + 1):
            inside = at < end
            here = np.minimum(at, last)
            if step in sampled:
                key = (key ^ np.where(inside, hashes[here], _U(0))) * _U(0xD6E8FEB86659FD93)
                key ^= key >> _U(32)
            at += inside & ((coins[here] >> _U(step)) & _U(1)).astype(bool)
    return w.mix(key)


def _starts(rows: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Window starts at every ``stride``-th word of each row that leave room for a window."""
    count = np.maximum((np.diff(rows) - size) // stride + 1, 0)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(rows[:-1] - stride * (ends - count), count) + stride * np.arange(total)


def index(ids: list, texts: list[str]) -> Items:
    """Search tables of some items."""
    found = w.segments(*w.buffers(pa.array(texts, pa.string())), lower=True)
    n_words = np.diff(found.rows)
    tables, most = [], None
    for kind in CLASSES:
        mine = (n_words >= kind.least) & (n_words < (most or np.inf))
        most = kind.least
        starts = _starts(found.rows, kind.size, 1)
        owner = np.searchsorted(found.rows, starts, side="right") - 1
        starts, owner = starts[mine[owner]], owner[mine[owner]]
        if not len(starts):
            continue
        repeats = []
        for r in range(REPEATS if kind.samples > 1 else 1):
            keys = walk(found.hash, starts, kind, r)
            order = np.argsort(keys, kind="stable")
            bits = max(12, math.ceil(math.log2(16 * len(keys))))
            seen = np.zeros(1 << bits, dtype=bool)
            seen[keys & _U((1 << bits) - 1)] = True
            repeats.append((keys[order], owner[order], (starts - found.rows[owner])[order], seen))
        tables.append((kind, repeats))
    return Items(ids, found.hash, found.rows, tables)


def edits(item: np.ndarray, region: np.ndarray) -> int:
    """Least number of word edits that turn ``item`` into some run of ``region``."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for symbol in item:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (region != symbol))
        row = np.minimum.accumulate(step - place) + place
    return int(row.min())


def matches(texts: pa.Array, items: Items) -> list[tuple[int, int, int]]:
    """``(row, item, edits)`` for every contaminated row and item, least edits first found."""
    found = w.segments(*w.buffers(texts), lower=True)
    if not len(found.hash):
        return []
    hits = []
    for kind, repeats in items.tables:
        starts = _starts(found.rows, kind.size, kind.stride)
        if not len(starts):
            continue
        for r, (keys, owner, offset, seen) in enumerate(repeats):
            mine = walk(found.hash, starts, kind, r)
            near = np.flatnonzero(seen[mine & _U(len(seen) - 1)])
            low = np.searchsorted(keys, mine[near])
            count = np.searchsorted(keys, mine[near], side="right") - low
            which = np.repeat(np.arange(len(near)), count)
            slot = np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(which))
            at = starts[near][which]
            row = np.searchsorted(found.rows, at, side="right") - 1
            hits.append(np.stack([row, owner[slot], at - offset[slot]]))
    if not hits:
        return []
    # Candidates of one row and item lie on diagonals; each is verified once.
    candidates = np.unique(np.concatenate(hits, axis=1), axis=1)
    best: dict[tuple[int, int], int] = {}
    done: tuple[int, int, int] | None = None
    for row, item, at in candidates.T.tolist():
        text = items.hashes[items.rows[item] : items.rows[item + 1]]
        most = int(MAX_EDITS * len(text))
        if best.get((row, item), most + 1) == 0 or (done and done[:2] == (row, item) and at <= done[2]):
            continue
        lo = max(at - most, found.rows[row])
        hi = min(at + len(text) + 2 * most, found.rows[row + 1])
        n = edits(text, found.hash[lo:hi])
        # The region allows this shift, so the next diagonals up to it need no second look.
        done = (row, item, at)
        if n <= most and n < best.get((row, item), most + 1):
            best[row, item] = n
    return [(row, item, n) for (row, item), n in best.items()]


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in groups of about ``MAX_WORDS`` words, each small enough for every task."""
    rows = benchmark.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    groups = max(1, math.ceil(size / MAX_WORDS))
    for g in range(groups):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g) if groups > 1 else rows
        taken = sorted(part.collect(), key=lambda r: (str(r[0]), r[1]))
        if taken:
            yield index([r[0] for r in taken], [r[1] for r in taken])


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``doc_id, item_id, edits`` for every contaminated document and item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int"
    out = spark.createDataFrame([], schema)
    for items in indexes(benchmark, item):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in w.slices(batch, "text"):
                    got = matches(part.column(1), items)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([r for r, _, _ in got], pa.int64())),
                            pa.array([items.ids[i] for _, i, _ in got], item_type),
                            pa.array([n for _, _, n in got], pa.int32()),
                        ],
                        names=["doc_id", "item_id", "edits"],
                    )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that no item contaminates, columns as given."""
    at = docs.columns.index(text)
    for items in indexes(benchmark, item):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in w.slices(batch, text):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[r for r, _, _ in matches(part.column(at), shared.value)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
