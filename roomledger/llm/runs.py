"""Maximal periodic runs of words, from suffix trees of a document and of its reversal.

A *run* of period ``q`` is a stretch of words with smallest period ``q`` that neither
neighbour extends. Every run holds a Lyndon root that is the longest Lyndon word at its
place under one of the two orders of words, the usual one or its inverse; both come from
the suffix order (the next smaller and the next greater suffix). So there are at most two
candidates ``(i, q)`` per word, and each is extended to both sides by one longest common
extension: forwards in the suffix tree of the words, backwards in that of the reversal.
The trees are built by Ukkonen's algorithm. Their Euler tour, folded to one entry per
leaf (the least depth met since the leaf before), makes a lowest common ancestor a range
minimum, which a sparse table answers in constant time for all candidates at once.

Only what can hold a run is given to the trees. In a run of length ``max(6, 4 q)`` or more
each three-word window occurs three times or more, so runs lie inside the stretches of
such windows; the test is repeated inside each stretch until it removes nothing. A run
cannot pass the end of its stretch, so nothing is lost or cut. Words are numbered exactly,
not hashed.

Every document is worked on by itself, inside the task that reads it: no shuffle, and
memory in proportion to one document.

Defined cases: null and empty text has no words, no runs and an empty ``collapsed``; null
and repeated keys are rows like any other; columns besides key and text are not read, and
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm import words as w

LEAST_LENGTH = 6
LEAST_TURNS = 4
RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
_ARROW_RUN = pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")])


class SuffixTree:
    """Suffix tree of a sequence of positive numbers; 0 is its end mark."""

    def __init__(self, symbols: list[int]):
        self.text = [*symbols, 0]
        self.n = len(symbols)
        self._grow()
        self._tour()

    def _grow(self) -> None:
        """Ukkonen: suffix links, one phase per symbol, leaves that reach to the end from the start."""
        s, size = self.text, len(self.text)
        base = max(s) + 1
        first, last, link = [0], [0], [0]
        edge: dict[int, int] = {}  # node * base + first symbol -> child
        node = at = length = left = 0
        for i, symbol in enumerate(s):
            left += 1
            waiting = 0
            while left:
                if not length:
                    at = i
                key = node * base + s[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(first)
                    first.append(i)
                    last.append(size)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    span = last[child] - first[child]
                    if length >= span:
                        node, at, length = child, at + span, length - span
                        continue
                    begin = first[child]
                    middle = s[begin + length]
                    if middle == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    split = len(first)
                    first += (begin, i)
                    last += (begin + length, size)
                    link += (0, 0)
                    edge[key] = split
                    edge[split * base + symbol] = split + 1
                    first[child] = begin + length
                    edge[split * base + middle] = child
                    if waiting:
                        link[waiting] = split
                    waiting = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - left + 1
        self._edges, self._base, self._first, self._last = edge, base, first, last

    def _tour(self) -> None:
        """Leaves in the order of their suffixes, with the least depth between neighbours."""
        nodes = len(self._first)
        keys = np.fromiter(self._edges.keys(), dtype=np.int64, count=nodes - 1)
        ends = np.fromiter(self._edges.values(), dtype=np.int64, count=nodes - 1)
        order = np.argsort(keys)
        children = ends[order].tolist()
        begin = np.searchsorted(keys[order] // self._base, np.arange(nodes + 1)).tolist()
        span = (np.array(self._last) - np.array(self._first)).tolist()
        depth = [0] * nodes
        leaves: list[int] = []
        between: list[int] = []
        low = 0
        # A negative entry is a child that is not its parent's first: the tour comes back
        # to the parent before it.
        stack = [(0, 0)]
        while stack:
            node, over = stack.pop()
            if node < 0:
                node = -node
                low = over
            here = over + span[node]
            lo, hi = begin[node], begin[node + 1]
            if lo == hi:
                depth[node] = here
                leaves.append(here)
                between.append(low)
            else:
                stack.extend((-child, here) for child in children[hi - 1 : lo : -1])
                stack.append((children[lo], here))
        size = len(self.text)
        suffix = size - np.array(leaves)
        self.rank = np.empty(size, dtype=np.int64)
        self.rank[suffix] = np.arange(size)
        table = [np.array(between, dtype=np.int32)]
        step = 1
        while 2 * step <= size:
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        self._table = table
        del self._edges, self._first, self._last

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at ``i`` and ``j``, ``i != j``."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1  # floor(log2)
        out = np.zeros(len(lo), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self._table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
        return out


def _next_beyond(rank: list[int], size: int) -> np.ndarray:
    """For each place the next one with a smaller number, ``size`` if there is none."""
    out, stack = [size] * size, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def _runs_of_stretch(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids)
    symbols = (np.unique(ids, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(symbols)
    rank = tree.rank
    places = np.arange(n)
    ends = [_next_beyond(r.tolist(), n + 1)[:n] for r in (rank, -rank)]
    i, end = np.tile(places, 2), np.concatenate(ends)
    period = end - i
    fits = (end < n) & (LEAST_TURNS * period <= n)
    i, period = i[fits], period[fits]
    forward = tree.common(i, i + period)
    # The root in the run's first turn has at least two more turns to its right.
    far = forward >= 2 * period
    i, period, forward = i[far], period[far], forward[far]
    if not len(i):
        return i, i, i
    back = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(i > 0)
    if len(inner):
        mirror = SuffixTree(symbols[::-1])
        back[inner] = mirror.common(n - i[inner], n - i[inner] - period[inner])
    start, length = i - back, back + period + forward
    enough = length >= np.maximum(LEAST_LENGTH, LEAST_TURNS * period)
    found = np.unique(np.stack([start[enough], period[enough], length[enough]]), axis=1)
    return found[0], found[2], found[1]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges outside of which no run lies."""
    out, todo = [], [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST_LENGTH:
            continue
        part = ids[lo:hi]
        base = int(part.max()) + 1
        pair = part[:-1] * base + part[1:]
        if base**3 >= 2**62:
            pair = np.unique(pair, return_inverse=True)[1]
        _, at, count = np.unique(pair[:-1] * base + part[2:], return_inverse=True, return_counts=True)
        flags = np.concatenate([[False], count[at] >= 3, [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + 2 == hi - lo:
                out.append((lo, hi))
            else:
                todo.append((lo + a, lo + b + 2))
    return out


def runs_of(words: list) -> np.ndarray:
    """All runs of a list of words: columns start, length, period, by start, then period."""
    table: dict = {}
    ids = np.fromiter((table.setdefault(x, len(table)) for x in words), dtype=np.int64, count=len(words))
    found = []
    for lo, hi in stretches(ids):
        start, length, period = _runs_of_stretch(ids[lo:hi])
        found.append(np.stack([start + lo, length, period], axis=1))
    every = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the text without repeated turns.

    A word is left out if a run contains it after that run's first period; the words that
    stay are joined by one space.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN, False)),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                sizes, runs, texts = [], [], []
                for value in part.column(1):
                    buffer = value.as_buffer()
                    words = buffer.to_pybytes().split() if buffer is not None else []
                    found = runs_of(words)
                    sizes.append(len(words))
                    runs.append(found)
                    texts.append(b" ".join(_kept(words, found)))
                at = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
                flat = np.concatenate(runs)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_ARROW_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at), values, type=pa.list_(pa.field("element", _ARROW_RUN, False))),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


def longest(runs: str = "runs") -> Column:
    """The run of greatest length; ties by smallest start, then period. Null without a run."""
    return F.expr(
        f"""array_max(transform({runs}, r -> named_struct('length', r.length, 'before', -r.start, 'short', -r.period)))"""
    )
