"""Near-duplicate classes by BagMinHash signatures over five-word shingles.

A text is the multiset of its five-word shingles (a shorter text is one shingle of all
its words); similarity is weighted Jaccard, the sum of the smaller counts over the sum
of the larger ones. Texts belong to one class if a chain of pairs with similarity of at
least ``SIMILARITY`` joins them.

Signature. Each slot of a signature holds the earliest point of a Poisson process over
(weight, time), so two slots agree with probability equal to the similarity. All
slots share one process per shingle whose points pick a slot each, and the weight axis
is discretised and split into levels [0,1), [1,2), [2,4), [4,8), ...: a shingle with
count c runs the levels below c, and in the level that holds c only points below c
count. Points come in order of time and a process stops at the text's largest slot
minimum, so a text of n shingles costs about n + slots * log(slots) points, however
large the counts are.

Banding. ``BANDS`` bands of ``ROWS`` slots; two texts of similarity 0.8 miss all bands
with probability 3e-6. Every two texts of different classes that share a bucket are
compared, in three rounds whose links are verified on the exact multisets and join
classes. First every text meets one hub. Then every text meets the one partner of another
class whose sketch agrees most with its own, over all its buckets. Both rounds verify at
most one pair per text. Last, what still holds several classes is compared whole: small
buckets give all pairs of different classes; a large one that a task can hold goes there
whole, one row per member; the members of still larger ones are dealt to
blocks, each two blocks meet in one task, and a task compares sketches, verifies on
the shingles themselves and gives a spanning forest of the links it finds. So the links
that leave a task are fewer than its members, and no pair of texts is written for a large
bucket. A bucket's largest class is met by the others only, so a large class with a few
strangers costs no square. A large group without links does cost one, in sketches
compared inside tasks.

Exact copies are one node (128-bit digest of the text), whatever their number. Candidate
pairs first compare 8 bits of each slot; pairs estimated below ``ESTIMATE`` (almost five
standard deviations under the limit) are dropped before their shingles are compared. Links,
classes and digests stay in Spark; small tables are broadcast only after a count.

Defined cases: a text without words (null, empty, white space) is a class of its own;
repeated rows and null ids are judged by their text; a class is named by its smallest
doc_id (null only if all are); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm import words as w
from roomledger.session import ROWS_PER_PARTITION, checkpoint_dir

SHINGLE = 5
SIMILARITY = 0.8
ESTIMATE = 0.65
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
SMALL_BUCKET = 8
# The driver holds a broadcast several times while it is built: as rows, as a map, in pieces.
BROADCAST_NODES = 100_000  # 16-byte digests
BROADCAST_BYTES = 8 << 20
TASK_LINKS = 1 << 20  # links whose chains one task follows, in some 200 MB
BLOCK = 2048  # members of a large bucket that one side of a task holds
BLOCK_SHINGLES = 1 << 20  # their shingles; a longer text has a side to itself but for hash chance
SLICE = 1 << 20  # bytes of text that are signed at once

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, and the row offsets."""
    found = w.segments(*w.buffers(texts))
    hashes, begin = w.windows(found.hash, found.rows, SHINGLE)
    n_words = np.diff(found.rows)
    row = w.row_of(found.rows)[begin]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        whole = np.array(
            [w.mix(np.bitwise_xor.reduce(w.mix(found.hash[found.rows[r] : found.rows[r + 1]] + np.arange(k, dtype=_U)), keepdims=True))[0]
             for r, k in zip(short, n_words[short], strict=True)],
            dtype=_U,
        )
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, whole])
        order = np.argsort(row, kind="stable")
        row, hashes = row[order], hashes[order]
    return hashes, np.searchsorted(row, np.arange(len(n_words) + 1))


def _levels(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The processes to run: row, seed, rate per slot, and the share of points that count."""
    row = w.row_of(rows)
    seeds, limit = [hashes], [np.ones(len(hashes))]
    owner, rate = [row], [np.ones(len(hashes))]
    again = w.repeated(w.mix(hashes + w.mix(row.astype(_U))))
    if again.any():
        pairs = np.stack([row[again].astype(_U), hashes[again]], axis=1)
        kinds, counts = np.unique(pairs, axis=0, return_counts=True)
        level = 1
        while (high := counts > 2 ** (level - 1)).any():
            width = float(2 ** (level - 1))
            seeds.append(w.mix(kinds[high, 1] + _U(level)))
            owner.append(kinds[high, 0].astype(np.int64))
            rate.append(np.full(int(high.sum()), width))
            limit.append(np.minimum((counts[high] - width) / width, 1.0))
            level += 1
    return tuple(np.concatenate(x) for x in (owner, seeds, rate, limit))


def signatures(hashes: np.ndarray, rows: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Row x slot: the identity of the earliest point; 0 for rows without shingles."""
    n = len(rows) - 1
    first = np.full(n * slots, np.inf)
    point = np.zeros(n * slots, dtype=_U)
    owner, seed, rate, limit = _levels(hashes, rows)
    time, j = np.zeros(len(seed)), _U(0)
    with np.errstate(over="ignore"):
        while len(seed):
            j += _U(1)
            bits = w.mix(seed + j * _STEP)
            # 44 bits give the waiting time, 20 the slot.
            time = time - np.log(((bits >> _U(20)).astype(float) + 0.5) * 2.0**-44) / (rate * slots)
            at = owner * slots + (((bits & _U(0xFFFFF)) * _U(slots)) >> _U(20)).astype(np.int64)
            if (limit < 1).any():
                ok = (w.mix(bits) >> _U(11)).astype(float) * 2.0**-53 < limit
            else:
                ok = np.ones(len(at), dtype=bool)
            ok &= time < first[at]
            np.minimum.at(first, at[ok], time[ok])
            won = ok & (time == first[at])
            point[at[won]] = bits[won]
            live = time < first.reshape(n, slots).max(axis=1)[owner]
            owner, seed, rate, limit, time = (x[live] for x in (owner, seed, rate, limit, time))
    return point.reshape(n, slots)


def _band_keys(points: np.ndarray) -> np.ndarray:
    n = len(points)
    parts = points.reshape(n, BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=_U), (n, BANDS)).copy()
        for k in range(ROWS):
            key = w.mix(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in w.slices(batch, "text", SLICE):
            hashes, rows = shingles(part.column(2))
            points = signatures(hashes, rows)
            keys = _band_keys(points)
            short = (points & _U(0xFF)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(np.diff(rows).astype(np.int32)),
                    lists,
                    pa.array([x.tobytes() for x in short], type=pa.binary()),
                ],
                names=["node", "doc_id", "size", "keys", "sketch"],
            )


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard of the shingle multisets, row by row."""
    sides = [shingles(x) for x in (left, right)]
    row = np.concatenate([w.row_of(r) for _, r in sides])
    key = np.concatenate([h for h, _ in sides])
    side = np.repeat([1, -1], [len(h) for h, _ in sides])
    order = np.lexsort((key, row))
    row, key, side = row[order], key[order], side[order]
    n = len(left)
    if not len(row):
        return np.zeros(n)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))
    a = np.add.reduceat((side > 0).astype(np.int64), new)
    b = np.add.reduceat((side < 0).astype(np.int64), new)
    low = np.bincount(row[new], np.minimum(a, b), minlength=n)
    high = np.bincount(row[new], np.maximum(a, b), minlength=n)
    return np.divide(low, high, out=np.zeros(n), where=high > 0)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names of all shingles of all rows, and the row offsets.

    The k-th occurrence of a shingle in a text has a name of its own, so that the overlap
    of two multisets is the overlap of two sets.
    """
    hashes, rows = shingles(texts)
    row = w.row_of(rows)
    hashes = hashes[np.lexsort((hashes, row))]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(hashes))
    again = place - np.maximum.accumulate(np.where(new, place, 0))
    with np.errstate(over="ignore"):
        names = np.where(new, hashes, w.mix(hashes + again.astype(_U) * _STEP))
    return names[np.lexsort((names, row))], rows


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in w.slices(batch, "text", SLICE):
            names, rows = grams(part.column(1))
            packed = [names[x:y].tobytes() for x, y in zip(rows, rows[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["node", "grams"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in w.slices(batch, "left", SLICE):
            linked = pa.array(similarity(part.column(2), part.column(3)) >= SIMILARITY - 1e-12)
            yield pa.RecordBatch.from_arrays(list(part.columns[:2]), names=["a", "b"]).filter(linked)


def _sized(table: DataFrame, most: int = BROADCAST_NODES) -> DataFrame:
    """Marked for broadcast if it has few rows; else the optimizer chooses."""
    return F.broadcast(table) if table.count() <= most else table


def _light(table: DataFrame, column: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its values of ``column`` take few bytes; else the optimizer chooses.

    Then the side that it is joined to, one row per pair, is not shuffled with the values.
    """
    size = table.agg(F.sum(F.octet_length(column) + F.lit(64))).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def _merged(table: DataFrame) -> DataFrame:
    """A checkpointed table in partitions of at least ``ROWS_PER_PARTITION`` rows, unless it has fewer rows.

    A loop over few links then needs no shuffle and few tasks; on many links nothing changes.
    """
    return table.coalesce(max(1, math.ceil(table.count() / ROWS_PER_PARTITION)))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for all links of a task."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held).combine_chunks()
    ends = pa.concat_arrays([table.column(k).chunk(0) for k in (0, 1)])
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.array_sort_indices(nodes))
    a, b = pc.index_in(ends, nodes).to_numpy().reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        # Nodes, and those that name them, take the smaller name; then names of names are followed to their end.
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    for start in range(0, len(nodes), 1 << 16):
        part = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays([nodes[part], nodes.take(pa.array(label[part]))], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that a chain of links reaches.

    One task follows the chains of up to ``TASK_LINKS`` links: a loop of joins would cost the
    driver a dozen plans for a few rows. More links are followed by joins.
    """
    if links.limit(TASK_LINKS + 1).count() <= TASK_LINKS:
        kind = links.schema["a"].dataType.simpleString()
        return links.select("a", "b").coalesce(1).mapInArrow(_chains, f"node {kind}, label {kind}").checkpoint()
    both = _merged(links.select("a", "b").union(links.select("b", "a")).distinct().checkpoint())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")
    ).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        ahead = low.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = low.join(ahead, low["label"] == ahead["n2"]).select("node", "was", F.col("l2").alias("label")).checkpoint()
        labels = new.select("node", "label")
        if not new.filter("label <> was").limit(1).count():
            return labels


def _nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, text, node``; the node is null for a text without words."""
    t = F.col(f"`{text}`")
    said = F.regexp_like(t, F.lit(r"[^\x20\x09-\x0D]"))
    return docs.select(
        F.when(said, F.unhex(F.md5(t.cast("binary")))).alias("node"), F.col(f"`{key}`").alias("doc_id"), t.alias("text")
    )


def _hub_pairs(live: DataFrame) -> DataFrame:
    """One pair ``a < b`` per node, with a hub of its buckets; most texts then have their class already."""
    hubs = live.groupBy("key").agg(F.min_by(F.struct("node", "size"), "node").alias("hub")).select(
        "key", F.col("hub.node").alias("h_node"), F.col("hub.size").alias("h_size")
    )
    met = live.join(hubs, "key").filter((F.col("node") != F.col("h_node")) & _similar_sizes("size", "h_size"))
    return met.groupBy(F.col("node").alias("b")).agg(F.min("h_node").alias("a")).select("a", "b")


def _similar_sizes(x: str, y: str) -> Column:
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y)


def _mixed(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``live`` with each node's class as ``label``, without the buckets that hold one class only.

    As classes are only ever joined, no later round needs those.
    """
    if labels is None:
        return live.withColumn("label", F.col("node"))
    known = live.join(_sized(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = known.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("key")
    return known.join(_sized(several.checkpoint()), "key", "left_semi").checkpoint()


def _small_pairs(known: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of different classes in small buckets."""
    few = known.filter(F.col("n") <= SMALL_BUCKET).select("key", "node", "size", "label")
    other = few.toDF(*[f"o_{c}" for c in few.columns])
    met = (few["key"] == other["o_key"]) & (few["node"] < other["o_node"]) & (few["label"] != other["o_label"])
    pairs = few.join(other, met & _similar_sizes("size", "o_size"))
    return pairs.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def _dealt(known: DataFrame) -> DataFrame:
    """Members of large buckets of several classes, ``key, node, size, label, block, last``.

    A member meets the blocks ``0 .. last`` of its bucket. A bucket that one side of a task
    can hold is one block; its members need one row each.
    """
    many = known.filter(F.col("n") > SMALL_BUCKET).select("key", "node", "size", "label")
    kinds = many.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("s"))

    def blocks(members: Column, size: Column) -> Column:
        return F.greatest(F.ceil(members / BLOCK), F.ceil(size / BLOCK_SHINGLES))

    buckets = (
        kinds.groupBy("key")
        .agg(F.max(F.struct("k", "label", "s")).alias("top"), F.sum("k").alias("n"), F.sum("s").alias("s"))
        .filter("top.k < n")
        .select(
            "key",
            F.col("top.label").alias("main"),
            blocks(F.col("top.k"), F.col("top.s")).alias("main_blocks"),
            blocks(F.col("n") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("blocks"),
            (blocks(F.col("n"), F.col("s")) == 1).alias("whole"),
        )
        .checkpoint()
    )
    dealt = many.join(_sized(buckets), "key").withColumn("of_main", F.col("label") == F.col("main"))
    salt = F.xxhash64("node", "key")
    # Blocks of the largest class come after the others and do not meet each other.
    at = F.when(F.col("of_main"), F.col("blocks") + F.pmod(salt, "main_blocks")).otherwise(F.pmod(salt, "blocks"))
    last = F.col("blocks") - 1 + F.when(F.col("of_main"), 0).otherwise(F.col("main_blocks"))
    at, last = (F.when(F.col("whole"), F.lit(0)).otherwise(x).cast("long") for x in (at, last))
    return dealt.select("key", "node", "size", "label", at.alias("block"), last.alias("last")).checkpoint()


def _meetings(dealt: DataFrame, signed: DataFrame) -> DataFrame:
    """A row for each member and each block it meets, with its sketch."""
    found = signed.select("node", "sketch").join(_sized(dealt.select("node").distinct()), "node", "left_semi")
    rows = dealt.join(_light(found.checkpoint(), "sketch"), "node")
    alone = rows.filter("last = 0").withColumns({"lo": F.least("block", "last"), "hi": F.greatest("block", "last")}).drop("last")
    if not dealt.filter("last > 0").limit(1).count():
        return alone
    several = (
        rows.filter("last > 0")
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        .withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
        .drop("with", "last")
    )
    return alone.unionByName(several)


def _nearest(known: DataFrame, signed: DataFrame) -> DataFrame:
    """``node, other, same``: partners of other classes in large buckets, the best one per two blocks."""

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        left, right, same = _agreement(key[1].as_py(), key[2].as_py(), rows)
        out: list[tuple[bytes, bytes, int]] = []
        nodes = rows["node"].to_pylist()
        for mine, others, counts in ((left, right, same), (right, left, same.T)):
            best = counts.argmax(axis=1) if counts.size else np.zeros(0, dtype=np.int64)
            for i, j in enumerate(best):
                if counts[i, j]:
                    out.append((nodes[mine[i]], nodes[others[j]], int(counts[i, j])))
        kinds = (pa.binary(), pa.binary(), pa.int32())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["node", "other", "same"])

    rows = _meetings(_dealt(known), signed)
    return rows.groupBy("key", "lo", "hi").applyInArrow(meet, "node binary, other binary, same int")


def _large_links(known: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """Links ``a < b`` that join the classes of large buckets as all their links would."""
    dealt = _dealt(known)
    wanted = _texts_of(dealt.select("node").distinct(), texts, signed)
    named = wanted.mapInArrow(_name, "node binary, grams binary").checkpoint()
    rows = _meetings(dealt, signed).join(_light(named, "grams"), "node")

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        left, right, same = _agreement(key[1].as_py(), key[2].as_py(), rows)
        nodes = rows["node"].to_pylist()
        ends = sorted(tuple(sorted((nodes[i], nodes[j]))) for i, j in _forest(left, right, same, rows))
        return pa.table([pa.array([p[k] for p in ends], type=pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.groupBy("key", "lo", "hi").applyInArrow(meet, "a binary, b binary").distinct()


def _classes(rows: pa.Table) -> np.ndarray:
    return np.unique(np.array(rows["label"].to_pylist(), dtype=object), return_inverse=True)[1]


def _agreement(lo: int, hi: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of either block, and the equal slots of each two; 0 where they cannot be a link between classes."""
    block, size, label = rows["block"].to_numpy(), rows["size"].to_numpy(), _classes(rows)
    sketch = _sketch(rows["sketch"])
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    if lo == hi:
        # The largest class is met by the others only.
        left = left[label[left] != np.bincount(label).argmax()]
    same = np.zeros((len(left), len(right)), dtype=np.uint8)
    for i in range(0, len(left), 32):
        some = left[i : i + 32]
        agree = (sketch[some, None, :] == sketch[None, right, :]).view(np.uint64).sum(axis=2)
        # Eight counters of a byte each, added up in the highest.
        count = ((agree * _U(0x0101010101010101)) >> _U(56)).astype(np.uint8)
        x, y = size[some, None], size[None, right]
        wanted = (label[some, None] != label[None, right]) & (np.minimum(x, y) >= SIMILARITY * np.maximum(x, y))
        same[i : i + 32] = np.where(wanted & (count >= ESTIMATE * SLOTS), count, 0)
    return left, right, same


def _forest(left: np.ndarray, right: np.ndarray, same: np.ndarray, rows: pa.Table) -> list[tuple[int, int]]:
    """Verified links between classes, without those between rows that earlier ones have joined."""
    label, packed, links = _classes(rows), rows["grams"].combine_chunks(), []
    both_sides = np.isin(right, left)  # two such rows meet once
    for i, counts in zip(left.tolist(), same, strict=True):
        near = right[(counts > 0) & (label[right] != label[i]) & ((right > i) | ~both_sides)]
        if not len(near):
            continue
        mine = np.frombuffer(packed[i].as_py(), dtype=_U)
        others = [np.frombuffer(packed[j].as_py(), dtype=_U) for j in near.tolist()]
        sizes = np.array([len(x) for x in others])
        flat = np.concatenate(others)
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        for j in near[both / (len(mine) + sizes - both) >= SIMILARITY - 1e-12].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _best(partners: DataFrame) -> DataFrame:
    """One pair ``a < b`` per node of ``node, other, same``: with the partner that agrees most."""
    top = partners.groupBy("node").agg(F.max(F.struct("same", "other")).alias("top"))
    other = F.col("top.other")
    return top.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def _alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """``a, b, same``: the pairs whose sketches agree in enough slots, and in how many."""
    ends = pairs.select("a").union(pairs.select("b")).distinct()
    found = signed.select("node", "sketch").join(_sized(ends), signed["node"] == F.col("a"), "left_semi").checkpoint()
    found = _light(found, "sketch")
    left, right = found.toDF("a", "sa"), found.toDF("b", "sb")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_sketch(batch.column(2)) == _sketch(batch.column(3))).sum(axis=1)
            counted = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.int32())], names=["a", "b", "same"])
            yield counted.filter(pa.array(same >= ESTIMATE * SLOTS))

    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a binary, b binary, same int")
    )


def _sketch(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)


def _texts_of(nodes: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """``node, text`` of some nodes; texts of other nodes are not moved."""
    reps = signed.select("node", "doc_id").join(_sized(nodes), "node", "left_semi").checkpoint()
    return (
        texts.alias("t")
        .join(
            _sized(reps).alias("r"),
            (F.col("t.node") == F.col("r.node")) & F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")),
            "left_semi",
        )
        .select("node", "text")
        .dropDuplicates(["node"])
    )


def links_of(pairs: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs that are similar, by their exact multisets."""
    pairs = pairs.checkpoint()
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = _light(_texts_of(ends, texts, signed).checkpoint(), "text")
    both = pairs.join(wanted.toDF("a", "left"), "a").join(wanted.toDF("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(_verify, "a binary, b binary")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``node, rep_node, class_id`` per distinct text; a class's representative is its smallest (id, node)."""
    checkpoint_dir(docs.sparkSession)
    texts = _nodes(docs, key, text).filter("node is not null")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    signed = (
        texts.mapInArrow(_sign, f"node binary, doc_id {id_type}, size int, keys array<bigint>, sketch binary")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("size").alias("size"),
            F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"),
        )
        .checkpoint()
    )
    entries = signed.select("node", "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").checkpoint()
    live = entries.join(shared.hint("merge"), "key").checkpoint()
    found, labels = None, None
    for round_no in range(3):
        if not round_no:
            fresh = links_of(_alike(_hub_pairs(live).checkpoint(), signed).select("a", "b"), texts, signed)
        else:
            known = _mixed(live, labels)
            live = known.drop("label")
            small = _alike(_small_pairs(known).checkpoint(), signed)
            if round_no == 1:
                small = small.checkpoint()  # read from either end
                sides = [small.select(F.col(x).alias("node"), F.col(y).alias("other"), "same") for x, y in ("ab", "ba")]
                fresh = links_of(_best(sides[0].union(sides[1]).union(_nearest(known, signed))), texts, signed)
            else:
                fresh = links_of(small.select("a", "b"), texts, signed).union(_large_links(known, texts, signed))
        fresh = _merged(fresh.checkpoint())
        if fresh.limit(1).count():
            found = fresh if found is None else _merged(found.union(fresh).checkpoint())
            labels = components(found)
    own = signed.select("node", F.struct("doc_id", "node").alias("id"))
    if labels is None:
        return own.select("node", F.col("id.node").alias("rep_node"), F.col("id.doc_id").alias("class_id"))
    named = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = named.groupBy("label").agg(F.min(F.struct(F.col("id.doc_id").isNull().alias("none"), "id")).alias("m"))
    return named.join(best, "label").select(
        "node", F.col("m.id.node").alias("rep_node"), F.col("m.id.doc_id").alias("class_id")
    )


def label(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` for every row of ``docs``."""
    classes = near_classes(docs, key, text).checkpoint()
    rows = _nodes(docs, key, text).select("node", "doc_id")
    return rows.join(classes, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one that names it; columns as in ``docs``."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        F.col(f"`{key}`").alias("__id"),
        F.col(f"`{text}`").alias("__text"),
    )
    nodes = _nodes(packed, "__id", "__text").select("node", "doc_id")
    classes = near_classes(packed, "__id", "__text")
    counts = nodes.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    names = (F.col("node") == F.col("rep_node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    # The rows that go, and those that occur as several equal rows: fewer than those that stay, unless most are copies.
    listed = (
        counts.join(classes, "node")
        .withColumn("names", names)
        .filter("NOT names OR n > 1")
        .select("node", "doc_id", "names")
        .checkpoint()
    )
    said = F.coalesce(F.regexp_like("__text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    rows = packed.withColumn("__node", F.when(said, F.unhex(F.md5(F.col("__text").cast("binary"))))).drop("__text")

    same = (F.col("__node") == F.col("node")) & F.col("__id").eqNullSafe(F.col("doc_id"))
    # Rows without words have no node and stay.
    once = rows.join(_sized(listed), same, "left_anti")
    repeated = listed.filter("names")
    if not repeated.limit(1).count():
        return once.select("__doc.*")
    # Only a representative that occurs as several equal rows needs whole rows grouped.
    again = rows.join(_sized(repeated), same, "left_semi").dropDuplicates(["__node"])
    return once.union(again).select("__doc.*")
