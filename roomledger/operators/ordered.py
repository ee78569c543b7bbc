"""Ranks, running totals and exact quantiles over one global order.

A window without a partition key, or with one key that holds a large part of
the rows, runs in a single task. These operators range-partition the rows on the
full sort key instead, number them inside each range, and add an offset
per range. The only windows left without a bound on the data have at most one
row per range. The ranges are checkpointed, because the offsets and the rows
must see the same cut even when an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.session import checkpoint_dir

CHUNK, POS = "__chunk", "__pos"
MAX_STRATA = 1000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def range_chunks(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """Sort globally; add the range number and the row number inside the range.

    There are at most ``spark.sql.shuffle.partitions`` ranges; adaptive execution
    merges neighbouring ones that are small, which keeps their order.
    """
    checkpoint_dir(df.sparkSession)
    numbered = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return numbered.select(
        *df.columns,
        F.shiftright("_id", _LOCAL_BITS).alias(CHUNK),
        F.col("_id").bitwiseAND((1 << _LOCAL_BITS) - 1).alias(POS),
    ).checkpoint()


def global_row_number(df: DataFrame, order_by: Sequence[Column], name: str = "rn") -> DataFrame:
    """``row_number()`` over the whole frame with one shuffle; also adds ``n_rows``."""
    rows = range_chunks(df, order_by)
    sizes = rows.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    by_chunk = Window.orderBy(CHUNK)
    offsets = sizes.select(
        CHUNK,
        F.coalesce(
            F.sum("_size").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias("n_rows"),
    )
    # One row per range, so the broadcast is bounded by the number of ranges.
    return rows.join(F.broadcast(offsets), CHUNK).select(
        *df.columns, (F.col("_before") + F.col(POS) + 1).alias(name), "n_rows"
    )


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: dict[str, Column],
    partition_by: Sequence[str] = (),
    grand: bool = False,
) -> DataFrame:
    """Inclusive running sums within ``partition_by``, safe for a key of any size.

    ``order_by`` should be unique within the partition. A key that spans several
    ranges gets the totals of its earlier ranges added; per range at most one key
    started earlier, so that correction has at most one row per range. With
    ``grand`` the total over the partition is added as ``<name>_total``; this is
    offered only without ``partition_by``, where it too is one row per range.
    """
    keys = list(partition_by)
    given = df.columns
    values = {f"_v_{name}": expr for name, expr in totals.items()}
    rows = range_chunks(df.withColumns(values), [*(F.col(k) for k in keys), *order_by])

    local = Window.partitionBy(CHUNK, *keys).orderBy(POS).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    part = rows.groupBy(CHUNK, *keys).agg(*[F.sum(v).alias(v) for v in values])
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.sum(f"_v_{n}").over(earlier).alias(f"_c_{n}") for n in totals]
    if grand:
        if keys:
            raise ValueError("grand totals are offered only without partition_by")
        carry_cols += [F.sum(f"_v_{n}").over(Window.partitionBy()).alias(f"{n}_total") for n in totals]
    carry = part.select(
        CHUNK, *[F.col(k).alias(f"_k_{k}") for k in keys], *carry_cols, F.row_number().over(across).alias("_nth")
    )
    if keys:
        carry = carry.filter("_nth > 1")
    # A null-safe match, since a NULL key is a group like any other.
    same = [rows[CHUNK] == carry[CHUNK], *[rows[k].eqNullSafe(carry[f"_k_{k}"]) for k in keys]]
    matched = rows.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(local) for n in totals}).join(
        F.broadcast(carry), same, "left"
    )
    return matched.select(
        *given,
        *[(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in totals],
        *([f"{n}_total" for n in totals] if grand else []),
    )


def ntile(rn: Column, n: Column, buckets: int) -> Column:
    """NTILE from a row number: the first ``n mod buckets`` tiles hold one row more."""
    whole, extra = F.floor(n / buckets), n % buckets
    boundary = extra * (whole + 1)
    tail = extra + F.floor(F.try_divide(rn - 1 - boundary, whole)) + 1
    return (
        F.when(rn <= boundary, F.floor((rn - 1) / (whole + 1)) + 1).otherwise(tail).cast("int")
    )


def equal_rank_bucket(rn: Column, n: Column, buckets: int) -> Column:
    """Bucket of a rank when the edges are interpolated quantiles of 1..n.

    Edge ``i`` lies at ``1 + i * (n - 1) / buckets`` and intervals are ``(lo, hi]``.
    Integer arithmetic keeps an edge that falls on a rank exact.
    """
    scaled = buckets * (rn - 1)
    span = F.greatest(n - 1, F.lit(1))
    up = F.floor((scaled + span - 1) / span)
    return F.greatest(F.lit(1), up).cast("int")


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, as columns ``q0``, ``q1``, ...

    Equal values are merged first; the order statistics are then read off running
    counts, so no group is ever gathered in one task. With ``weight``, a count per row,
    the rows are merged already.
    """
    keys = list(by)
    weighted = df.select(*keys, value, F.col(weight).alias("_n")) if weight else value_counts(df, value, keys)
    cum = running_totals(weighted, [F.col(value)], {"_cum": F.col("_n")}, keys)
    sizes = weighted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    return _pick_quantiles(cum, sizes, value, probs, keys)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "_n") -> DataFrame:
    """Rows per distinct value that is not null."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(name))


def _doubles(values: Sequence[float]) -> Column:
    """A constant array; as one text, since a call per number costs more than the query."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


SLIVER = 100_000  # rows around the wanted ranks that the driver may sort
EDGES = 500


def order_statistics(
    df: DataFrame, tie: str, ranks: dict[str, Callable[[int], Sequence[int]]]
) -> tuple[int, dict[str, list[tuple]]]:
    """Row count, and per value column the (value, tie) at some ranks of the order by value, then ``tie``.

    ``ranks`` maps a column to a function of the row count that gives ranks from 1. No row
    is sorted but those near a wanted rank: quantile estimates cut the values into ranges,
    with a range of its own for each estimate, so that a frequent value stands alone; one
    aggregate counts the ranges, which tells in which one a rank lies and at which place.
    Only the rows of these ranges are ordered: by the driver while they are few, else by
    the distributed row number. ``df`` is read three times and should be stored; its
    values are not null.
    """
    columns = list(ranks)
    shares = _doubles([k / EDGES for k in range(1, EDGES)])
    n, *sketched = df.agg(F.count(F.lit(1)), *[F.percentile_approx(c, shares, F.lit(10 * EDGES)) for c in columns]).first()
    if not n:
        return 0, {c: [] for c in columns}
    edges = {c: sorted(set(found)) for c, found in zip(columns, sketched, strict=True)}

    def slot(c: str) -> Column:
        """Range of a value: even for one strictly between estimates, odd for an estimate itself."""
        value, table = F.col(c).cast("double"), _doubles(edges[c])
        steps = F.array(*[F.lit(1 << k) for k in range(len(edges[c]).bit_length() - 1, -1, -1)])
        # Binary search for the number of estimates up to the value; beyond the table is null.
        at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))
        return F.when(F.get(table, at - 1) == value, 2 * at - 1).otherwise(2 * at).cast("int")

    placed = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("c"), slot(c).alias("slot"), F.col(c).cast("double").alias("v"), F.col(tie).alias("t")) for c in columns]))
    )
    sizes = {(r["c"], r["slot"]): r["n"] for r in placed.groupBy("c", "slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for c in columns:
        before, targets = 0, sorted(enumerate(ranks[c](n)), key=lambda x: x[1])
        for key in sorted(k for k in sizes if k[0] == c):
            while targets and targets[0][1] <= before + sizes[key]:
                place, rank = targets.pop(0)
                wanted.setdefault(key, []).append((place, rank - before))
            before += sizes[key]
    near = placed.filter(
        reduce(lambda a, b: a | b, [(F.col("c") == c) & (F.col("slot") == k) for c, k in wanted], F.lit(False))
    )
    out: dict[str, dict[int, tuple]] = {c: {} for c in columns}
    if sum(sizes[k] for k in wanted) <= SLIVER:
        held: dict[tuple[str, int], list] = {}
        for r in near.collect():
            held.setdefault((r["c"], r["slot"]), []).append((r["v"], r["t"] is not None, r["t"]))
        for key, places in wanted.items():
            rows = sorted(held[key])
            for place, at in places:
                out[key[0]][place] = (rows[at - 1][0], rows[at - 1][2])
    else:
        ranked = global_row_number(near, [F.col("c"), F.col("slot"), F.col("v"), F.col("t")])
        before, at = 0, {}
        for key in sorted(wanted):
            at |= {before + k: (key[0], place) for place, k in wanted[key]}
            before += sizes[key]
        for r in ranked.filter(F.col("rn").isin(*at)).collect():
            c, place = at[r["rn"]]
            out[c][place] = (r["v"], r["t"])
        # Two targets may share a rank.
        for key, places in wanted.items():
            for place, k in places:
                if place not in out[key[0]]:
                    out[key[0]][place] = next(out[key[0]][p] for p, j in places if j == k and p in out[key[0]])
    return n, {c: [out[c][k] for k in range(len(out[c]))] for c in columns}


def _pick_quantiles(cum, sizes, value, probs, keys):
    if keys:
        ranked = cum.join(sizes, keys)
    else:
        ranked = cum.join(F.broadcast(sizes))
    picks, out = [], []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_all") - 1)
        low, high = F.floor(position), F.ceil(position)
        for tag, at in (("lo", low), ("hi", high)):
            here = (at >= F.col("_cum") - F.col("_n")) & (at < F.col("_cum"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{tag}{i}"))
        picks.append(F.max(position - low).alias(f"_f{i}"))
        out.append(
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
        )
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *out)


def lowest_by_hash(
    df: DataFrame, key: Column, share: float, strata: Sequence[str] = (), name: str = "is_test"
) -> DataFrame:
    """Mark exactly ``round(share * n)`` rows of every stratum, chosen by a hash order.

    The rows themselves are not shuffled: counts per hash prefix locate the
    prefix that holds the cut, only that sliver (about n / 65536 rows) is ranked,
    and the resulting threshold, one row per stratum, is broadcast after a check
    that there are at most ``MAX_STRATA`` of them.
    """
    keys = list(strata)
    hashed = df.withColumn("_h", F.md5(key))
    found = _hash_cuts(hashed, share, keys)
    rows = found.limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata in {keys}")
    cuts = df.sparkSession.createDataFrame(rows, found.schema)
    same = [hashed[k].eqNullSafe(cuts[f"_k_{k}"]) for k in keys]
    joined = hashed.join(F.broadcast(cuts), same or F.lit(True), "left")
    # A stratum too small to give a row has no threshold.
    inside = F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))
    return joined.select(*df.columns, inside.cast("int").alias(name))


def _hash_cuts(hashed: DataFrame, share: float, keys: list[str]) -> DataFrame:
    prefix = F.substring("_h", 1, 4)
    counts = hashed.groupBy(*keys, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = counts.select(
        *keys,
        "_p",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        "_n",
        F.round(F.lit(float(share)) * F.sum("_n").over(whole)).cast("long").alias("_want"),
    )
    # Of each stratum the one prefix in which the wanted count is reached.
    edge = located.filter("_before < _want AND _before + _n >= _want").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_p").alias("_edge"),
        (F.col("_want") - F.col("_before")).alias("_take"),
    )
    same = [prefix == F.col("_edge"), *[hashed[k].eqNullSafe(edge[f"_k_{k}"]) for k in keys]]
    sliver = hashed.join(F.broadcast(edge), same).select(*[f"_k_{k}" for k in keys], "_h", "_take")
    order = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_h")
    return (
        sliver.withColumn("_r", F.row_number().over(order))
        .filter("_r = _take")
        .select(*[f"_k_{k}" for k in keys], F.col("_h").alias("_cut"))
    )
