"""Mixing sources to target weights.

Sources get targets in proportion to their weights; a target stops at ``max_epochs``
times its source's size and the excess is shared again by weight. Documents get
hash-random keys, are range-sorted by (source, key), and distributed prefix sums of
their sizes locate the key at which each source's exact budget is reached. Whole passes
over a source (epochs) come first; the last, partial pass ends at that key.

What a document gives then follows from its own source and key and one row per source,
so the documents themselves are never shuffled: only (source, key, size) is. A source
may hold any share of the rows, since the ranges cut through it, and the ranges are
checkpointed, so a lost executor cannot move the cut. Reruns agree, as nothing depends
on partitioning.

Defined cases: null text has size 0 and gives nothing; a null source is a source of its
own, last in order; rows with the same key (repeated or null ids) share what is left at
the cut in proportion to their sizes, rounded down; an empty table gives an empty mix.
Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.operators.ordered import global_row_number, running_totals
from roomledger.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
BROADCAST_SOURCES = 10_000
SEED = 17


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target``; ``sizes`` has a row per (source, source_size).

    ``weights`` repeats over the sources in code-point order, null last. Ordered by the
    level at which they are full, the sources before the first one that stays below its
    limit are full; the level follows from the sums over them.
    """
    ranked = global_row_number(sizes, [F.col("source").asc_nulls_last()])
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    weighted = ranked.select(
        "source",
        "source_size",
        F.get(cycle, F.pmod(F.col("rn") - 1, F.lit(len(weights))).cast("int")).alias("weight"),
        (max_epochs * F.col("source_size")).alias("limit"),
    )
    filled = running_totals(
        weighted,
        [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()],
        {"full": F.col("limit"), "share": F.col("weight"), "size": F.col("source_size")},
        grand=True,
    )
    left = F.col("size_total") - (F.col("full") - F.col("limit"))
    level = left / (F.col("share_total") - (F.col("share") - F.col("weight")))
    levels = filled.select("limit", "weight", level.alias("level"))
    # Past the first source below its limit the level only falls short of its own.
    found = levels.filter(F.col("level") * F.col("weight") <= F.col("limit")).agg(F.max("level").alias("level"))
    return weighted.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("limit").cast("double"), F.coalesce(found.scalar(), F.lit(0.0)) * F.col("weight")).alias(
            "target"
        ),
    )


def keyed(docs: DataFrame, key: str, source: str, size: Column) -> DataFrame:
    """``docs`` with ``__source``, ``__size`` and the hash-random ``__key``."""
    return docs.withColumns(
        {
            "__source": F.col(f"`{source}`"),
            "__size": size,
            "__key": F.xxhash64(F.lit(SEED), F.col(f"`{key}`")),
        }
    )


def cuts(rows: DataFrame, weights: Sequence[float] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: target, whole epochs, and the key where the last pass ends."""
    keys = rows.groupBy(F.col("__source").alias("source"), F.col("__key").alias("key")).agg(
        F.sum("__size").alias("size")
    )
    checkpoint_dir(rows.sparkSession)
    keys = keys.checkpoint()
    sizes = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.greatest(F.col("source_size"), F.lit(1))
    budgets = (
        targets(sizes, weights, max_epochs)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumns(
            {"epochs": F.floor(F.col("budget") / whole), "rest": F.pmod(F.col("budget"), whole)}
        )
        .checkpoint()
    )
    summed = running_totals(keys.filter("size > 0"), [F.col("key")], {"upto": F.col("size")}, ["source"])
    by_source = budgets.select(F.col("source").alias("b_source"), "rest")
    at = summed.join(_small(by_source), F.col("source").eqNullSafe(F.col("b_source"))).filter(
        (F.col("rest") > F.col("upto") - F.col("size")) & (F.col("rest") <= F.col("upto"))
    )
    ends = at.select(
        F.col("b_source").alias("e_source"),
        F.col("key").alias("cut"),
        (F.col("rest") - F.col("upto") + F.col("size")).alias("room"),
        F.col("size").alias("cut_size"),
    )
    return budgets.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").select(
        F.col("source").alias("m_source"), "source_size", "target", "epochs", "rest", "cut", "room", "cut_size"
    )


def _small(table: DataFrame) -> DataFrame:
    """Marked for broadcast if there are few sources; a plain join side otherwise."""
    few = len(table.limit(BROADCAST_SOURCES + 1).select(F.lit(1)).collect()) <= BROADCAST_SOURCES
    return F.broadcast(table) if few else table


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``source_size, target, taken``: the words that the mix takes of each."""
    plan = plan.checkpoint()
    part = (
        F.when(F.col("rest") == 0, 0)
        .when(F.col("__key") < F.col("cut"), F.col("__size"))
        .when(
            F.col("__key") == F.col("cut"),
            # The product of two sizes may pass 2 ** 63.
            F.floor(F.col("room").cast("decimal(19,0)") * F.col("__size") / F.col("cut_size")).cast("long"),
        )
        .otherwise(0)
    )
    return rows.join(_small(plan), F.col("__source").eqNullSafe(F.col("m_source")), "left").withColumn(
        "taken", (F.col("epochs") * F.col("__size") + part).cast("long")
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = CYCLE,
) -> DataFrame:
    """The mixed documents, with the columns of ``docs``.

    Rows are repeated once per pass. A document at the cut is kept whole, so each
    source ends within one document above its budget.
    """
    columns = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"),
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{text}`").alias("text"),
    )
    rows = keyed(packed, "key", "source", word_count("text"))
    narrow = rows.select("__source", "__size", "__key")
    copies = F.ceil(F.col("taken") / F.col("__size")).cast("int")
    return (
        taken(rows.select("__doc", "__source", "__size", "__key"), cuts(narrow, weights))
        .filter("taken > 0")
        .select("__doc", F.explode(F.sequence(F.lit(1), copies)).alias("__pass"))
        .select("__doc.*")
    )
