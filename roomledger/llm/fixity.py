"""Merkle fixity audit of WARC replicas.

A record's leaf is the SHA-256 of its bytes. In each file records lie in order; byte
offsets are prefix sums of record lengths. ``FANOUT`` consecutive nodes form a node of the
level above, whose hash covers the offset range (start, end) and hash of each child, up to
one root per file. Replicas build their trees apart. The audit compares roots and descends
only below nodes that differ, level by level, to the records at fault.

Only narrow rows (file, key, hash, length) are shuffled, the contents never. Ranks and
offsets come from range-partitioned prefix sums, so a file may hold any share of the
records; a node has at most ``FANOUT`` children.

Defined cases: null columns count as empty content; a null file is a file of its own;
records with the same key are ordered by hash, and equal ones are interchangeable; an
empty replica misses every record; two empty replicas agree. A lost or inserted record
shifts what follows in its file, and all of that is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.operators.ordered import running_totals
from roomledger.session import checkpoint_dir

FANOUT = 64
PAGES_PER_FILE = 1_000


def warc_record(key: str = "page_id", url: str = "url", body: str = "html") -> Column:
    """The bytes of a resource record."""
    content = F.coalesce(F.col(f"`{body}`"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col(f"`{url}`"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame, file: Column, key: str, record: Column) -> DataFrame:
    """``file, key, node, start, end, hash``: the bottom level, nodes numbered from 0 in each file."""
    rows = records.select(file.alias("file"), F.col(f"`{key}`").alias("key"), record.alias("r")).select(
        "file", "key", F.sha2("r", 256).alias("hash"), F.octet_length("r").cast("long").alias("size")
    )
    placed = running_totals(
        rows, [F.col("key").asc_nulls_first(), F.col("hash")], {"end": F.col("size"), "nth": F.lit(1)}, ["file"]
    )
    return placed.select(
        "file", "key", (F.col("nth") - 1).alias("node"), (F.col("end") - F.col("size")).alias("start"), "end", "hash"
    )


def parents(level: DataFrame) -> DataFrame:
    """The level above: ``file, node, start, end, hash``."""
    child = F.struct("node", "start", "end", "hash")
    nodes = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node")).agg(
        F.array_sort(F.collect_list(child)).alias("c")  # at most FANOUT
    )
    line = lambda x: F.concat_ws(":", x["start"], x["end"], x["hash"])
    return nodes.select(
        "file",
        "node",
        F.get("c", F.lit(0))["start"].alias("start"),
        F.element_at("c", F.lit(-1))["end"].alias("end"),
        F.sha2(F.array_join(F.transform("c", line), ","), 256).alias("hash"),
    )


def tree(bottom: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the records up to the roots, each stored."""
    checkpoint_dir(bottom.sparkSession)
    levels = [bottom.checkpoint()]
    for _ in range(height):
        levels.append(parents(levels[-1]).checkpoint())
    return levels


def height_of(*bottoms: DataFrame) -> int:
    """Levels above the records, so that every file of every replica ends in one root."""
    most = max((b.agg(F.max("node")).first()[0] or 0) + 1 for b in bottoms)
    height = 0
    while FANOUT**height < most:
        height += 1
    return height


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``file, node`` that the two sides hold differently or that one of them lacks."""
    left = a.select("file", "node", F.struct("start", "end", "hash").alias("x"))
    right = b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.struct("start", "end", "hash").alias("y"))
    both = left.join(right, F.col("file").eqNullSafe(F.col("f")) & (F.col("node") == F.col("n")), "full_outer")
    return both.filter(~F.col("x").eqNullSafe(F.col("y"))).select(
        F.when(F.col("x").isNull(), F.col("f")).otherwise(F.col("file")).alias("file"),
        F.coalesce("node", "n").alias("node"),
    )


def _under(level: DataFrame, bad: DataFrame) -> DataFrame:
    above = bad.select(F.col("file").alias("f"), F.col("node").alias("n"))
    same = level["file"].eqNullSafe(above["f"]) & (F.floor(level["node"] / FANOUT) == above["n"])
    return level.join(above, same, "left_semi")


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """``file, node`` of the records at fault, found from the roots down."""
    bad = _differing(ours[-1], theirs[-1]).checkpoint()
    for a, b in zip(reversed(ours[:-1]), reversed(theirs[:-1]), strict=True):
        if not bad.limit(1).count():
            break
        bad = _differing(_under(a, bad), _under(b, bad)).checkpoint()
    return bad


def report(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of either replica with its offsets and ``status``: ok, corrupt, missing or extra.

    ``ours`` and ``theirs`` are what ``leaves`` returns.
    """
    checkpoint_dir(ours.sparkSession)
    ours, theirs = ours.checkpoint(), theirs.checkpoint()
    height = height_of(ours, theirs)
    a, b = tree(ours, height), tree(theirs, height)
    bad = audit(a, b).select(F.col("file").alias("f"), F.col("node").alias("n"))
    at = lambda t: t["file"].eqNullSafe(bad["f"]) & (t["node"] == bad["n"])
    marked = ours.join(bad, at(ours), "left").drop("f")
    suspects = theirs.join(bad, at(theirs), "left_semi").select(
        F.col("file").alias("f"), F.col("node").alias("m"), F.col("key").alias("t_key"),
        F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("hash").alias("t_hash"),
    )
    joined = marked.join(suspects, F.col("file").eqNullSafe(F.col("f")) & (F.col("n") == F.col("m")), "full_outer")
    lost = F.col("hash").isNull()
    own = lambda x, y: F.when(lost, F.col(y)).otherwise(F.col(x)).alias(x)
    return joined.select(
        own("file", "f"),
        own("key", "t_key"),
        own("start", "t_start"),
        own("end", "t_end"),
        own("hash", "t_hash"),
        F.when(lost, "extra")
        .when(F.col("n").isNull(), "ok")
        .when(F.col("t_hash").isNull(), "missing")
        .otherwise("corrupt")
        .alias("status"),
    )
