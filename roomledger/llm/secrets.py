"""Secret scan with corpus-wide ownership frequency.

Base kinds (assignments, access keys, long hex runs) are always reported. Looser
candidates (tokens that mix upper and lower case with digits, key blocks, known key
prefixes, quoted or assigned values, also with / . = inside, that mix them alike) are reported only if they look live: the hash of the
value is counted over the whole corpus by distinct repositories and owners, and a value
that more than ``MAX_OWNERS`` owners or ``MAX_REPOSITORIES`` repositories hold is a widely
copied example. Every span, base ones too, carries its counts and its class (``owner``
or ``example``).

Owner is ``owner`` (default: the source column); a repository is an (owner, repository)
pair (default: owner and language). One pass over the whole texts gives narrow rows;
texts are never shuffled. A value's occurrences are merged before the shuffle by
(value, owner, repository), so a value in a third of all rows is a handful of rows.
Values travel as 128-bit digests and are never collected.

Defined cases: null and empty texts have no spans; a null owner or repository is one of
its own; repeated rows and null ids are judged row by row; an empty table gives an empty
result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm import words as w
from roomledger.session import checkpoint_dir

MAX_OWNERS = 1
MAX_REPOSITORIES = 3
KINDS = ("assign", "access", "hex", "prefix", "block", "mixed", "value")
BASE = 3

# The base patterns and their least lengths.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

_PREFIX = re.compile(r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----")
_MIXED = re.compile(r"[A-Za-z0-9+_-]{20,}")
# The value alone, after a colon, an equals sign or an opening quote; it may hold / . =
_VALUE = re.compile(r"""(?:[:=]\x20*["']?|["'])([A-Za-z0-9+/_.=-]{12,})""")


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    value: str


def _is_mixed(value: str) -> bool:
    """Digits, upper and lower case, changing often: no word, no name, no number."""
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return {0, 1, 2} <= set(kinds) and 4 * changes >= len(value)


def spans(text: str | None) -> list[Span]:
    """All spans by start, then kind. An added span that overlaps a base one is left out."""
    if not text:
        return []
    found = [Span(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [Span(1, *m.span(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Span(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((s.start, s.end) for s in found)
    for kind, pattern, group in ((3, _PREFIX, 0), (4, _BLOCK, 0), (6, _VALUE, 1), (5, _MIXED, 0)):
        more = [
            Span(kind, *m.span(group), m[group])
            for m in pattern.finditer(text)
            if kind < 5 or _is_mixed(m[group])
        ]
        more = _apart(more, taken)
        found += more
        taken = sorted([*taken, *((s.start, s.end) for s in more)])
    return sorted(found, key=lambda s: (s.start, s.kind))


def _apart(more: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """The spans, in order of start, that overlap none of the sorted ``taken``."""
    out, i, reach = [], 0, 0
    for span in more:
        while i < len(taken) and taken[i][0] < span.end:
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= span.start:
            out.append(span)
    return out


_SPAN = "struct<kind: int, start: bigint, end: bigint, value: binary>"


def candidates(docs: DataFrame, key: str, text: str, owner: str, repository: str) -> DataFrame:
    """``doc_id, owner, repository, found``: all spans of every row, values as digests."""
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.col(f"`{owner}`").cast("string").alias("owner"),
        F.col(f"`{repository}`").cast("string").alias("repository"),
        F.col(f"`{text}`").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                lists = [
                    [(s.kind, s.start, s.end, hashlib.blake2b(s.value.encode(), digest_size=16).digest()) for s in spans(t.as_py())]
                    for t in part.column(3)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(lists, schema)], names=["doc_id", "owner", "repository", "found"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, owner string, repository string, found array<{_SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """``value, n_rows, n_repositories, n_owners`` over all rows of ``candidates``."""
    each = found.select("owner", "repository", F.explode("found.value").alias("value"))
    by_repository = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("value").agg(
        F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")
    )


def is_example() -> F.Column:
    return (F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES)


def find(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang"
) -> DataFrame:
    """``doc_id, spans`` for every row.

    A span is a struct of ``kind, start, end, value`` (digest), ``n_owners,
    n_repositories`` and ``class``. Of the added kinds only those of class ``owner`` stay.
    """
    checkpoint_dir(docs.sparkSession)
    found = candidates(docs, key, text, owner, repository).checkpoint()
    # The rows are stored, so the numbers do not change when a task is repeated.
    rows = found.select("doc_id", "found", F.monotonically_increasing_id().alias("row"))
    kinds = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k))])
    seen = rows.select("row", F.inline("found")).join(ownership(found), "value")
    judged = seen.filter((F.col("kind") < BASE) | ~is_example()).select(
        "row",
        F.struct(
            "start",
            F.col("kind").alias("order"),
            kinds[F.col("kind")].alias("kind"),
            "end",
            "value",
            "n_owners",
            "n_repositories",
            F.when(is_example(), "example").otherwise("owner").alias("class"),
        ).alias("span"),
    )
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return rows.select("doc_id", "row").join(per_row, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)).alias("spans")
    )


def digest(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts and joined spans per document."""
    found = find(docs, **columns)
    base = F.filter("spans", lambda s: s["order"] < BASE)
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
