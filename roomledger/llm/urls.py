"""URL filter: rules first, then a character language-model ratio.

URLs that a rule accepts or rejects train two smoothed variable-order Markov models
over the characters of the whole lower-cased URL, query string and fragment included.
A URL without a rule is judged by the difference of the two
log-likelihoods per character, against a threshold calibrated on rule-judged URLs that
the models have not seen.

Everything is DataFrame expressions. Characters fall into ``len(ALPHABET) + 2`` classes,
so the model is a table of ``CLASSES ** 3`` numbers (two characters of context), however
many URLs there are. Counting is an aggregation with map-side combining onto that many
groups; scoring indexes the table, held as one array value, without any shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path; a null or
empty url has a score of 0, one without ``://`` is scored like any other; only
rule-judged URLs train, and without examples of both verdicts the score is 0 everywhere
and the verdict allow. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from roomledger.session import checkpoint_dir

# Host and path prefix, verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
ALPHABET = string.ascii_lowercase + "0/.-_%=&~+:@"  # "0" stands for every digit
CLASSES = len(ALPHABET) + 2  # 0 is any other character, the last one the start
START = CLASSES - 1
SUPPORT = 8  # times a context must be seen, else the shorter one decides
PRIOR = 4.0  # weight of the shorter context's estimate, in characters
HELD_OUT = 5  # one url in so many calibrates
BIN = 0.05
MAX_BIN = 200


def _text(url: str) -> Column:
    return F.coalesce(F.col(f"`{url}`"), F.lit(""))


def host_and_path(url: str) -> tuple[Column, Column]:
    u = _text(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits.

    A rule fits its host and every subdomain, if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _codes(text: Column) -> Column:
    """Class of every character, after two start marks."""
    plain = F.translate(text, string.digits, "0" * 10)
    chars = F.filter(F.split(plain, ""), lambda c: F.length(c) > 0)
    coded = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(START), F.lit(START)), coded)


def _gram(codes: Column, i: Column) -> Column:
    """Two characters of context and the character at position ``i`` as one number."""
    at = [F.get(codes, i - k) for k in (2, 1, 0)]
    return (at[0] * CLASSES + at[1]) * CLASSES + at[2]


def _positions(codes: Column) -> Column:
    """2 .. n + 1, empty for an empty text."""
    return F.when(F.size(codes) > 2, F.sequence(F.lit(2), F.size(codes) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def model(examples: DataFrame) -> DataFrame:
    """One row ``w``: the log ratio of accepted to rejected for every (context, character).

    ``examples`` has ``codes`` and ``accepted``. Each order's estimate is the shorter
    context's, moved towards the counts in proportion to how many there are.
    """
    seen = (
        examples.select("accepted", F.explode(F.transform(_positions(F.col("codes")), lambda i: _gram(F.col("codes"), i))).alias("g"))
        .groupBy("g")
        .agg(
            F.sum(F.col("accepted").cast("int")).alias("ya"),
            F.sum((~F.col("accepted")).cast("int")).alias("yb"),
        )
        .checkpoint()  # used four times below
    )
    grid = examples.sparkSession.range(CLASSES**3).select(
        F.col("id").cast("int").alias("g"),
        (F.col("id") % CLASSES).alias("c"),
        (F.col("id") % CLASSES**2).alias("ac"),
        F.floor(F.col("id") / CLASSES).alias("ba"),
        (F.floor(F.col("id") / CLASSES) % CLASSES).alias("a"),
    )
    full = grid.join(seen, "g", "left").fillna(0, ["ya", "yb"])
    # Windows over the fixed grid: at most CLASSES ** 2 rows each but the total's, which has CLASSES.
    over = {"ac": ["ac"], "ba": ["ba"]}
    for name, keys in over.items():
        part = Window.partitionBy(*keys)
        full = full.withColumns({f"{y}_{name}": F.sum(y).over(part) for y in ("ya", "yb")})
    singles = full.groupBy("c").agg(F.sum("ya").alias("ya_c"), F.sum("yb").alias("yb_c"))
    lefts = full.groupBy("a").agg(F.sum("ya").alias("ya_a"), F.sum("yb").alias("yb_a"))
    totals = singles.agg(F.sum("ya_c").alias("ya_n"), F.sum("yb_c").alias("yb_n"))
    both = singles.join(F.broadcast(totals)).join(F.broadcast(full), "c").join(F.broadcast(lefts), "a")

    def log_chance(y: str) -> Column:
        p = (F.col(f"{y}_c") + 0.5) / (F.col(f"{y}_n") + 0.5 * CLASSES)
        one = (F.col(f"{y}_ac") + PRIOR * p) / (F.col(f"{y}_a") + PRIOR)
        p = F.when(F.col(f"{y}_a") >= SUPPORT, one).otherwise(p)
        two = (F.col(y) + PRIOR * p) / (F.col(f"{y}_ba") + PRIOR)
        return F.log(F.when(F.col(f"{y}_ba") >= SUPPORT, two).otherwise(p))

    ready = (F.col("ya_n") > 0) & (F.col("yb_n") > 0)
    ratio = F.when(ready, log_chance("ya") - log_chance("yb")).otherwise(0.0)
    cells = both.select(F.struct("g", ratio.alias("r")).alias("cell"))
    return cells.agg(
        F.transform(F.array_sort(F.collect_list("cell")), lambda x: x["r"]).alias("w")
    )


def score(codes: Column, w: Column) -> Column:
    """Log-likelihood difference per character, rounded so that all engines agree."""
    total = F.aggregate(
        _positions(codes), F.lit(0.0), lambda acc, i: acc + F.get(w, _gram(codes, i))
    )
    return F.round(total / F.greatest(F.size(codes) - 2, F.lit(1)), 6)


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``cut``: the score from which on a URL is accepted.

    It maximises the sum of the shares of accepted and rejected URLs judged rightly,
    over at most ``2 * MAX_BIN + 2`` bins; the lowest such cut wins.
    """
    bins = (
        scored.groupBy(F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(MAX_BIN)), F.lit(-MAX_BIN)).alias("b"))
        .agg(
            F.sum(F.col("accepted").cast("int")).alias("ya"),
            F.sum((~F.col("accepted")).cast("int")).alias("yb"),
        )
    )
    whole = Window.partitionBy()
    below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    gain = (
        F.sum("yb").over(below) / F.greatest(F.sum("yb").over(whole), F.lit(1))
        - F.coalesce(F.sum("ya").over(below), F.lit(0)) / F.greatest(F.sum("ya").over(whole), F.lit(1))
    )
    rated = bins.select("b", F.round(F.coalesce(gain, F.lit(0.0)), 9).alias("gain"))
    best = rated.agg(F.max_by("b", F.struct("gain", -F.col("b"))).alias("b"), F.max("gain").alias("gain"))
    # Without a cut that separates anything the two models decide alone.
    return best.select(F.coalesce(F.when(F.col("gain") > 0, F.col("b") * BIN), F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds ``host, path, rule, score, verdict`` to the columns of ``pages``.

    Columns of these names, or of the four used on the way, are left out.
    """
    own = ["host", "path", "rule", "score", "verdict", "__url", "__says", "__codes", "__w"]
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in own]
    host, path = host_and_path(url)
    split = pages.select(*columns, host.alias("host"), path.alias("path"), _text(url).alias("__url"))
    name, says = longest_rule(F.col("host"), F.col("path"), rules)
    whole = F.lower(F.col("__url"))
    ruled = split.withColumns({"rule": name, "__says": says, "__codes": _codes(whole)})
    known = ruled.filter("__says is not null").select(
        F.col("__codes").alias("codes"),
        (F.col("__says") == "allow").alias("accepted"),
        (F.pmod(F.crc32(whole.cast("binary")), F.lit(HELD_OUT)) == 0).alias("held"),
    )
    checkpoint_dir(pages.sparkSession)
    w = model(known.filter("not held")).checkpoint().scalar()
    cut = threshold(
        known.filter("held").withColumn("w", w).select("accepted", score(F.col("codes"), F.col("w")).alias("score"))
    ).checkpoint().scalar()
    rated = ruled.withColumn("__w", w).withColumn("score", score(F.col("__codes"), F.col("__w")))
    return rated.withColumn(
        "verdict", F.coalesce("__says", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    ).drop("__says", "__codes", "__w", "__url")
