"""Quality rules as weak supervision.

Every rule looks at one signal of a document and votes good (1) or bad (-1), or
abstains (0). No rule is trusted alone: expectation-maximisation over all documents
estimates how often each rule votes which way on good and on bad text, and a document's
verdict is its posterior probability of being good.

One pass over the whole texts makes the signals (Arrow batches, numpy inside a task).
The fit needs only the number of documents per vote pattern; there are at most
``3 ** len(RULES)`` patterns whatever the number of documents, so they are counted by
Spark with map-side combining and fitted on the driver, and the posterior per pattern
goes back as a table of that bounded size.

Defined cases: null or empty text has no words, every signal 0, and fails the base
rules. Repeated rows are judged alike. With no documents the prior is used and the
result is empty. Columns of the input are not read except the text and those passed
through, so extra columns cannot clash; the operator's own columns replace equal names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm import words as w

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
KEEP_AT = 0.5

SIGNALS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letters",
    "n_upper",
    "n_marks",
    "n_distinct",
)

RULES = (
    "symbols",
    "repeats",
    "same_lines",
    "capitals",
    "marks",
    "variety",
    "letters",
    "prose",
    "word_length",
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0xC3:0xF5] = True  # the first byte of a letter outside ASCII, once per letter
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!?"]] = True


def text_signals(texts: pa.Array) -> dict[str, np.ndarray]:
    """The signals of every text, exact counts over the whole text."""
    data, at = w.buffers(texts)
    found = w.segments(data, at)
    lines = w.segments(data, at, w.NEWLINE)
    rows = w.row_of(found.rows)
    in_word = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~w.SPACE[data], out=in_word[1:])
    said = in_word[lines.end] > in_word[lines.start]  # lines with a word
    line_row = w.row_of(lines.rows)[said]
    line_key = _within(lines.hash[said], line_row)
    distinct_lines = np.unique(line_key, return_index=True)[1]
    n = len(at) - 1
    n_lines = np.bincount(line_row, minlength=n)
    covered = np.zeros(len(found.hash), dtype=bool)
    runs, begin = w.windows(found.hash, found.rows, REPEAT_WINDOW)
    twice = begin[w.repeated(_within(runs, rows[begin]))]
    for k in range(REPEAT_WINDOW):
        covered[twice + k] = True
    # For a signal 48 bits within a row are enough, and a plain sort is cheaper.
    packed = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (found.hash >> np.uint64(16)))
    fresh = np.ones(len(packed), dtype=bool)
    fresh[1:] = packed[1:] != packed[:-1]
    count = lambda table: w.per_row(table[data], at)
    return {
        "n_words": np.diff(found.rows),
        "word_chars": w.per_row(~w.SPACE[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": count(_SYMBOL),
        "n_dup_lines": n_lines - np.bincount(line_row[distinct_lines], minlength=n),
        "n_repeat_words": w.per_row(covered, found.rows),
        "n_lines": n_lines,
        "n_letters": count(_LETTER),
        "n_upper": count(_UPPER),
        "n_marks": count(_MARK),
        "n_distinct": w.per_row(fresh, found.rows),
    }


def _within(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys made distinct between rows."""
    with np.errstate(over="ignore"):
        return w.mix(keys + w.mix(rows.astype(np.uint64)))


# A slice's signals take some forty times its bytes for a moment.
SLICE_BYTES = 1 << 20


def with_signals(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with the signals appended as LONG."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in SIGNALS]
    # A text that is kept anyway is not sent twice.
    named = text if text in kept else "__text"
    extra = [] if text in kept else [F.col(f"`{text}`").alias("__text")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], *extra)
    wanted = source.drop("__text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, named, SLICE_BYTES):
                signals = text_signals(part.column(part.schema.get_field_index(named)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], *[pa.array(signals[s].astype(np.int64)) for s in SIGNALS]],
                    names=[*kept, *SIGNALS],
                )

    schema = ", ".join(
        [*[f"`{f.name}` {f.dataType.simpleString()}" for f in wanted], *[f"{s} bigint" for s in SIGNALS]]
    )
    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    """The rules that always reject."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _share(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _votes(bad: Column | None = None, good: Column | None = None) -> Column:
    vote = F.lit(0)
    if good is not None:
        vote = F.when(good, 1).otherwise(vote)
    return vote if bad is None else F.when(bad, -1).otherwise(vote)


def rules() -> dict[str, Column]:
    """One vote per rule, named as in ``RULES``.

    Shares are of words, lines or letters, so length does not matter. Passing a junk
    rule is no sign of quality, so those rules only vote bad; good votes need evidence.
    """
    symbols, marks = _share("n_symbols", "n_words"), _share("n_marks", "n_words")
    capitals, length = _share("n_upper", "n_letters"), _share("word_chars", "n_words")
    votes = {
        "symbols": _votes(bad=symbols >= 0.10),
        "repeats": _votes(bad=_share("n_repeat_words", "n_words") >= 0.30),
        "same_lines": _votes(bad=_share("n_dup_lines", "n_lines") >= 0.30),
        "capitals": _votes(bad=capitals >= 0.50),
        "marks": _votes(bad=marks >= 0.20),
        # Distinct words grow about with the square root of the length.
        "variety": _votes(bad=F.col("n_distinct") / F.sqrt(F.greatest("n_words", F.lit(1))) < 2),
        "letters": _votes(bad=_share("n_letters", "word_chars") < 0.50),
        "prose": _votes(good=(capitals < 0.15) & (symbols < 0.02) & (marks < 0.05)),
        "word_length": _votes(bad=(length < 2) | (length > 20), good=(length >= 3) & (length <= 10)),
    }
    # Too few words say nothing about style.
    return {name: F.when(F.col("n_words") >= 20, vote).otherwise(0) for name, vote in votes.items()}


def _pattern() -> Column:
    """The votes as one number in base 3."""
    digits = [(vote + 1) * 3**i for i, vote in enumerate(rules().values())]
    return sum(digits[1:], digits[0]).cast("int")


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good per pattern.

    A two-class model: rules vote, or abstain, independently given the class. Every
    probability is smoothed by one pseudo-vote, and the start says that bad votes are
    rare on good text, which also fixes which class is the good one.
    """
    k = len(RULES)
    votes = (patterns[:, None] // 3 ** np.arange(k)) % 3  # 0 bad, 1 none, 2 good
    hot = np.eye(3)[votes]  # pattern x rule x vote
    total = max(float(counts.sum()), 1.0)
    prior = 0.8
    chance = np.array([[0.005, 0.5, 0.495], [0.3, 0.4, 0.3]])  # good, bad
    law = np.repeat(chance[:, None, :], k, axis=1)
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        logs = np.einsum("prv,crv->pc", hot, np.log(law)) + np.log([prior, 1 - prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -700, 700)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
        prior = float(np.clip((counts * post).sum() / total, 0.01, 0.99))
        for c, share in enumerate((post, 1 - post)):
            seen = np.einsum("p,prv->rv", counts * share, hot) + chance[c]
            law[c] = seen / seen.sum(axis=1, keepdims=True)
    return post


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the signals, ``base_failed``, ``quality`` (posterior) and ``kept``."""
    seen = with_signals(docs, text, keep)
    spark = docs.sparkSession
    coded = seen.withColumn("__pattern", _pattern())
    # At most 3 ** len(RULES) rows; the texts are read, but nothing of them is sent back.
    rows = with_signals(docs, text, []).withColumn("__pattern", _pattern()).groupBy("__pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("__pattern").collect()
    patterns = np.array([r[0] for r in rows], dtype=np.int64)
    post = fit_votes(patterns, np.array([r[1] for r in rows], dtype=float))
    table = spark.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns, post, strict=True)], "__pattern int, quality double"
    )
    return (
        coded.drop("quality", "base_failed", "kept")
        .join(F.broadcast(table), "__pattern", "left")
        .drop("__pattern")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= KEEP_AT))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns only."""
    # Names by position: the documents' own may clash with those of the signals.
    columns = docs.columns
    tagged = docs.toDF(*[f"__c{i}" for i in range(len(columns))])
    judged = judge(tagged, f"__c{columns.index(text)}", tagged.columns)
    return judged.filter("kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])
