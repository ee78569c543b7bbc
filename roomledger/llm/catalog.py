"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import (
    attention,
    bagminhash,
    decontaminate,
    fixity,
    mixing,
    runs,
    secrets,
    separators,
    simple8b,
    superkmers,
    supervision,
    urls,
    whitening,
)
from roomledger.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    checkpoint_dir(spark)
    # Three narrow columns: sizes are counted once, and the texts are read once.
    rows = mixing.keyed(docs, "doc_id", "source", mixing.word_count("text")).drop("text", "source").checkpoint()
    return mixing.taken(rows, mixing.cuts(rows)).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", "taken"
    )


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.label(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return supervision.judge(docs, keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("quality", 9).alias("quality"),
    )


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.digest(_table(spark, sf_dir, "documents"))


def op6_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(_table(spark, sf_dir, "documents"))


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica in which every 97th page has lost a byte to bit rot."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    file = F.floor(F.col("page_id") / fixity.PAGES_PER_FILE)
    rotten = F.concat(F.lit("?"), F.expr("substring(html, 2)"))
    replica = pages.withColumn("html", F.when(F.pmod("page_id", F.lit(97)) == 13, rotten).otherwise(F.col("html")))
    ours, theirs = (fixity.leaves(x, file, "page_id", fixity.warc_record()) for x in (pages, replica))
    return fixity.report(ours, theirs).select(
        F.col("key").alias("page_id"), "file", "start", "end", F.col("hash").alias("sha256"), "status"
    )


def op8_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_tokens(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def with_turns(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by a hash of its id, ends in turns of a few of its own words."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    split = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    )
    turn = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(turn, times)))
    text = F.array_join(F.slice(whole, F.lit(1), F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_turns(_table(spark, sf_dir, "documents")))
    best = runs.longest("runs")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    length, period = F.col("best.length"), -F.col("best.short")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mix": op1_mix,
    "op2_urls": op2_urls,
    "op3_bagminhash": op3_bagminhash,
    "op4_quality": op4_quality,
    "op5_simple8b": op5_simple8b,
    "op6_attention": op6_attention,
    "op7_fixity": op7_fixity,
    "op8_separators": op8_separators,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_superkmers": op11_superkmers,
    "op12_runs": op12_runs,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op7_fixity": r"""
        WITH raw AS (
            SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS file,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                   || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                   || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
                   html
            FROM pages
        ), hashed AS (
            SELECT page_id, file, strlen(record) AS size, sha256(record) AS sha256,
                   coalesce(page_id % 97 = 13 AND html <> '' AND substring(html, 1, 1) <> '?', false) AS rotten
            FROM raw
        ), placed AS (
            SELECT *, CAST(sum(size) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256
                           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
            FROM hashed
        )
        SELECT page_id, file, upto - size AS start, upto AS "end", sha256,
               CASE WHEN rotten THEN 'corrupt' ELSE 'ok' END AS status
        FROM placed""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
