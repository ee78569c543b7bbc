"""The corpus pipeline on a small table with nulls, copies, a benchmark passage and an empty table."""

from __future__ import annotations

import random
import zlib

import numpy as np

import corpus_pipeline
from roomledger.llm import tokens

RNG = random.Random(5)
WORDS = ["the", "and", "of", "to", "in", "that", "is"] + ["".join(RNG.choices("abcdefghilmnoprstu", k=RNG.randint(3, 9))) for _ in range(600)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key int"


def prose(n: int) -> str:
    return ". ".join(" ".join(RNG.choices(WORDS, k=12)).capitalize() for _ in range(n // 12)) + "."


def plain_crc(text: str | None) -> tuple[int, int]:
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokens.tokenizer_file()).encode(text or "", add_special_tokens=False).ids + [2]
    return len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pipeline(spark, tmp_path):
    passage, copy = prose(48), prose(240)
    near = copy.replace(copy.split()[100], "changed", 1)
    texts = [prose(240) for _ in range(40)] + [copy, copy, near, None, "", " \n", "spam " * 400, prose(120) + " " + passage + " " + prose(120)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], 1, 7) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, passage), (1, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.columns == source.columns
        kept[name] = docs.collect()
    good = {r["doc_id"] for r in kept["quality"]}
    assert good.isdisjoint({43, 44, 45, 46})  # null, empty, blank and repetitive texts
    single = [r["text"] for r in kept["near_dedup"]]
    assert len(single) == len(set(single)) == len({t for t in map(lambda r: r["text"], kept["quality"])} - {near, copy}) + bool({40, 41, 42} & good)
    assert not any(passage in r["text"] for r in kept["decontaminate"])
    assert {r["doc_id"] for r in kept["near_dedup"]} - {47} <= {r["doc_id"] for r in kept["decontaminate"]}
    assert {r["doc_id"] for r in kept["mix"]} <= {r["doc_id"] for r in kept["decontaminate"]}

    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    want = sorted(plain_crc(r["text"]) for r in kept["mix"])
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
