"""Each operator against brute force on small rows: nulls, empties, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roomledger.llm import (
    attention,
    bagminhash,
    catalog,
    decontaminate,
    fixity,
    mixing,
    secrets,
    separators,
    simple8b,
    supervision,
    tokens,
    urls,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, node string, __key int"
RNG = np.random.default_rng(3)
VOCAB = [a + b + c for a in ("ba", "den", "ko", "lir", "mu", "na", "rel", "su") for b in ("ta", "vi", "gon", "pe", "lo", "zi", "far") for c in ("m", "nes", "t", "da", "rik", "ul", "o")]
SECRET = "aB3xY9kLm2Qp7Rt5Zw8c"


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCAB, n))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    a = prose(120)
    near = a.replace(a.split()[60], "changed", 1)
    return [
        a, a, near, None, "", " \n\t", prose(80), prose(30) + "\nline one\nline one\n\nüß # $ <x>",
        "spam spam spam " * 60, prose(3000), 'password = "abcdefgh12" token: short AKIA' + "A" * 12 + " " + "0f" * 16,
        prose(60) + " " + SECRET, "<|endoftext|> # a", "Ω naïve é   word",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ("a", "b", None)[i % 3], 1, 7, "x", 5) for i, t in enumerate(texts)]
    rows += [(None, texts[6], None, "c", None, None, None, None), rows[7]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame) -> dict:
    return {r["doc_id"]: r for r in frame.collect()}


def test_mixing(spark, docs, none, texts):
    rows = mixing.keyed(docs, "doc_id", "source", mixing.word_count("text")).checkpoint()
    got = mixing.taken(rows, mixing.cuts(rows)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["__size"] == len(WORD.findall(r["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["__size"]
        sizes[r["source"]] += r["__size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = ["a", "b", "c", None]
    weight, left, want, open_ = dict(zip(order, (5, 2, 1, 5), strict=True)), float(sum(sizes.values())), {}, set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 3 * sizes[s]}
        for s in full or open_:
            want[s] = 3 * sizes[s] if s in full else weight[s] * unit
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 2
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate([
        None, "", "nohost", "HTTP://WWW.Example.COM/en/x?q", "http://example.com/en/1", "http://a.example.com/en", "http://x.net/fr/2#z",
        "http://net/es/", "http://notnet/es/", "https://c.org",
    ])]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(10)] == [
        None, None, None, "www.example.com/en/", "example.com/en/", "com/", "net/fr/", "net/es/", None, None,
    ]
    assert (got[3]["host"], got[3]["path"]) == ("www.example.com", "/en/x")
    assert got[0]["host"] == got[2]["path"] == "" and {r["verdict"] for r in got.values()} == {"allow", "block"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_bag_min_hash(docs, none, texts):
    got = by_id(bagminhash.label(docs))
    assert got[0]["class_id"] == got[1]["class_id"] == got[2]["class_id"] == 0
    assert all(got[i]["class_id"] == i for i in (3, 4, 5, 7, 8, 9))
    kept = [r["doc_id"] for r in bagminhash.keep_one(docs).collect()]
    assert kept.count(0) == 1 and 1 not in kept and 2 not in kept and kept.count(7) == 1 and 3 in kept
    assert bagminhash.label(none).count() == bagminhash.keep_one(none).count() == 0


def test_only_rows_that_go_are_sent_to_every_task(spark, monkeypatch):
    texts = [prose(30) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(60, texts[0]), (None, texts[1]), (2, texts[2]), (61, " "), (None, None), (62, "x")]
    docs, sent, near = spark.createDataFrame(rows, "doc_id long, text string"), [], bagminhash.near_classes

    def classes(*args):
        out = near(*args)
        monkeypatch.setattr(bagminhash, "_sized", lambda table: sent.append(table.count()) or F.broadcast(table))
        return out

    monkeypatch.setattr(bagminhash, "near_classes", classes)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in bagminhash.keep_one(docs).collect())
    want = [(i, t) for i, t in rows[:60]] + [(61, " "), (None, None), (62, "x")]
    assert kept == sorted((i is None, i or 0, t or "") for i, t in want)
    assert max(sent) <= 3  # copies of texts 0 and 1, and the repeated row


def test_bag_star_of_edited_copies(spark, monkeypatch):
    """Copies that are near the original alone, and pairs that share a long boilerplate with all others."""
    monkeypatch.setattr(bagminhash, "BLOCK", 300, raising=False)
    rng = np.random.default_rng(11)
    say = lambda n: list(rng.choice(VOCAB, n))
    base, rows = say(250), []
    for i in range(1100):
        copy = base.copy()
        for at in rng.choice(49, 5, replace=False):
            copy[5 * at + 2] = f"edit{i}x{at}"
        rows.append((i, " ".join(copy)))
    rows.append((5000, " ".join(base)))
    common = say(200)
    for i in range(150):
        own = common + [f"own{i}x{j}" for j in range(60)]
        rows += [(6000 + 2 * i, " ".join(own)), (6001 + 2 * i, " ".join([*own[:-1], "last"]))]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [set(zip(*[t.split()[k:] for k in range(bagminhash.SHINGLE)])) for _, t in rows]
    often = [x for x, n in Counter(x for s in sets for x in s).items() if n > 1]
    has = np.array([[x in s for x in often] for s in sets], dtype=np.float32)
    both, size = has @ has.T, np.array([len(s) for s in sets])
    for i, j in np.argwhere(both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}
    assert len(set(want.values())) == 151 and want[5000] == 0
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in bagminhash.label(frame).collect()} == want


def test_bag_similarity_is_exact():
    bag = lambda t: Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    left = ["a b c d e f a b c d e f " * 5, prose(50)]
    right = ["a b c d e f a b c d e f " * 3, prose(50)]
    want = [sum((bag(x) & bag(y)).values()) / sum((bag(x) | bag(y)).values()) for x, y in zip(left, right, strict=True)]
    assert np.allclose(bagminhash.similarity(pa.array(left), pa.array(right)), want)
    hashes, rows = bagminhash.shingles(pa.array([left[0], right[0]]))
    points = bagminhash.signatures(hashes, rows, 4096)
    assert abs((points[0] == points[1]).mean() - want[0]) < 0.05


def _quality(text: str | None) -> tuple[int, ...]:
    text = text or ""
    found, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality(docs, none, texts):
    got = by_id(supervision.judge(docs, keep=["doc_id"]))
    for i, t in enumerate(texts):
        r = got[i]
        want = _quality(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert got[9]["kept"] and not got[8]["kept"]
    assert supervision.keep_good(docs).columns == docs.columns
    assert supervision.judge(none).count() == 0


def test_simple8b_round_trip():
    for n in (0, 1, 127, 128, 129, 5000):
        ids = RNG.integers(0, 1 << 17, n).astype(np.uint64) >> RNG.integers(0, 17, n).astype(np.uint64)
        if n > 2:
            ids[n // 2], ids[0] = (1 << 64) - 1, 1 << 60
        assert np.array_equal(simple8b.decode(*simple8b.encode(ids), n), ids)
    zeros = np.zeros(1000, dtype=np.uint64)
    assert np.array_equal(simple8b.decode(*simple8b.encode(zeros), 1000), zeros)


def _plain_ids(text: str | None, end: int, plain: bool) -> list[int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file())
    t.encode_special_tokens = plain
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_token_file_and_separators(spark, docs, none, texts):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got, counts = by_id(simple8b.digest(rows)), by_id(separators.count_tokens(rows))
    start = [0, 0]
    for i, t in enumerate(texts):
        ids = _plain_ids(t, 2, False)
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert tuple(got[i]) == (i, start[0], len(ids), crc)
        n = len(_plain_ids(t, 0, True))
        assert tuple(counts[i]) == (i, start[1], n)
        start = [start[0] + len(ids), start[1] + n]
    assert simple8b.digest(docs).count() == separators.count_tokens(docs).count() == docs.count()
    assert simple8b.digest(none).count() == separators.count_tokens(none).count() == 0


def test_texts_travel_packed_to_ranges_of_keys(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    rows = [(None if i % 50 == 0 else int(k), " ".join(RNG.choice(words, 200)) if i % 7 else None)
            for i, k in enumerate(RNG.integers(-80, 80, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h"))
    ranged, n = separators._ranged(keyed)
    packs = ranged.select("shard", "id", "h", "text").mapInArrow(
        separators._pack, "shard int, id array<bigint>, h array<bigint>, n array<bigint>, packed binary"
    ).collect()
    assert {p["shard"] for p in packs} <= set(range(n)) and len({p["shard"] for p in packs}) > 1
    assert sorted((k is not None, k or 0) for p in packs for k in p["id"]) == sorted((k is not None, k or 0) for k, _ in rows)
    assert sum(len(p["packed"]) for p in packs) < 0.6 * sum(len(t or "") for _, t in rows)
    separators.write_flat(docs, str(tmp_path / "flat"), block=512)
    blocks = spark.read.parquet(str(tmp_path / "flat")).orderBy("shard", "seq").collect()
    names = [k for b in blocks for k in b["ends_of"]]
    assert names == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    ids = np.concatenate([np.frombuffer(b["ids"], dtype="<u4") for b in blocks])
    found = np.split(ids, np.flatnonzero(ids == separators.END_ID) + 1)[:-1]
    assert len(found) == len(rows)
    want = {t: _plain_ids(t, separators.END_ID, True) for _, t in rows[:8]}
    assert all(ids in [x.tolist() for x in found] for ids in want.values())


def test_separator_scan_across_blocks(spark, tmp_path):
    ids = RNG.integers(0, 9, 5000).astype("<u4")
    ids[700:2100] = 1  # a document over many blocks
    (tmp_path / "a.bin").write_bytes(ids[:3000].tobytes())
    (tmp_path / "b.bin").write_bytes(ids[3000:].tobytes())
    found = separators.scan(separators.flat_files(spark, str(tmp_path), block=64), end=5)
    got = sorted((r["start"], r["n_tokens"]) for r in found.collect())
    ends = (np.flatnonzero(ids == 5) + 1).tolist()
    assert got == [(a, b - a) for a, b in zip([0, *ends], ends, strict=False)]


def _edits(item: list[str], words: list[str]) -> int:
    row = [0] * (len(words) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs, none):
    items = [prose(40), prose(15), "just five words are here", "", None]
    lines = items[0].split()
    lines[7], lines[20] = "x", "y"
    planted = [
        prose(50) + " " + items[0].upper() + " " + prose(30), prose(20) + " " + " ".join(lines) + " " + prose(9),
        prose(500), items[1], prose(10) + " " + " ".join(items[1].split()[:8]) + " " + prose(30), None, "", items[2] + " end",
    ]
    rows = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(planted):
        for i, item in enumerate(items):
            a, b = (WORD.findall((x or "").lower()) for x in (item, t))
            if a and b and (n := _edits(a, b)) <= int(decontaminate.MAX_EDITS * len(a)):
                want.add((d, i, n))
    assert {tuple(r) for r in decontaminate.find(rows, bench).collect()} == want
    left = {r["doc_id"] for r in decontaminate.clean(rows, bench).collect()}
    assert left == set(range(len(planted))) - {d for d, _, _ in want}
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.find(none, bench).count() == 0


def _spans(text: str | None) -> str:
    text, out = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets(spark, docs, none, texts):
    got = by_id(secrets.digest(docs))
    for i, t in enumerate(texts):
        want = _spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    assert (got[10]["n_assign"], got[10]["n_access"], got[10]["n_hex"]) == (1, 1, 1)
    assert "mixed:" in got[11]["spans"]
    shared = spark.createDataFrame([(i, f"key {SECRET} end", "en", f"owner{i}") for i in range(5)], "doc_id long, text string, lang string, source string")
    assert {r["spans"] for r in secrets.digest(shared).collect()} == {""}
    assert secrets.digest(none).count() == 0


def test_fixity(spark):
    schema = "page_id long, url string, html string, file string"
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7), "one" if i < 900 else "two") for i in range(1000)]
    rows += [(None, None, None, None), rows[5]]
    other = [*rows]
    other[150] = (150, "http://x/150", "<p>bad</p>", "one")
    other[999] = (5000, "http://x/9", "new", "three")
    ours, theirs = (
        fixity.leaves(spark.createDataFrame(x, schema), fixity.F.col("file"), "page_id", fixity.warc_record()) for x in (rows, other)
    )
    found = fixity.report(ours, theirs).collect()
    by = {(r["file"], r["key"]): r["status"] for r in found}
    assert by["two", 999] == "missing" and by["three", 5000] == "extra" and by[None, None] == "ok"
    # A shorter record moves what follows in its file; what lies before it and other files are untouched.
    assert by["one", 150] == "corrupt" and by["one", 149] == by["two", 998] == "ok"
    assert {r["status"] for r in fixity.report(ours, ours).collect()} == {"ok"}
    empty = ours.limit(0)
    assert {r["status"] for r in fixity.report(ours, empty).collect()} == {"missing"} and fixity.report(empty, empty).count() == 0


def test_attention_gradient_and_distribution():
    ids = RNG.integers(0, 300, 400).astype(np.uint32)
    at = np.array([0, 0, 3, 350, 400])
    key, n = np.unique(RNG.integers(0, attention.BUCKETS, 999) * attention.VOCABULARY + RNG.integers(0, 300, 999), return_counts=True)
    known = attention.statistics(key, n)
    batch = attention.windows(ids, at)
    assert sorted(batch.targets[batch.scored].tolist()) == sorted(ids.tolist())
    weights = attention.unpack(attention.fresh_weights() + RNG.normal(0, 0.1, len(attention.fresh_weights())))
    loss, g = attention.gradient(weights, known, batch)
    for name in ("q", "o", "w1", "u", "place"):
        step = {k: v.astype(np.float64).copy() for k, v in weights.items()}
        step[name][1, 1] += 1e-3
        high = attention.gradient(step, known, batch)[0]
        step[name][1, 1] -= 2e-3
        assert abs((high - attention.gradient(step, known, batch)[0]) / 2e-3 - g[name][1, 1]) < 2e-3
    every = [attention.text_scores(weights, known, np.array([5, x], dtype=np.uint32), np.array([0, 2]))[0] for x in range(0, attention.VOCABULARY, 97)]
    one = attention.text_scores(weights, known, np.array([5], dtype=np.uint32), np.array([0, 1]))[0]
    assert sum(10 ** (x - one) for x in every) < 1
    logs, _ = attention.forward(weights, known, batch.inputs)
    assert np.allclose(np.exp(logs).sum(axis=2), 1, atol=1e-4)


@pytest.mark.parametrize("table", [attention.TABLE_WORDS, 8])
def test_attention_base(docs, none, texts, table, monkeypatch):
    monkeypatch.setattr(attention, "TABLE_WORDS", table)
    rows = docs.collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*WORD.findall((t or "").translate(lower)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(x for r in rows if not held(r["doc_id"]) for x in split(r["text"]))
    total, kinds = sum(counts.values()), len(counts)
    for r in attention.score(docs).collect():
        if r["doc_id"] is None:
            continue
        words = split(texts[r["doc_id"]])
        want = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[x] > 0 for x in words), total)
        assert r["held_out"] == held(r["doc_id"]) and math.isclose(r["base_score"], want, rel_tol=1e-9) and r["score"] < 0
    assert attention.score(none).count() == 0


def test_attention_is_fitted_on_every_training_document(spark):
    """Also on texts whose hash is not 0 modulo 16; of each of them alone."""
    lines = spark.createDataFrame([(i, prose(40)) for i in range(20)], "doc_id long, text string")
    outside = lines.filter("pmod(xxhash64(7, text), 16) <> 0").limit(1).checkpoint()
    model, _ = attention.fit(outside, "doc_id", "text", tokens.tokenizer_file())
    moved = attention.unpack(model.weights)
    assert np.abs(moved["u"]).max() > 0 and np.abs(moved["b"]).max() > 0


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in catalog.queries()} == {f"op{n}" for n in range(1, 14)}


def test_a_bucket_that_a_task_holds_has_one_row_per_member(spark):
    n = bagminhash.SMALL_BUCKET + 20
    kinds = [b"m"] * 15 + [bytes([65 + i]) for i in range(n - 15)]
    sketch = RNG.integers(0, 256, bagminhash.SLOTS).astype(np.uint8).tobytes()
    rows = [(7, bytes([i]), 9, n, kinds[i]) for i in RNG.permutation(n).tolist()]
    known = spark.createDataFrame(rows, "key long, node binary, size int, n long, label binary")
    signed = spark.createDataFrame([(bytes([i]), sketch) for i in range(n)], "node binary, sketch binary")
    met = bagminhash._meetings(bagminhash._dealt(known), signed)
    assert met.count() == n and met.select("lo", "hi").distinct().count() == 1

    # All are alike: one chain of links joins every class, whatever the order of the rows.
    grams = np.arange(9, dtype=np.uint64).tobytes()
    table = pa.table({c: [r[c] for r in met.collect()] for c in ("node", "size", "label", "block", "sketch")})
    table = table.append_column("grams", pa.array([grams] * n, pa.binary()))
    links = bagminhash._forest(*bagminhash._agreement(0, 0, table), table)
    label = table["label"].to_pylist()
    joined = {label[i]: {label[i]} for i in range(n)}
    for i, j in links:
        group = joined[label[i]] | joined[label[j]]
        joined.update(dict.fromkeys(group, group))
    assert len(joined[b"m"]) == len(set(kinds)) and len(links) == len(set(kinds)) - 1


def test_chains_of_few_links_need_no_loop_of_joins(spark, monkeypatch):
    """The same classes as by joins; a long chain, a star, a ring, a loop on one node and repeated links."""
    from roomledger.llm import bagminhash

    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (300, 300), (5, 6)]
    pairs += [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(400, 900, (260, 2))]
    name = lambda k: bytes([(k * 37) % 256, k // 256, k % 256]) + b"\0" * 13
    links = spark.createDataFrame([tuple(sorted((bytearray(name(a)), bytearray(name(b))))) for a, b in pairs], "a binary, b binary").repartition(3).checkpoint()
    found, sc = [], spark.sparkContext
    for most, jobs in ((1 << 20, 6), (0, 10_000)):
        monkeypatch.setattr(bagminhash, "TASK_LINKS", most)
        sc.setJobGroup(f"chains-{most}", "chains")
        found.append(sorted((bytes(r.node), bytes(r.label)) for r in bagminhash.components(links).collect()))
        assert len(sc.statusTracker().getJobIdsForGroup(f"chains-{most}")) <= jobs
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and len(found[0]) == len({x for p in pairs for x in p})
    monkeypatch.undo()
    assert not bagminhash.components(links.limit(0)).count()
