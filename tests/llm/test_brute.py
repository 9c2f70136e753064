"""Operators against plain versions, the libraries, or labels that they haven't seen."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import common, contamination, fuzzy, language, lines, nearest, pieces, private, tokenfiles, toxicity
from tests.llm import brute
from tests.llm.test_overlap import kept as kept_of_each

SF = "/root/testdata/sf0.01"


def texts():
    frame = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(frame["doc_id"], frame["text"], strict=True))


def test_line_dedup(spark):
    docs = texts()
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in lines.op2_line_dedup(spark, SF).collect()}
    assert found == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in brute.line_dedup(docs).items()}


def test_bloom_filters_lose_nothing():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(-(1 << 62), 1 << 62, 5000) for _ in range(2))
    ranges, filters = 3, {}
    for a, b in ((0, 3000), (2000, 5000), (4900, 5000)):
        for r, once, twice in lines.set_bits(np.concatenate([hi[a:b], hi[:10] if a else hi[:0]]), np.concatenate([lo[a:b], lo[:10] if a else lo[:0]]), ranges):
            filters.setdefault(r, lines.Filters()).merge(once, twice)
    of, at = lines.range_of(hi, ranges), lines.probes(lo)
    suspected = np.array([lines.has(filters[r].twice, at[:, i]).all() for i, r in enumerate(of.tolist())])
    twice = np.isin(np.arange(5000), [*range(10), *range(2000, 3000), *range(4900, 5000)])
    assert suspected[twice].all() and suspected[~twice].mean() < 0.05
    assert [lines.least_of(r, ranges) <= h and (r + 1 == ranges or h < lines.least_of(r + 1, ranges)) for r, h in zip(of.tolist(), hi.tolist(), strict=True)] == [True] * 5000


def test_line_filters_in_passes(spark, monkeypatch):
    """Many small ranges, two in a pass: only suspects leave, nothing is lost."""
    monkeypatch.setattr(lines, "BITS", lines.RANGE // 1000)
    monkeypatch.setattr(lines, "PASS", 2)
    docs = texts()
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["_lines"]["n_lines"], r["_lines"]["n_dropped"], r["_lines"]["kept"]) for r in lines.dedup_lines(frame).collect()}
    assert found == brute.line_dedup(docs)


def test_components(spark):
    prints = {i: brute.fingerprint(t) for i, t in texts().items()}
    roots = brute.components(prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in fuzzy.op4_simhash(spark, SF).collect()}
    assert found == {i: (format(p, "016x"), roots[i]) for i, p in prints.items()}


def test_golay_buckets_cover_four_errors():
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 3000, dtype=np.int64)
    errors = [sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in a]
    b = (a.view(np.uint64) ^ np.array(errors, np.uint64)).view(np.int64)
    own, other = (set(zip(*map(np.ndarray.tolist, fuzzy.buckets(x)), strict=True)) for x in (a, b))
    assert {i for i, _ in own & other} == set(range(len(a)))


def test_hot_bucket_is_compared_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    prints = sorted({sum(1 << b for b in rng.sample(range(63), 2)) for _ in range(700)})
    monkeypatch.setattr(common, "BLOCK", 64)
    keyed = spark.createDataFrame([(1, p) for p in prints], "key long, fp long")
    dealt = common.blocks(keyed, "fp", 64)
    assert dealt.groupBy("piece").count().agg(F.max("count")).first()[0] < 300
    linked = dealt.repartition("key", "piece").sortWithinPartitions("key", "piece").select("key", "piece", "fp").mapInArrow(fuzzy._linked(4), "a long, b long")
    assert linked.count() < len(prints) * 30
    roots = {r["node"]: r["root"] for r in common.components(linked).collect()}
    assert set(roots.values()) == {prints[0]}


def test_components_of_a_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in common.components(path).collect()} == {0}


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice((text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]))
    return text


def test_decontamination(spark):
    rng = random.Random(4)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é"]
    words = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, words(rng.randint(4, 12))) for i in range(8)]
    docs = []
    for i in range(60):
        body = words(40)
        if i % 3:
            item = rng.choice(items)[1]
            body += " " + edited(rng, item, rng.randint(0, len(item) // 7)) + " " + words(10)
        docs.append((i, body))
    found = contamination.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=200)
    got = {(r["doc_id"], h["item_id"]): h["distance"] for r in found.collect() for h in r["_hits"]}
    expected = {}
    for i, text in docs:
        for j, item in items:
            pattern = brute.normal(item)
            budget = len(pattern) // 10
            if (d := brute.least_edits(pattern, brute.normal(text))) <= budget:
                expected[i, j] = d
    assert got == expected and len(expected) > 10


@pytest.mark.parametrize("rate", [0.1, 0.25, 0.5])
def test_decontamination_of_short_items(rate):
    """Items of 8 to 40 characters with as many edits as the rate allows, and one more."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    items = [(n, letters(n)) for n in range(8, 41)]
    own, found = contamination.Benchmark(items, rate), 0
    for n, item in items:
        for edits in {0, math.floor(rate * n), math.floor(rate * n) + 1}:
            text = letters(30) + edited(rng, item, edits) + letters(rng.randint(0, 30))
            got = {h["item_id"]: h["distance"] for h in own.hits(text)}
            expected = {i: d for i, other in items if (d := brute.least_edits(other, text)) <= math.floor(rate * len(other))}
            assert got == expected
            found += len(expected)
    assert found > 60


def test_token_files(spark):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(tokenfiles.public_tokenizer()), 0
    found = {r["doc_id"]: r for r in tokenfiles.op5_tokenfiles(spark, SF).collect()}
    for i, text in sorted(texts().items()):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file_encodings(spark, tmp_path, encoding):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenfiles.write_tokens(docs, str(tmp_path / encoding), tokenfiles.public_tokenizer(), encoding=encoding)
    file = next(p for p in sorted((tmp_path / encoding).glob("*.parquet")) if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
    assert ("RLE_DICTIONARY" in columns["ids.list.element"].encodings) == (encoding == "dictionary")
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_offset_index
    one = tokenfiles.read_tokens(spark, str(tmp_path / encoding)).where("doc_id = 17").collect()
    assert len(one) == 1 and len(one[0]["ids"]) == one[0]["n_tokens"]


def odd_texts(count, pool, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(count)]


def test_word_tokenizer_on_odd_texts():
    own = tokenfiles.Encoder(tokenfiles.public_tokenizer())
    pool = [chr(c) for c in range(0x2C0)] + [" "] * 60 + ["'s", "'LL", "<|endoftext|>", "日", "Σ", "̈", " ", "’"] * 8
    odd = odd_texts(4000, pool, 5)
    for text, ids in zip(odd, own.encode(odd), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == own.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_piece_encoder_on_odd_texts():
    own = pieces.Encoder(pieces.public_model())
    odd = odd_texts(4000, [" ", "  ", "\t", "\n", "a", "the", "é", "▁", "<s>", "<0x0A>", "日本", "😀", "\x00", ".", "12", "́", "﻿"], 6)
    for text, ids in zip(odd, own.encode(odd), strict=True):
        assert ids.tolist() == [*own.library.encode(text), 2], repr(text)


def test_pieces(spark):
    library = pieces.Encoder(pieces.public_model()).library
    found = {r["doc_id"]: r for r in pieces.op6_pieces(spark, SF).collect()}
    for i, text in texts().items():
        ids = [*library.encode(text or ""), 2]
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_come_back_as_texts(spark):
    path = pieces.public_model()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    back = docs.select("text", pieces.tokens(F.col("text"), path).alias("ids")).select("text", pieces.texts(F.col("ids"), path).alias("back"))
    assert back.where("text = back").count() == 50


def test_language_held_out(spark):
    labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = language.op8_language(spark, SF).where("held_out").join(labels, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.op3_toxicity(spark, path).where("held_out").join(labels, "doc_id").toPandas()
    ranks, positive = held["score"].rank().to_numpy(), held["toxic"].to_numpy() == 1
    n = positive.sum()
    auc = (ranks[positive].sum() - n * (n + 1) / 2) / (n * (len(held) - n))
    assert auc >= 0.9
    assert (held["predicted"] == held["toxic"]).mean() >= 0.95


def test_toxicity_gradient():
    network = toxicity.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    vocabulary = toxicity.inputs(["abc", "defg", "hi", "jkl", "mn"])
    docs, labels = [[np.array([0, 1, 2]), np.array([3])], [np.array([4, 0, 0, 1])], [np.array([], int)]], np.array([1, 0, 1])

    def loss():
        gates = np.matmul(network.vectors(*vocabulary), network.p["in"]) + network.p["bias"]
        chances, at, total = network.run(gates, *toxicity.padded([w for d in docs for w in d])), 0, 0.0
        for d, label in zip(docs, labels, strict=True):
            chance = toxicity.sigmoid(np.float64(network.document(chances[at : at + len(d)])))
            total -= np.log(chance if label else 1 - chance) / len(docs)
            at += len(d)
        return total

    rng = np.random.default_rng(0)
    for name, g in network.gradient(docs, labels, vocabulary).items():
        flat = network.p[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(g.ravel()), 3):
            kept = flat[i]
            flat[i] = kept + 1e-4
            up = loss()
            flat[i] = kept - 1e-4
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-4 - g.ravel()[i]) < 1e-4, name


PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and private.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15)
    return [(k, *m.span()) for k in range(4) for m in PLAIN[k].finditer(text or "") if tests[k](m.group())]


def test_private_base(spark):
    for text in odd_texts(20_000, ["a", "b@", "@", ".", "1", "12", "255", ".1", "-", " ", "+", "+1", "(", "4", "0", "é", "@x.y", "5555", ".com", "\n", "٣"], 7):
        assert private.base(text) == plain_base(text), repr(text)
    found = {r["doc_id"]: r for r in private.op9_private(spark, SF).collect()}
    for i, text in texts().items():
        own = plain_base(text)
        said = ",".join(f"{private.KINDS[k]}:{a}:{b}" for k, a, b in own)
        assert found[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [found[i][f"n_{kind}"] for kind in private.KINDS] == [sum(s[0] == k for s in own) for k in range(4)]
        assert set(filter(None, said.split(","))) <= set(found[i]["spans"].split(","))


def test_private_stretches_cover_whole_texts():
    """Every base span of a region that may teach is in one stretch, however far back in the text it stands."""
    text = "plain words 12 " * 3000 + "a@b.com 255.1.2.3 " + "x +49 30 1234567 " * 60 + "a@b.com+" * 100
    for longest in (60, 400, 100_000):
        parts = private.taught(text, longest)
        assert sum(len(p["spans"]) for p in parts) == len(plain_base(text)) > 160
        for p in parts:
            assert len(p["text"]) <= longest and p["before"] + p["text"] + p["after"] in text
            for s in p["spans"]:
                assert (s["kind"], 0, s["end"] - s["start"]) in plain_base(p["text"][s["start"] : s["end"]])
    assert private.taught(None, 400) == [] and private.taught("1" * 50_000, 400) == []


def test_toxicity_windows_are_drawn_from_whole_texts():
    text = " ".join(["word"] * 30_000 + ["last"])
    some = toxicity.drawn(text, 128)
    assert len(some) == 128 and some == toxicity.drawn(text, 128) and len(toxicity.drawn(text, 10_000)) == 1250
    assert toxicity.drawn(text, 10_000)[-1].endswith("last") and toxicity.drawn(None, 5) == [""]


def test_private_model_finds_what_greed_loses():
    field = private.train([])
    own, added = private.spans("pay 4539578763621486 4556737586899855 now", field)
    assert own == [] and added == [(2, 4, 20), (2, 21, 37)]
    assert private.spans("order 4539578763621487 of 12 to 3", field) == ([], [])


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_nearest_recall(spark, name):
    path = f"/root/testdata/{name}"
    frame = pd.read_parquet(f"{path}/embeddings.parquet")
    vectors, ids = nearest.unit(np.stack(frame["embedding"]).astype(float)), frame["vec_id"].to_numpy()
    found = nearest.op10_nearest(spark, path).toPandas().groupby("query_id")["vec_id"].agg(set)
    right = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        best = ids[np.argsort(-scores)[:5]]
        right, total = right + len(set(best) & found[ids[i]]), total + 5
    assert right >= 0.9 * total


def test_pipeline(spark, tmp_path):
    """All stages against their plain versions, in a row."""
    rng = random.Random(8)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    words = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    shared, items = [words(8) for _ in range(4)], [words(9) for _ in range(3)]
    docs = {}
    for i in range(90):
        parts = [words(rng.randint(20, 60)) for _ in range(rng.randint(1, 3))]
        if i % 4 == 0:
            parts.insert(0, rng.choice(shared))
        if i % 10 == 3:
            parts.append(rng.choice(items))
        docs[i] = docs[i - 7].replace("the", "the", 1) if i % 9 == 8 else "\n".join(parts)
    docs |= {90: None, 91: "", 92: "12 34 --", 93: docs[5] + " x"}
    frame = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    left = {i: kept for i, (_, _, kept) in brute.line_dedup(left).items()}
    ids = sorted(left)
    left = {ids[k]: left[ids[k]] for k in kept_of_each([left[i] for i in ids])}

    def clean(text):
        return all(brute.least_edits(p, brute.normal(text)) > len(p) // 10 for p in map(brute.normal, items))

    left = {i: t for i, t in left.items() if clean(t)}
    library = pieces.Encoder(pieces.public_model()).library
    found = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {i: [*library.encode(t), 2] for i, t in left.items()}
    assert 40 < len(found) < 90
