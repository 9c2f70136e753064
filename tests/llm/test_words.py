"""Fingerprints by spots, spelling variants and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import lexical, spots, variants

DOCS = "doc_id long, text string, word string, n long, _part int, tile int, score int"


def frame(spark, rows):
    """The documents with further columns that bear names of results and of inner columns."""
    return spark.createDataFrame([(i, t, "w", 7, 7, 7, 7) for i, t in rows], DOCS)


def plain_words(docs):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    known = plain_words(docs)
    form, near = {}, {w: [v for v in known if one_edit(w, v)] for w in known}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 10 * known[w] else None
    out = {}
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None)
    return out


def corpus(seed=3, docs=120):
    rng = random.Random(seed)
    parts = ["tion", "er", "Th", "éa", "lich", "Ça", "ä", "x", "in"]
    words = ["".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(150)]
    words += [w[:i] + rng.choice("aéz") + w[i + rng.randint(0, 1) :] for w in words for i in [rng.randrange(len(w))]]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 120)))) for i in range(docs)]
    long = "abcdefg" * 900
    extra = [f"{long} {long}x {long} {long}x {long}y", None, "", "ГДЕ×÷ naïve ÀÖØÞßÿ ÀÖØÞßÿ ÀÖØÞÞÿ ÀÖØÞÞÿ", "Wortwort " * 300 + "wortworx wortworx Wortwor Wortwor"]
    return [*rows, *((1000 + i, t) for i, t in enumerate(extra)), (None, rows[0][1]), (5, rows[7][1]), (5, rows[7][1])]


@pytest.mark.parametrize("block", [2048, 3])
def test_variants(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    docs = corpus()
    want = plain_variants(docs)
    found = variants.variants(frame(spark, docs)).collect()
    assert len(found) == len(want) > 150
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == want
    assert any(r["form"] != r["root"] and r["form"] for r in found) or any(r["form"] for r in found)


def test_chain_of_forms(spark):
    text = " ".join(["aaaaaaa"] * 3000 + ["aaaaaab"] * 250 + ["aaaaabb"] * 20 + ["aaaabbb"] * 2)
    docs = [(i, text) for i in range(2)]
    assert {r["word"]: (r["form"], r["root"]) for r in variants.variants(frame(spark, docs)).collect() if r["n"] > 3} == {
        w: v[:2] for w, v in plain_variants(docs).items() if v[2] > 3
    }


def test_near_matrices():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choices("ab", k=rng.randint(7, 9)))
        b = "".join(rng.choices("ab", k=len(a) - rng.randint(0, 1)))
        if a != b:
            left, right = (np.frombuffer(w.encode(), np.uint8)[None, :] for w in (a, b))
            assert sum(len(variants.near(left, right, side)[0]) for side in (0, 1)) == one_edit(a, b)


def plain_rank(docs, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    counted = [(i, Counter(pattern.findall(lower(t)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    count, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 25 + (25 * c.total() * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in pattern.findall(lower(text)))
            scores.append((-score, i is None, i or 0))
        out += [(item_id, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:20])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("docs_of_tree", "chars"), [(4096, 1 << 20), (7, 60)])
def test_ranked(spark, monkeypatch, docs_of_tree, chars):
    monkeypatch.setattr(lexical, "TREE_DOCS", docs_of_tree)
    docs = corpus(5, 200)
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(docs)[1].split()[: rng.randint(1, 30)] + ["tion", "TION"])) for k in range(12) if docs[k][1]]
    items += [(50, None), (51, ""), (52, "!!"), (53, "unheard of"), (None, "tioner Thin"), (54, "ГДЕ 日本")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    found = lexical.ranked(frame(spark, docs), benchmark, chars).collect()
    assert sorted(map(tuple, found), key=str) == plain_rank(docs, items)


def test_ranked_ties(spark):
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words here"), (3, "same words here")]
    items = spark.createDataFrame([(1, "words words")], "item_id long, text string")
    assert sorted(map(tuple, lexical.ranked(frame(spark, docs), items).collect()), key=str) == plain_rank(docs, [(1, "words words")])


def plain_spots(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.lower().encode())
    every = len(words) <= spots.SHORT or sum(w in spots.ANCHORS for w in words) * spots.SPARSE < len(words)
    out = set()
    for i, w in enumerate(words):
        if every or w in spots.ANCHORS:
            after = [x for x in words[i + 1 :] if x not in spots.ANCHORS][: spots.CHAIN]
            if len(after) == spots.CHAIN:
                out.add((w, *after))
    if not out and text:
        out = {tuple(words) or text}
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_edits(spark, parts):
    rng = random.Random(4)
    words = "the of and house river le de maison garden stone casa".split() + [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate([*texts, "", "!!! ???", "one", "é" * 5000, texts[1], texts[1]])]
    order = [(i, t) for i, t in reversed(rows)]
    want = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own = plain_spots(text)
        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), len(own) * 8, len(plain_spots(edited)) * 8, jaccard(own, plain_spots(edited)), jaccard(own, plain_spots(after)))
    rng.shuffle(rows)
    found = spots.with_edits(frame(spark, rows).repartition(3), parts).collect()
    assert {r[0]: (r[1], r[2], len(r[3]), len(r[4]), pytest.approx(r[5]), pytest.approx(r[6])) for r in found} == want
    same = {r["fingerprint"] for r in found if r["doc_id"] in (3, 192, 195)}
    assert len(same) == 1 and len(found) == len(rows)


def test_edits_odd(spark):
    found = spots.with_edits(frame(spark, [(7, "only one document of some length")]), 4).collect()
    assert len(found) == 1 and found[0]["near_next"] == 1.0
    rows = [(None, None), (None, "no id"), (4, "x"), (4, "x"), (4, "y of z"), (None, None)]
    assert len(spots.with_edits(frame(spark, rows), 3).collect()) == len(rows)
    assert spots.with_edits(frame(spark, []), 3).count() == 0
    large = [(2**62 + i, f"text number {i} of many") for i in range(40)] + [(None, "none")]
    for parts in (3, 11):
        found = {r["doc_id"]: r["edited_sha256"] for r in spots.with_edits(frame(spark, large), parts).collect()}
        for i in range(1, 40):
            text, after = large[i][1], large[i - 1][1]
            cut = len(text) // 3
            assert found[2**62 + i] == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()


def test_likeness_and_partitions():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint32)) for _ in range(2))
        exact = jaccard(set(a.tolist()), set(b.tolist()))
        assert spots.likeness(a, b) == pytest.approx(exact)
        least = float(rng.uniform(0.05, 0.9))
        assert spots.likeness(a, b, least) == (pytest.approx(exact) if exact >= least else pytest.approx(0) if spots.likeness(a, b, least) == 0 else pytest.approx(exact))
        if exact >= least and len(a) and len(b):
            assert abs(int(spots.partition(len(a), least)) - int(spots.partition(len(b), least))) <= 1


def test_near_documents(spark):
    rng = random.Random(9)
    words = "the of and a is to".split() * 12 + [f"word{i}" for i in range(400)]
    texts = ["", None, "the of", "one two three"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(5, 250))
        for changes in (0, 0, 1, 2, 5, 12):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    held, root = [plain_spots(t or "") for t in texts], list(range(len(texts)))
    for start in range(len(texts)):
        queue = [start] if root[start] == start else []
        while queue:
            at = queue.pop()
            for i in range(start + 1, len(texts)):
                if root[i] == i and jaccard(held[at], held[i]) >= 0.8:
                    root[i] = start
                    queue.append(i)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert {r["doc_id"]: r["component_id"] for r in spots.near_documents(frame(spark, rows)).collect()} == dict(enumerate(root))
