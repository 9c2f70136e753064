"""The pipeline's near-copy stage and language stage: whole results on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import clusters, common, fuzzy, language, overlap

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(texts):
    """The smallest place of each component of pairs at a similarity of 0.8 or more."""
    found, root = [sets(t) for t in texts], list(range(len(texts)))
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    for start in range(len(texts)):
        queue = [start] if root[start] == start else []
        while queue:
            at = queue.pop()
            for i in range(start + 1, len(texts)):
                if root[i] == i and near(found[at], found[i]):
                    root[i] = start
                    queue.append(i)
    return {i for i in root if root[i] == i}


def corpus():
    """Copies with more and more words changed, so that pairs lie on both sides of 0.8; and one group of many near copies."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for size in (20, 60, 200, 600):
        for _ in range(12):
            base = rng.choices(words, k=size)
            texts.append(" ".join(base))
            for changes in (1, 2, 4, 8, 16):
                copy = list(base)
                for at in rng.sample(range(size), min(changes, size // 4)):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    base = rng.choices(words, k=300)
    for _ in range(80):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice((2, 5, 8))):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    return texts


def test_stage_keeps_one_of_each_component(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    expected = kept(texts)
    assert {r["doc_id"] for r in fuzzy.stage(spark, docs, "").collect()} == expected
    monkeypatch.setattr(common, "BLOCK", 16)
    assert {r["doc_id"] for r in fuzzy.stage(spark, docs, "").collect()} == expected


@pytest.mark.parametrize(("pivots", "part"), [(1024, 4096), (12, 7)])
def test_clusters_of_groups(spark, monkeypatch, pivots, part):
    """Chains, tight and scattered groups, whatever the numbers of pivots and parts."""
    monkeypatch.setattr(clusters, "PIVOTS", pivots)
    monkeypatch.setattr(clusters, "PART", part)
    rng = np.random.default_rng(3)
    sets, root = [], []
    for g, (size, kind) in enumerate([(40, "chain"), (60, "tight"), (12, "apart"), (1, "tight"), (25, "mixed"), (2, "empty")]):
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        for k in range(size):
            own = base.copy()
            if kind == "chain":
                own[: 3 * k % 60] = rng.integers(0, 1 << 63, 3 * k % 60)
            elif kind != "tight" or k % 9 == 8:
                at = rng.choice(60, 0 if kind == "empty" else 30 if kind == "apart" else rng.integers(0, 14), replace=False)
                own[at] = rng.integers(0, 1 << 63, len(at))
            sets.append(np.zeros(0, np.uint64) if kind == "empty" else np.unique(own))
            root.append(g)
        if kind == "chain":  # each like the one before only
            for k in range(1, size):
                own = sets[-size + k - 1].copy()
                own[rng.choice(len(own), 5, replace=False)] = rng.integers(0, 1 << 63, 5)
                sets[-size + k] = np.unique(own)
    order = rng.permutation(len(sets))
    rows = [(root[i], int(k), sets[i].astype("<u8").tobytes()) for k, i in enumerate(order)]
    links = [tuple(r) for r in clusters.clustered(spark.createDataFrame(rows, "root long, node long, held binary"), (4, 5)).collect()]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert rows[a][0] == rows[b][0] and overlap.alike(sets[order[a]], sets[order[b]])
        up[max(top(a), top(b))] = min(top(a), top(b))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] == rows[b][0] and 5 * len(np.intersect1d(sets[order[a]], sets[order[b]])) >= 4 * len(np.union1d(sets[order[a]], sets[order[b]])):
                assert top(a) == top(b)
    if part >= 500 and pivots > 1:
        assert len(links) < len(rows)


def test_hot_group_gives_few_links(spark):
    """3 000 copies of one text, a few words changed in each, many pairs just under 0.8."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = []
    for _ in range(3000):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice((1, 1, 2, 3))):
            copy[at] = f"v{rng.randrange(3000)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    seen = []
    real = clusters.clustered

    def watched(members, *args, **kw):
        links = real(members, *args, **kw)
        seen.append((members.count(), links.count()))
        return links

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(overlap, "clustered", watched)
        found = {r["doc_id"] for r in fuzzy.stage(spark, docs, "").collect()}
    assert seen and seen[0][1] < 2 * seen[0][0]
    names: dict[tuple, int] = {}
    held = [np.array(sorted(names.setdefault(g, len(names)) for g in sets(t))) for t in texts]
    matrix = np.zeros((len(texts), len(names)), np.float32)
    for row, own in zip(matrix, held, strict=True):
        row[own] = 1
    size, rest, roots = matrix.sum(1), np.arange(len(texts)), set()
    while len(rest):
        queue = [int(rest[0])]
        roots.add(queue[0])
        rest = rest[1:]
        while queue and len(rest):
            p = queue.pop()
            both = matrix[rest][:, held[p]].sum(1)
            hit = 5 * both >= 4 * (size[rest] + size[p] - both)
            queue += rest[hit].tolist()
            rest = rest[~hit]
    assert found == roots


def test_pair_that_fingerprints_miss(spark):
    """More than four bits apart, yet at 0.8 by five words."""
    texts = corpus()
    pair = next(
        (a, b)
        for i, a in enumerate(texts) for b in texts[i + 1 : i + 6]
        if a and b and 5 * len(sets(a) & sets(b)) >= 4 * len(sets(a) | sets(b)) and (fuzzy.fingerprint(a) ^ fuzzy.fingerprint(b)).bit_count() > 8
    )
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(pair)], DOCS)
    assert [r["doc_id"] for r in fuzzy.stage(spark, docs, "").collect()] == [0]
    assert overlap.alike(overlap.shingles(pair[0]), overlap.shingles(pair[1]))


def test_linked_fingerprints_are_candidates(spark, monkeypatch):
    """Near copies come together by their fingerprints alone, and what they bring together is compared exactly."""
    rng = random.Random(9)
    texts = []
    for size in (60, 300, 900):
        for _ in range(20):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            texts += [" ".join(base), " ".join([*base[:-1], "x"])]
    texts += ["a b c d e f g " * 60 + " ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(2)]  # repeats count in fingerprints only
    texts += ["one " * 9, "one " * 12]
    prints = [fuzzy.fingerprint(t, 5) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 4}
    alike = {(i, j) for i, j in near if 5 * len(sets(texts[i]) & sets(texts[j])) >= 4 * len(sets(texts[i]) | sets(texts[j]))}
    assert len(alike) > 20 and near - alike and (len(texts) - 2, len(texts) - 1) in alike
    monkeypatch.setattr(overlap, "_pairs", lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    gone = set(range(len(texts))) - {r["doc_id"] for r in fuzzy.stage(spark, docs, "").collect()}
    assert gone == {j for _, j in alike}


def test_rows_without_ids_are_documents_of_their_own(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(50)) for _ in range(6)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2] + " x"), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[5]), (None, texts[5])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in data], DOCS)
    found = sorted((r["text"], r["doc_id"]) for r in fuzzy.stage(spark, docs, "").collect())
    assert len(found) == 6
    third = next(t for t, _ in found if t.startswith(texts[2]))
    assert [x for x in found if x[0] != third] == sorted([(texts[0], None), (texts[1], None), (texts[3], 7), (texts[4], 7), (texts[5], 8)], key=lambda x: x[0])
    again = docs.repartition(5).withColumn("text", F.col("text"))
    assert sorted((r["text"], r["doc_id"]) for r in fuzzy.stage(spark, again, "").collect()) == found


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "Ein Satz.", None, None, 9), (2, "12 34 --", None, None, 8), (3, None, None, None, 0), (4, "日本", None, None, 2)], DOCS)
    assert {r["doc_id"] for r in language.stage(spark, docs, "").collect()} == {1, 4}
