"""Ranked lexical search by a prefix tree of documents, bounded depth first for each item.

Documents are cut down to the terms that some item uses. Each becomes a list of terms, most frequent first, so that
documents with the same frequent terms share a path of a tree (an FP-tree whose leaves are documents). A node knows the
largest tf of its term and the smallest m among the documents below it. The score of a term grows with tf and falls with
m, so these give an upper bound for every document below.

An item sees the tree through the nodes of its own terms only (its conditional tree, found by the header lists). Bounds of
the best path below a node are gathered from the leaves up; the search then goes depth first, the best child first, leaves
every branch whose bound lies below the item's last kept score, and scores the documents of the others exactly.

Steps, each a Spark job over all documents: term vectors are written once; frequencies, N and L come from the written
table; each task builds trees of bounded blocks of its documents and carries its best scores from block to block; the
best of all tasks meet by item. Items come in blocks of ``BLOCK_CHARS``; only the terms and weights of one block are
broadcast at a time.

Defined results: null or term-less documents are no candidates and do not count in N; null or term-less items give no
rows; rows of equal ids are documents (or items) of their own, null ids come last among equal scores. Other columns have
no effect.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.context import cut
from sessionloom.llm.common import session, table

#: Results of an item, and the numbers of the score.
BEST, SCALE = 20, 1_000_000_000
#: In UTF-8, lower-cased as bytes: ASCII letters and digits, and all bytes of code points beyond.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Characters of the items of a block, and the documents and entries of a tree.
BLOCK_CHARS, TREE_DOCS, TREE_ENTRIES = 4 << 20, 4096, 1 << 20


def terms(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode().lower()) if text else []


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            ids, lengths, held, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py())
                if found:
                    counts = Counter(map(number.get, found))
                    counts.pop(None, None)
                    ids.append(doc_id)
                    lengths.append(len(found))
                    held.append(list(counts))
                    tfs.append(list(counts.values()))
            arrays = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])

    return run


class Tree:
    """A block of documents as arrays. Nodes are numbered in preorder; a node's documents are a range of the sorted ones."""

    def __init__(self, ids: list[int | None], m: np.ndarray, ranks: list[np.ndarray], tfs: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda k: ranks[k].astype(">i4").tobytes())
        self.ids = [ids[k] for k in order]
        sizes = np.array([len(ranks[k]) for k in order])
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.rank, tf = np.concatenate([ranks[k] for k in order]), np.concatenate([tfs[k] for k in order]).astype(np.int64)
        of_doc = np.repeat(np.arange(len(order)), sizes)
        m = m[order]
        #: What one unit of weight adds to the score of an entry's document.
        self.gain = SCALE * tf // (1000 * tf + 12 * m[of_doc])
        node, path, count = np.empty(len(tf), np.int64), np.empty(max(sizes, default=0), np.int64), 0
        before = np.empty(0, np.int32)
        first: list[np.ndarray] = []
        for a, b in itertools.pairwise(self.edges.tolist()):
            own = self.rank[a:b]
            size = min(len(own), len(before))
            differ = np.flatnonzero(own[:size] != before[:size])
            shared = int(differ[0]) if len(differ) else size
            path[shared : b - a] = np.arange(count, count + b - a - shared)
            first.append(np.arange(a + shared, b))
            count += b - a - shared
            node[a:b] = path[: b - a]
            before = own
        made = np.concatenate(first)
        self.low = of_doc[made]
        self.high = np.zeros(count, np.int64)
        np.maximum.at(self.high, node, of_doc + 1)
        most, least = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
        np.maximum.at(most, node, tf)
        np.minimum.at(least, node, m[of_doc])
        self.bound = SCALE * most // (1000 * most + 12 * least)
        by_term = np.argsort(self.rank[made], kind="stable")
        known, starts = np.unique(self.rank[made][by_term], return_index=True)
        #: For each term its nodes, in preorder.
        self.header = dict(zip(known.tolist(), np.split(by_term, starts[1:]), strict=True))

    def score(self, doc: int, weight: np.ndarray) -> int:
        a, b = self.edges[doc], self.edges[doc + 1]
        return int((weight[self.rank[a:b]] * self.gain[a:b]).sum())

    def search(self, weights: dict[int, int], weight: np.ndarray, best: list[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
        """The best of ``best`` and this block: (-score, no id, id), in order."""
        held = [(self.header[t], w) for t, w in weights.items() if t in self.header]
        if not held:
            return best
        nodes = np.concatenate([h for h, _ in held])
        gain = np.concatenate([w * self.bound[h] for h, w in held])
        order = np.argsort(nodes)
        nodes, gain = nodes[order], gain[order]
        low, high = self.low[nodes], self.high[nodes]
        # A node lies below all earlier ones that haven't ended where it begins.
        depth = np.arange(len(nodes)) - np.searchsorted(np.sort(high), low, "right")
        levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        parent, path, below = np.full(len(nodes), -1), gain.copy(), np.zeros(len(nodes), np.int64)
        for up, down in itertools.pairwise(levels):
            parent[down] = up[np.searchsorted(up, down) - 1]
            path[down] += path[parent[down]]
        for down in levels[:0:-1]:
            np.maximum.at(below, parent[down], gain[down] + below[down])
        by_parent = np.argsort(parent, kind="stable")
        child = np.searchsorted(parent[by_parent], np.arange(-1, len(nodes) + 1))
        bound = path + below
        last = -best[-1][0] if len(best) == BEST else 1

        def children(k: int) -> np.ndarray:
            return by_parent[child[k + 1] : child[k + 2]]

        def push(some: np.ndarray) -> None:
            some = some[bound[some] >= last]
            stack.extend(some[np.argsort(bound[some], kind="stable")].tolist())

        stack: list[int] = []
        push(children(-1))
        while stack:
            k = stack.pop()
            if bound[k] < last:
                continue
            inner = children(k)
            if path[k] >= last:  # documents that end here, so far as this item goes
                docs = np.arange(low[k], high[k])
                if len(inner):
                    at = np.searchsorted(low[inner], docs, "right") - 1
                    docs = docs[(at < 0) | (high[inner][at] <= docs)]
                for d in docs.tolist():
                    score = self.score(d, weight)
                    if score >= last:
                        best = sorted([*best, (-score, self.ids[d] is None, self.ids[d] or 0)])[:BEST]
                        last = -best[-1][0] if len(best) == BEST else 1
            if len(inner):
                push(inner)
        return best


def _searched(shared, count: int, length: int):
    """The best documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, items = shared.value
        weight = np.zeros(len(rank), np.int64)
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        ids, lengths, ranks, tfs, entries = [], [], [], [], 0

        def flush() -> None:
            n = np.array(lengths, np.int64)
            tree = Tree(ids, 100 - 25 + 25 * n * count // length, ranks, tfs)
            for i, own in enumerate(items):
                weight[list(own)] = list(own.values())
                best[i] = tree.search(own, weight, best[i])
                weight[list(own)] = 0

        for batch in batches:
            numbers, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists, tf = batch.column(2), batch.column(3)
            edges, number, values = lists.offsets.to_numpy(), lists.values.to_numpy(), tf.values.to_numpy()
            for doc_id, n, a, b in zip(numbers, sizes, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                own = rank[number[a:b]]
                order = np.argsort(own)
                ids.append(doc_id)
                lengths.append(n)
                ranks.append(own[order])
                tfs.append(values[a:b][order])
                entries += b - a
                if len(ids) >= TREE_DOCS or entries >= TREE_ENTRIES:
                    flush()
                    ids, lengths, ranks, tfs, entries = [], [], [], [], 0
        if ids:
            flush()
        rows = [(i, None if none else doc, -score) for i, own in enumerate(best) for score, none, doc in own]
        for start in range(0, len(rows), 1 << 16):
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows[start : start + (1 << 16)], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "score"])

    return run


def _ranked_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]]) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in block for t in own})
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = cut(docs.mapInArrow(_vectors(spark.sparkContext.broadcast(number)), "doc_id long, n long, terms array<int>, tfs array<int>"))
    count, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    df = dict.fromkeys(range(len(vocabulary)), 0)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = n
    rank = np.empty(len(vocabulary), np.int32)
    rank[sorted(df, key=lambda t: (-df[t], t))] = np.arange(len(vocabulary))
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
    items = [{int(rank[number[t]]): weight[number[t]] * times for t, times in Counter(own).items()} for _, own in block]
    found = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(_searched(spark.sparkContext.broadcast((rank, items)), count, length), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item (``doc_id, text`` against ``item_id, text``)."""
    spark = session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    items = items.select(F.col("item_id").cast("long"), F.col("text")).where(F.length("text") > 0)
    count = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).toLocalIterator()
        found = _ranked_block(docs, [(item_id, terms(text)) for item_id, text in rows])
        if found is not None:
            out = found if count == 1 else out.unionByName(cut(found))
    return out


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
