"""Exact single-link clusters within groups of candidates, by rounds of pivots.

A group holds sets that may be alike (numbers in ascending order, as bytes). In a round some members of each group are its
pivots: up to ``PIVOTS``, and ``PIVOT_BYTES`` of sets. They are compared with all members, those of one cluster only until
one matches. What was a pivot needs no other comparison. A group is finished when at most one cluster, the largest, holds
members that were no pivots: any two members of different clusters have then been compared. Groups up to the number of
pivots are finished in one round; a dense group of any size takes a few, as nearly all members join the first clusters.

A group with more than ``PART`` members is dealt to several tasks, each of which gets the pivots. A task gives fewer links
than it has members and pivots; it holds the pivots' sets and otherwise streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.context import cut
from sessionloom.llm.common import components, forest

PIVOTS, PIVOT_BYTES, PART = 1024, 32 << 20, 4096


def alike(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two ascending sets have at least the least similarity (a fraction); two empty sets have."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return not len(large)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both * least[1] >= (len(a) + len(b) - both) * least[0]


class _Run:
    """The pivots of a group, and the clusters known so far."""

    def __init__(self, least: tuple[int, int], dtype: str):
        self.least, self.dtype = least, dtype
        self.nodes, self.sets, self.own = [], [], []
        self.up: dict[int, int] = {}
        self.ready = False

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        """Make one cluster of two, the smaller number its name."""
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        self.cluster[self.cluster == max(a, b)] = min(a, b)
        return a != b

    def alike(self, held: np.ndarray) -> np.ndarray:
        """Which pivots are alike to a set: each of its elements is looked up in all of theirs at once."""
        at = np.searchsorted(self.elements, held)
        at[at == len(self.elements)] = 0
        at = at[self.elements[at] == held] if len(self.elements) else at[:0]
        count = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.holder[places], minlength=len(self.nodes))
        return both * self.least[1] >= (self.sizes + len(held) - both) * self.least[0]

    def start(self) -> list[tuple[int, int]]:
        """Links between the pivots."""
        self.ready = True
        self.sizes, self.cluster = np.array([len(s) for s in self.sets]), np.array(self.own, np.int64)
        every, of = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets), dtype=np.int32), self.sizes)
        order = np.argsort(every, kind="stable")
        self.elements, starts = np.unique(every[order], return_index=True)
        self.starts, self.holder = np.append(starts, len(every)), of[order]

        def near(at: np.ndarray, p: int) -> np.ndarray:
            return self.alike(self.sets[p])[at] | (self.cluster[at] == self.cluster[p])

        return [(self.nodes[p], self.nodes[q]) for p, q in forest(np.arange(len(self.nodes)), near) if self.join(self.own[p], self.own[q])]

    def member(self, node: int, cluster: int, held: np.ndarray) -> list[tuple[int, int]]:
        links = []
        alike, own = self.alike(held), self.top(cluster)
        while len(rest := np.flatnonzero(alike & (self.cluster != own))):
            links.append((self.nodes[rest[0]], node))
            self.join(self.own[rest[0]], cluster)
            own = self.top(cluster)
        return links


def _compared(least: tuple[int, int], dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            root, part, pivot, node, cluster = (batch.column(i).to_pylist() for i in range(5))
            for i, of in enumerate(zip(root, part, strict=True)):
                if of != key:
                    if now is not None and not now.ready:
                        links += now.start()
                    key, now = of, _Run(least, dtype)
                held = np.frombuffer(batch.column(5)[i].as_py(), dtype)
                if pivot[i]:
                    now.nodes.append(node[i])
                    now.own.append(cluster[i])
                    now.sets.append(held)
                    continue
                if not now.ready:
                    links += now.start()
                links += now.member(node[i], cluster[i], held)
            yield _links(links)
        if now is not None and not now.ready:
            yield _links(now.start())

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(1, initial=2**63 - 1)), pa.array(pairs.max(1, initial=-(2**63)))], ["a", "b"])


def _round(members: DataFrame, wanted: DataFrame, compare: Callable) -> tuple[DataFrame, DataFrame]:
    """Pivots among the ``wanted`` nodes (``root, node, bytes``), and the links that they give with all members of their groups."""
    first = Window.partitionBy("root").orderBy("node")
    few = wanted.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= PIVOTS)
    held = few.withColumn("_before", F.coalesce(F.sum("bytes").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pivots = cut(held.where(F.col("_before") < PIVOT_BYTES).select("root", "node"))
    marked = members.join(pivots.select("root").distinct(), "root", "left_semi").join(pivots.select("node", F.lit(True).alias("pivot")), "node", "left")
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.when(F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int")))
    dealt = marked.withColumn("pivot", F.coalesce("pivot", F.lit(False))).withColumn("part", F.explode(own))
    ordered = dealt.repartition("root", "part").sortWithinPartitions("root", "part", F.desc("pivot"), "node")
    return pivots, ordered.select("root", "part", "pivot", "node", "cluster", "held").mapInArrow(compare, "a long, b long")


def clustered(members: DataFrame, least: tuple[int, int], dtype: str = "<u8") -> DataFrame:
    """Links ``a, b`` that connect exactly what chains of alike members of a group connect.

    ``members``: a written table of ``root`` (the group), ``node`` and ``held``, the set.
    """
    compare = _compared(least, dtype)
    sized = members.select("root", "node", F.length("held").cast("long").alias("bytes"))
    groups = sized.groupBy("root").agg(F.count("*").alias("n"))
    counted = members.join(groups, "root")
    pivots, links = _round(counted.withColumn("cluster", F.col("node")), sized, compare)
    links = cut(links)
    done = pivots
    while True:
        # Only groups with members that were no pivots can have something left.
        left = sized.join(done, ["root", "node"], "left_anti")
        known = cut(left.select("root").distinct())
        if known.isEmpty():
            return links
        held = sized.join(known, "root", "left_semi")
        of_group = links.join(held.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")
        clusters = cut(held.join(components(of_group).withColumnRenamed("root", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node")))
        largest = clusters.groupBy("root", "cluster").agg(F.count("*").alias("k")).groupBy("root").agg(F.min(F.struct(-F.col("k"), "cluster")).alias("m"))
        rest = clusters.join(largest.select("root", F.col("m.cluster").alias("cluster")), ["root", "cluster"], "left_anti")
        wanted = cut(rest.join(done, ["root", "node"], "left_anti").select("root", "node", "bytes"))
        if wanted.isEmpty():
            return links
        pivots, more = _round(counted.join(clusters.select("node", "cluster"), "node"), wanted, compare)
        links, done = cut(links.unionByName(more)), cut(done.unionByName(pivots))
