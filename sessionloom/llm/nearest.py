"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors are scaled to length one. A table hashes by ``hashes`` functions floor((a . x + b) / width) with normal a; equal
values of all are a bucket. A query visits, in each table, its own bucket and perturbed ones in the order of their
estimated success: the probability, by the normal distribution of projected differences, that a neighbour at the usual
distance falls there. It stops when the visited buckets hold a share of all rows. Candidates of all tables are scored
exactly, in double precision, and merged.

The usual distance and the share are fitted on a bounded, hash-chosen sample (``sample_rows``), so that recall there
reaches ``recall``; neighbours in the whole table are nearer than in a sample, so recall grows with the rows. Every row is
indexed and no bucket is cut short.

Buckets are dealt to shards of about ``SHARD`` rows; a bucket with more rows is dealt by hash to several. Only the sizes of
buckets go to the driver, and their number is bounded by the hash functions. Equal vectors are indexed once with their
``k`` + 1 smallest ids (enough for any query's k, itself left out), so copies cost nothing.

Defined results: vectors that are null, zero or hold null or non-finite components, those without an id, and those of
another length than most take no part. Repeated rows count once. A query finds all others if there are fewer than k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.context import cut
from sessionloom.llm.common import sample, table

SHARD = 8192
#: Rows that the visited buckets of a table hold at least: small tables are searched whole.
LEAST = 400
SHARES = (0.01, 0.02, 0.04, 0.07, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0)
FLOOR = 1e-12


def phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by the rational approximation of the error function (error under 2e-7)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    y = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * y)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


@dataclass
class Hashes:
    """The functions of all tables."""

    size: int
    tables: int = 3
    hashes: int = 12
    width: float = 3.0
    seed: int = 5
    usual: float = 1.0
    share: float = 1.0
    a: np.ndarray = field(init=False)
    b: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.a = rng.standard_normal((self.tables, self.size, self.hashes))
        self.b = rng.uniform(-0.1, 0.1, (self.tables, self.hashes)) * self.width

    def project(self, vectors: np.ndarray, t: int) -> np.ndarray:
        return vectors @ self.a[t] + self.b[t]

    def cells(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """The bucket of each vector as one number: four bits for each function."""
        h = np.clip(np.floor(self.project(vectors, t) / self.width), -8, 7).astype(np.int64) + 8
        return (h << 4 * np.arange(self.hashes)).sum(1)

    def success(self, vectors: np.ndarray, t: int, cells: np.ndarray) -> np.ndarray:
        """The log probability, for each vector and bucket, that a neighbour at the usual distance is there."""
        at = self.project(vectors, t)
        edges = (np.arange(-7, 8)) * self.width
        out = np.zeros((len(vectors), len(cells)))
        for i in range(self.hashes):
            below = phi((edges[None, :] - at[:, i, None]) / self.usual)
            inside = np.diff(below, prepend=0.0, append=1.0, axis=1)
            out += np.log(np.maximum(inside, FLOOR))[:, cells >> 4 * i & 15]
        return out


def visited(scores: np.ndarray, counts: np.ndarray, rows: float) -> np.ndarray:
    """The score of the last bucket that each query visits."""
    order = np.argsort(-scores, axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1)
    last = np.minimum((held < rows).sum(1), len(counts) - 1)
    return np.take_along_axis(scores, np.take_along_axis(order, last[:, None], 1), 1)[:, 0]


def fit(vectors: np.ndarray, queries: int = 100, k: int = 5, recall: float = 0.96, **settings) -> Hashes:
    """The usual distance and the least share that reach the recall on a sample of unit vectors."""
    hashes = Hashes(vectors.shape[1], **settings)
    if len(vectors) <= k:
        return hashes
    asked = np.linspace(0, len(vectors) - 1, min(queries, len(vectors))).astype(int)
    near = vectors[asked] @ vectors.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, best, 1).min(1)
    hashes.usual = float(max(1e-3, np.sqrt(np.maximum(0, 2 - 2 * np.median(least)))))
    per_table = []
    for t in range(hashes.tables):
        cells, slot, counts = np.unique(hashes.cells(vectors, t), return_inverse=True, return_counts=True)
        per_table.append((hashes.success(vectors[asked], t, cells), slot, counts))
    for hashes.share in SHARES:
        found = np.zeros(best.shape, bool)
        for scores, slot, counts in per_table:
            last = visited(scores, counts, hashes.share * len(vectors))
            found |= np.take_along_axis(scores, slot[best], 1) >= last[:, None]
        if found.mean() >= recall:
            break
    return hashes


@dataclass
class Layout:
    """For each table: its buckets, their rows, their first shard and the number of shards that each is dealt to."""

    cells: list[np.ndarray]
    counts: list[np.ndarray]
    first: list[np.ndarray]
    parts: list[np.ndarray]


def layout(sizes: list[tuple[int, int, int]], tables: int) -> Layout:
    out, shard = Layout([], [], [], []), 0
    for t in range(tables):
        own = sorted((cell, n) for at, cell, n in sizes if at == t)
        first, parts, held = [], [], 0
        for _, n in own:
            count = math.ceil(n / SHARD)
            if held and (count > 1 or held + n > SHARD):
                shard, held = shard + 1, 0
            first.append(shard)
            parts.append(count)
            held += n
            if count > 1:
                shard, held = shard + count, 0
        shard += 1
        for name, values in (("cells", [c for c, _ in own]), ("counts", [n for _, n in own]), ("first", first), ("parts", parts)):
            getattr(out, name).append(np.array(values, np.int64))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.float64).reshape(len(flat), -1)


def _counted(hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = unit(_matrix(batch.column("embedding")))
                for t in range(hashes.value.tables):
                    cells, n = np.unique(hashes.value.cells(vectors, t), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), t)), pa.array(cells), pa.array(n)], ["t", "cell", "n"])

    return run


def _dealt(hashes, plan, asked: bool):
    """Rows of vectors, or of queries, for the shards: ``shard, t, asked, cell, last, id, embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = hashes.value, plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column("id").to_numpy(), unit(_matrix(batch.column("embedding")))
            for t in range(own.tables):
                cells, first, parts = where.cells[t], where.first[t], where.parts[t]
                if asked:
                    scores = own.success(vectors, t, cells)
                    last = visited(scores, where.counts[t], max(LEAST, own.share * where.counts[t].sum()))
                    pairs = []
                    for i in range(len(ids)):
                        hit = scores[i] >= last[i]
                        shards = set(first[hit].tolist())
                        for c in np.flatnonzero(hit & (parts > 1)).tolist():
                            shards.update(range(int(first[c]), int(first[c] + parts[c])))
                        pairs += [(i, s) for s in sorted(shards)]
                    at, shard = np.array(pairs, np.int64).reshape(-1, 2).T
                    cell, bound = np.zeros(len(at), np.int64), last[at]
                else:
                    at, cell = np.arange(len(ids)), own.cells(vectors, t)
                    slot = np.searchsorted(cells, cell)
                    spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    shard, bound = first[slot] + spread % parts[slot], np.zeros(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(np.full(len(at), t)), pa.array(np.full(len(at), int(asked))), pa.array(cell), pa.array(bound), pa.array(ids[at]), batch.column("embedding").take(pa.array(at))],
                    ["shard", "t", "asked", "cell", "last", "id", "embedding"],
                )

    return run


def _scored(hashes, k: int):
    """The best k + 1 vectors of a shard for each query sent there. Vectors of a shard come before its queries."""

    def best(own, t, cell, ids, vectors, norms, batch) -> pa.RecordBatch:
        order = np.argsort(cell, kind="stable")
        cell, ids, vectors, norms = cell[order], ids[order], vectors[order], norms[order]
        cells, starts = np.unique(cell, return_index=True)
        ends = np.append(starts[1:], len(cell))
        asked = _matrix(batch.column("embedding"))
        lengths = np.sqrt((asked * asked).sum(1))
        hit = own.success(unit(asked), t, cells) >= batch.column("last").to_numpy()[:, None]
        scores = np.full((len(asked), len(cell)), -np.inf)
        for c, (a, b) in enumerate(zip(starts, ends, strict=True)):
            rows = np.flatnonzero(hit[:, c])
            if len(rows):
                scores[rows, a:b] = (asked[rows] @ vectors[a:b].T) / (lengths[rows][:, None] * norms[None, a:b])
        queries, out = batch.column("id").to_numpy(), ([], [], [])
        for i in range(len(asked)):
            found = np.flatnonzero(np.isfinite(scores[i]))
            top = found[np.lexsort((ids[found], -scores[i][found]))[: k + 1]] if len(found) <= 4 * k else None
            if top is None:
                limit = np.partition(scores[i], len(cell) - k - 1)[len(cell) - k - 1]
                found = np.flatnonzero(scores[i] >= limit)
                top = found[np.lexsort((ids[found], -scores[i][found]))[: k + 1]]
            for column, values in zip(out, (np.full(len(top), queries[i]), ids[top], scores[i][top]), strict=True):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, ready = [], None, None
        for batch in batches:
            shards, asked = batch.column("shard").to_numpy(), batch.column("asked").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (asked[1:] != asked[:-1])])) if len(shards) else []
            for a, b in zip(new, [*new[1:], len(shards)], strict=True):
                part = batch.slice(a, b - a)
                if shards[a] != now:
                    held, now, ready = [], shards[a], None
                if not asked[a]:
                    held.append(part)
                    continue
                if ready is None:
                    if not held:
                        continue
                    rows = pa.Table.from_batches(held)
                    vectors = _matrix(rows.column("embedding"))
                    ready = (int(part.column("t")[0].as_py()), rows.column("cell").to_numpy(), rows.column("id").to_numpy(), vectors, np.sqrt((vectors * vectors).sum(1)))
                for start in range(0, part.num_rows, 256):
                    yield best(hashes.value, *ready, part.slice(start, 256))

    return run


def sound(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, once each."""
    whole = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)"
    )
    size = whole.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return whole.where(F.size("embedding") == (size["n"] if size else 0)).distinct()


def nearest(vectors: DataFrame, queries: str, k: int = 5, sample_rows: int = 10_000, **settings) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that the condition ``queries`` selects."""
    spark = vectors.sparkSession
    ranked = sound(vectors).withColumn("_r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
    first = cut(ranked.where(F.col("_r") <= k + 1))
    classes = first.where("_r = 1").select(F.col("vec_id").alias("id"), "embedding")
    total = classes.count()
    members = first.join(classes, "embedding").select("id", "vec_id")
    asking = sound(vectors).where(queries).join(classes, "embedding").select("id", F.col("vec_id").alias("query_id"))
    asking = cut(asking)
    drawn = sample(classes, "id", sample_rows, total).orderBy("id").limit(2 * sample_rows).collect()
    matrix = unit(np.array([r["embedding"] for r in drawn], float)) if drawn else np.ones((1, 1))
    hashes = spark.sparkContext.broadcast(fit(matrix, k=k, **settings))
    sizes = classes.mapInArrow(_counted(hashes), "t long, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n"))
    plan = layout([tuple(r) for r in sizes.collect()], hashes.value.tables)
    shared = spark.sparkContext.broadcast(plan)
    schema = "shard long, t long, asked long, cell long, last double, id long, embedding array<double>"
    index = classes.mapInArrow(_dealt(hashes, shared, False), schema)
    probes = classes.join(asking.select("id").distinct(), "id", "left_semi").mapInArrow(_dealt(hashes, shared, True), schema)
    dealt = index.unionByName(probes).repartition("shard").sortWithinPartitions("shard", "asked")
    scored = dealt.mapInArrow(_scored(hashes, k), "query long, id long, score double").groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")
    # Equal vectors share one list of candidates; a query leaves itself out, so k + 1 of them are enough.
    listed = best.join(members, "id").withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    named = asking.join(listed.withColumnRenamed("query", "_of").drop("id"), F.col("id") == F.col("_of")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy("_r")
    return named.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
