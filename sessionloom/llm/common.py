"""Helpers shared by the corpus operators: text columns, hash splits, bucket blocks and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.context import cut, utc

#: Rows per Arrow batch of the text operators: bounds a Python worker's memory where documents are long.
BATCH_ROWS = 400
#: Members of a bucket compared in one piece; larger buckets are cut into blocks and compared block by block.
BLOCK = 4096
#: Fixed value: the seed of the shingle hash.
SEED = 42


def session(spark: SparkSession) -> SparkSession:
    """The session, in UTC and with Arrow batches small enough for long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return utc(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(key: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the key and so the same on every run."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Set columns; one of the same name, in any case of letters, goes first."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[c.alias(n) for n, c in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one where the input has such a column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashes(words: list[bytes], width: int) -> np.ndarray:
    """The hash of each shingle of ``width`` words; fewer words are one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    count = max(1, len(words) - width + 1)
    stops = ends[-count:].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, count)


def simhash(hashed: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; zero where there are none."""
    if not (count := len(hashed)):
        return 0
    votes = np.unpackbits(hashed.view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view(np.int64)[0])


def blocks(keyed: DataFrame, member: str, size: int = BLOCK) -> DataFrame:
    """Deal the rows of ``key`` into pieces of bounded size: ``key, piece, member…``.

    A key with more than ``size`` rows is cut into ceil(n / size) blocks by a hash of the member, and each pair of
    blocks is a piece, so that any two members meet in some piece and no piece holds much more than two blocks.
    """
    heavy = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size).select("key", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    joined = keyed.join(heavy, "key", "left")
    block = F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(block, j) * F.col("parts") + F.greatest(block, j))
    return joined.withColumn("piece", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("parts")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup a sorted stream of batches so that no run of equal keys is cut; only the last run is carried over."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        last = [now.column(k)[-1].as_py() for k in keys]
        same = np.ones(now.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= now.column(k).to_numpy() == v
        start = now.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            yield pa.concat_tables([*kept, now.slice(0, start)])
            kept = [now.slice(start)]
        elif kept and [kept[0].column(k)[0].as_py() for k in keys] != last:
            yield pa.concat_tables(kept)
            kept = [now]
        else:
            kept.append(now)
    if kept:
        yield pa.concat_tables(kept)


def bounds(*keys: np.ndarray) -> np.ndarray:
    """The first row of each run of equal keys, and the end."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def forest(values: np.ndarray, near: Callable[[np.ndarray, int], np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that connect what ``near`` connects, at most one fewer than there are values.

    From one value after another, only those not yet reached are compared: a dense group costs a few passes.
    """
    links, rest = [], np.arange(len(values))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            hit = near(values[rest], p)
            found = rest[hit]
            links.extend((p, int(q)) for q in found)
            queue.extend(int(q) for q in found)
            rest = rest[~hit]
    return links


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node over ``a, b`` links.

    Alternating large-star and small-star rounds on written tables: links never leave the executors, a round costs
    shuffles in proportion to the links, and the number of rounds grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sign["n"], sign["s"]) == before:
            break
        before = (sign["n"], sign["s"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(lower.withColumnRenamed("m", "b")).distinct())
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
