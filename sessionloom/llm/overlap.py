"""Near copies by the Jaccard similarity of their sets of word shingles.

Texts are compared as sets of ``WIDTH``-word shingles (lower-case A-Z, words between blanks); two are near copies at a
similarity of ``LEAST`` or more. Texts with the same words count once, whatever their number.

* Fingerprints of the shingles (SimHash) are linked through their Golay codes, by the operator of ``fuzzy``: any two texts
  whose fingerprints differ in four bits or fewer are candidates, without exception.
* At 0.8 about ten bits of 64 differ, so ``BANDS`` keys of ``ROWS`` minima find the candidates that four bits miss: a pair
  at 0.8 shares a key with a chance of 1 - 1e-5.
* Within a bucket of minima, sizes (exact) and ``BITS`` one-bit minima discard what is far; the bits keep a pair at 0.8 with a
  chance of 1 - 1e-6 (five standard deviations).
* What hangs together so is a group, and the groups are cut into exact clusters on whole sets of shingles by rounds of
  pivots (``clusters``): a dense group of n copies costs a few comparisons for each, and no pair of a group that could
  join two clusters stays uncompared.

Buckets over ``common.BLOCK`` members are compared in pieces by several tasks.

Defined results: texts without words (null, empty, blank) are copies of each other; a text below five words is one
shingle. Every row is a document of its own, also where ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from sessionloom.context import cut
from sessionloom.llm import clusters, common
from sessionloom.llm.clusters import clustered
from sessionloom.llm.common import blocks, bounds, components, forest, hashes, runs, session, simhash

#: Words of a shingle, and the least similarity as a fraction.
WIDTH, LEAST = 5, (4, 5)
BANDS, ROWS, BITS = 16, 3, 128
#: Most one-bit minima that differ: 12.8 are expected at 0.8, with a standard deviation of 3.4.
FAR = 30
#: Shingles of a text that are mapped at once.
CHUNK = 4096

_random = np.random.default_rng(42)
_FLIP, _TIMES = (_random.integers(0, 1 << 64, BITS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)

PRINTED = StructType()
for _name in ("hi", "lo", "n", "fp", "s0", "s1"):
    PRINTED.add(_name, LongType())
PRINTED.add("keys", ArrayType(LongType()))
MEMBERS = ("node", "n", "s0", "s1")


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of a text, hashed."""
    return np.unique(hashes((text or "").encode().lower().split(), WIDTH))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have at least the least similarity; two empty sets have."""
    return clusters.alike(a, b, LEAST)


def _print(text: str | None) -> tuple:
    words = (text or "").encode().lower().split()
    digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
    if not words:
        return int(digest[0]), int(digest[1]), 0, 0, 0, 0, []
    every = hashes(words, WIDTH)
    found = np.unique(every)
    least = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), CHUNK):
        np.minimum(least, ((found[start : start + CHUNK, None] ^ _FLIP) * _TIMES).min(0), out=least)
    sketch = np.packbits(least >> np.uint64(17) & np.uint64(1) == 1).view(np.int64)
    bands = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = [xxhash.xxh3_64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(bands)]
    return int(digest[0]), int(digest[1]), len(found), simhash(every), int(sketch[0]), int(sketch[1]), keys


@F.pandas_udf(PRINTED)
def prints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_print(t if isinstance(t, str) else None) for t in texts], columns=PRINTED.names)


@F.pandas_udf(BinaryType())
def grams(texts: pd.Series) -> pd.Series:
    """The different shingles of each text as little-endian 64-bit numbers in order."""
    return pd.Series([shingles(t if isinstance(t, str) else None).astype("<u8").tobytes() for t in texts], dtype=object)


def _close(n: np.ndarray, s0: np.ndarray, s1: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """Which members at the places ``at`` may be near copies of member ``p``."""
    differ = np.bitwise_count((s0[at] ^ s0[p]).view(np.uint64)).astype(int) + np.bitwise_count((s1[at] ^ s1[p]).view(np.uint64))
    small, large = np.minimum(n[at], n[p]), np.maximum(n[at], n[p])
    return (differ <= FAR) & (small * LEAST[1] >= large * LEAST[0])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the candidates of each bucket."""
    for part in runs(batches, ["key", "piece"]):
        node, n, s0, s1 = (part.column(c).to_numpy() for c in MEMBERS)
        edges = bounds(part.column("key").to_numpy(), part.column("piece").to_numpy())
        many = np.diff(edges) > 1
        pairs = [np.zeros((0, 2), np.int64)]
        for a, b in zip(edges[:-1][many].tolist(), edges[1:][many].tolist(), strict=True):
            found = forest(np.arange(a, b), lambda at, p, a=a: _close(n, s0, s1, at, a + p))
            if found:
                pairs.append(a + np.array(found))
        at = np.concatenate(pairs)
        a, b = node[at[:, 0]], node[at[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _pairs(nodes: DataFrame) -> DataFrame:
    keyed = nodes.select(F.explode("keys").alias("key"), *MEMBERS)
    dealt = blocks(keyed, "node", common.BLOCK).repartition("key", "piece").sortWithinPartitions("key", "piece", "node")
    return dealt.select("key", "piece", *MEMBERS).mapInArrow(_candidates, "a long, b long").where("a <> b").distinct()


def rows(docs: DataFrame) -> Column:
    """A key of a row: its id, text and other columns. Rows with one key are equal in all columns."""
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")), rest.cast("string")).cast("binary"))


def _printed_alike(nodes: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links that connect the nodes with equal or linked fingerprints; of equal ones the smallest node has the links."""
    own = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    equal = nodes.join(own, "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
    ends = [own.select(F.col("fp").alias(f"_{c}"), F.col("first").alias(c)) for c in "ab"]
    near = links(own.select("fp")).distinct().select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(ends[0], "_a").join(ends[1], "_b").select("a", "b")
    return equal.unionByName(near)


def near_copies(docs: DataFrame, links: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All rows (``row, doc_id, digest, node``) and the components of the nodes that have near copies (``node, root``).

    ``links`` connects fingerprints (``fp``) that are near: ``fuzzy.links``.
    """
    session(docs.sparkSession)
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    printed = cut(docs.select(rows(docs).alias("row"), "doc_id", digest.alias("digest"), prints(F.col("text")).alias("p")).select("row", "doc_id", "digest", "p.*"))
    # Rows with the same words have the same prints; the number of a node is fixed when the table is written.
    nodes = cut(
        printed.groupBy("hi", "lo").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", "s0", "s1", "keys")]).withColumn("node", F.monotonically_increasing_id())
    )
    found = printed.select("row", "doc_id", "digest", "hi", "lo").join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("row", "doc_id", "digest", "node")
    groups = components(_pairs(nodes).unionByName(_printed_alike(nodes, links)))
    wanted = nodes.join(groups, "node").select("row", "node", "root").hint("shuffle_hash")
    # Equal rows have one key, so any of them gives the node's text.
    texts = docs.select(rows(docs).alias("row"), "text").join(wanted, "row").dropDuplicates(["node"])
    held = cut(texts.select("root", "node", grams(F.col("text")).alias("held")))
    return found, components(clustered(held, LEAST))
