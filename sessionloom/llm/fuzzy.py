"""Near-duplicates by SimHash fingerprints, found through Golay codes.

Every 23-bit word lies within distance three of exactly one word of the (23, 12) Golay code. A segment of a fingerprint is
decoded together with its 23 neighbours; that gives one or six codewords (``keys``), such that two segments at distance
two or less share one, and the codeword of a segment is among the keys of every segment at distance one.

A fingerprint has three segments. Where two fingerprints differ in four bits or fewer, some two segments hold two errors
or fewer together (pigeonhole), so that one of these holds for an ordered pair of segments:

* one is equal and the other has two errors or fewer: the equal one and a key of the other are a common bucket;
* both have at most one: (a key of the first, codeword of the second) of one is (codeword of the first, a key of the
  second) of the other.

Within a bucket fingerprints are compared bit by bit, and only as many links are kept as connect what is near: a bucket of
n gives fewer than n links, not all pairs. Buckets over ``BLOCK`` members are compared in pieces by several tasks. Equal
fingerprints count once, so a group of near copies is no larger than the number of fingerprints close to its centre.

Defined results: texts without words (null, empty, blank) have fingerprint zero, which links like any other; a row is a
document, and rows with equal ids are one. A null id is never the id of a component unless no other id is in it.

The pipeline's stage links five-word fingerprints in this way, adds candidates that four bits miss, and keeps what is
similar by whole sets of five-word shingles (``overlap``).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sessionloom.context import cut
from sessionloom.llm import overlap
from sessionloom.llm.common import blocks, bounds, components, forest, fresh, hashes, runs, session, simhash, table

#: Fixed value: the generator polynomial of the Golay code.
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11
#: First bit and width of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints whose keys are made at once.
CHUNK = 20_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of the word shingles, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # for bytes: A-Z, and blanks are 0x20 and 0x09 to 0x0D
    return simhash(hashes(words, width))


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


@functools.cache
def _code() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainders of each byte of a word, and the error pattern for each remainder."""

    def remainder(word: int) -> int:
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - CHECKS)
        return word

    single = [remainder(1 << bit) for bit in range(LENGTH)] + [0]
    tables = []
    for byte in range(3):
        values = np.zeros(256, np.int64)
        for v in range(256):
            for bit in range(8):
                if v >> bit & 1:
                    values[v] ^= single[byte * 8 + bit]
        tables.append(values)
    errors = np.zeros(1 << CHECKS, np.int64)
    spots = [(1 << bit, single[bit]) for bit in range(LENGTH)]
    for i, (a, ra) in enumerate(spots):
        errors[ra] = a
        for j, (b, rb) in enumerate(spots[:i]):
            errors[ra ^ rb] = a | b
            for c, rc in spots[:j]:
                errors[ra ^ rb ^ rc] = a | b | c
    return tables, errors


def codeword(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    (low, mid, high), errors = _code()
    wrong = errors[low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16]]
    return (words ^ wrong) >> CHECKS


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All different codewords of each word and its neighbours: (position of the word, codeword)."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)])
    found = np.sort(codeword(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    at, column = np.nonzero(new)
    return at, found[at, column]


def buckets(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, bucket) for all buckets of each."""
    bits = prints.view(np.uint64)
    words = [(bits >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    near, own = [keys(w) for w in words], [codeword(w) for w in words]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(3):
        for j in range(3):
            if i != j:
                at, key = near[j]
                out.append((at, ((i * 3 + j) << 40) | (words[i][at] << 12) | key))
            if i < j:
                for (at, key), left in ((near[i], True), (near[j], False)):
                    pair = key << 12 | own[j][at] if left else own[i][at] << 12 | key
                    out.append((at, ((9 + i * 3 + j) << 40) | pair))
    at, bucket = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    order = np.lexsort((bucket, at))
    at, bucket = at[order], bucket[order]
    first = np.concatenate([[True], (at[1:] != at[:-1]) | (bucket[1:] != bucket[:-1])])
    return at[first], bucket[first]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            prints = batch.column(0).slice(start, CHUNK).to_numpy()
            at, bucket = buckets(prints)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(prints[at])], ["key", "fp"])


def _linked(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["key", "piece"]):
            key, piece, prints = (part.column(c).to_numpy() for c in ("key", "piece", "fp"))
            edges = bounds(key, piece)
            size = np.diff(edges)
            left, right = [], []
            start = edges[:-1][size == 2]  # most buckets that hold more than one hold two
            near = np.bitwise_count((prints[start] ^ prints[start + 1]).view(np.uint64)) <= budget
            left.append(prints[start[near]])
            right.append(prints[start[near] + 1])
            for a, b in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist(), strict=True):
                own = prints[a:b]
                links = forest(own, lambda others, p, own=own: np.bitwise_count((others ^ own[p]).view(np.uint64)) <= budget)
                if links:
                    pairs = np.array(links)
                    left.append(own[pairs[:, 0]])
                    right.append(own[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """``a, b``: links between different fingerprints (``fp``) that connect all at ``budget`` bits or fewer."""
    if budget > 4:
        raise ValueError("the buckets hold for four differing bits at most")
    session(prints.sparkSession)
    keyed = prints.mapInArrow(_keyed, "key long, fp long")
    dealt = blocks(keyed, "fp").repartition("key", "piece").sortWithinPartitions("key", "piece")
    return dealt.select("key", "piece", "fp").mapInArrow(_linked(budget), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 4) -> DataFrame:
    """``doc_id, fp, component_id``: one row for each document."""
    session(docs.sparkSession)
    printed = cut(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), budget))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    found = known.join(smallest, "root").select("fp", "component_id")
    return printed.join(found, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies by five-word shingles, the document with the smallest id stays, null ids last.

    Among equal ids the smallest digest of the text decides, then that of the whole row; of equal rows one stays.
    """
    mark = fresh(docs, "_row")
    found, roots = overlap.near_copies(docs, links)
    of = found.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = cut(of.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "row")).alias("m")).select(F.col("m.row").alias(mark)))
    keyed = docs.withColumn(mark, overlap.rows(docs))
    out = keyed.join(kept.hint("shuffle_hash"), mark, "left_semi")
    # Rows with one key are equal in all columns: which of them stays makes no difference.
    repeated = found.join(kept, F.col("row") == F.col(mark), "left_semi").count() > kept.count()
    return (out.dropDuplicates([mark]) if repeated else out).drop(mark)
