"""Removal of lines that repeat across documents, by two Bloom filters.

One pass over the texts writes the 128-bit digests of each document's distinct line keys as a table, by the task that reads
them, without a shuffle. Over that table each task fills two Bloom filters, of digests it has seen once and twice, and sends
only the bits it has set. Filters of one range of digests are merged bit by bit: a bit is set twice if a task has it so, or
two tasks have it once. A second pass over the table asks the merged second filters; only the digests they suspect, with
their documents, are shuffled for the exact count and the choice of the document that keeps its lines.

All filters of a corpus grow with it, so they are never in one place: a range has ``RANGE`` bits, and a pass takes the
filters of at most ``PASS`` ranges to the tasks. The table is sorted by digest within pieces of it, so a pass reads the pages
of its own ranges. A larger corpus takes more passes, each over fewer pages. A line that very many documents share has the
bits of one line in each task, is counted by task first, and may be split in the join.

Defined results: a null or empty text is one empty line. A row is a document; rows with the same id count one by one, and
all those with the largest id keep their lines. A null id counts as smaller than any; rows without ids, or with equal ones,
get the lists of their own text. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from sessionloom.context import cut
from sessionloom.llm.common import bounds, fresh, replace_columns, session, table

STRIPPED = " \t\n\x0b\x0c\r"
#: Bits of a range's filter, bits for each digest, and bits set by one.
RANGE, BITS, PROBES = 1 << 23, 16, 2
#: Ranges whose filters the tasks of one pass hold.
PASS = 32
#: Digests that a task handles at once.
GATHERED = 1 << 18
HELD = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64())])
LOWEST = -(1 << 63)


def digest(line: str, least: int) -> bytes | None:
    """The digest of a line's key; none if the key is shorter than ``least`` code points."""
    key = line.strip(STRIPPED)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least else None  # bytes.lower() changes A-Z alone


def digests(text: str | None, least: int) -> set[bytes]:
    return {d for line in (text or "").split("\n") if (d := digest(line, least))}


def _held(least: int):
    """The digests of documents, sorted within pieces of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, docs, keys = bytearray(), [], []

        def flush() -> pa.RecordBatch:
            pair = np.frombuffer(bytes(raw), "<i8").reshape(-1, 2)
            order = pa.array(np.argsort(pair[:, 0]))
            columns = [pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(docs, pa.int64()), pa.array(keys, pa.int64())]
            return pa.RecordBatch.from_arrays([x.take(order) for x in columns], schema=HELD)

        for batch in batches:
            for text, doc, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = digests(text, least)
                raw += b"".join(found)
                docs += [doc] * len(found)
                keys += [key] * len(found)
            if len(docs) >= GATHERED:
                yield flush()
                raw, docs, keys = bytearray(), [], []
        if docs:
            yield flush()

    return run


def range_of(hi: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a digest; ranges follow each other in the order of ``hi``."""
    return (((hi.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def least_of(number: int, ranges: int) -> int:
    """The least ``hi`` of a range."""
    return (-(-(number << 32) // ranges) << 32) - (1 << 63)


def probes(lo: np.ndarray) -> np.ndarray:
    """The bits of digests in the filters of their range."""
    width = RANGE.bit_length() - 1
    return np.stack([(lo.view(np.uint64) >> np.uint64(i * width)) & np.uint64(RANGE - 1) for i in range(PROBES)]).astype(np.uint32)


def has(filter: np.ndarray, at: np.ndarray) -> np.ndarray:
    return filter[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


class Filters:
    """The bits of a range's digests seen once and seen twice."""

    def __init__(self):
        self.once, self.twice = (np.zeros(RANGE // 8, np.uint8) for _ in range(2))

    @staticmethod
    def put(filter: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(filter, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        """Add the bits that another pair of filters has set."""
        self.put(self.twice, np.concatenate([twice, once[has(self.once, once)]]))
        self.put(self.once, once)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= GATHERED:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if size:
        yield pa.Table.from_batches(kept)


def set_bits(hi: np.ndarray, lo: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each range the bits of all digests given, and of those given twice."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    edges = bounds(hi, lo)
    again, first = np.diff(edges) > 1, edges[:-1]
    of, at = range_of(hi[first], ranges), probes(lo[first])
    edges = bounds(of)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(of[a]), np.unique(at[:, a:b]), np.unique(at[:, a:b][:, again[a:b]])


def _bits(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            found = list(set_bits(part.column("hi").to_numpy(), part.column("lo").to_numpy(), ranges))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _, _ in found], pa.int64()), *(pa.array([f[i].astype("<u4").tobytes() for f in found], pa.binary()) for i in (1, 2))], ["range", "once", "twice"]
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter of each range, from rows in the order of ranges."""
    number, filters = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([filters.twice.tobytes()], pa.binary())], ["range", "twice"])

    for batch in batches:
        for of, *bits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if of != number:
                if filters:
                    yield out()
                number, filters = of, Filters()
            filters.merge(*(np.frombuffer(b, "<u4") for b in bits))
    if filters:
        yield out()


def _suspects(shared, ranges: int):
    """The rows whose digest the second filter of its range suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {r: np.frombuffer(f, np.uint8) for r, f in shared.value.items()}
        for part in _gathered(batches):
            of, at = range_of(part.column("hi").to_numpy(), ranges), probes(part.column("lo").to_numpy())
            suspected = np.zeros(len(of), bool)
            for r in np.unique(of).tolist():
                mine = np.flatnonzero(of == r)
                suspected[mine] = has(filters[r], at[:, mine]).all(0)
            yield from part.filter(pa.array(suspected)).combine_chunks().to_batches()

    return run


def suspects(held: DataFrame) -> DataFrame:
    """The rows of a table of digests (``hi, lo, doc_id, key``) that may be in more than one document."""
    spark = held.sparkSession
    ranges = max(1, math.ceil(held.count() * BITS / RANGE))
    bits = held.select("hi", "lo").mapInArrow(_bits(ranges), "range long, once binary, twice binary")
    merged = cut(bits.repartition(min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), "range").sortWithinPartitions("range").mapInArrow(_merged, "range long, twice binary"))
    found = []
    for first in range(0, ranges, PASS):
        end = min(first + PASS, ranges)
        shared = spark.sparkContext.broadcast(dict(map(tuple, merged.where(F.col("range").between(first, end - 1)).toLocalIterator())))
        rows = held.where(F.col("hi") >= least_of(first, ranges))
        if end < ranges:
            rows = rows.where(F.col("hi") < least_of(end, ranges))
        found.append(cut(rows.mapInArrow(_suspects(shared, ranges), held.schema)))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found)


@F.pandas_udf(StructType().add("kept", StringType()).add("n_lines", LongType()).add("n_dropped", LongType()))
def _without(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for texts, lists, leasts in batches:
        rows = []
        for text, dropped, least in zip(texts, lists, leasts, strict=True):
            lines = (text or "").split("\n")
            if dropped is None or not len(dropped):
                rows.append((text or "", len(lines), 0))
                continue
            gone = {struct.pack("<qq", *map(int, d.split(":"))) for d in dropped}
            kept = [line for line in lines if digest(line, least) not in gone]
            rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        yield pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, least: int = 20, documents: int = 3, into: str = "_lines") -> DataFrame:
    """The documents with a column ``into``: ``kept`` text, ``n_lines`` and ``n_dropped``.

    A line of one document stays there, so one and two mean the same for ``documents``.
    """
    session(docs.sparkSession)
    doc, key = F.col("doc_id").cast("long"), F.xxhash64("text")
    held = cut(docs.select(F.col("text"), doc, key.alias("key")).mapInArrow(_held(least), "hi long, lo long, doc_id long, key long"))
    doubted = suspects(held).withColumn("order", F.coalesce("doc_id", F.lit(LOWEST).cast("long")))
    counted = doubted.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("order").alias("last")).where(F.col("n") >= max(documents, 2))
    of, hashed, gone = (fresh(docs, c) for c in ("_of", "_key", "_gone"))
    drops = (
        doubted.join(cut(counted.select("hi", "lo", "last")), ["hi", "lo"])  # as a table it can be broadcast if small, and a line of very many documents be split
        .where("order < last")
        .groupBy(F.col("doc_id").alias(of), F.col("key").alias(hashed))
        .agg(F.collect_set(F.concat_ws(":", F.col("hi").cast("string"), F.col("lo").cast("string"))).alias(gone))
    )
    joined = docs.join(drops, doc.eqNullSafe(F.col(of)) & (key == F.col(hashed)), "left")
    return joined.withColumn(into, _without(F.col("text"), F.col(gone), F.lit(least))).drop(of, hashed, gone)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.kept").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its repeated lines; ``n_chars`` follows the text."""
    into = fresh(docs, "_lines")
    names = {c.lower() for c in docs.columns}
    dropped = F.col(f"{into}.n_dropped") > 0
    changed = {"text": F.when(dropped, F.col(f"{into}.kept")).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(dropped, F.length(f"{into}.kept").cast("long")).otherwise(F.col("n_chars"))
    return replace_columns(dedup_lines(docs, into=into), **changed).select(*[F.col(f"`{c}`") for c in docs.columns])
