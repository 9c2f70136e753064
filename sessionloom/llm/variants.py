"""Spelling variants: words one edit apart, found by comparing tiles of padded code-point matrices.

Two words are near if one inserted, deleted or replaced code point makes one the other. That is so exactly if their common
prefix and common suffix together reach the length of the longer one less one. A tile holds the words of one bucket as a
matrix of code points, one row for each word; prefixes are counted from the left edge, suffixes from the right, for all
pairs of two blocks of rows at once.

Which blocks have to meet follows from the same sum: of two near words, the longer of length L, either the first L // 2
code points agree or the last L - L // 2 do. So each word enters, for L its length and its length plus one, the bucket of
its first piece and that of its last. A pair that agrees in both belongs to the bucket of the first piece alone, so
each near pair is counted once. A bucket of more than ``BLOCK`` words (fewer where words are long: a block holds
``BLOCK_BYTES`` at most, or a single word) is cut into blocks, and each pair of blocks is a tile of its own task.

Tiles return no pairs: for each word the number of near words there and the best form, so that a tile gives no more rows
than it has words.

Defined results: a null text has no words; a null id counts as the empty text in the hash; words are told apart by code
points only (A-Z are lower-cased, letters beyond keep their case); a document that occurs twice counts twice. Other columns
of the input have no effect.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.context import cut
from sessionloom.llm.common import bounds, runs, session, table

#: Least length and occurrences of a word, how often the hash drops a code point, how much more often a form occurs.
LEAST, OFTEN, DROPPED, TIMES = 7, 2, 31, 10
#: Words of a block, its bytes, and the rows of a block that are compared at once.
BLOCK, BLOCK_BYTES, ROWS = 2048, 4 << 20, 256
#: Different words that a task gathers before it hands on their counts.
HELD = 200_000
#: In Latin-1 each code point up to U+00FF is one byte, and any other becomes a question mark, which ends a run.
RUN = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % LEAST)


def words(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text, in Latin-1, with their numbers."""
    found = Counter(RUN.findall(text.encode("latin-1", "replace").lower())) if text else Counter()
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if not h % DROPPED:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST:
            out[run] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.update(words(doc_id, text.as_py()))
            if len(held) >= HELD:
                yield _counts(held)
                held = Counter()
    yield _counts(held)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` (Latin-1 bytes), ``n``: the words that occur often enough."""
    session(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _common(left: np.ndarray, right: np.ndarray, columns: list[tuple[int, int]]) -> np.ndarray:
    """How many of the column pairs, from the first on, agree for each pair of rows."""
    alive = np.ones((len(left), len(right)), bool)
    count = np.zeros(alive.shape, np.uint8 if len(columns) < 256 else np.int32)
    for a, b in columns:
        alive &= left[:, a, None] == right[None, :, b]
        if not alive.any():
            break
        count += alive
    return count


def near(left: np.ndarray, right: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near rows of two matrices, the left one of the longer words, that the bucket of this side counts."""
    long, short = left.shape[1], right.shape[1]
    prefix = _common(left, right, [(j, j) for j in range(short)]).astype(np.int32)
    suffix = _common(left, right, [(long - 1 - j, short - 1 - j) for j in range(short)])
    first = prefix >= long // 2
    return np.nonzero((prefix + suffix >= long - 1) & (first if side == 0 else ~first))


class _Rows:
    """Rows of whole tiles, and for each the near words counted and the best form met."""

    def __init__(self, part: pa.Table):
        self.words = part.column("word").combine_chunks()
        self.n, self.block = part.column("n").to_numpy(), part.column("block").to_numpy()
        edges = np.frombuffer(self.words.buffers()[1], np.int32)[self.words.offset : self.words.offset + len(self.words) + 1]
        self.size, self.starts = np.diff(edges), edges[:-1]
        self.bytes = np.frombuffer(self.words.buffers()[2], np.uint8)
        self.count = np.zeros(len(self.n), np.int64)
        self.form = np.full(len(self.n), -1, np.int64)

    def matrix(self, at: np.ndarray) -> np.ndarray:
        return self.bytes[self.starts[at][:, None] + np.arange(self.size[at[0]])[None, :]]

    def meet(self, left: np.ndarray, right: np.ndarray, side: int) -> None:
        """Compare two blocks, the left one of words no shorter; pairs of one block count once."""
        if not len(left) or not len(right):
            return
        same = left is right
        other = self.matrix(right)
        for start in range(0, len(left), ROWS):
            own = left[start : start + ROWS]
            # Positions ascend, so a block that meets itself needs the rows from here on only.
            p, q = near(self.matrix(own), other[start:] if same else other, side)
            a, b = own[p], right[start:][q] if same else right[q]
            if same:
                a, b = a[a < b], b[a < b]
            self.add(np.concatenate([a, b]), np.concatenate([b, a]))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, 1)
        often = self.n[b] >= TIMES * self.n[a]
        for i, j in zip(a[often].tolist(), b[often].tolist(), strict=True):
            f = self.form[i]
            if f < 0 or (-self.n[j], self.words[j].as_py()) < (-self.n[f], self.words[int(f)].as_py()):
                self.form[i] = j

    def tile(self, a: int, b: int, kind: int, number: int) -> None:
        """Compare rows a to b. ``kind`` is twice the longer length, plus one for the bucket of last pieces."""
        long, side = divmod(kind, 2)
        at, block = np.arange(a, b), self.block[a:b]
        whole, less = ([at[(self.size[a:b] == size) & (block == x)] for x in np.unique(block)] for size in (long, long - 1))
        if number < 0:
            self.meet(whole[0], whole[0], side)
            self.meet(whole[0], less[0], side)
        elif len(whole) == 2:
            self.meet(whole[0], whole[1], side)
            self.meet(whole[0], less[1], side)
            self.meet(whole[1], less[0], side)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in runs(batches, ["kind", "piece", "tile"]):
        rows, kind, number = _Rows(part), part.column("kind").to_numpy(), part.column("tile").to_numpy()
        edges = bounds(kind, part.column("piece").to_numpy(), number)
        many = np.diff(edges) > 1
        for a, b in zip(edges[:-1][many].tolist(), edges[1:][many].tolist(), strict=True):
            rows.tile(a, b, int(kind[a]), int(number[a]))
        at = np.flatnonzero(rows.count)
        best = pa.array(rows.form[at], mask=rows.form[at] < 0)
        yield pa.RecordBatch.from_arrays([rows.words.take(pa.array(at)), pa.array(rows.count[at]), pa.array(rows.n).take(best), rows.words.take(best)], ["word", "n_near", "form_n", "form"])


def dealt(vocabulary: DataFrame) -> DataFrame:
    """The words of each tile: ``kind, piece, tile, block, word, n``."""
    size = F.length("word")
    sides = []
    for more in (0, 1):
        long = size + more
        half = F.floor(long / 2).cast("int")
        sides.append(F.struct((long * 2).alias("kind"), F.xxhash64(F.substring("word", F.lit(1), half)).alias("piece")))
        sides.append(F.struct((long * 2 + 1).alias("kind"), F.xxhash64(F.substring("word", size - (long - half) + 1, long - half)).alias("piece")))
    keyed = vocabulary.select("word", "n", F.explode(F.array(*sides)).alias("b")).select("b.*", "word", "n")
    fits = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / F.floor(F.col("kind") / 2))))
    heavy = keyed.groupBy("kind", "piece").agg(F.count("*").alias("held")).where(F.col("held") > fits)
    parts = heavy.select("kind", "piece", F.ceil(F.col("held") / fits).cast("int").alias("parts"))
    split = keyed.join(parts, ["kind", "piece"], "left").withColumn("block", F.pmod(F.xxhash64("word", F.lit(11)), F.col("parts")).cast("int"))
    # A block with itself has a negative number.
    pair = lambda j: F.when(j == F.col("block"), -1 - j.cast("long")).otherwise(F.least("block", j) * F.col("parts").cast("long") + F.greatest("block", j))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)
    tiled = split.withColumn("tile", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(tiles)))
    return tiled.select("kind", "piece", "tile", F.coalesce("block", F.lit(0)).alias("block"), "word", "n")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word."""
    known = cut(vocabulary(docs))
    tiles = dealt(known).repartition("kind", "piece", "tile").sortWithinPartitions("kind", "piece", "tile", "block", "word")
    found = tiles.mapInArrow(_compared, "word binary, n_near long, form_n long, form binary")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    near_words = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    joined = cut(known.join(near_words, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))
    # A form occurs ten times as often as its word at least, so the numbers bound the length of a chain.
    steps = math.log(max(joined.agg(F.max("n")).first()[0] or 1, 1), TIMES) + 1
    links = joined.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    rooted = joined.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rooted.select(text("word"), text("form"), text("root"), "n", "n_near", "form_n")


def op12_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
