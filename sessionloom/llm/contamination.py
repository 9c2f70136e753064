"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters may differ from a passage by ``k = floor(rate * L)`` edits. It is cut into k + 1 pieces; a
passage within k edits holds at least one piece unchanged. Pieces are found by their first eight bytes (shorter pieces
whole, in a table of their length), looked up for all places of a text at once. The stretch around an exact piece hit is verified with Myers' bit-parallel distance, first for
two neighbouring pieces, then four, and so on: by the same argument one of the unchanged pieces lies, at each level, in m
pieces that have at most m - 1 edits. Most chance hits end at the first level; the last is the whole item.

Texts and items are compared in lower case, each run of other characters than letters and digits as one blank.

The items are sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each block against all documents; a
benchmark of any size is searched whole.

Defined results: null or empty texts have no hits; null, empty or wordless items match nothing. Items below eight bytes
count where they occur unchanged as whole words. Items with equal text are all reported. Of several places in a document
that match an item, the one with the fewest edits, then the first, is reported. Repeated rows are searched each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from sessionloom.llm.common import fresh, session, table

OTHER = re.compile(r"[\W_]+")
#: Bytes of a piece that are looked up at most, and bits of the lookup's first filter.
GRAM, FILTER = 8, 20
BLOCK_CHARS = 1 << 23
MIX = np.uint64(0x9E3779B97F4A7C15)
HITS = ArrayType(StructType().add("item_id", LongType()).add("distance", IntegerType()).add("start", IntegerType()).add("end", IntegerType()))


def normal(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


class Grams:
    """The first ``width`` bytes of pieces, and the pieces that begin with them."""

    def __init__(self, width: int, first: dict[int, list[tuple]]):
        self.keep = np.uint64((1 << 8 * width) - 1)
        self.grams = np.array(sorted(first), np.uint64)
        self.pieces = [first[int(g)] for g in self.grams]
        self.filter = np.zeros(1 << FILTER, bool)
        self.filter[self.grams * MIX >> np.uint64(64 - FILTER)] = True

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a text holds a gram, and which."""
        grams = grams & self.keep
        at = np.flatnonzero(self.filter[grams * MIX >> np.uint64(64 - FILTER)])
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        exact = self.grams[slot] == grams[at]
        return at[exact], slot[exact]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def closest(places: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern to any stretch of ``text``, and the first end of such a stretch."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for at, c in enumerate(text, 1):
        equal = places.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(horizontal | up), up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        if score < best:
            best, end = score, at
    return best, end


class Benchmark:
    """Items, their pieces, and the lookup of the pieces' first bytes."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float):
        ids: dict[str, list[int | None]] = {}
        for item, text in items:
            if found := normal(text):
                ids.setdefault(found, []).append(item)
        self.texts, self.ids = list(ids), list(ids.values())
        self.budgets, self.short, self.reversed = [], [], {}
        self.masks: dict[int, dict[str, int]] = {}
        first: dict[int, dict[int, list[tuple]]] = {}
        for i, text in enumerate(self.texts):
            self.budgets.append(k := min(math.floor(rate * len(text)), len(text) - 1))
            if len(text.encode()) < GRAM:
                self.short.append(i)
                continue
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            for p, levels in enumerate(self.levels(text, cuts)):
                piece = text[cuts[p] : cuts[p + 1]].encode()
                of = first.setdefault(min(GRAM, len(piece)), {})
                of.setdefault(int.from_bytes(piece[:GRAM], "little"), []).append((i, cuts[p], piece, levels, self.beside(text, cuts, p, levels)))
        self.tables = [Grams(width, of) for width, of in sorted(first.items())]

    @staticmethod
    def levels(text: str, cuts: list[int]) -> list[list[tuple[int, int, int, dict[str, int]]]]:
        """For each piece the groups of pieces around it, small ones first: first and last place, edits, masks."""
        out: list[list] = [[] for _ in cuts[1:]]

        def halve(a: int, b: int, above: list) -> None:
            if b - a == 1:
                out[a] = above
                return
            whole = b - a == len(cuts) - 1
            group = above if whole else [(cuts[a], cuts[b], b - a - 1, masks(text[cuts[a] : cuts[b]])), *above]
            middle = (a + b) // 2
            halve(a, middle, group)
            halve(middle, b, group)

        halve(0, len(cuts) - 1, [])
        return out

    @staticmethod
    def beside(text: str, cuts: list[int], p: int, levels: list) -> tuple[str, str, int, int] | None:
        """Where a piece has one neighbour in its first group, with one edit: the neighbour's halves and place. One half is unchanged."""
        if not levels or levels[0][2] != 1:
            return None
        a, b = (cuts[p + 1], levels[0][1]) if levels[0][0] == cuts[p] else (levels[0][0], cuts[p])
        return text[a : (a + b) // 2], text[(a + b) // 2 : b], a, b

    def candidates(self, text: str) -> dict[int, list[int]]:
        """Places where each item could start: exact piece hits whose neighbours are near, too."""
        out: dict[int, list[int]] = {}
        raw = text.encode()
        if not raw or not self.tables:
            return out
        grams = np.ndarray((len(raw),), "<u8", raw + bytes(GRAM), strides=(1,))
        chars = None
        for table in self.tables:
            at, slot = table.places(grams)
            if not len(at):
                continue
            if chars is None:
                chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
            for byte, char, s in zip(at.tolist(), chars[at].tolist(), slot.tolist(), strict=True):
                for item, offset, piece, levels, beside in table.pieces[s]:
                    if raw.startswith(piece, byte):
                        start = char - offset
                        if beside and beside[0] not in (near := text[max(0, start + beside[2] - 1) : max(0, start + beside[3] + 1)]) and beside[1] not in near:
                            continue
                        if all(closest(of, b - a, text[max(0, start + a - k) : max(0, start + b + k)])[0] <= k for a, b, k, of in levels):
                            out.setdefault(item, []).append(start)
        return out

    def verified(self, i: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        """The best match of item i around the starts: distance, start, end."""
        item, k = self.texts[i], self.budgets[i]
        if i not in self.masks:
            self.masks[i], self.reversed[i] = masks(item), masks(item[::-1])
        starts.sort()
        best = None
        while starts:
            n = 1
            while n < len(starts) and starts[n] - starts[n - 1] <= 2 * k:
                n += 1
            low, high = max(0, starts[0] - k), min(len(text), starts[n - 1] + len(item) + k)
            starts = starts[n:]
            distance, end = closest(self.masks[i], len(item), text[low:high])
            if distance <= k and (best is None or distance < best[0]):
                _, back = closest(self.reversed[i], len(item), text[low : low + end][::-1])
                best = (distance, low + end - back, low + end)
        return best

    def hits(self, text: str | None) -> list[dict]:
        text = normal(text)
        found = []
        for i, starts in self.candidates(text).items():
            if match := self.verified(i, starts, text):
                found.append((i, *match))
        for i in self.short:
            if (at := f" {text} ".find(f" {self.texts[i]} ")) >= 0:
                found.append((i, 0, at, at + len(self.texts[i])))
        return [{"item_id": item, "distance": d, "start": a, "end": b} for i, d, a, b in found for item in self.ids[i]]


def _hits(benchmark):
    @F.pandas_udf(HITS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = benchmark.value
        for texts in batches:
            yield pd.Series([own.hits(t) for t in texts])

    return found


def with_hits(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = BLOCK_CHARS, into: str = "_hits") -> DataFrame:
    """The documents with an array ``into`` of ``item_id, distance, start, end`` (in the normal form of the text)."""
    spark = session(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where(F.length("text") > 0)
    count = max(1, math.ceil((items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) / block_chars))
    columns = []
    for b in range(count):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == b)
        shared = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in block.toLocalIterator()], rate))
        columns.append(_hits(shared)(F.col("text")))
    return docs.withColumn(into, columns[0] if count == 1 else F.concat(*columns))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each document and each item that it holds."""
    found = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("_hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance", F.col("hit.start").alias("match_start"), F.col("hit.end").alias("match_end"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item go."""
    into = fresh(docs, "_hits")
    return with_hits(docs, table(spark, sf_dir, "benchmark"), into=into).where(F.size(into) == 0).drop(into)
