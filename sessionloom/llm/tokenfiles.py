"""Token ids as Parquet list columns, written in the order of ids and read back in parts.

Documents are dealt to tasks by ranges of doc_id, so that files in the order of ``part`` and rows in the order of ``row``
are the documents in ascending order. Ids are a list column with dictionary or delta encoding; the id, length and place of a
document are columns of their own, delta encoded. Row groups and pages have controlled sizes and pages an index, so that a
reader of lengths, or of a range of documents, touches only their pages.

A task encodes through a table of the distinct pre-tokens that it has met: the library encodes each once, and the ids of a
text are joined by position. The tokenizer's pattern, normal form and lower case act on each side of a cut alike; texts with
characters for which this isn't plain are cut at white space only, and the library sees the whole pieces.

Defined results: a null text counts as empty and has the end id alone. Rows with a null id come first; rows with equal ids
follow each other in the order of their texts. Other columns aren't written.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.context import shared_dir
from sessionloom.llm.common import session, table

END = 2
#: Entries of a generation of a worker's table, and the longest piece that it keeps.
ENTRIES, LONGEST = 150_000, 64
#: The tokenizer's own pattern, for characters up to U+02AF.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼-¾"
PIECE = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{LETTERS}{NUMBERS}]+")
#: Characters that may compose or change otherwise than one by one, those above the pattern's, and special tokens.
OTHERWISE = re.compile("[\x1c-\x1fİȺȾʰ-\U0010ffff]|<\\|")
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[^{SPACES}]+")
SCHEMA = "doc_id long, part int, row long, place long, n_tokens long, ids array<int>"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain(text: str) -> bool:
    """The text has no character of ``OTHERWISE``; cheap where it is Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not OTHERWISE.search(text)
    return not any(c in text for c in ("<|", "\x1c", "\x1d", "\x1e", "\x1f"))


class Encoder:
    """Pieces are kept in two generations: when the young one is full, it becomes the old one, and what is used again returns.

    Single words go to the library's own model between blanks, without the normal form and pattern that they already
    have; printable ASCII also without the mapping of bytes, which leaves it as it is. A word ends with a token that has
    the model's suffix.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.ascii, self.bytes = Tokenizer(self.library.model), Tokenizer(self.library.model)
        self.ascii.pre_tokenizer = WhitespaceSplit()
        self.bytes.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, words: list[str], tokenizer) -> dict[str, bytes]:
        """Ids of words that the tokenizer doesn't cut, all in one call; nothing if their ends can't be told."""
        if not words:
            return {}
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<i4")
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return {}
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        kinds: dict[bool, list[str]] = {True: [], False: []}
        for p in pieces:
            if PIECE.fullmatch(p) and plain(p) and p == p.lower():
                kinds[p.isascii() and p.isprintable()].append(p)
        out = self.words(kinds[True], self.ascii) | self.words(kinds[False], self.bytes)
        for p in pieces:
            if p not in out:
                out[p] = np.array(self.library.encode(p, add_special_tokens=False).ids, "<i4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers, without an end id. New pieces are encoded first, all at once."""
        split = [[] if not t else PIECE.findall(t.lower()) if plain(t) else CHUNK.findall(t) for t in texts]
        if len(self.young) > ENTRIES:
            self.young, self.old = {}, self.young
        known, old = self.young, self.old
        new = []
        for piece in set().union(*split).difference(known):
            if piece in old:
                known[piece] = old[piece]
            else:
                new.append(piece)
        known.update(self.learn(new))
        out = [b"".join([known[p] for p in pieces]) for pieces in split]
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)


def _encoded(path: str, end: int | None):
    tail = b"" if end is None else np.array([end], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, row, place = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            raw = [ids + tail for ids in own.encode(batch.column(1).to_pylist())]
            sizes = np.fromiter(map(len, raw), np.int64, n) // 4
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(place + ends - sizes), pa.array(sizes), lists],
                ["doc_id", "part", "row", "place", "n_tokens", "ids"],
            )
            row, place = row + n, place + int(ends[-1])

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end: int | None = END, encoding: str = "dictionary", row_group: int = 32 << 20, page: int = 256 << 10, page_rows: int = 1000
) -> None:
    """Write ids of ``doc_id, text``; ``encoding`` of the ids is ``dictionary`` or ``delta``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    session(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(_encoded(tokenizer, end), SCHEMA).write
    for name, value in {
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.page.row.count.limit": str(page_rows), "compression": "zstd",
    }.items():
        writer = writer.option(name, value)
    writer.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ``start`` counts the ids of all documents before. Unused columns aren't read.

    The base of each part comes from one row per part, so no documents are sorted or moved.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    parts = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("held"))
    bases = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each row as one crc32 of little-endian 32-bit integers."""
    for batch in batches:
        lists = batch.column(3)
        edges, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), "<i4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_tokenfiles(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizer())
    return read_tokens(spark, folder).mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
