"""SentencePiece encoding and decoding through a table of distinct marked words.

The library writes each blank as a marker. Where no piece of a vocabulary has a marker after another character, no merge
crosses from a word to the marker that follows, so a text falls into marked words that are segmented alone. Each worker
holds a table of the distinct marked words that it has met: the library segments a word once, and the ids of a text are
joined from the table by position. The table is bounded; when full, it starts anew.

A vocabulary with pieces across markers, or one whose rules change the text, is refused. No model is trained here.

Defined results: a null text counts as empty and gives the end id alone. Repeated rows are encoded each.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from sessionloom.llm.common import session, table

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries of a worker's table, and the longest word that it keeps.
ENTRIES, LONGEST = 150_000, 64
#: The id that ends each text.
END = 2


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.library.encode("a  b ", out_type=str)[0][0] != MARK or self.library.decode(self.library.encode(" a  \tb ")) != " a  \tb ":
            raise ValueError("pieces of this vocabulary cross markers, or it changes texts")
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.mark = np.int32(self.library.piece_to_id(MARK)).tobytes()
        self.end = np.int32(END).tobytes()
        self.words: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as 32-bit integers; the library itself sets the first marker.

        Words with one marker are segmented in one call: each begins at a piece that begins with a marker.
        """
        single = [w for w in words if len(w) > 1 and w[1] != MARK]
        ids = np.array(self.library.encode(" ".join([w[1:] for w in single])), np.int32)
        starts = np.flatnonzero(self.marked[ids]) if single else []
        if len(starts) != len(single):
            raise AssertionError("a word has more than one marked piece")
        raw, places = ids.tobytes(), [4 * int(i) for i in starts] + [4 * len(ids)]
        out = {w: raw[a:b] for w, a, b in zip(single, places, places[1:], strict=False)}
        for w in words:
            if w not in out:
                out[w] = np.array(self.library.encode(w[1:].replace(MARK, " ")), np.int32).tobytes() if len(w) > 1 else self.mark
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id. Words that the table lacks are segmented first, all at once."""
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.words
        if len(known) > ENTRIES:
            known.clear()
        missing = set().union(*split).difference(known)
        new = self.learn(list(missing))
        known.update(new)
        out = [np.frombuffer(b"".join([known[w] for w in words]) + self.end, np.int32) for words in split]
        for w in missing:
            if len(w) > LONGEST:
                del known[w]
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return self.library.decode(ids.tolist() if isinstance(ids, np.ndarray) else list(ids))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)


@functools.cache
def _decimal(size: int) -> np.ndarray:
    return np.array([str(i) for i in range(size)], dtype=object)


def tokens(text: Column, path: str) -> Column:
    """A column of ids."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series(own.encode(texts))

    return encoded(text)


def texts(ids: Column, path: str) -> Column:
    """The texts of columns of ids."""

    @F.pandas_udf(StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for lists in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in lists])

    return decoded(ids)


def digests(text: Column, path: str, whole: bool = False) -> Column:
    """``n_tokens, ids_sha256, decoded_sha256`` of the ids of a text and of the text decoded from them; with ``whole`` also ``ids``."""
    fields = StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    @F.pandas_udf(fields.add("ids", ArrayType(IntegerType())) if whole else fields)
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        decimal = _decimal(own.library.get_piece_size())
        for part in batches:
            rows = []
            for ids in own.encode(part):
                row = (len(ids), hashlib.sha256(" ".join(decimal[ids].tolist()).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest())
                rows.append((*row, ids) if whole else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + whole])

    return digested(text)


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", digests(F.col("text"), public_model()).alias("d")).select("doc_id", "d.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded text."""
    session(spark)
    return docs.select("doc_id", digests(F.col("text"), public_model(), whole=True).alias("d")).select("doc_id", "d.*")
