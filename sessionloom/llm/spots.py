"""Document fingerprints by spot signatures: chains of content words that follow common words.

Common words of a language (``ANCHORS``) stand evenly in running text and hardly in menus, lists and tables, so a text is
fingerprinted where they stand: each anchor with the next ``CHAIN`` words that are no anchors is a spot, and the set of
the hashed spots is the fingerprint. In a text of few words, or with few anchors, every word is an anchor; these spots
come in addition, so a text just above the bound and its edited form below it still share theirs.

The likeness of two fingerprints is the Jaccard similarity of the sets. Where a least likeness is asked for, sets are
partitioned by their lengths such that partners lie in the same or the next partition, and a comparison ends as soon as
what is left can't reach it any more (``likeness``); ``near_documents`` groups all documents by these partitions.

``with_edits`` sets each document beside its edited text and the document that follows in descending order of ids. Rows
are dealt by split points of the order, drawn from a bounded sample of keys; each part also gets the first row of the
following part, so that one shuffle brings neighbours together and rows stream through a task in order.

Defined results: a null text counts as empty; the empty text has the empty fingerprint, which is wholly like another empty
one; a text without words is one spot of its own, as is one with too few words for a chain. Null ids come last, and rows
of equal ids follow each other in the order of a hash of their texts, then as they come. Other columns have no effect.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from sessionloom.context import cut
from sessionloom.llm.clusters import clustered
from sessionloom.llm.common import components, sample, session, table

#: Common words.
ANCHORS = frozenset(
    w.encode()
    for words in (
        "a an and are as at be been but by for from had has have he her his i in is it its not of on or that the their they this to was were which with you",
        "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou où par pas pour que qui se son sont sur un une",
        "al como con de del el en es está este ha la las lo los más no o para pero por que se sin son su sus un una y ya",
        "aber als am auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nach nicht sich sie sind und von war wie wird zu zum zur",
        "ao com da das do dos é em foi mais não na nas no nos os ou pela pelo por que sem ser seu sua um uma",
        "ai al alla che con da dal dei del della di e gli ha il in la le lo ma nel non per più si sono un una",
        "dat de die een en er haar het hij ik in is met niet of om op te tot van voor was ze zijn",
    )
    for w in words.split()
)
#: Content words of a spot, and the number of words up to which (and of words to an anchor from which) every word is an anchor.
CHAIN, SHORT, SPARSE = 2, 64, 16
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Sampled keys for each part of the order.
DRAWN = 64
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def signatures(text: str | None) -> np.ndarray:
    """The different spots of a text, hashed to 32 bits, in order."""
    if not text:
        return np.zeros(0, np.uint32)
    words = WORD.findall(text.lower().encode())
    common = np.fromiter((w in ANCHORS for w in words), bool, len(words))
    content = np.flatnonzero(~common)
    anchors = np.flatnonzero(common)
    if len(words) <= SHORT or len(anchors) * SPARSE < len(words):
        anchors = np.arange(len(words))
    after = np.searchsorted(content, anchors, "right")
    whole = after + CHAIN <= len(content)
    chains = content[after[whole][:, None] + np.arange(CHAIN)].tolist()
    hashed = xxhash.xxh32_intdigest
    found = [hashed(b" ".join([words[a], *[words[c] for c in chain]])) for a, chain in zip(anchors[whole].tolist(), chains, strict=True)]
    return np.unique(np.array(found or [hashed(b" ".join(words) or text.encode())], np.uint32))


def fingerprint(found: np.ndarray) -> str:
    """The spots in order, eight hex digits each."""
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard similarity of two sorted sets, or 0 as soon as it can't reach ``least``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < least * len(large):
        return 0.0
    # Both sets have ``least`` in common only if no more than this many of the smaller one are missing.
    allowed = len(small) - math.ceil(least * (len(a) + len(b)) / (1 + least) - 1e-9)
    both, step = 0, max(64, len(small) // 8)
    for start in range(0, len(small), step):
        piece = small[start : start + step]
        at = np.searchsorted(large, piece)
        at[at == len(large)] = 0
        both += int((large[at] == piece).sum())
        if start + len(piece) - both > allowed:
            return 0.0
    return both / (len(a) + len(b) - both)


def partition(size: int | np.ndarray, least: float) -> np.ndarray:
    """The partition of a set length. Lengths with a ratio of ``least`` or more are in the same or neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(least)).astype(np.int32)


@F.pandas_udf(BinaryType())
def spots(texts: pd.Series) -> pd.Series:
    """The spots of each text as little-endian 32-bit integers in order."""
    return pd.Series([signatures(t if isinstance(t, str) else None).tobytes() for t in texts], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def _numbers(held: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(h, "<u4").astype(np.int64) for h in held], dtype=object)


def _part(splits: list[tuple[bool, int, int]]):
    @F.pandas_udf(IntegerType())
    def part(none: pd.Series, down: pd.Series, hashed: pd.Series) -> pd.Series:
        """``down``: complements of ids, so that larger ids come first."""
        keys = zip(none.tolist(), down.tolist(), hashed.tolist(), strict=True)
        return pd.Series([bisect.bisect_right(splits, k) for k in keys], dtype="int32")

    return part


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the next one of its part; a row that isn't the part's own only ends it."""
    held = None
    for batch in batches:
        out: list[tuple] = []
        for own, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py() or ""
            found = signatures(text) if held is None or held[1] != text else held[2]
            if held is not None:
                of, before, spotted = held
                changed = len(before) // 3
                edited = before[: len(before) - changed] + text[:changed]
                anew = signatures(edited)
                out.append((of, len(before), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(spotted), fingerprint(anew), likeness(spotted, anew), likeness(spotted, found)))
            held = (doc_id, text, found) if own else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])


def with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Columns of ``SCHEMA`` for each row of ``doc_id, text``."""
    spark = session(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text")).withColumns({"_down": F.bitwise_not("doc_id"), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    keys = keyed.select(F.col("_down").isNull().alias("none"), F.coalesce("_down", F.lit(0)).alias("down"), F.col("_hash").alias("hash"), F.xxhash64("_down", "_hash").alias("mixed"))
    drawn = sorted(tuple(r) for r in sample(keys, "mixed", DRAWN * parts, keys.count()).select("none", "down", "hash").toLocalIterator())
    splits = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []
    placed = keyed.withColumn("_part", _part(splits)(F.col("_down").isNull(), F.coalesce("_down", F.lit(0)), F.col("_hash")))
    first = F.min(F.struct(F.col("_down").isNull().alias("none"), F.col("_down").alias("down"), F.col("_hash").alias("hash"))).alias("m")
    heads = sorted(tuple(r) for r in placed.drop("text", "doc_id").groupBy("_part").agg(first).select("_part", "m.down", "m.hash").toLocalIterator())
    # The first row of each part goes to the part before as well; that of the first one to the last one.
    before = [(heads[i - 1][0], down, hashed) for i, (_, down, hashed) in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(before, "_part int, down long, hash long"))
    extra = keyed.join(wanted, F.col("_down").eqNullSafe(F.col("down")) & (F.col("_hash") == F.col("hash"))).dropDuplicates(["_part"])
    names = ["doc_id", "text", "_down", "_hash", "_part"]
    both = placed.select(*names, F.lit(True).alias("_own")).unionByName(extra.select(*names, F.lit(False).alias("_own")))
    ordered = both.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", F.desc("_own"), F.asc_nulls_last("_down"), "_hash")
    return ordered.select("_own", "doc_id", "text").mapInArrow(_streamed, SCHEMA)


def near_documents(docs: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """``doc_id, component_id``: documents linked by a likeness of ``least`` (a fraction) or more; the smallest id, null ids aside.

    Documents with equal fingerprints count once. Sets of neighbouring partitions that share one of their rarest spots
    (so many that alike sets must share one) are candidates of one group; groups are cut into exact clusters.
    """
    session(docs.sparkSession)
    printed = cut(docs.select(F.col("doc_id").cast("long"), spots(F.col("text")).alias("held")).withColumn("print", F.sha2("held", 256)))
    nodes = cut(printed.groupBy("print").agg(F.any_value("held").alias("held")).withColumn("node", F.monotonically_increasing_id()))
    each = nodes.select("node", F.explode(_numbers(F.col("held"))).alias("spot"))
    often = each.groupBy("spot").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often, "spot").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "spot"))).alias("shared"))
    size = (F.length("held") / 4).cast("int")
    # Spots of one document only come first in the order of rareness and find no partner.
    prefix = size - F.ceil(size * least[0] / least[1]).cast("int") + 1 - (size - F.size("shared"))
    level = F.floor(F.log(size.cast("double")) / -math.log(least[0] / least[1]))
    keyed = nodes.join(shared, "node").where(prefix > 0).select("node", level.alias("level"), F.explode(F.slice("shared", F.lit(1), prefix)).alias("s"))
    buckets = keyed.select("node", F.explode(F.array("level", F.col("level") + 1)).alias("level"), F.col("s.spot").alias("spot"))
    first = buckets.groupBy("level", "spot").agg(F.min("node").alias("a"))
    groups = components(buckets.join(first, ["level", "spot"]).select("a", F.col("node").alias("b")).where("a <> b").distinct())
    members = cut(nodes.join(groups, "node").select("root", "node", "held"))
    roots = components(clustered(members, least, "<u4"))
    of = printed.join(nodes.select("print", "node"), "print").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    return of.join(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def op11_spots(spark, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
