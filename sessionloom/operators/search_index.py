"""A written search index of sessions and their messages, appended to by imports and read by the words of a query.

Each import writes a segment: postings by stem, message texts, and one row for each session with the lengths that ranking
needs. A session of a later segment replaces that of earlier ones, so an import writes what it
brings and nothing else. The session rows are written last; a segment without them isn't seen, and a repeated import
replaces its own folders.

A task turns a block of documents into one row of postings for each stem, so postings move once, into the order of stems. A
query reads the row groups of its own stems; a frequent stem has many rows, none of more than ``BLOCK`` documents. A posting has the document's length and all positions; a session's
columns are told apart by the high bits of a position, so phrases never reach from one column into the next. Texts are
read for the hits of the result alone, by the paths of at most ``limit`` sessions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..context import cut
from ..functions import text as T
from ..functions.porter import stem as porter_stem
from .search import _forms_of, bm25, parse_query, session_text, snippet, stem_phrases, top_hits

#: Documents of a row of postings, the first bit of a position that holds the column, and the words whose stems a worker keeps.
BLOCK, COLUMN_BIT, KNOWN = 4096, 40, 500_000

SESSION_FIELDS = ("file_path", "session_id", "tool", "date", "custom_title", "first_prompt")
DOC = ("kind", "file_path", "msg_index", "role", "length")
POSTED = (
    "stem string, kind string, n long, most int, shortest long, "
    "docs array<struct<file_path: string, msg_index: int, role: string, length: long, positions: array<bigint>>>"
)


def _places(words: Column, first: int) -> Column:
    return F.transform(words, lambda w, i: i + F.lit(first).cast("long"))


def _documents(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions (``s``) and messages (``m``): the columns of DOC, their ``terms`` and the ``places`` of these."""
    columns = list(K.SESSION_COLUMN_WEIGHTS)
    lists = session_text(sessions).select("file_path", *[T.tokens(F.col(c)).alias(c) for c in columns])
    whole = lists.select(
        F.lit("s").alias("kind"), "file_path", F.lit(None).cast("int").alias("msg_index"), F.lit(None).cast("string").alias("role"),
        F.flatten(F.array(*columns)).alias("terms"), F.flatten(F.array(*[_places(F.col(c), at << COLUMN_BIT) for at, c in enumerate(columns)])).alias("places"),
    )
    words = messages.select("file_path", F.col("msg_index").cast("int").alias("msg_index"), "role", T.tokens(F.col("text")).alias("terms"))
    said = words.select(F.lit("m").alias("kind"), "file_path", "msg_index", "role", "terms", _places(F.col("terms"), 0).alias("places"))
    return whole.unionByName(said).withColumn("length", F.size("terms").cast("long"))


def _posted(block: int):
    """Rows of POSTED from documents, one for each stem and kind of a block; each worker stems a word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                yield _posting_rows(batch.slice(start, block), known)
            if len(known) > KNOWN:
                known.clear()

    return run


def _posting_rows(batch: pa.RecordBatch, known: dict[str, str]) -> pa.RecordBatch:
    kind, path, index, role, length, terms, places = (batch.column(i) for i in range(7))
    coded = terms.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    for w in words:
        if w not in known:
            known[w] = porter_stem(w)
    stems, code = np.unique(np.array([known[w] for w in words], object), return_inverse=True) if words else (np.zeros(0, object), np.zeros(0, np.int64))
    doc = np.repeat(np.arange(len(batch)), terms.value_lengths().to_numpy())
    own, message, place = code[coded.indices.to_numpy()], np.array([k == "m" for k in kind.to_pylist()], bool)[doc], places.flatten().to_numpy()
    order = np.lexsort((place, doc, message, own))
    own, message, doc, place = own[order], message[order], doc[order], place[order]
    row = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (message[1:] != message[:-1])])[: len(own)])
    post = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (message[1:] != message[:-1]) | (doc[1:] != doc[:-1])])[: len(own)])
    ends = np.append(post, len(own)).astype(np.int32)
    at, first = pa.array(doc[post]), np.searchsorted(post, row).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place, pa.int64()))
    held = pa.StructArray.from_arrays([path.take(at), index.take(at), role.take(at), length.take(at), positions], ["file_path", "msg_index", "role", "length", "positions"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(post)).astype(np.int32)), held)
    most = np.maximum.reduceat(np.diff(ends), first) if len(first) else np.zeros(0, np.int32)
    shortest = np.minimum.reduceat(length.to_numpy()[doc[post]], first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(stems[own[row]], pa.string()), pa.array(np.where(message[row], "m", "s"), pa.string()), pa.array(np.diff(np.append(first, len(post))), pa.int64()),
         pa.array(most, pa.int32()), pa.array(shortest, pa.int64()), lists],
        ["stem", "kind", "n", "most", "shortest", "docs"],
    )


def write_segment(path: str, segment: int, sessions: DataFrame, messages: DataFrame) -> None:
    """Add the sessions (the columns of SESSION_FIELDS and of ``search.session_text``) and their messages (``file_path, msg_index, role, text``)."""
    if segment < 0:
        raise ValueError("segments are numbered from 0")
    docs = _documents(sessions, messages)
    postings = docs.select("kind", "file_path", "msg_index", "role", "length", "terms", "places").mapInArrow(_posted(BLOCK), POSTED)
    texts = messages.select("file_path", F.col("msg_index").cast("int").alias("msg_index"), "role", "text")
    sums = docs.groupBy("file_path").agg(
        F.max(F.when(F.col("kind") == "s", F.col("length"))).alias("length"), F.count_if(F.col("kind") == "m").alias("messages"),
        F.coalesce(F.sum(F.when(F.col("kind") == "m", F.col("length"))), F.lit(0)).alias("words"),
    )
    held = sessions.select(*SESSION_FIELDS).join(sums, "file_path")
    for name, df, order in (("postings", postings, ["stem", "kind"]), ("texts", texts, ["file_path", "msg_index"]), ("sessions", held, ["file_path"])):
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}/segment={segment}")


def _sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/sessions").parquet(f"{path}/sessions")


def live(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, segment`` of the sessions as last imported, with their sums."""
    newest = F.max_by(F.struct("length", "messages", "words"), "segment")
    return _sessions(spark, path).groupBy("file_path").agg(F.max("segment").alias("segment"), newest.alias("sums")).select("file_path", "segment", "sums.*")


def _occurrences(phrase: list[str], of: dict[str, str]) -> Column:
    """The places where a phrase begins."""
    empty = F.array().cast("array<bigint>")
    places = [F.coalesce(F.col(of[s]), empty) for s in phrase]
    return reduce(lambda starts, p: F.array_intersect(starts, F.transform(p[1], lambda x: x - p[0])), list(enumerate(places))[1:], places[0])


def matches(spark: SparkSession, path: str, phrases: list[list[str]], current: DataFrame) -> DataFrame:
    """``segment, kind, file_path, msg_index, role, rank`` of all sessions and messages with a phrase of stems; less is better."""
    stems = sorted({s for p in phrases for s in p})
    blocks = spark.read.schema(f"{POSTED}, segment int").option("basePath", f"{path}/postings").parquet(f"{path}/postings")
    found = blocks.where(F.col("stem").isin(*stems)).select("segment", "stem", "kind", F.inline("docs"))
    ours = found.join(current.select("file_path", "segment"), ["file_path", "segment"], "left_semi")
    of = {s: f"__p{i}" for i, s in enumerate(stems)}
    docs = ours.groupBy("segment", *DOC).agg(*[F.first(F.when(F.col("stem") == s, F.col("positions")), ignorenulls=True).alias(c) for s, c in of.items()])
    weights = F.array(*[F.lit(float(w)) for w in K.SESSION_COLUMN_WEIGHTS.values()])
    weighed = lambda starts: F.aggregate(starts, F.lit(0.0), lambda sum_, p: sum_ + F.element_at(weights, (F.shiftright(p, COLUMN_BIT) + 1).cast("int")))
    starts = [_occurrences(p, of) for p in phrases]
    counted = docs.select("segment", *DOC, *[F.when(F.col("kind") == "s", weighed(s)).otherwise(F.size(s).cast("double")).alias(f"__f{i}") for i, s in enumerate(starts)])
    some = reduce(lambda a, b: a | b, [F.col(f"__f{i}") > 0 for i in range(len(phrases))])
    hits = cut(counted.where(some))
    df = hits.groupBy("kind").agg(*[F.count_if(F.col(f"__f{i}") > 0).cast("double").alias(f"__d{i}") for i in range(len(phrases))])
    sums = current.agg(F.count("*").alias("s_n"), F.sum("length").alias("s_len"), F.sum("messages").alias("m_n"), F.sum("words").alias("m_len"))
    sizes = sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_n").cast("double").alias("__n"), (F.col(f"{k}_len") / F.col(f"{k}_n")).alias("__avg")) for k in "sm"])))
    known = hits.join(F.broadcast(df.join(sizes, "kind")), "kind")  # a row for each of the two kinds
    score = F.lit(0.0)
    for i in range(len(phrases)):
        d = F.col(f"__d{i}")
        idf = F.greatest(F.log((F.col("__n") - d + 0.5) / (d + 0.5)), F.lit(K.BM25_IDF_FLOOR))
        score = score - bm25(F.col(f"__f{i}"), F.col("length").cast("double"), F.col("__avg"), idf)
    boost = F.when(F.col("role") == "user", F.lit(K.USER_HIT_BOOST)).otherwise(F.lit(1.0))
    return known.select("segment", "kind", "file_path", "msg_index", "role", (score * boost).alias("rank"))


def _headline() -> Column:
    return F.concat_ws("\n", "first_prompt", "custom_title")


def search(spark: SparkSession, path: str, query: str, limit: int = K.RANKED_LIMIT, kept: DataFrame | None = None) -> DataFrame:
    """Ranked sessions with their best hits: SESSION_FIELDS, ``rank``, ``snippet`` and ``hits`` (``msg_index, role, rank, snippet``).

    The rank of a session is its own plus that of its best message; the snippet is that of the best visible hit, else of
    the session's headline. ``kept`` (``file_path``) restricts the result, never the statistics. A query without words
    gives the recent sessions, newest first, with rank 0 and no hits.
    """
    phrases = [list(p) for p in dict.fromkeys(tuple(p) for p in stem_phrases(parse_query(query)))]
    current = live(spark, path)
    shown = _sessions(spark, path).join(current.select("file_path", "segment"), ["file_path", "segment"], "left_semi").select(*SESSION_FIELDS)
    if kept is not None:
        shown = shown.join(kept.select("file_path"), "file_path", "left_semi")
    order = ["rank", F.desc_nulls_first("date"), "file_path"]
    if not phrases:
        recent = shown.withColumn("rank", F.lit(0.0)).orderBy(*order).limit(max(1, limit))
        return recent.withColumns({"snippet": F.lit(None).cast("string"), "hits": F.array().cast("array<struct<msg_index: int, role: string, rank: double, snippet: string>>")})
    ranked = matches(spark, path, phrases, current)
    best = ranked.groupBy("file_path").agg(
        (F.coalesce(F.max(F.when(F.col("kind") == "s", F.col("rank"))), F.lit(0.0)) + F.coalesce(F.min(F.when(F.col("kind") == "m", F.col("rank"))), F.lit(0.0))).alias("rank")
    )
    result = cut(best.join(shown, "file_path").orderBy(*order).limit(max(1, limit)))
    paths = [r["file_path"] for r in result.select("file_path").collect()]  # at most ``limit``
    wanted = ranked.where((F.col("kind") == "m") & F.col("file_path").isin(*paths)).withColumn("rank", F.round("rank", 9))
    hits = top_hits(wanted.select("segment", "file_path", "msg_index", "role", "rank"))
    texts = spark.read.option("basePath", f"{path}/texts").parquet(f"{path}/texts").where(F.col("file_path").isin(*paths)).drop("role")
    shown_texts = cut(hits.join(texts, ["file_path", "msg_index", "segment"]))
    terms = _forms_of(shown_texts.select("text").unionByName(result.select(_headline().alias("text"))), parse_query(query))
    cuts = shown_texts.withColumn("snippet", snippet(F.col("text"), phrases, terms))
    listed = cuts.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("hit", "msg_index", "role", "rank", "snippet"))).alias("hits"))
    headline = snippet(_headline(), phrases, terms)
    return (
        result.join(listed, "file_path", "left")
        .withColumn("snippet", F.coalesce(F.try_element_at("hits", F.lit(1))["snippet"], headline))
        .withColumn("hits", F.coalesce(F.transform("hits", lambda h: F.struct(h["msg_index"].alias("msg_index"), h["role"].alias("role"), h["rank"].alias("rank"), h["snippet"].alias("snippet"))), F.array()))
        .select(*SESSION_FIELDS, "rank", "snippet", "hits")
    )
