"""Full-text and pattern search.

Two ways to rank: ``scan_*`` scores a corpus in one narrow pass for ad-hoc questions, and a written postings
table answers repeated ones by reading only the terms asked for. Corpus statistics always cover all rows;
filters apply after scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..context import cut, rows
from ..functions import text as T
from ..functions.porter import stem as porter_stem
from .blocks import spread_join, top_n

_TERM = re.compile(r"[^\W_]+", re.UNICODE)


# --- query text -----------------------------------------------------------------


def parse_query(query: str) -> list[list[str]]:
    """Quotes removed, split on white space; each token is a phrase of one or more terms."""
    phrases = []
    for token in query.replace('"', "").replace("'", "").split():
        terms = _TERM.findall(T.fold_literal(token))
        if terms and terms not in phrases:
            phrases.append(terms)
    return phrases


def excerpt_query(files: Sequence[str], subject: str) -> list[list[str]]:
    """Base names of the files and words of the subject, longer than one character."""
    words = [f.rsplit("/", 1)[-1] for f in files] + subject.split()
    return parse_query(" ".join(w for w in (x.replace('"', "").replace("'", "").strip() for x in words) if len(w) > 1))


def stem_phrases(phrases: list[list[str]]) -> list[list[str]]:
    return [[porter_stem(t) for t in p] for p in phrases]


def stem_terms(terms: DataFrame) -> DataFrame:
    """term -> stem over a distinct vocabulary: the one place where Python sees words."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"term": pdf["term"], "stem": [porter_stem(t) for t in pdf["term"]]})

    return terms.select("term").distinct().mapInPandas(apply, "term string, stem string")


# --- scan ranking ------------------------------------------------------------------


def surface_forms(spaced: DataFrame, columns: Sequence[str], stems: Sequence[str]) -> dict[str, list[str]]:
    """stem -> the corpus' own words that have it. Only words that begin like a stem leave their rows.

    A rule of the stemmer changes at most the last two letters of what it leaves, so the other letters begin the word.
    """
    starts = sorted({s[: max(1, len(s) - 2)] for s in stems})
    if not starts:
        return {}
    pattern = F.lit(f" ((?:{'|'.join(map(re.escape, starts))})[^ ]*) ")
    found = [F.regexp_extract_all(F.col(f"__{c}"), pattern, F.lit(1)) for c in columns]
    words = spaced.select(F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("term"))
    forms: dict[str, list[str]] = {s: [] for s in stems}
    for r in stem_terms(words).where(F.col("stem").isin(*stems)).collect():
        forms[r["stem"]].append(r["term"])
    return {s: sorted(terms) for s, terms in forms.items()}


def form_count(spaced: Column, phrase: Sequence[str], forms: Mapping[str, Sequence[str]]) -> Column:
    """Occurrences of a phrase of stems, by the words that have them."""
    if not all(forms[s] for s in phrase):
        return F.lit(0).cast("long")
    text = "".join(f" (?:{'|'.join(map(re.escape, forms[s]))}) " for s in phrase)
    return F.regexp_count(spaced, F.lit(f"(?={text})")).cast("long")


def phrase_count(spaced: Column, phrase: Sequence[str]) -> Column:
    """Occurrences of a phrase in spaced terms.

    Terms carry their own blanks, so neighbours never share one and counting is a replacement. A phrase that can
    overlap itself is counted at every position instead.
    """
    text = "".join(f" {t} " for t in phrase)
    if any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase))):
        return F.regexp_count(spaced, F.lit(f"(?={text})"))
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(text), F.lit("")))) / len(text)).cast("long")


def bm25(tf: Column, length: Column, avg: Column, idf: Column) -> Column:
    k1, b = F.lit(K.BM25_K1), F.lit(K.BM25_B)
    return idf * tf * (k1 + 1) / (tf + k1 * (F.lit(1.0) - b + b * length / avg))


def scan_bm25(
    corpus: DataFrame, phrases: list[list[str]], columns: Mapping[str, float], keys: Sequence[str], stemmed: bool = False
) -> DataFrame:
    """Rank rows by weighted BM25 (negative is better) without an index.

    Frequencies are counted inside each row and the statistics are one aggregate, so the corpus is never
    shuffled. With ``stemmed`` words match by their stems: one more pass finds the words that have them, and only
    the distinct words are stemmed. Output: keys, rank; only rows with a match. No phrases, no rows.
    """
    keys = list(keys)
    if not phrases:
        return corpus.select(*keys, F.lit(0.0).alias("rank")).limit(0)
    texts = corpus.select(*keys, *[T.spaced_terms(F.col(c)).alias(f"__{c}") for c in columns])
    if stemmed:
        phrases = [list(p) for p in dict.fromkeys(tuple(p) for p in stem_phrases(phrases))]
        forms = surface_forms(texts, list(columns), sorted({s for p in phrases for s in p}))
    length = sum((T.count_terms(F.col(f"__{c}")) for c in columns), F.lit(0))
    measured = F.struct(
        length.cast("double").alias("__len"),
        *[
            sum(
                (F.lit(w) * (form_count(F.col(f"__{c}"), p, forms) if stemmed else phrase_count(F.col(f"__{c}"), p)) for c, w in columns.items()), F.lit(0.0)
            ).alias(f"__f{i}")
            for i, p in enumerate(phrases)
        ],
    )
    # The generator keeps the match filter above the counting, so the text is folded once per row.
    counted = texts.select(*keys, F.inline(F.array(measured)))
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__len").alias("__avg"),
        *[F.sum((F.col(f"__f{i}") > 0).cast("int")).cast("double").alias(f"__d{i}") for i in range(len(phrases))],
    )
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df = F.col(f"__d{i}")
        idf = F.greatest(F.log((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(K.BM25_IDF_FLOOR))
        score = score - bm25(F.col(f"__f{i}"), F.col("__len"), F.col("__avg"), idf)
    any_hit = F.lit(False)
    for i in range(len(phrases)):
        any_hit = any_hit | (F.col(f"__f{i}") > 0)
    hits = counted.where(any_hit)
    return hits.join(F.broadcast(stats)).select(*keys, score.alias("rank"))  # one row of statistics


# --- postings -----------------------------------------------------------------------


def build_postings(corpus: DataFrame, columns: Sequence[str], keys: Sequence[str], stemmed: bool = True) -> DataFrame:
    """term, keys, col, tf, positions: one row per distinct term of a row's column.

    Terms are sorted and cut into postings inside their row, so nothing is shuffled for that; rows that share their
    keys count as one and are merged. Stems are computed once per distinct term and joined back, with frequent terms
    spread.
    """
    keys = list(keys)
    columns = list(columns)
    texts = corpus.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in columns])).alias("x"))
    raw = row_postings(texts.select(*keys, F.col("x.col").alias("col"), T.tokens(F.col("x.text")).alias("__terms")), [*keys, "col"])
    if not stemmed:
        shared = corpus.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        whole = raw if shared.isEmpty() else merged_postings(raw, F.col("term"), [*keys, "col"])
        return whole.select("term", *keys, "col", F.size("positions").alias("tf"), "positions")
    stems = stem_terms(raw)
    named = spread_join(raw, stems, ["term"], F.xxhash64(*keys))
    return merged_postings(named, F.col("stem"), [*keys, "col"]).select("term", *keys, "col", F.size("positions").alias("tf"), "positions")


def row_postings(listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, term, positions from the terms (``__terms``) of each row, by sorting them with their places."""
    placed = F.sort_array(F.transform("__terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    s, n = F.col("__s"), F.size("__s")
    # The generators keep the sorted terms and the bounds above the lambdas that read them, so they are made once per row.
    ordered = listed.select(*keys, F.explode(F.array(placed)).alias("__s")).where(n > 0)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (s[i]["term"] != s[F.greatest(i - 1, F.lit(0))]["term"]))
    bounded = ordered.select(*keys, "__s", F.explode(F.array(F.concat(first, F.array(n)))).alias("__b"))

    def posting(at: Column, k: Column) -> Column:
        places = F.slice("__s", at + 1, F.col("__b")[k + 1] - at)
        return F.struct(s[at]["term"].alias("term"), F.transform(places, lambda p: p["pos"]).alias("positions"))

    return bounded.select(*keys, F.inline(F.transform(F.slice("__b", F.lit(1), F.size("__b") - 1), posting)))


def merged_postings(postings: DataFrame, term: Column, keys: Sequence[str]) -> DataFrame:
    return postings.groupBy(term.alias("term"), *keys).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def document_lengths(corpus: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    length = sum((F.size(T.tokens(F.col(c))) for c in columns), F.lit(0))
    return corpus.select(*keys, length.cast("long").alias("length"))


def write_postings(postings: DataFrame, path: str) -> None:
    """Parquet in ranges of terms, so that a query reads a few row groups."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def postings_bm25(
    spark: SparkSession, postings: DataFrame, lengths: DataFrame, phrases: list[list[str]], weights: Mapping[str, float], keys: Sequence[str]
) -> DataFrame:
    """Rank from postings: keys, rank. Terms are pushed to the scan; phrases check adjacent positions."""
    keys = list(keys)
    wanted = sorted({t for p in phrases for t in p})
    pruned = postings.where(F.col("term").isin(*wanted) if wanted else F.lit(False))
    slots = rows(spark, "term, phrase, slot", [(t, i, j) for i, p in enumerate(phrases) for j, t in enumerate(p)])
    sizes = F.create_map(*[F.lit(x) for i, p in enumerate(phrases) for x in (i, len(p))])
    starts = pruned.join(slots, "term").select(
        *keys, "col", F.col("phrase").cast("int").alias("phrase"), "slot", F.explode(F.transform("positions", lambda p: p - F.col("slot").cast("int"))).alias("start")
    )
    occurrences = starts.groupBy(*keys, "col", "phrase", "start").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") == F.element_at(sizes, F.col("phrase"))
    )
    weight = F.lit(0.0)
    for c, w in weights.items():
        weight = F.when(F.col("col") == c, F.lit(float(w))).otherwise(weight)
    tf = occurrences.groupBy(*keys, "phrase").agg(F.sum(weight).alias("tf"))
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("df"))
    corpus = lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("avg"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(K.BM25_IDF_FLOOR))
    score = bm25(F.col("tf"), F.col("length"), F.col("avg"), idf)
    matched = tf.join(lengths, keys)
    return matched.join(F.broadcast(df), "phrase").join(F.broadcast(corpus)).groupBy(*keys).agg((-F.sum(score)).alias("rank"))


# --- session search -------------------------------------------------------------------


def session_text(sessions: DataFrame) -> DataFrame:
    """The five searchable columns of a session."""
    nl = "\n"
    return sessions.select(
        "file_path", F.concat_ws(nl, "first_prompt", "custom_title").alias("headline"), F.array_join("commands", nl).alias("commands"),
        F.concat_ws(nl, F.array_join("files_touched", nl), F.array_join("files_read", nl)).alias("paths"),
        (F.array_join("error_messages", nl) if "error_messages" in sessions.columns else F.lit("")).alias("context_text"),
        (F.col("thinking") if "thinking" in sessions.columns else F.lit("")).alias("thinking"),
    )


def rank_sessions(sessions: DataFrame, phrases: list[list[str]]) -> DataFrame:
    return scan_bm25(session_text(sessions), phrases, K.SESSION_COLUMN_WEIGHTS, ["file_path"], stemmed=True)


def rank_messages(messages: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """Ranks of single messages; a user's own words count one and a half times."""
    raw = scan_bm25(messages, phrases, {"text": 1.0}, ["file_path", "msg_index", "role"], stemmed=True)
    boost = F.when(F.col("role") == "user", F.lit(K.USER_HIT_BOOST)).otherwise(F.lit(1.0))
    return raw.withColumn("rank", F.col("rank") * boost)


def merge_hits(session_hits: DataFrame, message_hits: DataFrame) -> DataFrame:
    """Session rank plus best message rank; a missing side adds nothing. Sentinel messages rank, too."""
    best = message_hits.groupBy("file_path").agg(F.min("rank").alias("mrank"))
    return session_hits.withColumnRenamed("rank", "srank").join(best, "file_path", "full_outer").select(
        "file_path", (F.coalesce("srank", F.lit(0.0)) + F.coalesce("mrank", F.lit(0.0))).alias("rank")
    )


def top_hits(message_hits: DataFrame) -> DataFrame:
    """The three best visible messages per session."""
    visible = message_hits.where("msg_index >= 0")
    return top_n(visible, ["file_path"], [F.col("rank"), F.col("msg_index")], K.HITS_PER_SESSION, rank="hit")


def search_sessions(sessions: DataFrame, messages: DataFrame, query: str, limit: int = K.RANKED_LIMIT, kept: DataFrame | None = None) -> DataFrame:
    """Ranked sessions for free text. ``kept`` (file_path) restricts the result, never the statistics.

    A query without words gives the recent sessions, newest first, with rank 0; see ``sessions.recent_order``.
    """
    phrases = parse_query(query)
    wanted = sessions.select("file_path", "session_id", "tool", "date", "custom_title", "first_prompt")
    if kept is not None:
        wanted = wanted.join(kept.select("file_path"), "file_path", "left_semi")
    if not phrases:
        recent = wanted.select("file_path", F.lit(0.0).alias("rank"), *[c for c in wanted.columns if c != "file_path"])
        return recent.orderBy(F.desc_nulls_first("date"), "file_path").limit(max(1, limit))
    ranked = merge_hits(rank_sessions(sessions, phrases), rank_messages(messages, phrases))
    return ranked.join(wanted, "file_path").orderBy("rank", F.desc_nulls_first("date"), "file_path").limit(max(1, limit))


def with_snippets(results: DataFrame, messages: DataFrame, hits: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """Best hits of the results with a window of words around the first match. Only result rows are cut."""
    shown = top_hits(hits.join(results.select("file_path"), "file_path", "left_semi"))
    texts = messages.join(shown.select("file_path", "msg_index", "hit", "rank"), ["file_path", "msg_index"])
    return texts.select("file_path", "msg_index", "role", "hit", snippet(F.col("text"), phrases, _forms_of(texts, phrases)).alias("snippet"))


def _forms_of(messages: DataFrame, phrases: list[list[str]]) -> list[str]:
    """The words of the messages that have a stem of the query."""
    stems = sorted({s for p in stem_phrases(phrases) for s in p})
    forms = surface_forms(messages.select(T.spaced_terms(F.col("text")).alias("__text")), ["text"], stems)
    return sorted({t for terms in forms.values() for t in terms})


def snippet(text: Column, phrases: list[list[str]], forms: Sequence[str] | None = None) -> Column:
    """At most 32 words around the first match, with marks where text was cut. ``forms``: the words that match, if not the query's own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    terms = [t for p in phrases for t in p] if forms is None else list(forms)
    hit = F.filter(F.transform(words, lambda w, i: F.when(F.arrays_overlap(T.tokens(w), F.array(*[F.lit(t) for t in terms]).cast("array<string>")), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(0))
    size = F.lit(K.SNIPPET_TOKENS)
    start = F.greatest(F.least(first - 8, F.size(words) - size), F.lit(0))
    body = F.array_join(F.slice(words, start + 1, size), " ")
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), body, F.when(start + size < F.size(words), F.lit("…")).otherwise(""))


def session_excerpts(messages: DataFrame, phrases: list[list[str]], limit: int = K.HITS_PER_SESSION) -> DataFrame:
    """Best messages of every session for a query; sentinels are dropped after the cut."""
    ranked = scan_bm25(messages, phrases, {"text": 1.0}, ["file_path", "msg_index", "role"], stemmed=True)
    best = top_n(ranked, ["file_path"], [F.col("rank"), F.col("msg_index")], limit)
    return best.where("msg_index >= 0")


# --- patterns ---------------------------------------------------------------------------


def pattern_of(pattern: str, regex: bool = False, ignore_case: bool = True) -> str:
    if not pattern:
        raise ValueError("empty pattern")
    re.compile(pattern) if regex else None
    # Java quoting of a literal
    body = pattern if regex else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", pattern)
    return ("(?iu)" if ignore_case else "") + body


def grep_matches(messages: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """All matching messages with the first match; literal patterns prefilter by ``contains`` where that is safe."""
    java = pattern_of(pattern, regex, ignore_case)
    rows_ = messages.where("msg_index >= 0")
    if not regex and not ignore_case:
        rows_ = rows_.where(F.col("text").contains(pattern))
    elif not regex and pattern.isascii() and "k" not in pattern.lower() and "s" not in pattern.lower():
        # lower() maps every case variant the expression accepts; k and s have non-ASCII variants
        rows_ = rows_.where(F.lower("text").contains(pattern.lower()))
    matched = rows_.where(F.col("text").rlike(java))
    found = F.regexp_extract("text", f"({java})" if not ignore_case else f"(?iu)({java[5:]})", 1)
    return matched.withColumn("match_at", F.regexp_instr("text", F.lit(java)) - 1).withColumn("match_size", F.length(found))


def match_context(matches: DataFrame, before: int = K.GREP_RADIUS, after: int = K.GREP_RADIUS) -> DataFrame:
    start = F.greatest(F.col("match_at") - before, F.lit(0))
    end = F.least(F.length("text"), F.col("match_at") + F.col("match_size") + after)
    body = T.collapse(F.substring("text", start + 1, end - start))
    return matches.withColumn(
        "snippet", F.concat(F.when(start > 0, F.lit("…")).otherwise(""), body, F.when(end < F.length("text"), F.lit("…")).otherwise(""))
    )


def grep(matches: DataFrame, limit: int = K.GREP_LIMIT) -> DataFrame:
    """First hits in path and message order with their snippets."""
    shown = matches.orderBy("file_path", "msg_index").limit(max(0, limit))
    return match_context(shown).select("file_path", "msg_index", "role", "snippet")


def grep_totals(matches: DataFrame, limit: int = K.GREP_LIMIT) -> DataFrame:
    per_file = matches.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_hits"), F.count(F.lit(1)).alias("total_sessions")).select(
        "total_hits", "total_sessions", F.least(F.col("total_hits"), F.lit(limit)).cast("long").alias("returned_hits"),
        (F.col("total_hits") > limit).alias("truncated"),
    )


def message_scope(messages: DataFrame, sessions: DataFrame, role: str | None = None) -> DataFrame:
    """Addressable messages with their session's columns; long sessions are spread over several tasks."""
    visible = messages.where("msg_index >= 0")
    if role:
        visible = visible.where(F.col("role") == role)
    wanted = sessions.select("file_path", F.col("tool").alias("session_tool"), "cwd", "date", "session_id")
    return spread_join(visible, wanted, ["file_path"], F.col("msg_index"))


def scan_search(messages: DataFrame, query: str) -> DataFrame:
    """Index-free substring search: the first user message of each session that contains the text, with context."""
    at = F.locate(query.lower(), F.lower("text")) - 1
    hits = messages.where((F.col("role") == "user") & (at >= 0)).withColumn("match_at", at).withColumn("match_size", F.lit(len(query)))
    first = top_n(hits, ["file_path"], [F.col("msg_index")], 1)
    start = F.greatest(F.col("match_at") - 30, F.lit(0))
    end = F.least(F.length("text"), F.col("match_at") + F.col("match_size") + 70)
    body = F.trim(F.regexp_replace(F.substring("text", start + 1, end - start), "\n", " "))
    snippet_ = F.concat(F.when(start > 0, F.lit("…")).otherwise(""), body, F.when(end < F.length("text"), F.lit("…")).otherwise(""))
    return first.select("file_path", "msg_index", snippet_.alias("snippet"))


# --- documents ------------------------------------------------------------------------------


def search_documents(documents: DataFrame, query: str, limit: int = 50, id_column: str = "id") -> DataFrame:
    """Documents that contain every phrase (unstemmed), best first."""
    phrases = parse_query(query)
    spaced = T.spaced_terms(F.col("content"))
    every = F.lit(True)
    for p in phrases:
        every = every & F.contains(spaced, F.lit("".join(f" {t} " for t in p)))
    ranked = scan_bm25(documents, phrases, {"content": 1.0}, [id_column])
    matching = documents.where(every).select(id_column)
    return ranked.join(matching, id_column, "left_semi").orderBy("rank", id_column).limit(min(max(1, limit), 50))


def index_documents(indexed: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose index rows must be rebuilt: new, changed content, or not exactly one row."""
    state = indexed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("sha256").alias("indexed_sha"))
    return documents.join(state, "id", "left").where(
        F.col("n").isNull() | (F.col("n") != 1) | (F.col("indexed_sha") != F.col("sha256"))
    ).drop("n", "indexed_sha")


# --- evaluation --------------------------------------------------------------------------------


def search_eval(results: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """recall@5, mean reciprocal rank and abstention over labelled queries.

    ``results``: query_id, rank (1-based), id. ``labels``: query_id, id, negative (no expected id when true).
    """
    queries = labels.groupBy("query_id").agg(F.max("negative").alias("negative"), F.sum((~F.col("negative")).cast("int")).alias("expected"))
    found = results.join(labels.where("not negative").select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), F.sum((F.col("rank") <= top).cast("int")).alias("in_top")
    )
    answered = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("answers"))
    per = queries.join(found, "query_id", "left").join(answered, "query_id", "left")
    return per.agg(
        F.avg(F.when(~F.col("negative"), F.coalesce("in_top", F.lit(0)) / F.least(F.col("expected"), F.lit(top)))).alias("recall"),
        F.avg(F.when(~F.col("negative"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)))).alias("mrr"),
        F.avg(F.when(F.col("negative"), F.col("answers").isNull().cast("double"))).alias("abstention"),
    )
