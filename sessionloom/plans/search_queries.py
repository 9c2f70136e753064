"""Ranked and pattern search over messages, sessions and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import bindings as B
from ..context import cut, shared_dir
from ..functions import text as T
from ..operators import search as S
from ..operators import search_index as I
from ..operators.blocks import top_n
from . import session_queries  # noqa: F401  (shared SQL)
from .registry import cte, query, sql

QUERY = "thble eron thorti"
PHRASES = S.parse_query(QUERY)
PAIR = [["of", "the"], ["heon"]]
TOK = "regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


def _f(tokens: str, phrase: list[str]) -> str:
    joined = f"(' ' || array_to_string({tokens}, '  ') || ' ')"
    text = "".join(f" {t} " for t in phrase)
    return f"((length({joined}) - length(replace({joined}, '{text}', ''))) // {len(text)})"


def bm25_sql(source: str, keys: str, columns: dict[str, float], phrases: list[list[str]]) -> str:
    toks = ", ".join(f"{TOK.format(c=c)} AS t_{c}" for c in columns)
    length = " + ".join(f"len(t_{c})" for c in columns)
    fs = ", ".join(
        "(" + " + ".join(f"{w}::DOUBLE * {_f('t_' + c, p)}" for c, w in columns.items()) + f") AS f{i}" for i, p in enumerate(phrases)
    )
    ds = ", ".join(f"(count(*) FILTER (WHERE f{i} > 0))::DOUBLE AS d{i}" for i in range(len(phrases)))
    score = " - ".join(
        f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))" for i in range(len(phrases))
    )
    hit = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""SELECT {keys}, -({score.replace(' - greatest', ' + greatest')}) AS rank FROM (SELECT {keys}, ({length})::DOUBLE AS len, {fs} FROM (SELECT {keys}, {toks} FROM {source})) c,
 (SELECT count(*)::DOUBLE AS n, avg(len) AS av, {ds} FROM (SELECT ({length})::DOUBLE AS len, {fs} FROM (SELECT {toks} FROM {source}))) s WHERE {hit}"""


cte("seen", "SELECT file_path, msg_index, role, text FROM msgs WHERE genuine OR role = 'assistant'", "msgs")
cte(
    "sess_text",
    """SELECT file_path, first_prompt || chr(10) || custom_title AS headline, replace(commands, ',', chr(10)) AS commands, replace(files_touched, ',', chr(10)) || chr(10) || replace(files_read, ',', chr(10)) AS paths FROM sess""",
    "sess",
)
# Porter's algorithm by regular expressions over the distinct words: the SQL stems by itself.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1, _EQ1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
_HAS_V, _CVC = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _suffixes(rules: dict[str, str | None], condition: str) -> str:
    """The longest suffix decides; a rule applies where what it leaves meets the condition."""
    whens = []
    for suffix in sorted(rules, key=len, reverse=True):
        stem = f"left(w, length(w) - {len(suffix)})"
        more = f" AND regexp_matches({stem}, '[st]$')" if suffix == "ion" else ""
        whens.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN regexp_matches({stem}, '{condition}'){more} THEN {stem} || '{rules[suffix] or ''}' ELSE w END")
    return f"CASE {' '.join(whens)} ELSE w END"


_STEP2 = dict(zip(
    "ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi".split(),
    "ate tion ence ance ize ble al ent e ous ize ate ate al ive ful ous al ive ble log".split(), strict=True,
))
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")
_E = "left(w, length(w) - 1)"
cte("spoken_terms", f"SELECT DISTINCT unnest(t) AS term FROM (SELECT {TOK.format(c='text')} AS t FROM seen UNION ALL SELECT {TOK.format(c='headline')} FROM sess_text UNION ALL SELECT {TOK.format(c='commands')} FROM sess_text UNION ALL SELECT {TOK.format(c='paths')} FROM sess_text)", "seen", "sess_text")
cte("stem0", "SELECT term, regexp_replace(term, '^y', 'Y') AS w FROM spoken_terms WHERE length(term) > 2 AND regexp_matches(term, '^[a-z]+$')", "spoken_terms")
cte("stem1a", f"SELECT term, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_E} ELSE w END AS w FROM stem0", "stem0")
cte(
    "stem1b",
    f"""SELECT term, CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
 WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND NOT regexp_matches(w, '[aeiouylsz]$') THEN {_E} WHEN regexp_matches(w, '{_CVC}') THEN w || 'e' ELSE w END AS w FROM (
 SELECT term, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{_M0}') THEN {_E} ELSE w END WHEN cut THEN left(w, length(w) - n) ELSE w END AS w, cut FROM (
 SELECT *, NOT ends_with(w, 'eed') AND n > 0 AND regexp_matches(left(w, length(w) - n), '{_HAS_V}') AS cut FROM (SELECT *, CASE WHEN ends_with(w, 'ed') THEN 2 WHEN ends_with(w, 'ing') THEN 3 ELSE 0 END AS n FROM stem1a)))""",
    "stem1a",
)
cte("stem1c", f"SELECT term, CASE WHEN ends_with(w, 'y') AND regexp_matches({_E}, '{_HAS_V}') THEN {_E} || 'i' ELSE w END AS w FROM stem1b", "stem1b")
cte("stem2", f"SELECT term, {_suffixes(_STEP2, _M0)} AS w FROM stem1c", "stem1c")
cte("stem3", f"SELECT term, {_suffixes(_STEP3, _M0)} AS w FROM stem2", "stem2")
cte("stem4", f"SELECT term, {_suffixes(_STEP4, _M1)} AS w FROM stem3", "stem3")
cte("stem5a", f"SELECT term, CASE WHEN ends_with(w, 'e') AND (regexp_matches({_E}, '{_M1}') OR regexp_matches({_E}, '{_EQ1}') AND NOT regexp_matches({_E}, '{_CVC}')) THEN {_E} ELSE w END AS w FROM stem4", "stem4")
cte("stem5b", f"SELECT term, CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{_M1}') THEN {_E} ELSE w END AS w FROM stem5a", "stem5a")
cte("stems", "SELECT v.term, coalesce(replace(w, 'Y', 'y'), v.term) AS stem FROM spoken_terms v LEFT JOIN stem5b USING (term)", "spoken_terms", "stem5b")


def _stemmed(source: str, keys: str, column: str) -> str:
    """The keys and the column's words as stems, in order."""
    return f"""SELECT {keys}, string_agg(stem, ' ' ORDER BY pos) AS {column} FROM (SELECT {keys}, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT {keys}, {TOK.format(c=column)} AS t FROM {source})) JOIN stems USING (term) GROUP BY ALL"""


cte("seen_stems", f"SELECT k.file_path, k.msg_index, k.role, coalesce(s.text, '') AS text FROM seen k LEFT JOIN ({_stemmed('seen', 'file_path, msg_index', 'text')}) s USING (file_path, msg_index)", "seen", "stems")
cte(
    "sess_stems",
    "SELECT k.file_path, " + ", ".join(f"coalesce({c}_.{c}, '') AS {c}" for c in ("headline", "commands", "paths")) + " FROM sess_text k "
    + " ".join(f"LEFT JOIN ({_stemmed('sess_text', 'file_path', c)}) {c}_ USING (file_path)" for c in ("headline", "commands", "paths")),
    "sess_text", "stems",
)
SESSION_QUERY = [["talk"], ["git", "status"], ["f2", "py"]] + PHRASES[:1]
_WEIGHTS = {"headline": 10.0, "commands": 6.0, "paths": 5.0}
cte("srank", bm25_sql("sess_stems", "file_path", _WEIGHTS, S.stem_phrases(SESSION_QUERY)), "sess_stems")
cte("mrank0", bm25_sql("seen_stems", "file_path, msg_index, role", {"text": 1.0}, S.stem_phrases(PHRASES)), "seen_stems")
cte("mrank", "SELECT file_path, msg_index, role, rank * CASE WHEN role = 'user' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS rank FROM mrank0", "mrank0")
cte("mrank_s0", bm25_sql("seen_stems", "file_path, msg_index, role", {"text": 1.0}, S.stem_phrases(SESSION_QUERY)), "seen_stems")


def _seen(spark, d):
    m = B.message_rows(spark, d)
    return m.where("genuine or role = 'assistant'").select("file_path", "msg_index", "role", "text")


@query("bm25_sessions", sql("SELECT file_path, round(rank, 6) AS rank FROM srank", "srank"))
def _(spark, d):
    return S.rank_sessions(B.session_index(spark, d), SESSION_QUERY).select("file_path", F.round("rank", 6).alias("rank"))


@query("bm25_messages", sql("SELECT file_path, msg_index, role, round(rank, 6) AS rank FROM mrank", "mrank"))
def _(spark, d):
    return S.rank_messages(_seen(spark, d), PHRASES).withColumn("rank", F.round("rank", 6))


@query("bm25_phrases", sql("SELECT doc_id, round(rank, 6) AS rank FROM (" + bm25_sql("documents", "doc_id", {"text": 1.0}, PAIR) + ")"))
def _(spark, d):
    return S.scan_bm25(B.table(spark, d, "documents"), PAIR, {"text": 1.0}, ["doc_id"]).withColumn("rank", F.round("rank", 6))


@query(
    "search_sessions",
    sql(
        """SELECT s.file_path, round(coalesce(a.rank, 0) + coalesce(m.rank, 0), 6) AS rank FROM sess s LEFT JOIN srank a ON a.file_path = s.file_path
 LEFT JOIN (SELECT file_path, min(rank * CASE WHEN role = 'user' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS rank FROM mrank_s0 GROUP BY 1) m ON m.file_path = s.file_path
 WHERE (a.rank IS NOT NULL OR m.rank IS NOT NULL) AND s.tool <> 'codex' ORDER BY coalesce(a.rank, 0) + coalesce(m.rank, 0), s.date DESC, s.file_path LIMIT 50""",
        "srank", "mrank_s0", "sess",
    ),
)
def _(spark, d):
    sessions = B.session_index(spark, d)
    text = "talk git-status f2.py " + PHRASES[0][0]
    found = S.search_sessions(sessions, _seen(spark, d), text, kept=sessions.where("tool <> 'codex'"))
    return found.select("file_path", F.round("rank", 6).alias("rank"))


INDEX_QUERY = "talk git-status f2.py " + PHRASES[0][0]
_STEMS = ", ".join(f"'{t}'" for t in sorted({t for p in S.stem_phrases(S.parse_query(INDEX_QUERY)) for t in p}))
_MARKED = """CASE WHEN start > 0 THEN '…' ELSE '' END || array_to_string(words[start + 1 : start + 32], ' ') || CASE WHEN start + 32 < len(words) THEN '…' ELSE '' END"""


def _window(source: str, keys: str, text: str) -> str:
    """The words around the first one that has a stem of the query, per row of the source."""
    hit = f"list_position(list_transform(words, lambda w: list_has_any({TOK.format(c='w')}, terms)), true)"
    return f"""SELECT {keys}, {_MARKED} AS snippet FROM (SELECT *, greatest(least(coalesce({hit}, 1) - 1 - 8, len(words) - 32), 0) AS start FROM (
 SELECT *, list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '') AS words FROM {source}, (SELECT list(term) AS terms FROM stems WHERE stem IN ({_STEMS})) f))"""


cte(
    "index_ranked",
    """SELECT s.file_path, s.first_prompt, s.custom_title, coalesce(a.rank, 0) + coalesce(m.rank, 0) AS rank FROM sess s LEFT JOIN srank a ON a.file_path = s.file_path
 LEFT JOIN (SELECT file_path, min(rank * CASE WHEN role = 'user' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS rank FROM mrank_s0 GROUP BY 1) m ON m.file_path = s.file_path
 WHERE (a.rank IS NOT NULL OR m.rank IS NOT NULL) AND s.tool <> 'codex' ORDER BY coalesce(a.rank, 0) + coalesce(m.rank, 0), s.date DESC, s.file_path LIMIT 50""",
    "srank", "mrank_s0", "sess",
)
cte(
    "index_hits",
    """SELECT h.file_path, h.msg_index, hit, k.text FROM (SELECT file_path, msg_index, row_number() OVER (PARTITION BY file_path
 ORDER BY round(rank * CASE WHEN role = 'user' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 9), msg_index) AS hit FROM mrank_s0 WHERE msg_index >= 0) h
 JOIN seen k USING (file_path, msg_index) JOIN index_ranked USING (file_path) WHERE hit <= 3""",
    "mrank_s0", "seen", "index_ranked",
)
cte("index_windows", _window("index_hits", "file_path, msg_index, hit", "text"), "index_hits", "stems")
cte("index_headlines", _window("(SELECT file_path, concat_ws(chr(10), first_prompt, custom_title) AS headline FROM index_ranked)", "file_path", "headline"), "index_ranked", "stems")


@query(
    "search_index",
    sql(
        """SELECT r.file_path, round(r.rank, 6) AS rank, coalesce(h.hits, '') AS hits, coalesce(h.snippets[1], l.snippet) AS snippet, coalesce(array_to_string(h.snippets, ' | '), '') AS hit_snippets
 FROM index_ranked r JOIN index_headlines l USING (file_path) LEFT JOIN (SELECT file_path, string_agg(CAST(msg_index AS VARCHAR), ',' ORDER BY hit) AS hits, list(snippet ORDER BY hit) AS snippets
 FROM index_windows GROUP BY 1) h USING (file_path)""",
        "index_ranked", "index_windows", "index_headlines",
    ),
)
def _(spark, d):
    """Two imports; the second one brings half of the sessions again, whole now."""
    path = f"{shared_dir(spark)}/sessionloom/index-{uuid.uuid4().hex}"
    sessions, seen = B.session_index(spark, d), _seen(spark, d)
    again = F.pmod(F.xxhash64("file_path"), F.lit(2)) == 0
    I.write_segment(path, 0, sessions.withColumn("first_prompt", F.when(again, F.lit("an earlier state")).otherwise(F.col("first_prompt"))), seen.where(~again | (F.col("msg_index") < 2)))
    I.write_segment(path, 1, sessions.where(again), seen.where(again))
    found = I.search(spark, path, INDEX_QUERY, kept=sessions.where("tool <> 'codex'"))
    return found.select(
        "file_path", F.round("rank", 6).alias("rank"), F.array_join(F.col("hits.msg_index").cast("array<string>"), ",").alias("hits"), "snippet",
        F.array_join("hits.snippet", " | ").alias("hit_snippets"),
    )


@query("top_hits_per_session", sql("SELECT file_path, msg_index, CAST(hit AS INTEGER) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY round(rank, 9), msg_index) AS hit FROM mrank) WHERE hit <= 3", "mrank"))
def _(spark, d):
    ranked = S.rank_messages(_seen(spark, d), PHRASES).withColumn("rank", F.round("rank", 9))
    return S.top_hits(ranked).select("file_path", "msg_index", "hit")


@query("session_excerpts", sql("SELECT file_path, msg_index FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank, msg_index) AS hit FROM mrank0) WHERE hit <= 3", "mrank0"))
def _(spark, d):
    return S.session_excerpts(_seen(spark, d), PHRASES).select("file_path", "msg_index")


@query("result_snippets")
def _(spark, d):
    seen = _seen(spark, d)
    found = S.search_sessions(B.session_index(spark, d), seen, QUERY)
    return S.with_snippets(found, seen, S.rank_messages(seen, PHRASES), PHRASES)


@query(
    "build_postings",
    sql(f"SELECT term, doc_id, count(*) AS tf, min(pos) - 1 AS first_pos, max(pos) - 1 AS last_pos FROM (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT doc_id, {TOK.format(c='text')} AS t FROM documents)) GROUP BY 1, 2"),
)
def _(spark, d):
    p = S.build_postings(B.table(spark, d, "documents"), ["text"], ["doc_id"], stemmed=False)
    return p.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_min("positions").cast("long").alias("first_pos"), F.array_max("positions").cast("long").alias("last_pos"))


@query("postings_bm25", sql("SELECT doc_id, round(rank, 6) AS rank FROM (" + bm25_sql("documents", "doc_id", {"text": 1.0}, PAIR) + ")"))
def _(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "text")
    postings = cut(S.build_postings(docs, ["text"], ["doc_id"], stemmed=False))
    lengths = cut(S.document_lengths(docs, ["text"], ["doc_id"]))
    return S.postings_bm25(spark, postings, lengths, PAIR, {"text": 1.0}, ["doc_id"]).withColumn("rank", F.round("rank", 6))


@query("stemmed_postings_bm25", sql("SELECT file_path, msg_index, round(rank, 6) AS rank FROM mrank0", "mrank0"))
def _(spark, d):
    seen = _seen(spark, d)
    postings = cut(S.build_postings(seen, ["text"], ["file_path", "msg_index"]))
    lengths = cut(S.document_lengths(seen, ["text"], ["file_path", "msg_index"]))
    found = S.postings_bm25(spark, postings, lengths, S.stem_phrases(PHRASES), {"text": 1.0}, ["file_path", "msg_index"])
    return found.withColumn("rank", F.round("rank", 6))


cte("doc_rank", bm25_sql("documents", "doc_id", {"text": 1.0}, [["the"], ["of", "the"]]))


@query(
    "search_documents",
    sql(f"SELECT doc_id FROM doc_rank JOIN documents USING (doc_id) WHERE {_f(TOK.format(c='text'), ['of', 'the'])} > 0 ORDER BY rank, doc_id LIMIT 50", "doc_rank"),
)
def _(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return S.search_documents(docs, "the of-the", 50, "doc_id").select("doc_id")


@query(
    "index_documents",
    sql("SELECT doc_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 7 = 0 OR doc_id % 11 = 0"),
)
def _(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    known = docs.where("id % 11 <> 0").withColumn("sha256", F.when(F.col("id") % 10 == 3, F.lit("old")).otherwise(F.col("sha256")))
    indexed = known.unionByName(known.where("id % 7 = 0"))
    return S.index_documents(indexed, docs).select(F.col("id").alias("doc_id"))


_SNIP = """CASE WHEN greatest(p - 60, 0) > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, CAST(greatest(p - 60, 0) AS INTEGER) + 1, CAST(least(length(text), p + m + 60) - greatest(p - 60, 0) AS INTEGER)), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))
 || CASE WHEN least(length(text), p + m + 60) < length(text) THEN '…' ELSE '' END"""


@query(
    "grep_literal",
    sql(f"SELECT file_path, msg_index, {_SNIP} AS snippet FROM (SELECT *, strpos(lower(text), 'thin. ') - 1 AS p, 6 AS m FROM seen WHERE contains(lower(text), 'thin. ')) ORDER BY file_path, msg_index LIMIT 50", "seen"),
)
def _(spark, d):
    return S.grep(S.grep_matches(_seen(spark, d), "Thin. ")).select("file_path", "msg_index", "snippet")


@query(
    "grep_regex",
    sql(f"SELECT file_path, msg_index, {_SNIP} AS snippet FROM (SELECT *, strpos(text, x) - 1 AS p, length(x) AS m FROM (SELECT *, regexp_extract(text, '(?i)h[ae]\\w+ea\\b') AS x FROM seen) WHERE x <> '') ORDER BY file_path, msg_index LIMIT 50", "seen"),
)
def _(spark, d):
    return S.grep(S.grep_matches(_seen(spark, d), r"h[ae]\w+ea\b", regex=True)).select("file_path", "msg_index", "snippet")


@query(
    "grep_totals",
    sql("SELECT count(*) AS total_hits, count(DISTINCT file_path) AS total_sessions, least(count(*), 50) AS returned_hits, count(*) > 50 AS truncated FROM seen JOIN sess USING (file_path) WHERE role = 'user' AND tool <> 'codex' AND contains(lower(text), 'the')", "seen", "sess"),
)
def _(spark, d):
    scoped = S.message_scope(_seen(spark, d), B.session_index(spark, d).where("tool <> 'codex'"), role="user")
    return S.grep_totals(S.grep_matches(scoped, "the"))


@query(
    "scan_search",
    sql(
        """SELECT file_path, msg_index, CASE WHEN p > 30 THEN '…' ELSE '' END || trim(replace(substr(text, CAST(greatest(p - 30, 0) AS INTEGER) + 1, CAST(least(length(text), p + 4 + 70) - greatest(p - 30, 0) AS INTEGER)), chr(10), ' '), ' ') || CASE WHEN p + 74 < length(text) THEN '…' ELSE '' END AS snippet FROM
 (SELECT *, strpos(lower(text), 'tion') - 1 AS p, row_number() OVER (PARTITION BY file_path ORDER BY msg_index) rn FROM msgs WHERE role = 'user' AND contains(lower(text), 'tion')) WHERE rn = 1""",
        "msgs",
    ),
)
def _(spark, d):
    return S.scan_search(B.message_rows(spark, d), "tion")


@query("message_scope", sql("SELECT tool AS session_tool, cwd, count(*) AS n FROM seen JOIN sess USING (file_path) GROUP BY 1, 2", "seen", "sess"))
def _(spark, d):
    return S.message_scope(_seen(spark, d), B.session_index(spark, d)).groupBy("session_tool", "cwd").agg(F.count(F.lit(1)).alias("n"))


@query("search_eval")
def _(spark, d):
    """The first words of every benchmark passage as a query; documents that contain its opening are expected.

    One pass over the texts keeps the openings and terms that some query asks for; only these are grouped.
    """
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    bench = B.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(T.tokens(F.col("text")), 1, 4).alias("q"))
    openings = bench.select("query_id", F.lit(True).alias("opening"), F.array_join("q", " ").alias("word"))
    asked = openings.unionByName(bench.select("query_id", F.lit(False).alias("opening"), F.explode(F.array_distinct("q")).alias("word")))
    last = F.greatest(F.size("tokens") - 4, F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get("tokens", i + k) for k in range(4)]))
    words = docs.select("id", F.size("tokens").alias("len"), F.explode(F.array(F.struct(F.lit(True).alias("opening"), grams.alias("words")), F.struct(F.lit(False).alias("opening"), F.col("tokens").alias("words")))).alias("x"))
    held = words.select("id", "len", "x.opening", F.explode("x.words").alias("word")).join(asked.select("opening", "word").distinct(), ["opening", "word"], "left_semi")
    found = cut(held.groupBy("id", "len", "opening", "word").agg(F.count(F.lit(1)).alias("tf")))
    expected = openings.join(found, ["opening", "word"]).select("query_id", "id")
    labels = bench.select("query_id").join(expected, "query_id", "left").select("query_id", "id", F.col("id").isNull().alias("negative"))
    hits = asked.where("not opening").join(found, ["opening", "word"]).groupBy("query_id", "id").agg(
        F.count(F.lit(1)).alias("matched"), (F.sum("tf") / F.max("len")).alias("density")
    ).where("matched = 4")
    ranked = top_n(hits, ["query_id"], [F.desc("density"), F.col("id")], 50, rank="rank").select("query_id", "id", "rank")
    return S.search_eval(cut(ranked), cut(labels))
