"""Why does this code exist: commits, the sessions behind them, and what was said there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import correlate as W
from ..operators import search as S
from ..operators.blocks import top_n


def commit_terms(commits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Search terms of each commit: words of its subject and of its files' base names."""
    names = F.transform("files", T.basename)
    words = F.array_distinct(T.tokens(F.concat_ws(" ", "subject", F.array_join(names, " "))))
    return commits.select(*keys, "sha", F.explode(F.filter(words, lambda w: F.length(w) > 1)).alias("term"))


def excerpts(ranked: DataFrame, commits: DataFrame, messages: DataFrame, limit: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Best messages per (commit, session) pair by BM25 over the commit's terms, by stems; then message order.

    Every commit is a query of its own, so terms, not texts, are joined: the messages' words that have a wanted stem,
    counted per message. Statistics (messages, length, messages with a stem) cover all messages.
    """
    keys = list(keys)
    pairs = ranked.select(*keys, "sha", F.col("session_key").alias("file_path"))
    asked = commit_terms(commits, keys)
    wanted = asked.join(S.stem_terms(asked), "term").select(*keys, "sha", "stem").distinct()
    tokens = messages.select("file_path", "msg_index", T.tokens(F.col("text")).alias("tokens"))
    corpus = tokens.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("tokens")).alias("avg"))
    words = tokens.select("file_path", "msg_index", F.size("tokens").cast("double").alias("length"), F.explode("tokens").alias("term"))
    forms = S.stem_terms(words).join(wanted.select("stem").distinct(), "stem", "left_semi")
    counted = words.join(forms, "term").groupBy("file_path", "msg_index", "stem").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("length").alias("length"))
    known = counted.groupBy("stem").agg(F.count(F.lit(1)).cast("double").alias("df"))
    scored = (
        wanted.join(pairs, [*keys, "sha"])
        .join(counted.where("msg_index >= 0"), ["file_path", "stem"])
        .join(known, "stem")
        .join(F.broadcast(corpus))  # one row
    )
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(K.BM25_IDF_FLOOR))
    rank = (-F.sum(S.bm25(F.col("tf"), F.col("length"), F.col("avg"), idf))).alias("rank")
    hits = scored.groupBy(*keys, "sha", "file_path", "msg_index").agg(rank)
    return top_n(hits, [*keys, "sha", "file_path"], [F.round("rank", 9), F.col("msg_index")], limit)


def why(commits: DataFrame, work: DataFrame, sessions: DataFrame, messages: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Evidence for all commits at once; a single target is a filter on the result."""
    ranked = W.correlate_commits(commits, work, keys)
    return {
        "evidence": W.evidence(ranked, sessions),
        "excerpts": excerpts(ranked, commits, messages, keys=keys),
    }
