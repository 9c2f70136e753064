"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. A word it doesn't know is scored by the
longest character n-grams that it does know: four characters, else three, two, one. The language of a text is the one
with the largest sum over its words.

The model is counted from a bounded, hash-chosen sample of the labelled rows (``per_language`` rows for each language),
keeps the ``entries`` most frequent words and n-grams of each length, and is broadcast: its size doesn't follow the corpus.

Defined results: null, empty or letterless text gives ``und`` with score 0; so does everything where nothing is labelled.
Labels that are null or empty teach nothing. Equal scores go to the language that sorts first. Repeated rows are
predicted each; other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import fresh, id_bucket, replace_columns, sample, session, table

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Longest n-gram of the fallback.
LONGEST = 4
#: Words of a worker that stay scored; when full, the memory starts anew.
REMEMBERED = 100_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    word_scores: np.ndarray
    gram_scores: list[np.ndarray]


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        rows: dict[tuple[str, int, str], int] = {}
        for lang, words in counts.items():
            for word, k in words.items():
                rows[lang, 0, word] = k
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        rows[lang, n, g] = rows.get((lang, n, g), 0) + k
        yield pd.DataFrame([(*key, k) for key, k in rows.items()], columns=["lang", "n", "gram", "k"])


def fit(labelled: DataFrame, per_language: int = 1500, entries: int = 30_000) -> Model:
    """Count a model from ``doc_id, text, lang``."""
    labelled = labelled.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, [], np.zeros((0, 0)), [])
    chosen = None
    for lang in languages:
        part = sample(labelled.where(F.col("lang") == lang), "doc_id", per_language, sizes[lang])
        chosen = part if chosen is None else chosen.unionByName(part)
    counted = chosen.mapInPandas(_count, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    kept = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("k"), "gram"))).where(F.col("r") <= entries)
    index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in index]
    of = {lang: i for i, lang in enumerate(languages)}
    for r in kept.select("lang", "n", "gram", "k").toLocalIterator():
        at = index[r["n"]].setdefault(r["gram"], len(index[r["n"]]))
        found[r["n"]].append((at, of[r["lang"]], r["k"]))
    scores = []
    for names, cells in zip(index, found, strict=True):
        counts = np.zeros((len(names), len(languages)))
        for at, lang, k in cells:
            counts[at, lang] = k
        scores.append(np.log((counts + 0.5) / (counts.sum(0) + 0.5 * max(1, len(names)))))
    return Model(languages, index[0], index[1:], scores[0], scores[1:])


class Scorer:
    """Scores words with a memory of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at = dict(self.model.words)
        self.rows = [self.model.word_scores]
        self.new: list[np.ndarray] = []
        self.size = len(self.at)

    def unseen(self, word: str) -> np.ndarray:
        for n in range(len(self.model.grams), 0, -1):
            known = self.model.grams[n - 1]
            at = [known[g] for g in grams(word, n) if g in known]
            if at:
                return self.model.gram_scores[n - 1][at].mean(0)
        return np.zeros(len(self.model.languages))

    def table(self) -> np.ndarray:
        if self.new:
            self.rows = [np.concatenate([*self.rows, np.array(self.new)])]
            self.new = []
        return self.rows[0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """All new words of the texts are scored first, each once."""
        if self.size > len(self.model.words) + REMEMBERED:
            self.forget()
        counted = []
        for text in texts:
            words = Counter(WORD.findall(text.lower())) if text else Counter()
            if not any(c.isalpha() for w in words for c in w):
                counted.append(None)
                continue
            for w in words:
                if w not in self.at:
                    self.at[w] = self.size
                    self.new.append(self.unseen(w))
                    self.size += 1
            counted.append((np.fromiter(map(self.at.__getitem__, words), int, len(words)), np.fromiter(words.values(), float, len(words))))
        scores, names, best = self.table(), [], []
        for one in counted:
            if one is None or not self.model.languages:
                names.append(UNDETERMINED)
                best.append(0.0)
                continue
            total = one[1] @ scores[one[0]]
            odds = np.exp(total - total.max())
            names.append(self.model.languages[int(total.argmax())])
            best.append(float(odds.max() / odds.sum()))
        return names, best


def predictions(docs: DataFrame, model: Model):
    """A column ``lang_pred, score`` for the texts of the documents."""
    shared = session(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            names, scores = scorer.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predicted(F.col("text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``."""
    found = docs.withColumn("_found_language", predictions(docs, model))
    return replace_columns(found, lang_pred=F.col("_found_language.lang_pred"), score=F.col("_found_language.score")).drop("_found_language")


def training(docs: DataFrame) -> DataFrame:
    """The rows that may teach: those outside the held-out fifth."""
    return docs.where(id_bucket("doc_id", 5) != 0)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(training(docs)))
    return found.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letters, and so without a language, go.

    Nothing else goes: which language is predicted, and with what score, rejects no document. Where no row teaches a
    language, all documents with a letter stay.
    """
    model = fit(training(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    into = fresh(docs, "_found_language")
    return docs.withColumn(into, predictions(docs, model)).where(F.col(f"{into}.lang_pred") != UNDETERMINED).drop(into)
