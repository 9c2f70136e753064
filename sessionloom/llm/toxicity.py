"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a vector of its own (hashed) and the mean vector of its character n-grams (hashed, with marks
for its ends). A text is cut into windows of ``WINDOW`` words, each half a window after the one before; all of them are
scored. In a window two gated recurrent units read the words in both directions, attention weighs their states, and the
weighted mean gives the window's chance of toxicity. The mean and the largest chance of all windows give the score.

Weights are fitted by back-propagation on a bounded, hash-chosen sample of labelled rows (``per_class`` of each class) with
the class shares of all labelled rows. Their whole texts are cut into windows where they lie; of a text with more than
``sample_windows`` so many are drawn from all of it, and each round of training takes up to ``train_windows`` of these. The network is small and broadcast.

Defined results: a text without words (null, empty, figures) is scored as one empty window. Null labels teach nothing;
where no row of one class may teach, all scores are 0. Repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from sessionloom.llm.common import id_bucket, sample, session, table

WORD = re.compile(r"[^\W\d_]+")
#: Words of a window; windows overlap by half.
WINDOW, STEP = 48, 24
#: Hashed vectors of words and of n-grams, their width, and the states of one direction.
BUCKETS, WIDTH, STATES = 1 << 14, 16, 8
GRAMS = (3, 4, 5, 6)
#: Words of a worker whose inputs stay computed.
REMEMBERED = 150_000


def inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words; hashed n-grams of all words in turn; the first n-gram of each word."""
    own = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    hashes, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(points)) + n <= ends)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = (value ^ points[at + k]) * np.uint64(0x100000001B3)
            value ^= value >> np.uint64(29)
        hashes.append((value % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(of[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return own, np.concatenate(hashes)[order], np.searchsorted(owner[order], np.arange(len(words)))


def windows(ids: np.ndarray) -> list[np.ndarray]:
    """All overlapping windows; the last one ends where the text ends."""
    if len(ids) <= WINDOW:
        return [ids]
    starts = list(range(0, len(ids) - WINDOW, STEP)) + [len(ids) - WINDOW]
    return [ids[s : s + WINDOW] for s in starts]


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows, and what of them is words."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    mask = np.arange(max(1, length.max())) < length[:, None]
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.concatenate(parts)
    return out, mask


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def added(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to rows, which may repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    to[rows[first]] += np.add.reduceat(values[order], first, axis=0)


class Network:
    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "words": normal(BUCKETS, WIDTH, scale=0.1), "grams": normal(BUCKETS, WIDTH, scale=0.1),
            "in": normal(2, WIDTH, 3 * STATES, scale=0.4), "bias": np.zeros((2, 1, 3 * STATES), np.float32),
            "gates": normal(2, STATES, 2 * STATES, scale=0.25), "state": normal(2, STATES, STATES, scale=0.25),
            "look": normal(2 * STATES, STATES, scale=0.3), "weigh": normal(STATES, scale=0.3),
            "out": normal(2 * STATES, scale=0.3), "level": np.full(1, -1.0, np.float32), "doc": np.array([3.0, 3.0, -2.5], np.float32),
        }
        self.shift = 0.0

    def vectors(self, own: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(first, len(grams)))[:, None]
        return self.p["words"][own] + np.add.reduceat(self.p["grams"][grams], first, axis=0) / counts

    def projected(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions: 2 x words x 3 states."""
        return (np.matmul(self.vectors(*inputs(words)), self.p["in"]) + self.p["bias"]).astype(np.float32)

    def run(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Chances of windows, and with ``keep`` all that the gradient needs."""
        p, (n, length) = self.p, ids.shape
        turned, shown = np.stack([ids, ids[:, ::-1]]), np.stack([mask, mask[:, ::-1]])[..., None]
        h = np.zeros((2, n, STATES), np.float32)
        states, tape = np.empty((2, length, n, STATES), np.float32), []
        for t in range(length):
            x = np.stack([gates[0][turned[0, :, t]], gates[1][turned[1, :, t]]])
            zr = sigmoid(x[..., : 2 * STATES] + h @ p["gates"])
            z, r = zr[..., :STATES], zr[..., STATES:]
            inner = h @ p["state"]
            new = np.tanh(x[..., 2 * STATES :] + r * inner)
            after = np.where(shown[:, :, t], (1 - z) * new + z * h, h)
            if keep:
                tape.append((h, z, r, inner, new))
            h = states[:, t] = after
        both = np.concatenate([states[0], states[1, ::-1]], axis=-1).transpose(1, 0, 2)
        u = np.tanh(both @ p["look"])
        e = np.where(mask, u @ p["weigh"], -30.0)
        a = np.exp(e - e.max(1, keepdims=True)) * mask
        a = a / np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = (a[..., None] * both).sum(1)
        chance = sigmoid(pooled @ p["out"] + p["level"])
        return (chance, both, u, a, pooled, tape, turned, shown) if keep else chance

    def document(self, chances: np.ndarray) -> float:
        w = self.p["doc"]
        return float(w[0] * chances.mean() + w[1] * chances.max() + w[2])

    def score(self, chances: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.document(chances) + self.shift)))

    def gradient(self, docs: list[list[np.ndarray]], labels: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean log loss of documents given as windows of word numbers."""
        p = self.p
        sizes = [len(d) for d in docs]
        ids, mask = padded([w for d in docs for w in d])
        used, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(mask.shape)
        own, all_grams, first = vocabulary
        counts = np.diff(np.append(first, len(all_grams)))[used]
        starts = np.cumsum(counts) - counts
        grams = all_grams[np.repeat(first[used] - starts, counts) + np.arange(counts.sum())]
        vectors = self.vectors(own[used], grams, starts)
        gates = np.matmul(vectors, p["in"]) + p["bias"]
        chance, both, u, a, pooled, tape, turned, shown = self.run(gates, ids, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_chance, at = np.zeros_like(chance), 0
        for size, label in zip(sizes, labels, strict=True):
            part = chance[at : at + size]
            wrong = (sigmoid(np.float64(self.document(part))) - label) / len(docs)
            g["doc"] += wrong * np.array([part.mean(), part.max(), 1.0])
            d_chance[at : at + size] += wrong * p["doc"][0] / size
            d_chance[at + int(part.argmax())] += wrong * p["doc"][1]
            at += size
        d_out = d_chance * chance * (1 - chance)
        g["out"], g["level"] = pooled.T @ d_out, d_out.sum(keepdims=True)
        d_pooled = d_out[:, None] * p["out"]
        d_both = a[..., None] * d_pooled[:, None]
        d_a = (both * d_pooled[:, None]).sum(-1)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["weigh"] = (u * d_e[..., None]).sum((0, 1))
        d_u = d_e[..., None] * p["weigh"] * (1 - u * u)
        g["look"] = np.tensordot(both, d_u, ((0, 1), (0, 1)))
        d_both = d_both + d_u @ p["look"].T
        d_states = np.stack([d_both[..., :STATES], d_both[:, ::-1, STATES:]]).transpose(0, 2, 1, 3)
        d_gates, d_h = np.zeros((2, len(used), 3 * STATES)), np.zeros((2, len(chance), STATES))
        turn = lambda m: np.swapaxes(m, 1, 2)
        for t in range(ids.shape[1] - 1, -1, -1):
            h, z, r, inner, new = tape[t]
            d_h = d_h + d_states[:, t]
            d_after = np.where(shown[:, :, t], d_h, 0)
            d_new = d_after * (1 - z) * (1 - new * new)
            d_inner = d_new * r
            d_zr = np.concatenate([d_after * (h - new) * z * (1 - z), d_new * inner * r * (1 - r)], -1)
            g["state"] += turn(h) @ d_inner
            g["gates"] += turn(h) @ d_zr
            d_x = np.concatenate([d_zr, d_new], -1)
            for k in range(2):
                added(d_gates[k], turned[k, :, t], d_x[k])
            d_h = np.where(shown[:, :, t], d_after * z, d_h) + d_inner @ turn(p["state"]) + d_zr @ turn(p["gates"])
        g["bias"] = d_gates.sum(1, keepdims=True)
        g["in"] = np.matmul(vectors.T, d_gates)
        d_vectors = np.matmul(d_gates, turn(p["in"])).sum(0)
        added(g["words"], own[used], d_vectors)
        added(g["grams"], grams, np.repeat(d_vectors / counts[:, None], counts, axis=0))
        return g

    def train(self, texts: list[list[str]], labels: list[int], rounds: int = 5, batch: int = 48, rate: float = 0.01, train_windows: int = 6, seed: int = 8) -> None:
        """Adam over random windows of texts, each given as its windows' words."""
        rng = np.random.default_rng(seed)
        index: dict[str, int] = {}
        docs = []
        for parts in texts:
            docs.append([np.array([index.setdefault(w, len(index)) for w in part.split()], np.int64) for part in parts])
        if not index:
            return
        vocabulary = inputs(list(index))
        labels = np.array(labels)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, total = 0, rounds * -(-len(docs) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(docs))
            for start in range(0, len(docs), batch):
                chosen = order[start : start + batch]
                parts = [[docs[i][k] for k in (rng.choice(len(docs[i]), train_windows, replace=False) if len(docs[i]) > train_windows else range(len(docs[i])))] for i in chosen]
                g = self.gradient(parts, labels[chosen], vocabulary)
                step += 1
                pace = rate * (1 - 0.9 * step / total)
                for k, v in self.p.items():
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.99 * second[k] + 0.01 * g[k] * g[k]
                    v -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


class Scorer:
    """Scores texts with a bounded memory of words."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.gates = np.zeros((2, 0, 3 * STATES), np.float32)

    def scores(self, texts: list[str | None], rows: int = 2048) -> list[float]:
        if len(self.at) > REMEMBERED:
            self.forget()
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        if new := list(set().union(*split).difference(self.at)):
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, *(self.network.projected(new[i : i + 20_000]) for i in range(0, len(new), 20_000))], axis=1)
        known, out, held, sizes = self.at, [], [], []
        gates = self.gates if self.gates.shape[1] else np.zeros((2, 1, 3 * STATES), np.float32)

        def flush() -> None:
            chances = [np.zeros(0)]
            for i in range(0, len(held), rows):
                chances.append(self.network.run(gates, *padded(held[i : i + rows])))
            whole, at = np.concatenate(chances), 0
            for size in sizes:
                out.append(self.network.score(whole[at : at + size]))
                at += size
            held.clear()
            sizes.clear()

        for words in split:
            parts = windows(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            held.extend(parts)
            sizes.append(len(parts))
            if len(held) >= 2 * rows:
                flush()
        flush()
        return out


def drawn(text: str | None, most: int) -> list[str]:
    """Windows of a text as words between blanks: all, or ``most`` of them, the same on every run and in the text's order."""
    words = WORD.findall((text or "").lower())
    parts = windows(np.arange(len(words)))
    if len(parts) > most:
        chosen = np.random.default_rng(zlib.crc32(" ".join(words).encode())).choice(len(parts), most, replace=False)
        parts = [parts[k] for k in np.sort(chosen)]
    return [" ".join([words[i] for i in part]) for part in parts]


def _drawn(most: int):
    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([drawn(t, most) for t in texts])

    return run


def fit(labelled: DataFrame, docs: DataFrame, per_class: int = 2000, sample_windows: int = 128, **settings) -> Network | None:
    """A network from ``doc_id, toxic`` and the texts of the documents; none if a class has no rows."""
    labels = labelled.where("toxic IN (0, 1)").select("doc_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    chosen = None
    for label, size in sorted(sizes.items()):
        part = sample(labels.where(F.col("toxic") == label), "doc_id", per_class, size)
        chosen = part if chosen is None else chosen.unionByName(part)
    session(docs.sparkSession)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = sorted((r["doc_id"], r["parts"], r["toxic"]) for r in rows.select("doc_id", _drawn(sample_windows)("text").alias("parts"), "toxic").collect())
    found = [r[2] for r in rows]
    if len(set(found)) < 2:
        return None
    network = Network()
    network.train([r[1] for r in rows], found, **settings)
    network.shift = float(np.log(sizes[1] / sizes[0]) - np.log(sum(found) / (len(found) - sum(found))))
    return network


def scored(texts: Column, network: Network | None, spark) -> Column:
    """A column of scores between 0 and 1."""
    if network is None:
        return F.lit(0.0)
    shared = session(spark).sparkContext.broadcast(network)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in batches:
            yield pd.Series(scorer.scores(list(part)), dtype="float64")

    return score(texts)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = fit(labels.where(id_bucket("doc_id", 4) != 2), docs)
    found = docs.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), scored(F.col("text"), network, spark).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
