"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds what their greed loses.

The base patterns (email, ip, card, phone) give leftmost spans that don't overlap within a kind; a match that fails its
test is dropped as a whole. Two card numbers beside each other, for example, are one match of 32 digits, and both are lost.

The model looks at each region of figures or around an ``@``, cut into tokens (runs of digits, runs of letters, single
other characters). Candidate segments of at most ``WIDEST`` tokens are scored by features of the whole span (number of
digits, check digit, values of the parts, even groups, kind of separators, what stands beside it). Dynamic programming over
tokens chooses boundaries and kinds of the whole region jointly, so a span is taken only where it beats the other ways to
cut the region. A chosen span is added where it overlaps no base span.

Weights are trained here, in numpy, by the likelihood of whole segmentations: on regions generated by rule, alone and side
by side, and on a bounded, hash-chosen sample of the regions in the whole texts of sampled documents, labelled by their base
spans. A long region is cut into stretches between spans; a region whose figures may hide a lost card teaches nothing.

Defined results: null or empty texts have no spans. Places count code points, ends are exclusive. A row is a document.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from sessionloom.llm.common import replace_columns, sample, session, table

KINDS = ("email", "ip", "card", "phone")
#: Most tokens of a segment: 19 figures one by one, with what stands between them.
WIDEST = 37
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of these starts within a run of digits, and none needs to give back what it has taken.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
REGION = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9.@_%+-]*|[+(]?[0-9](?:[ ().+-]{0,3}[0-9])++")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"),
    re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
)
FEATURES = 10
#: Labels: the kinds, and no entity.
NONE = len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the characters before it and the domain after it: linear, also on long runs of letters."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start, domain = free + len(before.rstrip(LOCAL)), DOMAIN.match(text, at + 1)
        free = at + 1
        if start < at and domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """Spans of the base patterns: kind, start, end."""
    out = [(0, a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def features(kind: int, text: str, before: str, after: str) -> list[float]:
    """Of a whole span."""
    digits = [c for c in text if "0" <= c <= "9"]
    groups = [len(g) for g in re.findall(r"[0-9]+", text)]
    valid = {
        0: lambda: len(text) <= 254 and not text.startswith(".") and ".." not in text,
        1: lambda: all(int(p) <= 255 for p in text.split(".")),
        2: lambda: luhn("".join(digits)),
        3: lambda: 9 <= len(digits) <= 15,
    }[kind]()
    return [
        1.0, float(valid), float(not valid), float(len(set(groups[:-1])) <= 1 and len(groups) > 1), float(len(groups) == 1),
        float(len(set(re.findall(r"[^0-9A-Za-z]", text))) <= 1), float(before.isalnum() or after.isalnum()), float(before in "+-.(" and before != ""),
        float(len(digits) == 16), len(text) / 20,
    ]


class Region:
    """Tokens of a stretch of text and the candidate segments: (first token, end, kind, features)."""

    def __init__(self, text: str, before: str = " ", after: str = " "):
        self.edges = [m.start() for m in TOKEN.finditer(text)] + [len(text)]
        n = len(self.edges) - 1
        self.size, self.found = n, []
        at = "@" in text
        for i in range(n):
            first = text[self.edges[i]]
            kinds = ((3,) if first == "+" else (1, 2) if first.isdigit() else ()) + ((0,) if at else ())
            for j in range(i + 1, min(n, i + WIDEST) + 1) if kinds else ():
                part = text[self.edges[i] : self.edges[j]]
                for kind in kinds:
                    if SHAPES[kind].fullmatch(part):
                        left = text[self.edges[i] - 1] if i else before
                        right = text[self.edges[j]] if j < n else after
                        self.found.append((i, j, kind, np.array(features(kind, part, left, right))))


class Field:
    """The semi-Markov model: weights of span features by kind, and of one kind after another."""

    def __init__(self):
        self.span = np.zeros((NONE, FEATURES))
        self.next = np.zeros((NONE + 1, NONE + 1))

    def arcs(self, region: Region) -> list[list[tuple[int, int, float, int]]]:
        """By end: start, label, score, candidate. A token outside entities is a segment of its own with score zero."""
        out = [[] for _ in range(region.size + 1)]
        for j in range(1, region.size + 1):
            out[j].append((j - 1, NONE, 0.0, -1))
        for c, (i, j, kind, values) in enumerate(region.found):
            out[j].append((i, kind, float(self.span[kind] @ values), c))
        return out

    def decode(self, region: Region) -> list[int]:
        """The candidates of the best segmentation; of equal ones, that with the earlier arcs."""
        best = [{NONE: (0.0, None, -1)}] + [{} for _ in range(region.size)]
        for j, arcs in enumerate(self.arcs(region)):
            for i, label, score, c in arcs:
                for last, (value, _, _) in best[i].items():
                    total = value + score + self.next[last, label]
                    if label not in best[j] or total > best[j][label][0]:
                        best[j][label] = (total, (i, last), c)
        label = max(best[-1], key=lambda x: best[-1][x][0])
        j, chosen = region.size, []
        while j:
            _, back, c = best[j][label]
            if c >= 0:
                chosen.append(c)
            j, label = back
        return chosen[::-1]

    def gradient(self, region: Region, gold: set[int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of the segmentation whose entities are the candidates ``gold``."""
        arcs, n, labels = self.arcs(region), region.size, NONE + 1
        ahead = np.full((n + 1, labels), -np.inf)
        ahead[0, NONE] = 0.0
        for j in range(1, n + 1):
            for i, label, score, _ in arcs[j]:
                ahead[j, label] = np.logaddexp(ahead[j, label], np.logaddexp.reduce(ahead[i] + self.next[:, label]) + score)
        back = np.full((n + 1, labels), -np.inf)
        back[n] = 0.0
        total = np.logaddexp.reduce(ahead[n])
        span, following = np.zeros_like(self.span), np.zeros_like(self.next)
        for j in range(n, 0, -1):
            for i, label, score, c in arcs[j]:
                through = self.next[:, label] + score + back[j, label]
                back[i] = np.logaddexp(back[i], through)
                chance = np.exp(ahead[i] + through - total)
                following[:, label] -= chance
                if c >= 0:
                    span[label] -= chance.sum() * region.found[c][3]
        value, last, j = 0.0, NONE, 0
        starts = {region.found[c][0]: c for c in gold}
        while j < n:
            if j in starts:
                _, end, kind, values = region.found[starts[j]]
                value += float(self.span[kind] @ values)
                span[kind] += values
            else:
                end, kind = j + 1, NONE
            value += self.next[last, kind]
            following[last, kind] += 1
            last, j = kind, end
        return span, following, value - total


def generated(count: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Regions made by rule, with their spans: entities and other figures, alone or side by side."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        digits = number(rng.choice((13, 15, 16, 16, 16, 16, 19)) - 1)
        digits = next(digits + c for c in "0123456789" if luhn(digits + c))
        gap = rng.choice(("", "", " ", "-"))
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if gap else digits

    def other() -> str:
        while True:
            digits = number(rng.choice((2, 3, 5, 7, 11, 13, 16, 16, 18)))
            if rng.random() < 0.2:
                digits = "-".join(digits[i : i + 3] for i in range(0, len(digits), 3))
            if len(digits.replace("-", "")) < 13 or not luhn(digits.replace("-", "")):
                return digits

    makers = (
        lambda: "".join(rng.choice("abcdefgxyz") for _ in range(rng.randint(2, 9))) + rng.choice(("", "." + number(2))) + "@" + "".join(rng.choice("mailhost") for _ in range(5)) + rng.choice((".com", ".example.org")),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}" if rng.random() < 0.5 else "+" + rng.choice((" ", "-", "")).join((str(rng.randint(1, 99)), number(3), number(3), number(4))),
        other,
        lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}",
    )
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.choice((1, 1, 2, 2, 3))):
            label = rng.choices(range(len(makers)), (2, 2, 3, 2, 4, 1))[0]
            part = makers[label]()
            text += " " if text else ""
            if label < NONE:
                spans.append((label, len(text), len(text) + len(part)))
            text += part
        out.append((text, spans))
    return out


def gold(region: Region, spans: list[tuple[int, int, int]]) -> set[int] | None:
    """The candidates that are the spans; none if a span is no candidate or spans overlap."""
    at = {(region.edges[i], region.edges[j], kind): c for c, (i, j, kind, _) in enumerate(region.found)}
    spans = sorted(spans, key=lambda s: s[1])
    if any((a, b, kind) not in at for kind, a, b in spans) or any(x[2] > y[1] for x, y in zip(spans, spans[1:], strict=False)):
        return None
    return {at[a, b, kind] for kind, a, b in spans}


def taught(text: str | None, longest: int) -> list[dict]:
    """Stretches of the regions of a whole text with the base spans in them, at most ``longest`` characters each.

    A region is cut between tokens, outside spans. One token or span above that length is in no stretch.
    """
    out, own = [], sorted((a, b, kind) for kind, a, b in base(text or ""))
    k = 0
    for m in REGION.finditer(text or ""):
        first, last = m.span()
        while k < len(own) and own[k][1] <= first:
            k += 1
        inside = []
        for span in own[k:]:
            if span[0] >= last:
                break
            if first <= span[0] and span[1] <= last:
                inside.append(span)
        if CARD.search(m.group()) and len(DIGIT.findall(m.group())) > 19:
            continue  # the base may have lost a span here
        edges, covered, at = [], 0, 0
        for edge in [first + t.start() for t in TOKEN.finditer(m.group())] + [last]:
            while at < len(inside) and inside[at][0] < edge:
                covered = max(covered, inside[at][1])
                at += 1
            if covered <= edge:
                edges.append(edge)
        a = held = 0
        for b in range(1, len(edges)):
            if b + 1 < len(edges) and edges[b + 1] - edges[a] <= longest:
                continue
            low, high, a = edges[a], edges[b], b
            if high - low > longest:
                continue
            while held < len(inside) and inside[held][1] <= low:
                held += 1
            parts = []
            for start, end, kind in inside[held:]:
                if start >= high:
                    break
                parts.append({"kind": kind, "start": start - low, "end": end - low})
            out.append({"text": text[low:high], "before": text[max(0, low - 1) : low], "after": text[high : high + 1], "spans": parts})
    return out


def example(text: str, before: str, after: str, spans: list[tuple[int, int, int]]) -> tuple[Region, set[int]] | None:
    region = Region(text, before, after)
    if region.found and (labelled := gold(region, spans)) is not None:
        return region, labelled
    return None


def train(stretches: list[tuple[str, str, str, list[tuple[int, int, int]]]], generate: int = 700, rounds: int = 12, rate: float = 0.3, seed: int = 9) -> Field:
    examples = []
    for text, spans in generated(generate):
        region = Region(text)
        if (labelled := gold(region, spans)) is not None:
            examples.append((region, labelled))
    examples.extend(filter(None, (example(*stretch) for stretch in stretches)))
    field, rng = Field(), random.Random(seed)
    for r in range(rounds):
        rng.shuffle(examples)
        for region, labelled in examples:
            span, following, _ = field.gradient(region, labelled)
            step = rate / (1 + r)
            field.span += step * (span - 0.001 * field.span)
            field.next += step * (following - 0.001 * field.next)
    return field


def spans(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those that the model adds; both by kind, then start."""
    if not text:
        return [], []
    own = base(text)
    taken = sorted((a, b) for _, a, b in own)
    added = []
    if "@" in text or DIGIT.search(text):
        k = 0
        for m in REGION.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if b - a < 7 or k < len(taken) and taken[k][0] <= a and b <= taken[k][1]:
                continue
            region = Region(m.group(), text[a - 1 : a], text[b : b + 1])
            if not region.found:
                continue
            near = [t for t in taken[max(0, k - 4) :] if t[0] < b]
            for c in field.decode(region):
                i, j, kind, _ = region.found[c]
                s, e = a + region.edges[i], a + region.edges[j]
                if not any(x < e and s < y for x, y in near):
                    added.append((kind, s, e))
    return own, sorted(added)


TAUGHT = "array<struct<text:string,before:string,after:string,spans:array<struct<kind:int,start:int,end:int>>>>"


def _taught(longest: int):
    @F.pandas_udf(TAUGHT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[s for s in taught(t, longest) if Region(s["text"], s["before"], s["after"]).found] for t in texts])

    return run


def fit(docs: DataFrame, sample_docs: int = 3000, sample_regions: int = 6000, longest: int = 400) -> Field:
    """Train on generated regions and on those of a bounded sample of documents, taken from whole texts.

    Of the different stretches of the sampled documents the ``sample_regions`` with the least hashes teach: the same on every run.
    """
    session(docs.sparkSession)
    chosen = sample(docs.where(F.col("text").rlike("[0-9@]")), "doc_id", sample_docs, docs.count())
    rows = chosen.select(F.explode(_taught(longest)("text")).alias("s")).select("s.*").distinct()
    rows = rows.orderBy(F.xxhash64("text", "before", "after"), "text", "before", "after", "spans").limit(sample_regions).collect()
    return train([(r["text"], r["before"], r["after"], [tuple(s) for s in r["spans"]]) for r in rows])


SPAN = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("base", BooleanType())


def find(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with an array ``spans`` of ``kind, start, end, base``."""
    shared = session(docs.sparkSession).sparkContext.broadcast(field)

    @F.pandas_udf(ArrayType(SPAN))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for text in texts:
                own, added = spans(text, shared.value)
                both = sorted([(*s, True) for s in own] + [(*s, False) for s in added])
                rows.append([{"kind": KINDS[kind], "start": a, "end": b, "base": is_base} for kind, a, b, is_base in both])
            yield pd.Series(rows)

    return replace_columns(docs.withColumn("_spans", found(F.col("text"))), spans=F.col("_spans")).drop("_spans")


def op9_private(spark, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs.select("doc_id", "text"), fit(docs))
    own = F.filter("spans", lambda s: s["base"])
    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
