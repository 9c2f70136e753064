"""Text expressions. Every function takes and returns a Column and stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks -> base letter, derived from Unicode decompositions."""
    source, target = [], []
    for start, end in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(start, end):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base != chr(code) and base.isascii():
                source.append(chr(code))
                target.append(base)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics; plain ASCII text skips the translation."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, _FOLD_FROM, _FOLD_TO)).otherwise(low)


def fold_literal(text: str) -> str:
    table = str.maketrans(_FOLD_FROM, _FOLD_TO)
    return text.lower().translate(table)


def tokens(text: Column) -> Column:
    """Letter and digit runs of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def spaced_terms(text: Column) -> Column:
    """All terms in order, each with a blank on both sides: `` a  b  c `` (one blank when there is none)."""
    plain = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def count_terms(spaced: Column) -> Column:
    return F.when(F.trim(spaced) == "", F.lit(0)).otherwise(
        ((F.length(spaced) - F.length(F.replace(spaced, F.lit("  "), F.lit("")))) / 2 + 1).cast("long")
    )


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut_with_mark(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def strip_injected(text: Column) -> Column:
    """Remove tag-wrapped text that a harness placed on a user turn."""
    for tag in K.INJECTED_BARE_TAGS:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")
    for tag in K.INJECTED_ATTR_TAGS:
        text = F.regexp_replace(text, rf"(?s)<{tag}\b[^>]*>.*?</{tag}>", "")
    return text


def clean(text: Column) -> Column:
    """Prompt text without tags, one line, bounded."""
    return F.substring(collapse(F.regexp_replace(text, r"<[^>]+>", "")), 1, K.PROMPT_CHARS)


def strip_insight_fences(text: Column) -> Column:
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: ~line.rlike(r"^\s*★\s*Insight\s*─*\s*$") & ~line.rlike(r"^\s*─{5,}\s*$"),
    )
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clip(text: Column, size: int) -> Column:
    """Cut at a word boundary when that costs less than 40 % of the field."""
    flat = collapse(text)
    head = F.substring(flat, 1, size - 1)
    last_space = F.length(head) - F.instr(F.reverse(head), " ")
    at_word = F.when(
        (F.instr(head, " ") > 0) & (last_space > F.lit(size * 0.6)), F.substring(head, F.lit(1), last_space.cast("int"))
    ).otherwise(head)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(at_word), F.lit("…")))


def clean_title(text: Column) -> Column:
    flat = F.regexp_replace(text, "[#*`>_|]+", " ")
    flat = collapse(F.regexp_replace(flat, "[☀-➿]|️", " "))
    return (
        F.when(F.length(flat) > 72, F.concat(F.rtrim(F.substring(flat, 1, 72)), F.lit("…")))
        .when(flat == "", F.lit("untitled"))
        .otherwise(flat)
    )


def clean_prompt(text: Column) -> Column:
    flat = F.regexp_replace(text, r"(?s)```.*?```", " ")
    flat = collapse(F.regexp_replace(flat, "[#*`>_|]+", " "))
    return F.when(flat == "", F.lit(None).cast("string")).otherwise(
        F.when(F.length(flat) > 90, F.concat(F.rtrim(F.substring(flat, 1, 90)), F.lit("…"))).otherwise(flat)
    )


def has_artifact(text: Column) -> Column:
    return text.rlike(K.ARTIFACT_PATTERN)


def resolve_project(cwd: Column) -> Column:
    repo = F.regexp_extract(cwd, r"^/[^/]+/[^/]+/Developer/([^/]+)", 1)
    base = F.regexp_extract(cwd, r"([^/]+)/*$", 1)
    return F.coalesce(F.nullif(repo, F.lit("")), F.nullif(base, F.lit("")), F.lit("unknown"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def short_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def command_family(command: Column) -> Column:
    parts = F.split(collapse(command), " ")
    first, second = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    alone = second.isNull() | (second == "") | second.startswith("-") | second.contains("/") | second.contains("=")
    return F.when(alone, first).otherwise(F.concat_ws(" ", first, second))


def branch_label(cwd: Column, branches: Column | None = None) -> Column:
    label = basename(cwd)
    return label if branches is None else F.coalesce(F.try_element_at(branches, cwd), label)


def is_real_model(model: Column) -> Column:
    return F.coalesce((model != "") & ~model.startswith("<"), F.lit(False))


def canonical_model(model: Column) -> Column:
    """Provider prefix and trailing markers removed; known families pretty-printed."""
    bare = F.regexp_replace(model, r"(?i)^[a-z0-9.-]+/", "")
    bare = F.trim(F.regexp_replace(bare, r"(\[[^\]]*\]|:[^:]*)+$", ""))
    pattern = r"^claude-(opus|sonnet|haiku|fable|mythos)-(\d+)(?:-(\d{1,2})(?=-|$))?"
    family = F.regexp_extract(bare, pattern, 1)
    major = F.regexp_extract(bare, pattern, 2)
    minor = F.regexp_extract(bare, pattern, 3)
    gpt = r"^gpt-([\d.]+)(.*)$"
    return (
        F.when(
            family != "",
            F.concat(F.initcap(family), F.lit(" "), major, F.when(minor != "", F.concat(F.lit("."), minor)).otherwise("")),
        )
        .when(bare.rlike(gpt), F.concat(F.lit("GPT-"), F.regexp_extract(bare, gpt, 1), F.regexp_extract(bare, gpt, 2)))
        .otherwise(bare)
    )


def clean_for_mining(text: Column) -> Column:
    for pattern in (
        r"(?s)```.*?```",
        r"`[^`]*`",
        r"<[^>\n]{1,80}>",
        r"(?i)\[request interrupted[^\]]*\]",
        r"https?://\S+",
        r"[\w.-]{1,256}/[\w./-]{1,512}",
    ):
        text = F.regexp_replace(text, pattern, " ")
    return text


def mining_words(text: Column) -> Column:
    raw = F.regexp_extract_all(clean_for_mining(F.lower(text)), F.lit(r"([a-z][a-z'-]{3,})"), 1)
    bare = F.transform(raw, lambda w: F.regexp_replace(w, "['-]", ""))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 4))


def resume_command(tool: Column, cwd: Column, session_id: Column) -> Column:
    place = F.format_string('cd "%s"', cwd)
    return (
        F.when(
            (tool == "claude") & ~session_id.contains("/subagents/"),
            F.concat(place, F.lit(" && claude --resume "), session_id),
        )
        .when(tool == "opencode", F.concat(place, F.lit(" && opencode --session "), session_id))
        .otherwise(place)
    )


def format_tokens(n: Column) -> Column:
    def scaled(scale: float, suffix: str) -> Column:
        return F.concat(F.format_string("%.1f", n.cast("double") / F.lit(scale)), F.lit(suffix))

    return (
        F.when(n >= 1_000_000_000, scaled(1e9, "B"))
        .when(n >= 1_000_000, scaled(1e6, "M"))
        .when(n >= 1_000, scaled(1e3, "K"))
        .otherwise(n.cast("string"))
    )


def format_bytes(n: Column) -> Column:
    def scaled(scale: int, suffix: str) -> Column:
        return F.format_string("%.1f " + suffix, n.cast("double") / F.lit(float(scale)))

    return (
        F.when(n >= 1 << 30, scaled(1 << 30, "GB"))
        .when(n >= 1 << 20, scaled(1 << 20, "MB"))
        .when(n >= 1 << 10, scaled(1 << 10, "KB"))
        .otherwise(F.format_string("%d B", n))
    )


def format_usd(n: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(n, 2))


def format_percent(share: Column) -> Column:
    return F.format_string("%d%%", F.floor(share * 100 + 0.5).cast("long"))


def hour_label(hour: Column) -> Column:
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.format_string("%d %s", twelve.cast("int"), F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over characters, as BIGINT."""
    chars = F.split(text, "")
    return F.when(text == "", F.lit(2166136261).cast("long")).otherwise(
        F.aggregate(
            chars,
            F.lit(2166136261).cast("long"),
            lambda h, c: F.when(c == "", h).otherwise(
                (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(
                    F.lit(4294967295).cast("long")
                )
            ),
        )
    )
