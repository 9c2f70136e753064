"""Porter's suffix-stripping stemmer (M. F. Porter, 1980), for ASCII words.

Rules are (suffix, replacement) tables; the conditions are the paper's: m counts vowel-consonant
sequences, *v* asks for a vowel, *d for a double consonant, *o for consonant-vowel-consonant.
"""

from __future__ import annotations

import re
from functools import lru_cache

_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as c/v letters; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    fitting = [s for s in suffixes if word.endswith(s)]
    return max(fitting, key=len) if fitting else None


def _table(word: str, rules) -> str:
    suffix = _longest(word, [s for s, _ in rules])
    if suffix and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + dict(rules)[suffix]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # -eed, -ed, -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        suffix = _longest(word, ("ed", "ing"))
        if suffix and _has_vowel(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _table(_table(word, _STEP2), _STEP3)
    suffix = _longest(word, _STEP4)
    if suffix:
        rest = word[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
