"""A Porter stemmer that rewrites words by their consonant/vowel shape.

Steps 1a, 1b, 2, 3, 4 and 5 are applied; a final y is not turned into i (step 1c is left out).
"""

from __future__ import annotations

import re

# Suffix rules of the Porter algorithm, in the order they are tried.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def short(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def swap(word: str, rules) -> str:
    for old, new in rules:
        if word.endswith(old):
            return word[: -len(old)] + new if measure(word[: -len(old)]) > 0 else word
    return word


def plural(word: str) -> str:
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss")):
        if word.endswith(old):
            return word[: -len(old)] + new
    return word[:-1] if word.endswith("s") and len(word) > 1 else word


def past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), word)
    if cut == word or "v" not in shape(cut):
        return word
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if cut[-2:-1] == cut[-1:] and shape(cut).endswith("c") and cut[-1] not in "lsz":
        return cut[:-1]
    return cut + "e" if measure(cut) == 1 and short(cut) else cut


def stem(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    word = swap(swap(past(plural(word)), STEP2), STEP3)
    for suffix in STEP4:
        left = word[: -len(suffix)]
        if word.endswith(suffix) and measure(left) > 1 and (suffix != "ion" or left.endswith(("s", "t"))):
            word = left
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
