"""Text analysis as Column functions: character filters, tokenizers, token filters.

A character filter maps a string Column to a string Column, a tokenizer maps it to array<string>, and
a token filter maps array<string> to array<string>. All but Unicode normalisation, iteration marks
and Porter stems stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Filter = Callable[[Column], Column]

# The English and Japanese stop words.
ENGLISH_STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing
don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself
just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t
than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where
which while who whom why will with you your yours yourself yourselves
""".split()
JAPANESE_STOP_WORDS = """
の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる
へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について せ だっ その後 できる それ う ので なお のみ でき き つ
における および いう さらに でも ら たり その他 に関する たち ます ん なら に対して 特に せる 及び これら とき では にて ほか ながら うち そして とともに ただし
かつて それぞれ または お ほど ものの に対する ほとんど と共に といった です とも ところ ここ
""".split()

# Character filters


def mapping_filter(rules: Mapping[str, str]) -> Filter:
    """Leftmost-longest replacement of literal patterns."""
    longest = sorted(rules, key=lambda k: (-len(k), k))
    if all(len(k) == 1 and len(v) <= 1 for k, v in rules.items()):
        order = sorted(rules, key=lambda k: not rules[k])  # translate() drops characters past the end of the target
        return lambda text: F.translate(text, "".join(order), "".join(rules[k] for k in order))
    pattern = "(?:" + "|".join(_quote(k) for k in longest) + ")"

    def run(text: Column) -> Column:
        if not rules:
            return text
        table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.element_at(table, m), F.lit("")))), "")

    return run


def _quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", text)


def pattern_filter(pattern: str, replacement: str) -> Filter:
    """Every match is replaced by the replacement as it stands (no group references)."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return lambda text: F.regexp_replace(text, pattern, literal)


def normalise_filter(form: str = "NFKC") -> Filter:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no such normalisation form: {form}")

    def one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return F.pandas_udf(one, "string")


def voiced(c: str) -> str:
    made = unicodedata.normalize("NFC", c + "゙")
    return made if len(made) == 1 and c not in "うウ" else c


def unvoiced(c: str) -> str:
    parts = unicodedata.normalize("NFD", c)
    return parts[0] if len(parts) == 2 and parts[1] == "゙" and parts[0] not in "うウ" else c


def spelled_out(text: str, kanji: bool = True, kana: bool = True) -> str:
    """Japanese iteration marks replaced by what they repeat: the k-th mark of a run of n repeats the k-th of n characters before the run."""
    marks = ("々" if kanji else "") + ("ゝゞヽヾ" if kana else "")
    if not marks:
        return text

    def run(m: re.Match) -> str:
        back = min(m.start(), len(m[0]))
        out = []
        for i, mark in enumerate(m[0]):
            at = m.start() + i - back
            c = text[at] if back and at < m.start() else mark
            out.append(c if mark == "々" else unvoiced(c) if mark in "ゝヽ" else voiced(unvoiced(c)))
        return "".join(out)

    return re.sub(f"[{marks}]+", run, text)


def iteration_mark_filter(kanji: bool = True, kana: bool = True) -> Filter:
    def one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else spelled_out(t, kanji, kana))

    return F.pandas_udf(one, "string")


# Tokenizers


def regex_tokenizer(pattern: str = r"\w+", gaps: bool = False) -> Filter:
    """Matches of a Unicode-aware pattern, or what lies between them."""
    if gaps:
        return lambda text: F.filter(F.split(text, f"(?U){pattern}", -1), lambda t: t != "")
    return lambda text: F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


whitespace_tokenizer = regex_tokenizer(r"\s+", gaps=True)


def word_tokenizer(text: Column) -> Column:
    """Words by Unicode classes: letters and digits with inner apostrophes, dots or commas as word breaks define them."""
    word = r"(?U)[\p{L}\p{M}\p{Nd}_]+(?:(?:['’.:](?=\p{L})|[.,](?=\p{Nd}))[\p{L}\p{M}\p{Nd}_]+)*"
    return F.regexp_extract_all(text, F.lit(word), F.lit(0))


def whole_tokenizer(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def ngram_tokenizer(low: int, high: int) -> Filter:
    """N-grams by start, then by size."""
    if not 1 <= low <= high:
        raise ValueError("sizes must be 1 <= low <= high")

    def run(text: Column) -> Column:
        n = F.length(text)
        sizes = F.array(*[F.lit(k) for k in range(low, high + 1)])
        at = lambda i: F.transform(F.filter(sizes, lambda k: i + k - 1 <= n), lambda k: F.substring(text, i, k))
        return F.when(n < low, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), n - low + 1), at)))

    return run


def cjk_tokenizer(text: Column) -> Column:
    """Without a dictionary: runs of CJK characters as overlapping bigrams, other words whole."""
    cjk = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー"
    runs = F.regexp_extract_all(text, F.lit(rf"(?U)[{cjk}]+|(?:(?![{cjk}])\w)+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{cjk}]") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))))


def token_kind(token: Column) -> Column:
    """The script or class of a token."""
    return (
        F.when(token.rlike(r"^\p{IsHiragana}+$"), "hiragana").when(token.rlike(r"^[\p{IsKatakana}ー]+$"), "katakana").when(token.rlike(r"^\p{IsHangul}+$"), "hangul")
        .when(token.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]+$"), "cjk").when(token.rlike(r"^\p{Nd}+$"), "num")
        .when(token.rlike(r"^[\p{L}\p{M}\p{Nd}_]+$"), "alphanum").when(token.rlike(r"^[\p{P}\p{S}]+$"), "punctuation").otherwise("other")
    )


# Token filters


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def stop(words: Iterable[str] = ENGLISH_STOP_WORDS) -> Filter:
    held = tuple(words)
    return lambda tokens: F.filter(tokens, lambda t: ~t.isin(*held))  # a hash lookup by literal set


def strip(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")


def remove_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def limit(n: int) -> Filter:
    return lambda tokens: F.slice(tokens, 1, n)


def boosted(tokens: Column, factor: float) -> Column:
    """(term, pos, boost) of each token; on tokens that have a boost already, it is multiplied."""
    return F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"), F.lit(float(factor)).alias("boost")))


# Suffixes of the simple stemmer.
SIMPLE_SUFFIXES = ("ing", "ed", "er", "est", "ly", "s", "es", "ies", "ied", "tion", "sion", "able", "ible", "ment", "ness", "ful")


def simple_stem(tokens: Column, suffixes: Iterable[str] = SIMPLE_SUFFIXES) -> Column:
    """The longest suffix goes if at least three characters stay; one pattern does it, since the earliest start is the longest suffix."""
    pattern = "^(.{3,}?)(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"
    return F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), pattern, "$1"))


def porter_stem(tokens: Column) -> Column:
    """Stems of whole token arrays, one Arrow batch at a time."""
    from sablefin.functions.stem import stem

    def run(batches: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def one(word: str) -> str:
            if word not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[word] = stem(word)
            return seen[word]

        return batches.map(lambda words: None if words is None else [one(w) for w in words])

    return F.pandas_udf(run, "array<string>")(tokens)
