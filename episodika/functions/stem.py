"""English stemming (the published Porter2 rules) and stop words, applied per Arrow batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# The usual English stop words of full-text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)

# Irregular words of the rule set.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
SUFFIX_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
SUFFIX_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
SUFFIX_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al",
    "er", "ic",
)

_VOWEL = "[aeiouy]"
_REGION = re.compile(r".*?[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE_END = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _region(word: str, start: int) -> int:
    found = _REGION.match(word, start)
    return found.end() if found else len(word)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(rf"(^|(?<={_VOWEL}))y", "Y", word.lstrip("'"))
    prefix = re.match(r"gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w, 0)
    r2 = _region(w, r1)

    w = re.sub(r"'s?'?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w

    found = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if found:
        base, suffix = w[: found.start()], found.group()
        if suffix.startswith("eed"):
            if found.start() >= r1:
                w = base + "ee"
        elif re.search(_VOWEL, base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif _DOUBLE_END.search(base):
                w = base[:-1]
            elif r1 >= len(base) and _SHORT_END.search(base):
                w = base + "e"
            else:
                w = base
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)

    for suffix, new in SUFFIX_2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            allowed = {"ogi": w[:at].endswith("l"), "li": w[:at].endswith(tuple("cdeghkmnrt"))}.get(suffix, True)
            if at >= r1 and allowed:
                w = w[:at] + new
            break
    for suffix, new in SUFFIX_3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                w = w[:at] + new
            break
    for suffix in SUFFIX_4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[:at].endswith(("s", "t"))):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_WORD = re.compile(r"[^\W_]+")


@F.arrow_udf(T.ArrayType(T.StringType()))
def english_stems(text: pa.Array) -> pa.Array:
    """Distinct stems of a text without stop words. Spark has no stemmer, hence Python; the word cache makes it cheap."""
    out = []
    for value in text.to_pylist():
        words = dict.fromkeys(_WORD.findall(value.lower())) if value else {}
        out.append(list(dict.fromkeys(stem(w) for w in words if w not in STOP_WORDS)))
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def word_stem(word: pa.Array) -> pa.Array:
    """Stem of one lower-case word."""
    return pa.array([None if w is None else stem(w) for w in word.to_pylist()], pa.string())


def is_stop_word(word: Column) -> Column:
    return word.isin(sorted(STOP_WORDS))
