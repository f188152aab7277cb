"""English word stems by the published Snowball rules (its second English stemmer), and the words that a search ignores."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that stand in nearly every text.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Words with stems of their own, words that stay, and words that stay once a plural is taken off.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SPECIAL |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings and what takes their place, in the first region (second and third step) and dropped in the second region.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str | None:
    """The longest of some endings that a word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    word = re.sub("'s'$|'s$|'$", "", word)
    head = re.match("gener|commun|arsen", word)
    first = head.end() if head else _region(word, 0)
    second = _region(word, first)

    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[: -2 if len(word) > 4 else -1]
    elif end == "s" and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in FINISHED:
        return word.lower()

    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= first:
            word = word[: -len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif first >= len(word) and _SHORT_END.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _ending(word, SECOND)
    if end and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple("cdeghkmnrt")):
            word = before + SECOND[end]
    end = _ending(word, THIRD)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + THIRD[end]
    end = _ending(word, FOURTH)
    if end and len(word) - len(end) >= second and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) > second or (len(word) > first and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.lower()


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """`word` and `stem` of a table of different words, in Arrow batches: as many calls as there are words, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=[word, "stem"])

    return words.select(word).distinct().mapInArrow(run, f"`{word}` string, stem string")
