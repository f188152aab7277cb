"""Texts of planning proposals: which of two counts, repair of cut ones, titles and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow.functions import text as T
from parcelflow.functions.text import let as _let

#: Lengths at which a source cuts its texts, and the length from which weak signs of a cut count.
LIMIT = (79, 81)
LONG = 75
#: What a cut text ends in: a numbered item just begun, a clause of a letter or two, a word that wants another.
NUMBERED = r"(?i)[,;]\s*(?:and\s+)?\d+\s*[).:-]\s*[a-z]{1,3}\s*$"
CLAUSE = r"(?i)[,;:]\s+[a-z]{1,2}\s*$"
CONNECTOR = r"(?i)\b(?:and|or|with|to|for|of|the|including|comprising)\s*$"
#: The opening of a list of works, and that of a retention.
PERMISSION = r"(?i)^Permission for:\s*1\s*[).:-]\s*(.+)$"
RETENTION = r"(?i)^the\s+development\s+to\s+be\s+retained\s+consists\s+of\s*(?:(?:\(\s*1\s*\)|1\s*[).:-])\s*)?(?:the\s+)?(.+)$"
#: A sentence's end, which the point of an abbreviated number or reference is not.
SENTENCE = r"(?i)^(.*?(?:(?<!(?:^|\s)\d{0,20}(?:no|nos|ref))\.|[!?]))(?=\s|$)"
#: Least characters of a clause that stays at the limit, and longest title and summary.
LEAST_CLAUSE, TITLE, SUMMARY = 35, 120, 155


def capital(value: Column) -> Column:
    """The text with its first ASCII letter in upper case."""
    at = F.regexp_instr(value, F.lit("[A-Za-z]"))
    return _let(F.struct(value.alias("v"), at.alias("at")), lambda x: F.when(x["at"] == 0, x["v"]).otherwise(F.concat(F.substr(x["v"], F.lit(1), x["at"] - 1), F.upper(F.substr(x["v"], x["at"], F.lit(1))), F.substr(x["v"], x["at"] + 1))))


def _first(value: Column, change: Callable[[Column], Column]) -> Column:
    """The text with another first character."""
    return _let(value, lambda v: F.concat(change(F.substring(v, 1, 1)), F.substring(v, 2, 1_000_000_000)))


def authoritative(short: Column, full: Column) -> Column:
    """The full text unless it is empty or shorter than the other; null where neither says anything."""
    a, b = T.squeeze(short), T.squeeze(full)
    return F.when(b.isNotNull() & (F.length(b) >= F.coalesce(F.length(a), F.lit(0))), b).otherwise(a)


def at_limit(value: Column) -> Column:
    """Whether a text has the length at which the source cuts, and no closing mark."""
    return F.length(value).between(*LIMIT) & ~value.rlike(r"[.!?)]$")


def _without_end(whole: Column) -> Column:
    """struct<text, dangling>: the text without what it dangles in."""
    long = F.length(whole) >= LONG
    signs = [(whole.rlike(NUMBERED), NUMBERED), (long & whole.rlike(CLAUSE), CLAUSE), (long & whole.rlike(CONNECTOR), CONNECTOR)]
    pick = lambda found, pattern: F.struct(F.regexp_replace(whole, pattern, "").alias("text"), F.lit(found).alias("dangling"))
    kept = F.when(signs[0][0], pick(True, signs[0][1]))
    for sign, pattern in signs[1:]:
        kept = kept.when(sign, pick(True, pattern))
    return kept.otherwise(F.struct(whole.alias("text"), F.lit(False).alias("dangling")))


def _last_clause_off(tidy: Column) -> Column:
    clause = F.rtrim(F.regexp_extract(tidy, rf"^(.{{{LEAST_CLAUSE},}})[,;][^,;]*$", 1))
    return _let(clause, lambda c: F.when(c != "", c).otherwise(F.btrim(F.regexp_replace(tidy, r"\s+[A-Za-z]{1,6}$", ""))))


def _listed(safe: Column) -> Column:
    return _let(F.regexp_extract(safe, PERMISSION, 1), lambda body: F.when(body != "", F.concat(F.lit("Permission for "), _first(body, T.lower_letter))).otherwise(safe))


def repaired(value: Column, fallback: str = "Proposal description not recorded") -> Column:
    """struct<display, original, truncated>: a text that looks cut ends at its last sound place and an ellipsis.

    original is null for whole texts. The cut falls before a numbered item just begun, a short clause or a dangling
    connector; a text at the source's limit without these loses its last clause, or else its last short word.
    """

    def ended(end: Column) -> Column:
        tidy = F.regexp_replace(F.btrim(end["text"]), r"[,;:]\s*$", "")
        safe = _let(tidy, lambda t: F.when(end["dangling"], t).otherwise(_last_clause_off(t)))
        return _let(F.btrim(F.regexp_replace(_let(safe, _listed), "[.!?…]+$", "")), lambda s: F.when(s != "", F.concat(s, F.lit("…"))).otherwise(F.lit(fallback)))

    def shown(whole: Column) -> Column:
        def of(end: Column) -> Column:
            cut = (whole != "") & (end["dangling"] | at_limit(whole))
            display = F.when(whole == "", F.lit(fallback)).when(cut, ended(end)).otherwise(whole)
            return F.struct(capital(display).alias("display"), F.when(cut, whole).alias("original"), cut.alias("truncated"))

        return _let(_without_end(whole), of)

    return _let(F.coalesce(T.squeeze(value), F.lit("")), shown)


def capped(value: Column, most: int) -> Column:
    """The first sentence if it is short enough, else the text up to its last clause, conjunction or word that is, and an ellipsis."""
    most = max(40, most)
    least = min(70, int(most * 0.55))
    breaks = [rf"^(.{{{least},}})[;:,](?=\s|$)", rf"(?i)^(.{{{least},}})\s(?:and|with|including|comprising)\s", r"^(.+) "]

    def cut(v: Column) -> Column:
        found = _let(F.substring(v, 1, most + 1), lambda head: F.coalesce(*(F.nullif(F.regexp_extract(head, b, 1), F.lit("")) for b in breaks), F.substring(head, 1, most)))
        bare = F.regexp_replace(F.regexp_replace(F.btrim(found), "[,;:]$", ""), "[.!?…]+$", "")
        return _let(bare, lambda c: F.when(c != "", F.concat(c, F.lit("…"))).otherwise(v))

    def of(v: Column) -> Column:
        sentence = F.regexp_extract(v, SENTENCE, 1)
        return _let(sentence, lambda s: F.when((s != "") & (F.length(s) <= most), s).when(F.length(v) <= most, v).otherwise(cut(v)))

    return _let(value, of)


def _retention(shown: Column) -> Column:
    return _let(F.regexp_extract(shown, RETENTION, 1), lambda item: F.when(item != "", F.concat(F.lit("Retention: "), _first(item, T.lower_letter))).otherwise(shown))


def title(value: Column, fallback: str = "Planning application", most: int = TITLE) -> Column:
    """A heading: placeholders give the fallback, cut texts are repaired, a retention names its first item."""
    return _told(value, fallback, lambda said: capped(_let(repaired(said, fallback)["display"], _retention), most))


def summary(value: Column, fallback: str = "Planning application details", most: int = SUMMARY) -> Column:
    """The proposal in at most about `most` characters."""
    return _told(value, fallback, lambda said: capped(repaired(said, fallback)["display"], most))


def _told(value: Column, fallback: str, use: Callable[[Column], Column]) -> Column:
    return _let(T.meaningful(value), lambda said: capital(F.when(said.isNull(), F.lit(fallback)).otherwise(use(said))))
