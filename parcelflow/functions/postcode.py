"""Postcodes of seven characters: a routing key and a unique identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters in use, and the two parts of a code.
LETTERS = "AC-FHKNPRTV-Y"
ROUTING_KEY = f"(?:[{LETTERS}][0-9]{{2}}|D6W)"
IDENTIFIER = f"[0-9{LETTERS}]{{4}}"


def compact(value: Column) -> Column:
    """The code without blanks in capitals; null where the whole text is none."""
    text = F.upper(F.btrim(value))
    return F.when(text.rlike(rf"^{ROUTING_KEY}\s*{IDENTIFIER}$"), F.regexp_replace(text, r"\s+", ""))


def canonical(value: Column) -> Column:
    code = compact(value)
    return F.when(code.isNotNull(), F.concat(F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 4)))


def extract(value: Column) -> Column:
    """The first code within a text that no letter or digit touches; null without one."""
    pattern = rf"(?i)(?:^|[^0-9A-Z])({ROUTING_KEY})\s*({IDENTIFIER})(?=$|[^0-9A-Z])"
    key, rest = F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2)
    return F.when(key != "", F.upper(F.concat(key, F.lit(" "), rest)))


def looks_like(value: Column) -> Column:
    """Whether a short text has the shape of a code, valid or not."""
    text = F.upper(F.btrim(value))
    return F.coalesce(text.rlike(r"^[A-Z0-9]{3}\s*[A-Z0-9]{3,5}$") & text.rlike("[0-9]"), F.lit(False))


def routing_key(value: Column) -> Column:
    return F.substring(compact(value), 1, 3)


def first_valid(*values: Column) -> Column:
    """The first of several texts that is or holds a code."""
    return F.coalesce(*(F.coalesce(canonical(v), extract(v)) for v in values))
