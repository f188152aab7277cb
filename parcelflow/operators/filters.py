"""Search filters as predicates that reach the scan: areas by every way to name them, date presets, and windows that hold no more rows than a source returns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import text as T
from parcelflow.functions.places import COUNTY_NAMES
from parcelflow.operators.search import plain
from parcelflow.sources.shared import materialised

#: Years of each preset, and the default.
PRESETS = {"last-year": 1, "last-2-years": 2, "last-3-years": 3, "last-5-years": 5}
DEFAULT_PRESET = "last-2-years"


@dataclass(frozen=True)
class AreaTerms:
    """What an area's name asks for: slugs, routing keys, counties and texts."""

    slugs: tuple[str, ...]
    prefixes: tuple[str, ...]
    counties: tuple[str, ...]
    texts: tuple[str, ...]


def _once(values: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(v for v in values if v))


def area_terms(name: str, counties: Iterable[str] = COUNTY_NAMES) -> AreaTerms:
    """The whole name and its comma parts, as slugs, as routing keys, as counties with or without a title, and as texts of three letters or more."""
    terms = _once([name.strip(), *(part.strip() for part in name.split(","))])
    slug = lambda t: plain(re.sub("['’]", "", t)).replace(" ", "-")
    by_slug = {slug(c): c for c in counties}
    keys = (re.sub(r"\s+", "", t.upper()) for t in terms)
    texts = (" ".join(t.replace(",", " ").split()) for t in terms)
    return AreaTerms(_once(map(slug, terms)), _once(k for k in keys if re.fullmatch("[A-Z][0-9][A-Z0-9]", k)), _once(by_slug.get(slug(re.sub(r"(?i)^co(unty)?\.?\s+", "", t)), "") for t in terms), _once(t for t in texts if len(t) >= 3))


def area_filter(name: str, broad: bool = True, counties: Iterable[str] | None = COUNTY_NAMES) -> Column:
    """A predicate on area_slug, eircode_prefix, county, locality and, if `broad`, address; false for an empty name.

    Equalities come first: a scan prunes by them. Texts match whatever the case, wildcards taken literally. Without `counties`
    none is looked for. The narrow form is for when the broad one takes too long.
    """
    asked = area_terms(name, counties or ())
    parts = [F.col(c).isin(*v) for c, v in (("area_slug", asked.slugs), ("eircode_prefix", asked.prefixes), ("county", asked.counties)) if v]
    parts += [F.col(c).ilike(T.match_pattern(t)) for t in asked.texts for c in (("locality", "address") if broad else ("locality",))]
    return F.coalesce(reduce(Column.__or__, parts, F.lit(False)), F.lit(False))


def broad_area_filter(slug: str, label: str) -> Column:
    """Rows of an area by its slug, or that name its label or a comma part of it in locality or address."""
    texts = area_terms(label, ()).texts
    return F.coalesce(reduce(Column.__or__, (F.col(c).ilike(T.match_pattern(t)) for t in texts for c in ("locality", "address")), F.col("area_slug") == slug), F.lit(False))


def years_before(day: date, years: int) -> date:
    """The same day of an earlier year; of a year without it the next day."""
    try:
        return day.replace(year=day.year - years)
    except ValueError:
        return date(day.year - years, 3, 1)


def date_range(as_of: date, preset: str | None = None, since: date | None = None, until: date | None = None) -> tuple[date | None, date | None]:
    """First and last day of a search: as given, or of a preset, or of the default; `all` has neither."""
    if since or until:
        return since, until
    if preset == "all":
        return None, None
    return years_before(as_of, PRESETS[preset if preset in PRESETS else DEFAULT_PRESET]), as_of


def date_windows(start: date, end: date, days: int) -> list[tuple[date, date]]:
    """Windows of so many days from the first day to the last, the last one shorter if need be."""
    days = max(1, days)
    return [(d, min(end, d + timedelta(days=days - 1))) for d in (start + timedelta(days=k) for k in range(0, (end - start).days + 1, days))]


def bisected_windows(rows: DataFrame, day: str, kind: str, start: date, end: date, days: int, most: int) -> DataFrame:
    """kind, first, last, n: date windows of every kind, those of more than `most` rows halved until none is, or has a day only.

    The rows are counted once by day and kind. A round halves the windows that are too full, half of an odd
    number of days rounded down, and only these are counted again; days keep the window that they end in. Windows without
    rows of a kind are not listed.
    """
    counts = rows.where(F.col(day).between(F.lit(start), F.lit(end))).groupBy(F.col(kind).alias("kind"), F.col(day).cast("date").alias("day")).agg(F.count("*").alias("n"))
    at = F.datediff("day", F.lit(start))
    first = F.date_add(F.lit(start), (F.floor(at / max(1, days)) * max(1, days)).cast("int"))
    open_ = materialised(counts.withColumn("first", first).withColumn("last", F.least(F.lit(end), F.date_add("first", max(1, days) - 1))))
    size, done = max(1, days), []
    key = ["kind", "first", "last"]
    while True:
        totals = open_.groupBy(*key).agg(F.sum("n").alias("total"))
        full = (F.col("total") > most) & (F.col("last") > F.col("first")) & F.lit(size > 1)
        done.append(totals.where(~full).select(*key, F.col("total").alias("n")))
        if size == 1:
            break
        size //= 2
        held = open_.join(totals.where(full).select(F.col("kind").alias("of"), F.col("first").alias("from"), F.col("last").alias("until")), F.col("kind").eqNullSafe(F.col("of")) & (F.col("first") == F.col("from")) & (F.col("last") == F.col("until")))
        step = F.date_add("from", (F.floor(F.datediff("day", "from") / size) * size).cast("int"))
        open_ = materialised(held.select("kind", "day", "n", step.alias("first"), "until").select("kind", "day", "n", "first", F.least("until", F.date_add("first", size - 1)).alias("last")))
    return reduce(DataFrame.unionByName, done)
