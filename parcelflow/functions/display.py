"""Column expressions for texts as readers see them, and gates on what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import status
from parcelflow.functions import text as T

#: Words that stay small in display case.
SMALL = ("and", "of", "the", "on")


def display_case(value: Column) -> Column:
    """Texts all in capitals with a capital for each word and hyphen part; others with blanks collapsed only; null as empty."""

    def word(w: Column) -> Column:
        parts = F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))
        return F.when(w.isin(*SMALL), w).otherwise(F.array_join(parts, "-"))

    def cased(text: Column) -> Column:
        letters = F.regexp_replace(text, "[^A-Za-z]", "")
        words = F.array_join(F.transform(F.split(F.lower(text), " "), word), " ")
        return F.when(T.let(letters, lambda x: (x != "") & (x == F.upper(x))), words).otherwise(text)

    return T.let(F.coalesce(T.squeeze(value), F.lit("")), cased)


def sale_label(address: Column, locality: Column, county: Column, area_slug: Column) -> Column:
    """What to call a sale: its address, else locality or area with the county where they differ, else the county."""
    street = display_case(T.compact_address(F.coalesce(address, F.lit(""))))
    area = display_case(T.slug_title(F.coalesce(area_slug, F.lit(""))))

    def within(region: Column, name: Column) -> Column:
        apart = (region != "") & (F.lower(name) != F.lower(region))
        return F.when(name != "", F.when(apart, F.concat(name, F.lit(", "), region)).otherwise(name))

    def placed(region: Column) -> Column:
        return F.coalesce(*(T.let(name, lambda n: within(region, n)) for name in (display_case(locality), area)), F.nullif(region, F.lit("")), F.lit("Nearby sale"))

    return T.let(street, lambda s: F.when(s != "", s).otherwise(T.let(display_case(county), placed)))


def sale_labels(sales: DataFrame) -> DataFrame:
    """county, labels, first_label: how many labels the sales of each county have, and the least; each different text is labelled once.

    sales: county, address, locality, area_slug.
    """
    texts = sales.select("county", "address", "locality", "area_slug").distinct()
    label = sale_label(F.col("address"), F.col("locality"), F.col("county"), F.col("area_slug"))
    found = texts.select("county", label.alias("label")).distinct()
    return found.groupBy("county").agg(F.count("label").alias("labels"), F.min("label").alias("first_label"))


def council_status(raw: Column, state: Column) -> Column:
    """The council's own wording where it says more than the state; null where it means the same or nothing."""
    value = T.meaningful(raw)
    return F.when(~((state != "unknown") & (status.canonical(value) == state)), value)


def status_event_label(state: Column) -> Column:
    return F.concat(F.lit("Status changed to "), status.label(state))


def strict_day(value: Column) -> Column:
    """The date of a text of exactly year, month and day that the calendar has, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(value, "yyyy-MM-dd"))


def due_shown(due: Column, state: Column, *done: Column) -> Column:
    """The decision-due date while it matters: no final or decided state, and none of the later dates."""
    closed = status.is_terminal(state) | F.coalesce(state == "decision_made", F.lit(False)) | F.coalesce(*done).isNotNull()
    return F.when(~closed, strict_day(due))


def search_terms(value: Column) -> Column:
    """The text and its comma parts, trimmed, each once, empty ones dropped."""
    parts = F.array_prepend(F.split(F.btrim(value), ","), F.btrim(value))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p != ""))


def is_discovered(verdict: Column, coverage: Column, crawled: Column, sitemaps: Column, referrers: Column) -> Column:
    """Whether an inspected page is known to the search engine: indexed, crawled, listed, linked, or a coverage state that says so."""
    known = (F.nullif(F.btrim(coverage), F.lit("")).isNotNull()) & ~F.lower(coverage).rlike("unknown to google|not available")
    signs = [verdict == "PASS", F.nullif(F.btrim(crawled), F.lit("")).isNotNull(), F.size(sitemaps) > 0, F.size(referrers) > 0, known]
    return F.array_contains(F.array(*(F.coalesce(s, F.lit(False)) for s in signs)), True)
