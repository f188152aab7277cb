"""Plain full-text search: rows that hold every word of a query, whatever its ending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions.stemming import STOP_WORDS, stems
from parcelflow.sources.shared import materialised

WORD = r"[\p{L}\p{N}]+"


def search_words(text: Column) -> Column:
    """The different words of a text in lower case, stop words left out; empty for null."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, sorted(STOP_WORDS))))


def text_search(rows: DataFrame, queries: DataFrame, row_id: str, text: str, query_id: str, query: str) -> DataFrame:
    """query_id, row_id for every row whose text holds a word of each stem of a query; queries without a word find nothing. Rows of one id count together.

    Every different word is stemmed once. Words whose stem no query asks for leave before rows are shuffled. A query
    meets only the rows of its rarest stem, and of those all its stems are looked for, so that a stem that
    most rows hold costs nothing unless it is all that a query has.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(search_words(F.col(query))).alias("word"))
    asked = materialised(asked.join(stems(asked), "word").select("query_id", "stem").distinct())
    held = rows.select(F.col(row_id).alias("row_id"), F.explode(search_words(F.col(text))).alias("word"))
    known = materialised(stems(held.select("word")).join(asked.select("stem").distinct(), "stem", "left_semi"))
    held = materialised(held.join(known, "word").select("row_id", "stem").distinct())
    counts = held.groupBy("stem").agg(F.count("*").alias("n"))
    wanted = asked.join(counts, "stem", "left").groupBy("query_id").agg(F.collect_set("stem").alias("stems"), F.min_by("stem", F.struct("n", "stem")).alias("stem"), F.bool_or(F.col("n").isNull()).alias("unknown"))
    own = held.groupBy("row_id").agg(F.collect_set("stem").alias("own_stems"))
    met = held.join(wanted.where("not unknown"), "stem").select("query_id", "row_id", "stems").join(own, "row_id")
    return met.where(F.size(F.array_except("stems", "own_stems")) == 0).select(F.col("query_id").alias(query_id), F.col("row_id").alias(row_id))
