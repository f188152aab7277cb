"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule has a rejecting condition and a work estimate (characters or words it walks).
On a sample the share that each rule rejects and its mean work are measured in one
aggregation; the rules are then tried in falling order of rejection per work, and the first
that rejects a document ends its cascade. The order changes the time, never the verdict.

Null and blank texts have no words and fail the base checks. Equal texts get equal rows.
Columns of the input other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm import words as W

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """`rejects` and `work` are columns over text and the base statistics."""

    name: str
    rejects: Column
    work: Column


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows that appear twice or more, by hashes of the windows."""

    def window_hashes(hashes: Column) -> Column:
        at = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    def repeated(found: Column) -> Column:
        twice = F.filter(found, lambda x, i: x["g"].eqNullSafe(F.get(found, i - 1)["g"]) | x["g"].eqNullSafe(F.get(found, i + 1)["g"]))
        return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def count(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(pairs, repeated))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), window_hashes), count)


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, text, words and counts of each document, and whether the base checks fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(W.WORD))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = slim.withColumns({"words": W.words(F.col("text")), "lines": lines})
    counted = cut.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, W.SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def default_rules() -> list[Rule]:
    """Thresholds in whole numbers, so that every engine agrees on them."""
    n, chars, text = F.col("n_words"), F.col("word_chars"), F.col("text")
    stutter = _let(F.col("words"), lambda words: F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))))
    one, per_char, per_word = F.lit(1.0), F.length(text).cast("double"), n.cast("double")
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n, one),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.col("n_lines"), one),
        Rule("word_length", (chars > n * 15) | (chars < n * 2), one),
        Rule("capitals", F.regexp_count(text, F.lit("[A-Z]")) * 2 > chars, per_char * 2),
        Rule("exclamations", F.regexp_count(text, F.lit("!")) * 2 > n, per_char),
        Rule("few_letters", F.regexp_count(text, F.lit(r"\p{L}")) * 2 < chars, per_char * 8),
        Rule("stutter", stutter * 5 > n, per_word * 6),
    ]


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejection per work on the statistics of a sample; one row comes to the driver."""
    measures = [F.avg(r.rejects.cast("double")).alias(f"share_{k}") for k, r in enumerate(rules)] + [F.avg(r.work).alias(f"work_{k}") for k, r in enumerate(rules)]
    row = sample.where(~F.col("base_failed")).agg(*measures).first()
    value = {k: (row[f"share_{k}"] or 0.0) / max(row[f"work_{k}"] or 0.0, 1.0) for k in range(len(rules))}
    return [rules[k] for k in sorted(value, key=lambda k: (-value[k], row[f"work_{k}"] or 0.0, k))]


def cascade(docs: DataFrame, rules: list[Rule] | None = None, fraction: float = 0.01, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every document."""
    stats = base_statistics(docs, id_col, text_col)
    verdict = F.lit(False)
    ordered = order_rules(base_statistics(docs.sample(fraction, seed), id_col, text_col), default_rules() if rules is None else rules)
    chain = F.when(F.col("base_failed"), F.lit(True))
    for rule in ordered:
        chain = chain.when(rule.rejects, F.lit(True))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~chain.otherwise(verdict)).alias("kept"))


ORACLE = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
g as (select doc_id, i, w[i:i + 4] as gram from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
d as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
r as (select doc_id, count(distinct i + k) as n_repeat_words from d, (select unnest(range(5)) as k) group by doc_id),
s as (select w.doc_id, w.text, w.w, len(w.w) as n_words,
        length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(l.lines) as n_lines, len(l.lines) - len(list_distinct(l.lines)) as n_dup_lines,
        coalesce(r.n_repeat_words, 0) as n_repeat_words
      from w join l using (doc_id) left join r using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as capitals,
        length(text) - length(replace(text, '!', '')) as exclamations,
        length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) as letters,
        len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) as stutter from s)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars > 15 * n_words or word_chars < 2 * n_words
    or 2 * capitals > word_chars or 2 * exclamations > n_words or 2 * letters < word_chars or 5 * stutter > n_words) as kept
from b
"""
