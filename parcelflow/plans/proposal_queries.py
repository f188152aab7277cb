"""Queries of proposal texts: every document is a proposal, whole and in the pieces that a source with a short field would keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import proposals as P
from parcelflow.functions import text as T
from parcelflow.plans.registry import query
from parcelflow.sources.tables import table

SPACE = "[ \\t\\n\\x0b\\f\\r]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _capital(x: str) -> str:
    head = f"length(regexp_extract({x}, '^[^A-Za-z]*'))"
    return f"substr({x}, 1, {head}) || upper(substr({x}, {head} + 1, 1)) || substr({x}, {head} + 2)"


def _repaired(source: str, fallback: str) -> str:
    """CTEs from `source` (key, raw) to `shown` (key, whole, truncated, display)."""
    return f"""w as (select key, trim(regexp_replace(coalesce(raw, ''), '{SPACE}+', ' ', 'g')) as whole from {source}),
    g as (select *, regexp_matches(whole, {_quoted(P.NUMBERED)}) as a, length(whole) >= {P.LONG} and regexp_matches(whole, {_quoted(P.CLAUSE)}) as b, length(whole) >= {P.LONG} and regexp_matches(whole, {_quoted(P.CONNECTOR)}) as c,
      length(whole) between {P.LIMIT[0]} and {P.LIMIT[1]} and not regexp_matches(whole, '[.!?)]$') as l from w),
    k as (select *, regexp_replace(trim(case when a then regexp_replace(whole, {_quoted(P.NUMBERED)}, '') when b then regexp_replace(whole, {_quoted(P.CLAUSE)}, '') when c then regexp_replace(whole, {_quoted(P.CONNECTOR)}, '') else whole end), '[,;:] *$', '') as tidy from g),
    y as (select *, case when a or b or c then tidy when regexp_matches(tidy, '^.{{{P.LEAST_CLAUSE},}}[,;][^,;]*$') then rtrim(regexp_extract(tidy, '^(.{{{P.LEAST_CLAUSE},}})[,;][^,;]*$', 1)) else trim(regexp_replace(tidy, ' +[A-Za-z]{{1,6}}$', '')) end as safe from k),
    z as (select *, trim(regexp_replace(case when regexp_matches(safe, {_quoted(P.PERMISSION)}) then 'Permission for ' || lower(substr(regexp_extract(safe, {_quoted(P.PERMISSION)}, 1), 1, 1)) || substr(regexp_extract(safe, {_quoted(P.PERMISSION)}, 1), 2) else safe end, '[.!?…]+$', '')) as bare from y),
    d as (select key, whole, whole <> '' and (a or b or c or l) as truncated, case when whole = '' then '{fallback}' when not (a or b or c or l) then whole when bare <> '' then bare || '…' else '{fallback}' end as display from z),
    shown as (select key, whole, truncated, {_capital("display")} as display from d)"""


def _capped(v: str, most: int) -> str:
    least = min(70, int(most * 0.55))
    marked = f"regexp_replace({v}, '(?i)(^| )([0-9]{{0,20}}(?:no|nos|ref))\\.', '\\1\\2' || chr(1), 'g')"
    sentence = f"replace(regexp_extract({marked}, '^(.*?[.!?])(?: |$)', 1), chr(1), '.')"
    head = f"substr({v}, 1, {most + 1})"
    breaks = [f"^(.{{{least},}})[;:,](?: |$)", f"(?i)^(.{{{least},}}) (?:and|with|including|comprising) ", "^(.+) "]
    cut = f"trim(coalesce({', '.join(f'''nullif(regexp_extract({head}, {_quoted(b)}, 1), '')''' for b in breaks)}, substr({v}, 1, {most})))"
    bare = f"regexp_replace(regexp_replace({cut}, '[,;:]$', ''), '[.!?…]+$', '')"
    return f"case when {sentence} <> '' and length({sentence}) <= {most} then {sentence} when length({v}) <= {most} then {v} when {bare} <> '' then {bare} || '…' else {v} end"


MEANT = f"""m as (select doc_id as key, case when lower(t) not in ({", ".join(f"'{x}'" for x in T.PLACEHOLDERS)}) then upper(substr(t, 1, 1)) || substr(t, 2) end as raw from
  (select doc_id, nullif(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')), '') as t from documents))"""


@query("f31_summaries", f"with {MEANT}, {_repaired('m', 'Planning application details')}, v as (select key, whole, case when whole = '' then display else {_capped('display', P.SUMMARY)} end as s from shown) select key as doc_id, {_capital('s')} as summary from v")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all documents: first sentence, clause, conjunction or word boundary."""
    return table(spark, sf_dir, "documents").select("doc_id", P.summary(F.col("text")).alias("summary"))


@query("f31_titles", f"""with {MEANT}, {_repaired('m', 'Planning application')}, r as (select key, whole, case when regexp_matches(display, {_quoted(P.RETENTION)}) then 'Retention: ' || lower(substr(regexp_extract(display, {_quoted(P.RETENTION)}, 1), 1, 1)) || substr(regexp_extract(display, {_quoted(P.RETENTION)}, 1), 2) else display end as display from shown),
  v as (select key, case when whole = '' then display else {_capped('display', P.TITLE)} end as s from r) select key as doc_id, {_capital('s')} as title from v""")  # fmt: skip
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.title(F.col("text")).alias("title"))


PIECES = "p as (select {'d': doc_id, 'i': unnest(range(len(x)))} as key, unnest(x) as raw from (select doc_id, regexp_extract_all(text, '(?s).{1,80}') as x from documents))"


@query("f32_repaired_proposals", f"with {PIECES}, {_repaired('p', 'Proposal description not recorded')} select key.d as doc_id, count(*) as n, count(*) filter (truncated) as n_truncated, sha256(string_agg(display, chr(10) order by key.i)) as displays from shown group by 1")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces of 80 characters, each repaired as a proposal that its source has cut."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)(.{1,80})"), F.lit(1))).alias("i", "raw"))
    shown = pieces.select("doc_id", "i", P.repaired(F.col("raw")).alias("r"))
    found = shown.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("r.truncated").alias("n_truncated"), F.array_sort(F.collect_list(F.struct("i", "r.display"))).alias("all"))
    return found.select("doc_id", "n", "n_truncated", F.sha2(F.array_join(F.transform("all", lambda r: r["display"]), "\n"), 256).alias("displays"))


@query("f33_authoritative_texts", "select p_partkey, case when length(p_type || ' ' || p_brand) >= length(p_name) then p_type || ' ' || p_brand else p_name end as chosen from part")
def authoritative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two texts of every part the full one, unless it is shorter."""
    return table(spark, sf_dir, "part").select("p_partkey", P.authoritative(F.concat(F.lit(" "), "p_name"), F.concat("p_type", F.lit("  "), "p_brand")).alias("chosen"))
