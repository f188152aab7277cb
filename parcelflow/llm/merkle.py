"""Merkle manifest of a dataset: hash trees of fan-out 8 over ordered leaves, collapsed in blocks by array functions.

A leaf is the sha256 of a row's fields, each `-` if null, else its UTF-8 byte count, `:` and its
value. The leaves of one language ascend by doc_id; runs of eight nodes become their hash until one
node, the language's subroot, is left. The subroots in order of language make the root in the same way.

Leaves are numbered by a range shuffle, then held in ordered arrays of `BLOCK` leaves, which
`sequence`, `slice` and `transform` collapse by up to three levels; the blocks' roots are the next
round's leaves. Siblings go down the same way, block by block, and `aggregate` folds a leaf with
them. No group holds more than `BLOCK` rows, however many one language has, and only hashes are
shuffled, never texts.

Null ids come first, and rows of one language and id ascend by leaf; equal rows are leaves of their
own, in any order, as they can't be told apart. A null language is a tree of its own, before all
others. Null and empty texts are different leaves. A single leaf is its subroot, and a single
subroot the root; a node without siblings has none in its proof. An empty table has no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.shared import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Levels that a round collapses, and leaves of one array.
LEVELS = 3
BLOCK = FAN**LEVELS
PATH = "array<struct<before: string, after: string>>"


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The hash of some values in order."""

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return _hash(F.concat(*map(told, fields)))


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(text) == F.length(text)  # ASCII, where lower() touches nothing else
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """`rows` with pos, the place within their `tree` from 0, and m, the number of the tree's rows, without a task for a whole tree.

    Rows are sorted in ranges; each range adds what the ranges before it hold of its tree.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    spread = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows may fill several ranges
    ranged = spread.repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie").drop("tie")
    placed = scratch.write(ranged.withColumn("at", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftright("at", 33)
    parts = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    parts = parts.select(F.col("tree").alias("of"), "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("m"))
    joined = placed.join(parts, placed["tree"].eqNullSafe(parts["of"]) & (part == parts["part"]))
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "m")


def _count_above(m: Column, levels: int) -> Column:
    """Nodes of a tree of m leaves, so many levels up."""
    return F.ceil(m / F.lit(float(FAN**levels))).cast("long")


def _level_above(level: Column) -> Column:
    """The hash of every run of FAN nodes of an array."""
    starts = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda i: _hash(F.array_join(F.slice(level, i * FAN + 1, F.lit(FAN)), "")))


def _blocks(nodes: DataFrame) -> DataFrame:
    """tree, block, m, rows (pos, node and what comes with it, in order) and the node arrays of each level: l0 to l2; root."""
    held = [c for c in nodes.columns if c not in ("tree", "m")]
    found = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("m").alias("m"), F.sort_array(F.collect_list(F.struct("pos", *(c for c in held if c != "pos")))).alias("rows"))
    found = found.withColumn("l0", F.transform("rows", lambda r: r["node"]))
    for k in range(LEVELS):
        below = F.col(f"l{k}")
        found = found.withColumn(f"l{k + 1}", F.when(_count_above(F.col("m"), k) > 1, _level_above(below)).otherwise(below))
    return found.withColumn("root", F.element_at(f"l{LEVELS}", 1)).drop(f"l{LEVELS}")


def _collapse(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round from the leaves up, and the root of each tree."""
    rounds: list[DataFrame] = []
    while True:
        rounds.append(scratch.write(_blocks(nodes), f"{name}-{len(rounds)}"))
        nodes = rounds[-1].select("tree", F.col("block").alias("pos"), _count_above(F.col("m"), LEVELS).alias("m"), F.col("root").alias("node"))
        if (nodes.agg(F.max("m")).first()[0] or 1) == 1:
            return rounds, nodes.select("tree", F.col("node").alias("root"))


def _siblings(level: Column, index: Column) -> Column:
    """The other nodes of the run that node `index` of a level is in, joined: those before it and those after it."""
    place = index % FAN
    before = F.slice(level, (index - place + 1).cast("int"), place.cast("int"))
    after = F.slice(level, (index + 2).cast("int"), (F.lit(FAN - 1) - place).cast("int"))
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf with the siblings on its way up, lowest level first, and the columns of `above` (tree, path, others)."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        above = above.select(F.col("tree").alias("of"), F.col("pos").alias("own"), "path", *carried)
        blocks = blocks.drop("root")
        met = blocks.join(above, blocks["tree"].eqNullSafe(above["of"]) & (blocks["block"] == above["own"]))

        def way(index: Column) -> Column:
            own = [F.when(_count_above(F.col("m"), k) > 1, F.array(_siblings(F.col(f"l{k}"), F.floor(index / FAN**k)))).otherwise(F.array().cast(PATH)) for k in range(LEVELS)]
            return F.concat(*own, F.col("path"))

        paired = F.transform("rows", lambda r, i: F.struct(r.alias("row"), way(i).alias("path")))
        above = met.select("tree", *carried, F.explode(paired).alias("x")).select("tree", *carried, "x.row.*", "x.path")
    return above


def manifest(rows: DataFrame) -> DataFrame:
    """Of rows with `tree`, `doc_id`, `node` (a leaf) and any others: all of them, pos, subroot, root and path, the siblings on the way to the root."""
    scratch = Scratch(rows.sparkSession)
    leaves = _numbered(scratch.write(rows, "leaves"), ["doc_id", "node"], scratch, "leaves")
    rounds, subroots = _collapse(leaves, scratch, "leaves")
    tops = subroots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("own_tree"), F.col("root").alias("node"))
    top_rounds, root = _collapse(_numbered(tops, ["own_tree"], scratch, "tops"), scratch, "tops")
    start = root.select("tree", "root", F.array().cast(PATH).alias("path"))
    found = _descend(top_rounds, start).select(F.col("own_tree").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    return _descend(rounds, found)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda now, p: _hash(F.concat(p["before"], now, p["after"])))


def proof(path: Column) -> Column:
    """The hash of all siblings, level by level."""
    return _hash(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def verify(docs: DataFrame, claimed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of every row; folded_root and verified tell whether `claimed`, in place of the text, still leads to the root."""
    fields = [docs[c] for c in FIELDS]
    told = docs.select(docs["lang"].cast("string").alias("tree"), "doc_id", leaf(*fields).alias("node"), F.when(~claimed.eqNullSafe(docs["text"]), leaf(*fields[:-1], claimed)).alias("other"))
    out = manifest(told).withColumn("folded_root", folded(F.coalesce("other", "node"), F.col("path")))
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text, with A-Z in lower case where 3 divides the crc32 of the id in decimals."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, lowered(text)).otherwise(text)


ORACLE = r"""
with recursive bytes as (select distinct doc_id, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint) as b from documents where doc_id is not null),
steps as (select doc_id, b, 1 as i, xor(4294967295::bigint, b[1]) as c, 0 as bit from bytes
  union all select doc_id, b, case when bit = 7 then i + 1 else i end,
    case when bit = 7 and i < len(b) then xor(xor(c >> 1, 3988292384 * (c & 1)), b[i + 1]) else xor(c >> 1, 3988292384 * (c & 1)) end, (bit + 1) % 8 from steps where i <= len(b)),
crc as (select doc_id, xor(c, 4294967295::bigint) as crc from steps where i > len(b)),
d as (select row_number() over () as id, doc_id, lang, source, n_chars, text, coalesce(crc % 3 = 0, false) as changes from documents left join crc using (doc_id)),
f as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from d),
l as (select id, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
  case when changes and text is not null then sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as other from f),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, id) - 1 as pos from l),
levels as (select lang, 0 as level, list(leaf order by pos) as nodes from p group by lang
  union all select lang, level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], ''))) from levels where len(nodes) > 1),
tops as (select lang, level as top, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as place from levels where len(nodes) = 1),
highs as (select 0 as level, list(subroot order by place) as nodes from tops having count(*) > 0
  union all select level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], ''))) from highs where len(nodes) > 1),
climb as (select p.id, p.doc_id, p.leaf, t.subroot, t.place, p.lang, t.top, 0 as level, case when t.top = 0 then t.place else p.pos end as at, p.other as now, '' as path from p join tops t on p.lang is not distinct from t.lang
  union all select c.id, c.doc_id, c.leaf, c.subroot, c.place, c.lang, c.top, c.level + 1, case when c.level + 1 = c.top then c.place else c.at // 8 end,
    sha256(array_to_string(l.nodes[c.at // 8 * 8 + 1:c.at], '') || c.now || array_to_string(l.nodes[c.at + 2:c.at // 8 * 8 + 8], '')),
    c.path || array_to_string(l.nodes[c.at // 8 * 8 + 1:c.at], '') || array_to_string(l.nodes[c.at + 2:c.at // 8 * 8 + 8], '')
  from climb c join (select lang, level, nodes, false as high from levels where len(nodes) > 1 union all select null, level, nodes, true from highs where len(nodes) > 1) l
    on case when c.level < c.top then not l.high and l.lang is not distinct from c.lang and l.level = c.level else l.high and l.level = c.level - c.top end
  ),
done as (select id, max(level) as level from climb group by id)
select c.doc_id, c.leaf, c.subroot, r.root, sha256(c.path) as proof_sha256, c.now as folded_root, c.now = r.root as verified
from climb c join done on c.id = done.id and c.level = done.level, (select nodes[1] as root from highs where len(nodes) = 1) r
"""
