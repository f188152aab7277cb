"""Steps that several operators share: checkpoints and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.sources.shared import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, which at its end gives free memory back to the system; a worker that serves many tasks keeps it otherwise."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others need none
        if trim is not None:
            trim(0)

    return tidy


class Scratch:
    """Compressed tables in the shared folder, for what is too large to check-point row by row; each is dropped once it is used up."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        jvm, context = self.spark._jvm, self.spark.sparkContext
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, with as many underscores after it as no column of the frames has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Buckets of ids in `divided`, one bit each, 64 to a row: the bound of what it broadcasts is 2^16 rows of two numbers.
ID_BUCKETS = 1 << 22


def divided(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """`rows` in two parts without a shuffle: those whose id may be among `ids`, and those whose id is not.

    A bit for each bucket of ids goes to all tasks: at most ID_BUCKETS bits, however many
    ids there are. With very many ids the first part is all rows, and nothing is lost but the saving.
    """
    bucket = F.pmod(F.xxhash64(id_col), F.lit(ID_BUCKETS))
    word, bit = F.shiftright(bucket, 6), F.pmod(bucket, F.lit(64)).cast("int")
    of_row, of_ids, bits = (unused(name, rows) for name in ("word_of_row", "word_of_ids", "bits_of_ids"))
    used = ids.groupBy(word.alias(of_ids)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits))
    joined = rows.withColumn(of_row, word).join(F.broadcast(used), F.col(of_row) == F.col(of_ids), "left")
    inside = F.coalesce(F.getbit(bits, bit) == 1, F.lit(False))
    return joined.where(inside).select(*rows.columns), joined.where(~inside).select(*rows.columns)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component for every node of `edges` (a, b): the smallest id it reaches.

    Alternates large-star and small-star steps until the edges no longer change. Each step
    groups by node with partial aggregation, and hands the minimum back by a join whose hot
    keys can be split. Self edges and repeated edges may be among the input; null ends are not.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    seen = _checksum(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        was, seen = seen, _checksum(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    return checkpointed(nodes.join(found, nodes["id"] == found["u"], "left").select("id", F.coalesce("component", "id").alias("component")))


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])
