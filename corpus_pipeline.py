"""A corpus pipeline: each stage takes all rows that the one before kept, written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import byte_bpe, jaccard_join, mixing, quality_model, substring_dedup
from parcelflow.llm.queries import vocabulary
from parcelflow.llm.shared import checkpointed, divided, unused
from parcelflow.sources.shared import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows of one Arrow batch in the stages. Spark's 10,000 texts are tens of MB, several times over in the JVM and in Python.
BATCH_ROWS = 1_000


def in_small_batches(stage: Stage) -> Stage:
    """`stage` with Arrow batches of BATCH_ROWS in its session, from then on, as its rows are computed later."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; it learns from `labels`.

    Null and empty texts have a score like any other; equal texts stay or go together, repeated rows too.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.keep_good(docs, quality_model.train(docs, labels))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of five-word shingles at a similarity of 0.8.

    Documents without words, null texts among them, are in no group and stay. Of rows with one id and
    equal texts the one with the least other columns stays; rows without id stay. Only documents that may
    go are shuffled.
    """
    groups = jaccard_join.join(docs, words=5, part=80)
    removed = checkpointed(groups.where("component_id <> doc_id").select("doc_id").distinct())
    repeated = checkpointed(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    near, rest = divided(docs, removed.unionByName(repeated))
    held = near.join(removed, "doc_id", "left_anti").select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    single = held.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("others"))
    single = single.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns))
    return rest.unionByName(held.where("doc_id is null")).unionByName(single)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier one has; those left without a word go.

    Null and empty texts and rows without id stay as they are; rows of one id never cut each other.
    """
    return substring_dedup.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never.

    Rows equal in id, text and source are taken alike. A null source is a source; texts without words have
    size 0.
    """
    key, of, count, copy = (unused(name, docs) for name in ("mix_key", "mix_id", "mix_copies", "mix_copy"))
    value = F.xxhash64("text", "source")
    taken = mixing.mix(docs.withColumn(key, value), carry=(key,))
    picks = taken.groupBy(F.col("doc_id").alias(of), key).agg(F.max("copies").alias(count)).where(F.col(count) > 0)
    held = docs.join(picks, docs["doc_id"].eqNullSafe(picks[of]) & (value == picks[key]))
    return held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count).cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of every row; null and empty texts have none."""
    coded = byte_bpe.encode(docs.select("doc_id", "source", "text"), vocabulary(), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", in_small_batches(keep_good)),
    ("jaccard_join", in_small_batches(keep_one_of_each_group)),
    ("substring_dedup", in_small_batches(cut_passages)),
    ("mixing", in_small_batches(mix_sources)),
    ("byte_bpe", in_small_batches(encode)),
]

#: The second and the third stage can be said in SQL, the others cannot; tests hold all against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before return is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
