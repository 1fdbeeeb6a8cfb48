"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import decontam, mil_quality, near_sets, pfair_mix, sstable
from gridtide.llm.queries import tokenizer_path
from gridtide.llm.shared import free_name, stored, table

QUALITY_CUTOFF = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at QUALITY_CUTOFF or more (NULL text scores as empty)."""
    net = mil_quality.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_quality")
    return mil_quality.with_score(docs, net, score).filter(F.col(score) >= QUALITY_CUTOFF).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one of the smallest doc_id; rows without an id are rows like any other."""
    return near_sets.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """The documents at the target weights, in the order of their slots: an over-represented source's surplus goes.

    ``weights`` (source, weight) are the targets; without them the sources' sizes to the power 0.9
    (pfair_mix.tempered_weights). The surplus is measured in characters, so a source at or under its share keeps all
    its documents. Rows that share a doc_id share its block.
    """
    slot = free_name(docs, "_slot")
    plan = pfair_mix.mix(docs, weights).filter("in_share").groupBy("doc_id").agg(F.min("slot").alias(slot))
    mixed = docs.join(plan, docs["doc_id"].eqNullSafe(plan["doc_id"])).select(*[docs[c] for c in docs.columns], slot)
    ordered = mixed.repartitionByRange(slot, "doc_id").sortWithinPartitions(slot, pfair_mix.order_key(F.col("doc_id")))
    return ordered.drop(slot)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sorted-string-table shards of the documents' tokens: doc_id, start, n_tokens, ids_crc32."""
    return sstable.token_output(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", benchmark_decontamination), ("mix", source_mix), ("token_shards", token_shards)]

#: Trained models and a tokenizer stand behind the rows, so SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
