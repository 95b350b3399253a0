"""A corpus pipeline of five stages, each over all that the one before has kept.

    quality rules -> SimHash near-duplicates -> suffix-array dedup -> benchmark decontamination -> packing

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlex.llm import decontaminate, packing, quality, simhash, suffix_dedup
from netlex.llm._common import fresh, scratch_of, table, written
from netlex.llm.queries import tokenizer

#: Bytes of a repeated string that the pipeline cuts out: about 45 words, and the gram that anchors it.
REPEAT, GRAM = 240, 48
#: Bytes of a shard of the suffix arrays: half the usual, as the stage follows others in the same Python workers and JVMs.
SHARD = 750_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def _row_keys(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a further column of row keys, its name, and whether some are no doc_ids: rows with a null id, or one that
    other rows have too, get a key from id and text, above all ids; equal rows have equal keys."""
    name, again, odd = (fresh(docs, c) for c in ("row_key", "repeated_id", "repeated"))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias(again), F.lit(True).alias(odd))
    if repeated.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, False
    key = F.lit(2**62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**61))
    marked = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col(again)), "left")
    return marked.withColumn(name, F.when(F.col(odd), key).otherwise(F.col("doc_id").cast("long"))).drop(again, odd), name, True


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one with the least doc_id stays (rows
    without an id of their own after those with one); of equal rows, one."""
    keyed, key, odd = _row_keys(docs)
    if odd:
        keyed = written(keyed.dropDuplicates([key]), "row_keys")
    copies = simhash.similar_documents(keyed, similarity=0.8, size=5, id_col=key).filter("doc_id <> component_id").select(F.col("doc_id").alias(key))
    return keyed.join(copies, key, "left_anti").select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that stand elsewhere too are cut out of the texts; n_chars follows."""
    return suffix_dedup.rewrite(docs, REPEAT, GRAM, size_col="n_chars", most=SHARD)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away a benchmark item go."""
    keyed, key, _ = _row_keys(docs)
    leaks = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in length buckets and batches."""
    return packing.pack_documents(docs, tokenizer())


def _tidy(stage):
    """The stage, which first deletes the scratch tables of the stage before: that one's output has been written by now."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch_of(spark, "pipeline"):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("SimHash near-dedup", _tidy(near_duplicates)),
    ("suffix-array dedup", _tidy(repeated_strings)),
    ("benchmark decontamination", _tidy(decontaminated)),
    ("packing", _tidy(packed)),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
