"""Packing: length buckets of least padding, and batches of a token budget inside each.

Lengths are token counts. A document longer than `max_tokens` is cut into pieces of that size. The histogram of piece
lengths, in steps of `step` tokens, covers all documents and has max_tokens / step cells at most; dynamic programming over
it chooses the bucket sizes that pad least. In each bucket, pieces get places by (doc_id, piece), and every
floor(budget / bucket size) of them form a batch. Places come from counts by range of doc_id, not from one sorted task.

Nulls: a null or empty text has length 0 and takes the smallest bucket; a null doc_id comes first. Repeated rows are
packed as often as they stand. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlex.llm._common import written
from netlex.llm.token_output import token_counts


def bucket_sizes(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Sizes, ascending, of at most `buckets` buckets with the least sum of count x (size - length).

    lengths: distinct, ascending. Ties take the smaller last boundary."""
    n = len(lengths)
    if not n:
        return []
    size, count = lengths.astype(np.float64), np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    mass = np.concatenate(([0.0], np.cumsum(size * counts)))
    # cost[i, j]: cells i to j - 1 in a bucket of size lengths[j - 1].
    cost = size[None, :] * (count[None, 1:] - count[:-1, None]) - (mass[None, 1:] - mass[:-1, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best, back = cost[0].copy(), []
    for _ in range(1, min(buckets, n)):
        total = best[:-1, None] + cost[1:, 1:]
        at = total.argmin(axis=0)
        better = np.concatenate(([np.inf], total[at, np.arange(n - 1)]))
        back.append(np.where(better < best, np.concatenate(([0], at)), -1))
        best = np.minimum(best, better)
    ends, j = [n - 1], n - 1
    for chosen in reversed(back):
        if chosen[j] >= 0:
            j = int(chosen[j])
            ends.append(j)
    return [int(lengths[e]) for e in reversed(ends)]


def pack(sizes: DataFrame, buckets: int = 16, step: int = 8, max_tokens: int = 8192, budget: int = 65_536) -> DataFrame:
    """sizes (doc_id, n_tokens) -> doc_id, piece, n_tokens, bucket_tokens, batch (from 0 in its bucket), place (in its batch)."""
    if not (max_tokens % step == 0 and max_tokens <= budget):
        raise ValueError("max_tokens must be a multiple of step and at most budget")
    last = F.greatest(F.floor((F.col("n_tokens") - 1) / max_tokens), F.lit(0)).cast("int")
    pieces = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    length = F.least(F.col("n_tokens") - F.col("piece") * F.lit(max_tokens).cast("long"), F.lit(max_tokens).cast("long"))
    cell = F.greatest(F.ceil(F.col("n_tokens") / step) * step, F.lit(step)).cast("long")
    pieces = pieces.select("doc_id", "piece", length.alias("n_tokens")).withColumn("cell", cell)
    dealt = written(pieces.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "piece", "n_tokens").withColumn("part", F.spark_partition_id()), "pieces")
    histogram = dealt.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").toPandas()
    chosen = bucket_sizes(histogram["cell"].to_numpy(), histogram["n"].to_numpy(), buckets)
    bucket = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in chosen]) if chosen else F.array(F.lit(step).cast("long")), lambda b: b >= F.col("cell")))
    rows = dealt.withColumn("bucket_tokens", bucket)
    # Places within a range part and bucket, and what earlier parts hold: one row for each part and bucket.
    held = rows.groupBy("bucket_tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("bucket_tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part", "bucket_tokens").orderBy("doc_id", "piece", "n_tokens")
    placed = rows.withColumn("rank", F.row_number().over(own) - 1).join(base, ["bucket_tokens", "part"])
    rank, fill = F.col("rank") + F.col("base"), F.floor(F.lit(budget) / F.col("bucket_tokens"))
    return placed.select("doc_id", "piece", "n_tokens", "bucket_tokens", F.floor(rank / fill).cast("long").alias("batch"), (rank % fill).cast("long").alias("place"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Written first: dealing by range samples its input, and so would count all tokens twice.
    return pack(written(token_counts(texts, tokenizer), "sizes"), **options)
