"""Ordinals and ranks over tables of any size, and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.functions.stats import pearson


def row_ordinals(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with the 0-based place of each row in the order (which must be total).

    The rows are range-partitioned and numbered in each part; one row for each part then carries the offsets."""
    parted = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part_": F.spark_partition_id(), "line_": F.monotonically_increasing_id()}))
    held = parted.groupBy("part_").agg(F.count("*").alias("n_"), F.min("line_").alias("first_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part_", "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    return parted.join(base, "part_").withColumn(name, F.col("line_") - F.col("first_") + F.col("base_")).drop("part_", "line_", "first_", "base_")


def rank_desc(df: DataFrame, measures: list[str], key: str = "node") -> DataFrame:
    """Ordinal ranks 1..n of each measure, largest first, ties by key: columns <measure>_rank."""
    for m in measures:
        df = row_ordinals(df, [F.desc(m), F.asc(key)], f"{m}_rank").withColumn(f"{m}_rank", F.col(f"{m}_rank") + 1)
    return df


def top_overlap(df: DataFrame, measures: list[str], k: int, key: str = "node") -> DataFrame:
    """Keys in the top k of every measure."""
    tops = [df.orderBy(F.desc(m), key).limit(k).select(key) for m in measures]
    out = tops[0]
    for t in tops[1:]:
        out = out.intersect(t)
    return out


def rank_shift(ranks: DataFrame, one: str, two: str, cut: int, k: int, key: str = "node") -> DataFrame:
    """Among ranks up to cut in `one`: the k largest changes to `two`."""
    rows = ranks.filter(F.col(one) <= cut).select(key, one, two, (F.col(one) - F.col(two)).alias("shift"))
    return rows.orderBy(F.desc(F.abs("shift")), key).limit(k)


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks: computed on distinct values in range partitions, so equal rows never meet in one window and no
    window holds all values. A null value has no rank and its rows go."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n_"))
    parted = settle(counts.repartitionByRange(value).withColumn("part_", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    held = parted.groupBy("part_").agg(F.sum("n_").alias("held_"))
    base = held.select("part_", F.coalesce(F.sum("held_").over(before(Window.orderBy("part_"))), F.lit(0)).alias("base_"))
    lower = F.coalesce(F.sum("n_").over(before(Window.partitionBy("part_").orderBy(value))), F.lit(0)) + F.col("base_")
    return df.join(parted.join(base, "part_").select(value, (lower + (F.col("n_") + 1) / 2).alias(name)), value)


#: How equal values are ranked: by their mean rank; in the order of the key, as a stable sort gives them; by the best of their ranks.
TIES = ("average", "ordinal", "least")


def spearman(df: DataFrame, x: str, y: str, ties: str = "average", key: str | None = None) -> DataFrame:
    """spearman: Pearson's correlation of the ranks of x and y under one of TIES; `ordinal` needs a key that tells rows apart."""
    if ties not in TIES or (ties == "ordinal" and key is None):
        raise ValueError(f"ties is one of {TIES}, and ordinal needs a key")
    rows = df.select(x, y, *([key] if key else [])).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for value, name in ((x, "rx_"), (y, "ry_")):
        if ties == "average":
            rows = average_ranks(rows, value, name)
        elif ties == "ordinal":
            rows = row_ordinals(rows, [F.asc(value), F.asc(key)], name)
        else:
            ranked = average_ranks(rows, value, name)
            best = ranked.groupBy(value).agg((F.first(name) - (F.count("*") - 1) / 2).alias("best_"))
            rows = rows.join(best, value).withColumnRenamed("best_", name)
    return rows.agg(pearson("rx_", "ry_").alias("spearman"))
