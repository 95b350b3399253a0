"""Running values and neighbours inside groups of any size.

A window function puts a whole group into one task. Here rows are dealt by ranges of (keys, order) instead, so a group of
any size is spread over many tasks; windows run inside each range part, and what a group hands on from part to part is one
row a part. Null keys form a group of their own, as in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlex.functions.shared import settle

#: value name -> (aggregate, argument): the running aggregate, one of F.sum, F.count, F.max, F.min and F.bit_xor.
Values = dict[str, tuple[Callable[[Column], Column], Column]]


def _parted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return settle(df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id()))


def _same(x: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in x.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _ends(parted: DataFrame, keys: list[str]) -> DataFrame:
    """part_, first_, last_: the least and greatest key of each part; one row a part."""
    key = F.struct(*keys)
    return parted.groupBy("part_").agg(F.min(key).alias("first_"), F.max(key).alias("last_"))


def running(df: DataFrame, keys: list[str], order: list[str], values: Values, inclusive: bool = True) -> DataFrame:
    """df with a running aggregate for each of `values`, in ascending `order` (nulls first) inside equal `keys`.

    inclusive: the row itself counts; else only rows before it (null for the first). Rows equal in keys and order come in
    any order. An empty table gives an empty result."""
    arg = {v: f"arg_{i}_" for i, v in enumerate(values)}
    parted = _parted(df.withColumns({arg[v]: c for v, (_, c) in values.items()}), keys, order)
    ends = settle(_ends(parted, keys))
    # What a part hands on: the aggregates over the rows of its last group.
    tails = parted.join(F.broadcast(ends.select("part_", "last_")), "part_").filter(F.struct(*keys).eqNullSafe(F.col("last_")))
    tails = tails.groupBy("part_").agg(*(f(F.col(arg[v])).alias(f"own_{v}") for v, (f, _) in values.items()))
    rows = ends.join(tails, "part_").select("part_", F.col("last_").alias("group_"), (F.col("first_") == F.col("last_")).alias("head_"), *(F.col(f"own_{v}") for v in values))
    none = [F.lit(None).cast(dict(tails.dtypes)[f"own_{v}"]).alias(f"own_{v}") for v in values]
    heads = ends.filter("not first_ <=> last_").select("part_", F.col("first_").alias("group_"), F.lit(True).alias("head_"), *none)
    before = Window.partitionBy("group_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.withColumn("head_", F.coalesce("head_", F.lit(True))).union(heads)
    carried = carried.select("part_", "group_", "head_", *(_total(f)(F.col(f"own_{v}")).over(before).alias(f"had_{v}") for v, (f, _) in values.items())).filter("head_").drop("head_")
    own = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = parted.withColumns({f"run_{v}": f(F.col(arg[v])).over(own) for v, (f, _) in values.items()}).withColumn("key_", F.struct(*keys))
    # One row a part at most.
    out = out.join(F.broadcast(carried.withColumnRenamed("part_", "of_")), _same({"part_": "of_", "key_": "group_"}), "left")
    merged = {}
    for v, (f, _) in values.items():
        merged[v] = F.aggregate(F.filter(F.array(f"had_{v}", f"run_{v}"), lambda x: x.isNotNull()), F.lit(None).cast(dict(out.dtypes)[f"run_{v}"]), _merge(f))
    return out.withColumns(merged).select(*[c for c in df.columns if c not in values], *values)


def _total(f: Callable) -> Callable[[Column], Column]:
    """The aggregate of a part's aggregates: counts are added up, the others merge with themselves."""
    return F.sum if f is F.count else f


def _merge(f: Callable) -> Callable[[Column, Column], Column]:
    pair = {F.sum: lambda x, y: x + y, F.count: lambda x, y: x + y, F.max: F.greatest, F.min: F.least, F.bit_xor: lambda x, y: x.bitwiseXOR(y)}[f]
    return lambda x, y: F.when(x.isNull(), y).otherwise(pair(x, y))


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], ahead: bool = False) -> DataFrame:
    """df with, for each (name, column) of `columns`, that column's value in the row before (ahead: after) inside equal
    `keys` in ascending `order` (nulls first), as lag and lead give it; null at the ends. `order` should be total."""
    parted = _parted(df, keys, order)
    value, place = F.struct(*columns.values()), F.struct(*keys, *order)
    # The row a part hands on: its last one (ahead: its first), with its key; parts without rows hand nothing on.
    held = parted.groupBy("part_").agg((F.min_by if ahead else F.max_by)(F.struct(F.struct(*keys).alias("key"), value.alias("value")), place).alias("edge_"))
    next_ = Window.orderBy("part_")
    handed = held.select("part_", (F.lead if ahead else F.lag)("edge_").over(next_).alias("edge_")).filter("edge_ is not null")
    own = Window.partitionBy("part_", *keys).orderBy(*order)
    out = parted.withColumns({"next_": (F.lead if ahead else F.lag)(value).over(own), "key_": F.struct(*keys)})
    out = out.join(F.broadcast(handed), "part_", "left")
    edge = F.when(F.col("edge_")["key"].eqNullSafe(F.col("key_")), F.col("edge_")["value"])
    found = F.coalesce("next_", edge)
    return out.withColumns({n: found[c] for n, c in columns.items()}).select(*[c for c in df.columns if c not in columns], *columns)
