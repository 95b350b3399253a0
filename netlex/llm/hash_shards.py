"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and shards; a node weighs as much as the shards below it. A document descends level by level: each
child draws -ln(u) / weight, u being a hash of the document's key and the child's name, and the least draw takes it. So shares
follow the weights, no table of places is kept, and a draw depends on that child's weight alone: if weights change, documents
move only into subtrees that gained and out of those that lost, in proportion, and every node that keeps its weights keeps what it holds among its children.

`layout` gives `base` shards (in regions of racks) and makes every shard beyond a region of its own, so one more shard takes
documents into itself and moves no other, however many there are.

Slots number the documents of a shard without a gap: they are counted by ranges of doc_id, so no shard is ordered in one task.

Nulls: a null text has no bytes; a null doc_id has the empty key. Rows with one doc_id are in one shard, each with a slot of
its own, in the order of crc and size. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlex.llm._common import written

#: (region, rack, shard) -> weight
Tree = dict[tuple[int, int, int], float]
#: Bits of a draw: so many fit a double exactly.
BITS = 52


def layout(shards: int, base: int = 24, regions: int = 3, racks: int = 2) -> Tree:
    """`base` shards of weight 1 in regions of racks of as equal size as may be, and each shard beyond in a region of its own."""
    if shards < base:
        raise ValueError("shards can't be fewer than base")
    cell = lambda s: s * regions * racks // base
    tree = {(cell(s) // racks, cell(s) % racks, s): 1.0 for s in range(base)}
    return tree | {(regions + i, 0, base + i): 1.0 for i in range(shards - base)}


def _least(key: Column, children: dict[int, tuple[str, float]]) -> Column:
    """The child (number -> name, weight) with the least draw; a tie goes to the lesser number."""
    if len(children) == 1:
        return F.lit(next(iter(children)))

    def draw(name: str, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
        return -F.ln((bits + 0.5) / float(1 << BITS)) / F.lit(float(weight))

    return F.array_min(F.array(*[F.struct(draw(*x).alias("draw"), F.lit(c).alias("child")) for c, x in sorted(children.items()) if x[1] > 0]))["child"]


def _choice(value: Column, cases: dict[int, Column]) -> Column:
    out = F.lit(None).cast("int")
    for k, c in cases.items():
        out = F.when(value == k, c).otherwise(out)
    return out


def descend(docs: DataFrame, tree: Tree, name: str, id_col: str = "doc_id") -> DataFrame:
    """docs with the shard of each row's id in the tree as column `name`."""
    key, total = F.coalesce(F.col(id_col).cast("string"), F.lit("")), lambda *at: sum(w for k, w in tree.items() if k[: len(at)] == at)
    regions = sorted({r for r, _, _ in tree})
    racks = {r: sorted({k for q, k, _ in tree if q == r}) for r in regions}
    region = _least(key, {r: (f"region {r}", total(r)) for r in regions})
    out = docs.withColumn(f"{name}_region", region)
    rack = _choice(F.col(f"{name}_region"), {r: _least(key, {k: (f"region {r} rack {k}", total(r, k)) for k in racks[r]}) for r in regions})
    out = out.withColumn(f"{name}_rack", rack)
    shard = _choice(
        F.col(f"{name}_region"),
        {r: _choice(F.col(f"{name}_rack"), {k: _least(key, {s: (f"shard {s}", w) for (q, p, s), w in tree.items() if (q, p) == (r, k)}) for k in racks[r]}) for r in regions},
    )
    return out.withColumn(name, shard.cast("int")).drop(f"{name}_region", f"{name}_rack")


def slots(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with slot: the place of each row among those with its `group`, in ascending order, from 0."""
    # The line number parts rows that are equal in all of the order; the table is written before it is counted.
    lined = rows.withColumn("line", F.monotonically_increasing_id())
    dealt = written(lined.repartitionByRange(*order, "line").withColumn("part", F.spark_partition_id()), "dealt")
    held = dealt.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part", group).orderBy(*order, "line")
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(base, [group, "part"]).withColumn("slot", F.col("own") + F.col("base")).drop("own", "base", "part", "line")


def shard(docs: DataFrame, shards: int = 24, base: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = descend(descend(rows, layout(shards, base), "shard"), layout(shards + 1, base), "grown_shard")
    return slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: Tree, id_col: str = "doc_id") -> DataFrame:
    """The documents as Parquet folders by shard (`shard_number`), without a shuffle; read back."""
    descend(docs, tree, "shard_number", id_col).write.partitionBy("shard_number").parquet(path)
    return docs.sparkSession.read.parquet(path)
