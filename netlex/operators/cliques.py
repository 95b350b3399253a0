"""Cliques, families of cliques and clique percolation."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netlex.functions.shared import settle
from netlex.operators.components import star_labels
from netlex.operators.graph import symmetrize, triangles
from netlex.operators.ranks import row_ordinals


def _expand(at, xs: list, ys: list, laters: list[bool], least: int) -> list[list]:
    """Maximal cliques through `at` whose other members come later in the order; earlier neighbours only exclude."""
    near: dict = {}
    later, earlier = set(), set()
    for a, b, late in zip(xs, ys, laters, strict=True):
        (later if late else earlier).add(a)
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return grown(at, later, earlier, near, least)


def grown(at, later: set, earlier: set, near: dict, least: int) -> list[list]:
    """The same from the neighbours themselves and what each is linked to; others may be among the latter."""
    out = []
    stack = [([at], later, earlier)]
    while stack:
        held, todo, out_of = stack.pop()
        if not todo and not out_of:
            if len(held) >= least:
                out.append(sorted(held))
            continue
        if len(held) + len(todo) < least:
            continue
        pivot = max(todo | out_of, key=lambda v: (len(todo & near.get(v, set())), v))
        for v in sorted(todo - near.get(pivot, set())):
            n = near.get(v, set())
            stack.append(([*held, v], todo & n, out_of & n))
            todo = todo - {v}
            out_of = out_of | {v}
    return out


def maximal_cliques(pairs: DataFrame, min_size: int = 3) -> DataFrame:
    """clique (sorted array), size: all maximal cliques of min_size or more.

    Every node gets the links among its neighbours from the triangles; it expands with later neighbours by (degree,
    node) and excludes with earlier ones, so each clique comes once, at its first node. min_size below 2 is not offered."""
    s = symmetrize(pairs.select("a", "b"))
    deg = s.groupBy("src").agg(F.count("*").alias("deg"))
    place = deg.select(F.col("src").alias("node"), "deg")
    rows = s.join(deg, "src").join(place.select(F.col("node").alias("dst"), F.col("deg").alias("d2")), "dst")
    later = (F.col("d2") > F.col("deg")) | ((F.col("d2") == F.col("deg")) & (F.col("dst") > F.col("src")))
    spokes = rows.filter(F.col("deg") >= min_size - 1).select(F.col("src").alias("at"), F.col("dst").alias("x"), F.col("dst").alias("y"), later.alias("later"))
    t = triangles(pairs)
    corner = lambda a, b, c: t.select(F.col(a).alias("at"), F.col(b).alias("x"), F.col(c).alias("y"))
    rims = corner("x", "y", "z").union(corner("y", "x", "z")).union(corner("z", "x", "y"))
    rims = settle(rims.join(spokes.select("at", "x", "later"), ["at", "x"]).select("at", "x", "y", "later"))
    # A node with no later neighbour starts no clique, and one without two that are linked starts none of three.
    starts = spokes.filter("later").select("at").distinct()
    if min_size > 2:
        last = rims.filter("later").select("at", "y").join(spokes.filter("later").select("at", F.col("x").alias("y")), ["at", "y"], "left_semi")
        starts = last.select("at").distinct()
    frame = spokes.union(rims).join(starts, "at", "left_semi")
    kind = dict(pairs.dtypes)["a"]

    def run(batches):
        for batch in batches:
            rows, found = batch.column("rows"), []
            ends, (xs, ys, laters) = rows.offsets.to_pylist(), (rows.values.field(c).to_pylist() for c in ("x", "y", "later"))
            for k, at in enumerate(batch.column("at").to_pylist()):
                part = slice(ends[k], ends[k + 1])
                found += _expand(at, xs[part], ys[part], laters[part], min_size)
            yield pa.RecordBatch.from_arrays([pa.array(found, batch_type)], ["clique"])

    batch_type = pa.list_(to_arrow_type(frame.schema["at"].dataType))
    near = frame.groupBy("at").agg(F.collect_list(F.struct("x", "y", "later")).alias("rows"))
    return near.mapInArrow(run, f"clique array<{kind}>").withColumn("size", F.size("clique"))


def k_cliques(pairs: DataFrame, k: int) -> DataFrame:
    """clique (array, ascending) of k nodes each, by k - 2 joins with the pair table."""
    u = settle(pairs.select("a", "b"))
    out = u.select(F.array("a", "b").alias("clique"))
    for size in range(2, k):
        last = F.col("clique")[size - 1]
        grown = out.withColumn("a", last).join(u, "a").select("clique", "b")
        for i in range(size - 1):
            grown = grown.withColumn("a", F.col("clique")[i]).join(u, ["a", "b"], "left_semi")
        out = grown.select(F.concat("clique", F.array("b")).alias("clique"))
    return out


def k_clique_communities(pairs: DataFrame, k: int) -> DataFrame:
    """k, comm (from 0, largest first, ties by least node, then by least clique), node: unions of k-cliques that share k - 1 nodes.

    Cliques are linked through their (k - 1)-subsets to one clique each, never to one another."""
    cliques = settle(k_cliques(pairs, k))
    subsets = cliques.select("clique", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.filter("clique", lambda x, j: j != i))).alias("subset"))
    hub = subsets.groupBy("subset").agg(F.min("clique").alias("hub"))
    links = subsets.join(hub, "subset").filter("clique <> hub").select(F.col("clique").alias("a"), F.col("hub").alias("b")).distinct()
    label = cliques.join(star_labels(links).withColumnsRenamed({"node": "clique"}), "clique", "left").select("clique", F.coalesce("comp", "clique").alias("comp"))
    members = settle(label.select("comp", F.explode("clique").alias("node")).distinct())
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    order = row_ordinals(sizes, [F.desc("n"), F.asc("least"), F.asc("comp")], "comm")
    return members.join(order.select("comp", "comm"), "comp").select(F.lit(k).alias("k"), "comm", "node")


def overlap_counts(memberships: DataFrame, nodes: DataFrame, ks: list[int]) -> DataFrame:
    """node and k<k>_n, its number of communities, for every k; zeros stay."""
    counts = memberships.groupBy("node").pivot("k", ks).agg(F.count("comm"))
    rows = nodes.select("node").distinct().join(counts, "node", "left").fillna(0)
    return rows.select("node", *(F.col(str(k)).alias(f"k{k}_n") for k in ks))


def overlap_leaders(counts: DataFrame, column: str, top: int = 10) -> DataFrame:
    """node, the column of overlap_counts, place (from 1): the nodes in most communities, ties by node."""
    best = counts.select("node", column).orderBy(F.desc(column), "node").limit(top)
    return row_ordinals(best, [F.desc(column), F.asc("node")], "place").withColumn("place", F.col("place") + 1)


def overlap_place(counts: DataFrame, column: str, node) -> DataFrame:
    """node, the column, place of one node: one more than the nodes that are in more communities."""
    one = counts.filter(F.col("node") == node).select("node", F.col(column).alias("own"))
    ahead = counts.crossJoin(F.broadcast(one.select("own"))).agg((F.count_if(F.col(column) > F.col("own")) + 1).alias("place"))
    return one.crossJoin(ahead).select("node", F.col("own").alias(column), "place")


def focal_subgraph(memberships: DataFrame, pairs: DataFrame, node) -> DataFrame:
    """a, b: the links among the nodes that share a community with a node, itself included."""
    mine = memberships.filter(F.col("node") == node).select("k", "comm")
    near = settle(memberships.join(mine, ["k", "comm"], "left_semi").select("node").distinct())
    return pairs.select("a", "b").join(near.withColumnRenamed("node", "a"), "a", "left_semi").join(near.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def focal_communities(memberships: DataFrame, node) -> DataFrame:
    """comm, size, members (sorted) of the communities that hold the node."""
    mine = memberships.filter(F.col("node") == node).select("k", "comm")
    return memberships.join(mine, ["k", "comm"], "left_semi").groupBy("k", "comm").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))


def similar_cliques(c: DataFrame, similarity: float) -> DataFrame:
    """c (id, clique) -> x < y: ids of cliques whose Jaccard similarity is at least `similarity`.

    A prefix-filter join: members are ordered from rare to common, and two similar sets share one of their first
    size - ceil(similarity x size) + 1; only these are joined, so that a hub's cliques do not all meet at the hub."""
    flat = c.select("id", F.size("clique").alias("size"), F.explode("clique").alias("node"))
    rare = flat.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    x = F.sort_array(F.collect_list(F.struct("n", "node"))).alias("x")
    # Members of one clique only come first in the order and need no rows.
    ordered = flat.join(rare, "node").groupBy("id").agg(F.first("size").alias("size"), x)
    most = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("x"))
    first = ordered.withColumn("most", most.cast("int")).filter("most > 0").select("id", "size", F.explode(F.transform(F.slice("x", F.lit(1), F.col("most")), lambda v: v["node"])).alias("node"))
    sizes = (F.col("size") >= similarity * F.col("size_y") - 1e-9) & (F.col("size_y") >= similarity * F.col("size") - 1e-9)
    pair = first.join(first.select("node", F.col("id").alias("y"), F.col("size").alias("size_y")), "node").filter((F.col("id") < F.col("y")) & sizes).select(F.col("id").alias("x"), "y").distinct()
    both = pair.join(c.select(F.col("id").alias("x"), F.col("clique").alias("cx")), "x").join(c.select(F.col("id").alias("y"), F.col("clique").alias("cy")), "y")
    n = F.size(F.array_intersect("cx", "cy"))
    return both.filter(n >= similarity * (F.size("cx") + F.size("cy") - n) - 1e-12).select("x", "y")


#: Pairs of one group of linked cliques that are settled in one task.
LINKED = 100_000


def _leaders(similar: DataFrame, most: int) -> DataFrame:
    """similar (x < y) -> id, leads of all ids in it: an id leads if no smaller similar id does.

    Groups of linked ids with up to `most` pairs are settled apart, each in one task and one go, however long a chain they hold;
    larger ones in rounds, from ids whose smaller partners are all settled, until none is left."""
    group = star_labels(similar.select(F.col("x").alias("a"), F.col("y").alias("b")))
    rows = settle(similar.join(group.select(F.col("node").alias("x"), "comp"), "x"))
    large = settle(rows.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("comp"))

    def settle_group(part: pd.DataFrame) -> pd.DataFrame:
        before: dict[int, list[int]] = {}
        for x, y in zip(part["x"], part["y"], strict=True):
            before.setdefault(x, [])
            before.setdefault(y, []).append(x)
        leads: dict[int, bool] = {}
        for i in sorted(before):
            leads[i] = not any(leads[x] for x in before[i])
        return pd.DataFrame({"id": list(leads), "leads": list(leads.values())})

    out = rows.join(large, "comp", "left_anti").groupBy("comp").applyInPandas(settle_group, "id long, leads boolean")
    if large.isEmpty():
        return out
    rest = settle(rows.join(large, "comp", "left_semi").select("x", "y"))
    state = settle(rest.select(F.explode(F.array("x", "y")).alias("id")).distinct().withColumn("leads", F.lit(None).cast("boolean")))
    while not state.filter("leads is null").isEmpty():
        before = rest.join(state.withColumnRenamed("id", "x"), "x").groupBy(F.col("y").alias("id")).agg(F.max(F.coalesce("leads", F.lit(False))).alias("led"), F.count_if(F.col("leads").isNull()).alias("open"))
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = settle(state.join(before, "id", "left").select("id", leads.alias("leads")))
    return out.union(state)


def clique_families(cliques: DataFrame, similarity: float = 0.6, most: int = LINKED) -> DataFrame:
    """lineup (array), size, variants, swaps, members: cliques in order (larger first, then lexicographic) join the first
    family whose line-up is similar (Jaccard), or found one."""
    c = settle(row_ordinals(cliques.select("clique", F.size("clique").alias("size")), [F.desc("size"), F.asc("clique")], "id"))
    similar = settle(similar_cliques(c, similarity))
    leads = settle(_leaders(similar, most))
    first = similar.join(leads.filter("leads").select(F.col("id").alias("x")), "x").groupBy(F.col("y").alias("id")).agg(F.min("x").alias("family"))
    # A clique without similar ones leads, too.
    placed = c.join(leads, "id", "left").join(first, "id", "left").select("id", "clique", F.when(F.coalesce("leads", F.lit(True)), F.col("id")).otherwise(F.col("family")).alias("family"))
    lineups = c.select(F.col("id").alias("family"), F.col("clique").alias("lineup"))
    groups = placed.groupBy("family").agg(F.count("*").alias("variants"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("clique")))).alias("members"))
    return groups.join(lineups, "family").select("lineup", F.size("lineup").alias("size"), "variants", F.array_except("members", "lineup").alias("swaps"), "members")


def clique_mix(cliques: DataFrame, labels: DataFrame) -> DataFrame:
    """clique, size, labelled, labels (distinct known), top_label (commonest, ties to the least)."""
    rows = cliques.select("clique", F.explode("clique").alias("node")).join(labels.filter("label is not null and label <> ''"), "node", "left")
    counts = rows.groupBy("clique", "label").agg(F.count("*").alias("n"))
    known = F.col("label").isNotNull()
    return counts.groupBy("clique").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("labelled"),
        F.count_if(known).alias("labels"),
        F.min(F.when(known, F.struct(-F.col("n"), "label")))["label"].alias("top_label"),
    ).withColumn("size", F.size("clique"))
