"""Communities, partitions and mixing."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators import held
from netlex.operators.graph import symmetrize


def relabel_by_size(partition: DataFrame) -> DataFrame:
    """node, comm: 0..k-1, largest first, ties by least member."""
    from netlex.operators.ranks import row_ordinals

    sizes = partition.groupBy("comm").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    order = row_ordinals(sizes, [F.desc("n"), F.asc("least")], "new")
    return partition.join(order.select("comm", "new"), "comm").select("node", F.col("new").alias("comm"))


def modularity(sym: DataFrame, partition: DataFrame) -> DataFrame:
    """modularity of labels over both orientations (src, dst, weight)."""
    of = lambda end: partition.select(F.col("node").alias(end), F.col("comm").alias(f"c_{end}"))
    rows = sym.join(of("src"), "src").join(of("dst"), "dst")
    total = sym.agg(F.sum("weight").alias("w"))
    inside = rows.filter("c_src = c_dst").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("inside"))
    parts = rows.groupBy("c_src").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    return total.crossJoin(inside).crossJoin(parts).select((F.col("inside") / F.col("w") - F.col("kk") / (F.col("w").cast("double") * F.col("w"))).alias("modularity"))


#: Full sweeps in a row without growth of modularity by GROWTH after which a level ends.
PATIENCE, GROWTH = 3, 1e-7


def _quality(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, comm: np.ndarray) -> float:
    whole, of = weight.sum(), comm[src]
    tot = np.bincount(of, weight)
    return float(weight[of == comm[dst]].sum() / whole - (tot * tot).sum() / whole**2)


def _moves(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, seed: int, sweeps: int | None) -> np.ndarray:
    """Communities of the nodes 0..n-1 after local moves: until nobody moves, or modularity no longer grows."""
    whole, k = weight.sum(), np.bincount(src, weight, n)
    apart = src != dst
    s, d, w = src[apart], dst[apart], weight[apart]
    comm = np.arange(n)
    kept, top, still, idle = comm, _quality(src, dst, weight, comm), 0, 0
    for sweep in itertools.count() if sweeps is None else range(sweeps):
        turn = (held.mixed((np.arange(n) + (seed * 1_000_003 + sweep // 2) * n).astype(np.uint64)) & np.uint64(1)) == sweep % 2
        tot, mine = np.bincount(comm, k, n), turn[s]
        order = np.argsort(s[mine].astype(np.int64) * n + comm[d[mine]])
        node, to, into = s[mine][order], comm[d[mine]][order], w[mine][order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (to[1:] != to[:-1]))) if len(node) else np.empty(0, np.int64)
        node, to, into = node[first], to[first], np.add.reduceat(into, first) if len(first) else into
        own = to == comm[node]
        gain = np.round(into - (tot[to] - np.where(own, k[node], 0.0)) * k[node] / whole, 9)
        # The own community is an option even without a link to it.
        stay = np.round(-(tot[comm] - k) * k / whole, 9)
        stay[node[own]] = gain[own]
        if len(node):
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(starts, len(node)))
            # Labels ascend, so the first of the best is the least.
            best = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, starts), size))
            best = best[np.append(True, node[best][1:] != node[best][:-1])]
            best = best[gain[best] > stay[node[best]]]
        else:
            best = np.empty(0, np.int64)
        comm = comm.copy()
        comm[node[best]] = to[best]
        still = 0 if len(best) else still + 1
        if still == 2:
            break
        if sweep % 2 and sweeps is None:
            now = _quality(src, dst, weight, comm)
            idle = 0 if now > top + GROWTH else idle + 1
            if now > top:
                kept, top = comm, now
            if idle == PATIENCE:
                break
    return comm if sweeps is not None or _quality(src, dst, weight, comm) >= top else kept


def louvain_of(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, seed: int, sweeps: int | None, levels: int | None) -> np.ndarray:
    """The least member of the community of each node 0..n-1."""
    src, dst, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    base = np.arange(n)
    top = _quality(src, dst, weight, base) if len(src) else 0.0
    for level in itertools.count() if levels is None else range(levels):
        size = int(base.max(initial=-1)) + 1
        if not len(src):
            break
        names, place = np.unique(_moves(src, dst, weight, size, seed + level, sweeps), return_inverse=True)
        key, at = np.unique(place[src].astype(np.int64) * len(names) + place[dst], return_inverse=True)
        src, dst, weight = key // len(names), key % len(names), np.bincount(at, weight)
        now = _quality(src, dst, weight, np.arange(len(names)))
        if now <= top + 1e-9:
            break
        top, base = now, place[base]
    least = np.full(int(base.max(initial=-1)) + 1, n)
    np.minimum.at(least, base, np.arange(n))
    return least[base]


def _louvain_held(pairs: DataFrame, seed: int, sweeps: int | None, levels: int | None) -> DataFrame:
    """louvain of pairs (a, b, weight) in a task that holds them."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        rows = list(batches)
        if not sum(r.num_rows for r in rows):
            return
        a, b, w = (np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in rows]) for c in ("a", "b", "weight"))
        order = np.lexsort((b, a))
        names, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
        comm = louvain_of(at[: len(a)], at[len(a) :], w[order], len(names), seed, sweeps, levels)
        yield from pa.table({"node": pa.array(names), "comm": pa.array(names[comm])}).to_batches(max_chunksize=1 << 16)

    return settle(pairs.repartition(1).mapInArrow(run, f"node {kind}, comm {kind}"))


def louvain(pairs: DataFrame, weighted: bool = True, sweeps: int | None = None, levels: int | None = None, seed: int = 1) -> DataFrame:
    """node, comm (least member's node), by parallel local moves.

    In a half-sweep just the nodes whose hash has the sweep's parity may move, each to the neighbouring community of the
    largest modularity gain (ties: least label). A level ends when nobody moves in a full sweep, or modularity has not grown over
    PATIENCE of them; then communities contract to nodes, until modularity no longer grows. sweeps (half-sweeps of a level) and
    levels may be bounded. A graph that a task may hold is moved there; for others one scalar a sweep comes to the driver."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    links = settle(pairs.select("a", "b", w.alias("weight")).filter("a is not null and b is not null and weight is not null"))
    if links.count() <= held.HELD:
        return _louvain_held(links, seed, sweeps, levels)
    sym = settle(symmetrize(links))
    base = settle(sym.select(F.col("src").alias("node")).distinct().withColumn("comm", F.col("node")))
    graph, whole = sym, sym.agg(F.sum("weight")).first()[0] or 1.0
    score = lambda part: modularity(sym, part).first()[0] or 0.0
    best = score(base)
    for _ in itertools.count() if levels is None else range(levels):
        nodes = settle(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")).withColumn("comm", F.col("node")))
        # The weight k of a link's src goes with it: it holds for the whole level.
        links = settle(graph.filter("src <> dst").join(nodes.select(F.col("node").alias("src"), "k"), "src"))
        kept, top, still, idle = nodes, None, 0, 0
        for sweep in itertools.count() if sweeps is None else range(sweeps):
            turn = lambda node: F.pmod(F.xxhash64(F.lit(seed), F.lit(sweep // 2), node), F.lit(2)) == sweep % 2  # noqa: B023, E731
            # Only nodes whose turn it is weigh options. These meet once, by node, with all that a gain needs.
            label = settle(nodes.join(nodes.groupBy("comm").agg(F.sum("k").alias("tot")), "comm").select("node", "comm", "tot", "k"))
            into = links.filter(turn("src")).join(label.select(F.col("node").alias("dst"), "comm", "tot"), "dst").select(F.col("src").alias("node"), "comm", "tot", "k", F.col("weight").alias("into"), F.lit(0).alias("stay"))
            # The own community is an option even without a link to it.
            own = label.filter(turn("node")).select("node", "comm", "tot", "k", F.lit(0.0).alias("into"), F.lit(1).alias("stay"))
            options = into.union(own).repartition("node").groupBy("node", "comm").agg(F.sum("into").alias("into"), F.first("tot").alias("tot"), F.first("k").alias("k"), F.max("stay").alias("stay"))
            gain = F.col("into") - (F.col("tot") - F.when(F.col("stay") == 1, F.col("k")).otherwise(0.0)) * F.col("k") / whole
            best_of = F.min(F.struct((-F.round(gain, 9)).alias("loss"), (-F.col("stay")).alias("stay"), "comm"))
            chosen = options.groupBy("node").agg(best_of.alias("best")).filter("best.stay = 0").select("node", F.col("best.comm").alias("to"))
            moved = settle(nodes.join(chosen, "node", "left").select("node", "k", F.coalesce("to", "comm").alias("comm"), F.col("to").isNotNull().alias("went")))
            nodes, still = moved.drop("went"), 0 if moved.agg(F.max("went")).first()[0] else still + 1
            if still == 2:
                break
            if sweep % 2 and sweeps is None:
                now = modularity(graph, nodes).first()[0] or 0.0
                idle = 0 if top is None or now > top + GROWTH else idle + 1
                if top is None or now > top:
                    kept, top = nodes, now
                if idle == PATIENCE:
                    nodes = kept
                    break
        named = nodes.select("node", "comm").join(nodes.groupBy("comm").agg(F.min("node").alias("least")), "comm").select(F.col("node").alias("comm"), F.col("least").alias("new"))
        part = settle(base.join(named, "comm").select("node", F.col("new").alias("comm")))
        now = score(part)
        if now <= best + 1e-9:
            break
        best, base = now, part
        of = lambda end: named.select(F.col("comm").alias(end), F.col("new").alias(f"n_{end}"))  # noqa: B023, E731
        graph = settle(graph.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    return base


def attribute_assortativity(pairs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, assortativity (Newman's r over links with both ends labelled; null if degenerate); labels: keys, node, label."""
    k = list(keys)
    of = lambda end, name: labels.select(*k, F.col("node").alias(end), F.col("label").alias(name))
    known = labels.filter("label is not null and label <> ''")
    labels = known
    mixed = symmetrize(pairs.select("a", "b")).join(of("src", "x"), "src").join(of("dst", "y"), [*k, "dst"]).groupBy(*k, "x", "y").agg(F.count("*").alias("n"))
    rows = mixed.groupBy(*k, "x").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    total = rows.groupBy(*k).agg(F.sum("n").cast("double").alias("n"), F.sum("same").alias("same"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    trace, square = F.col("same") / F.col("n"), F.col("sq") / (F.col("n") * F.col("n"))
    return total.select(*k, F.when(F.abs(1 - square) > 1e-12, (trace - square) / (1 - square)).alias("assortativity"))


def flows(partition: DataFrame, p: str, q: str) -> DataFrame:
    """p, q, count over nodes labelled in both."""
    return partition.filter(F.col(p).isNotNull() & F.col(q).isNotNull()).groupBy(F.col(p).alias("p"), F.col(q).alias("q")).agg(F.count("*").alias("count"))


def nmi(partition: DataFrame, p: str, q: str) -> DataFrame:
    """2 I / (H_p + H_q) in natural logarithms; 1 if both entropies are 0."""
    joint = flows(partition, p, q)
    n = joint.agg(F.sum("count").cast("double").alias("n"))
    entropy = lambda x: joint.groupBy(x).agg(F.sum("count").alias("m")).crossJoin(F.broadcast(n)).agg((-F.sum(F.col("m") / F.col("n") * F.ln(F.col("m") / F.col("n")))).alias(f"h_{x}"))
    mp, mq = (joint.groupBy(x).agg(F.sum("count").alias(f"m_{x}")) for x in ("p", "q"))
    info = joint.join(mp, "p").join(mq, "q").crossJoin(F.broadcast(n)).agg(F.sum(F.col("count") / F.col("n") * F.ln(F.col("count") * F.col("n") / (F.col("m_p").cast("double") * F.col("m_q")))).alias("i"))
    rows = info.crossJoin(entropy("p")).crossJoin(entropy("q"))
    return rows.select(F.when(F.col("h_p") + F.col("h_q") < 1e-12, 1.0).otherwise(F.try_divide(2 * F.col("i"), F.col("h_p") + F.col("h_q"))).alias("nmi"))


def best_alignment(partition: DataFrame, p: str, q: str) -> DataFrame:
    """p, q: each p-label's commonest q-label, ties to the least label."""
    return flows(partition, p, q).groupBy("p").agg(F.min_by("q", F.struct(-F.col("count"), "q")).alias("q"))


def movers(partition: DataFrame, p: str, q: str, weights: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """node, p, q, (strength): nodes whose q-label is not their p-label's aligned one; the k strongest, if given."""
    aligned = best_alignment(partition, p, q).withColumnRenamed("q", "aligned")
    rows = partition.filter(F.col(q).isNotNull()).select("node", F.col(p).alias("p"), F.col(q).alias("q")).join(aligned, "p").filter("q <> aligned").select("node", "p", "q")
    if weights is not None:
        rows = rows.join(weights.select("node", "strength"), "node")
        if k is not None:
            rows = rows.orderBy(F.desc("strength"), "node").limit(k)
    return rows


def community_profile(partition: DataFrame, deg: DataFrame, k: int = 5) -> DataFrame:
    """comm, size, top: the k members of highest degree (array)."""
    w = Window.partitionBy("comm").orderBy(F.desc("deg"), "node")
    rows = partition.join(deg.select("node", "deg"), "node")
    tops = rows.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).groupBy("comm").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("top"))
    return rows.groupBy("comm").agg(F.count("*").alias("size")).join(tops, "comm")


def within_share(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    of = lambda end: partition.select(F.col("node").alias(end), F.col("comm").alias(f"c_{end}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    return rows.agg(F.try_divide(F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0)), F.sum("weight")).alias("within_share"))
