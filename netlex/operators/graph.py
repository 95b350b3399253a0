"""Graph tables and their local statistics.

Edges are (src, dst) rows; an undirected graph is its canonical pairs (a < b[, weight]); nodes are (node) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlex.functions.stats import pearson


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes and no loops; duplicates stay."""
    known = nodes.select("node").distinct()
    kept = edges.filter("src <> dst").join(known.withColumnRenamed("node", "src"), "src", "left_semi")
    return kept.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def undirect(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def undirect_weighted(edges: DataFrame) -> DataFrame:
    """The weight of a pair sums both directions and duplicates."""
    pairs = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.agg(F.sum("weight").alias("weight"))


def symmetrize(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest).union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), *rest))


def induced(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    known = nodes.select("node").distinct()
    for end in ends:
        edges = edges.join(known.withColumnRenamed("node", end), end, "left_semi")
    return edges


def with_attributes(nodes: DataFrame, attributes: DataFrame, defaults: dict) -> DataFrame:
    """Left lookup by node; missing or null values take the defaults."""
    return nodes.join(attributes, "node", "left").fillna(defaults)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, deg, indeg, outdeg: distinct neighbours; isolated nodes have 0. Each direction is one row of one aggregation."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")).union(e.select(F.col("dst"), F.col("src"), F.lit(0)))
    links = ends.groupBy("node", "other").agg(F.sum("out").alias("o"), F.sum(1 - F.col("out")).alias("i"))
    found = links.groupBy("node").agg(F.count("*").alias("deg"), F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))
    return nodes.select("node").distinct().join(found, "node", "left").fillna(0, ["deg", "indeg", "outdeg"])


def strength(pairs: DataFrame) -> DataFrame:
    return symmetrize(pairs).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"), F.count("*").alias("deg"))


def degree_counts(deg: DataFrame) -> DataFrame:
    return deg.groupBy(F.col("deg").alias("k")).agg(F.count("*").alias("count"))


def degree_histogram(deg: DataFrame, width: int) -> DataFrame:
    """bin (lower bound), count; empty bins up to the greatest degree are there."""
    counts = deg.groupBy((F.floor(F.col("deg") / width) * width).alias("bin")).agg(F.count("*").alias("count"))
    bins = counts.agg(F.max("bin").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"), F.lit(width).cast("long"))).alias("bin"))
    return bins.join(counts, "bin", "left").fillna(0, ["count"])


def log_binned(counts: DataFrame, n_bins: int) -> DataFrame:
    """bin, lo, hi, mid, count, density of (k, count) in log-spaced bins over [1, max + 1]; k <= 0 goes; k at the top
    edge falls into the last bin. One pass over the counts; the edges come from one global maximum."""
    top = counts.filter("k > 0").agg(F.log10(F.max("k") + 1).alias("top"))
    at = F.least(F.floor(F.log10("k") / F.col("top") * n_bins + 1e-12), F.lit(n_bins - 1)).cast("int")
    binned = counts.filter("k > 0").crossJoin(F.broadcast(top)).groupBy(at.alias("bin"), "top").agg(F.sum("count").alias("count"))
    edge = lambda i: F.pow(F.lit(10.0), F.col("top") * i / n_bins)
    edges = binned.withColumns({"lo": edge(F.col("bin")), "hi": edge(F.col("bin") + 1)})
    return edges.select("bin", "lo", "hi", F.sqrt(F.col("lo") * F.col("hi")).alias("mid"), "count", (F.col("count") / (F.col("hi") - F.col("lo"))).alias("density"))


def density_histogram(counts: DataFrame, n_bins: int) -> DataFrame:
    """log_binned with densities as shares of all positive values."""
    total = counts.filter("k > 0").agg(F.sum("count").alias("total"))
    return log_binned(counts, n_bins).crossJoin(F.broadcast(total)).select("bin", "mid", "count", (F.col("density") / F.col("total")).alias("density"))


def ccdf(counts: DataFrame) -> DataFrame:
    """k, p = P(K >= k) for k > 0; nodes of degree 0 stay in the total. Runs over distinct degrees."""
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return counts.select("k", (F.sum("count").over(above) / F.sum("count").over(total)).alias("p")).filter("k > 0")


def loglog_slope(counts: DataFrame) -> DataFrame:
    """slope of ln count on ln k over k > 0; null with fewer than three points."""
    slope = F.regr_slope(F.ln("count"), F.ln("k"))
    return counts.filter("k > 0 and count > 0").agg(F.when(F.count("*") >= 3, slope).alias("slope"))


def local_slope(tail: DataFrame, points: int = 5) -> DataFrame:
    """k, slope of ln p on ln k over `points` neighbouring k, full windows only."""
    half = points // 2
    w = Window.orderBy("k").rowsBetween(-half, half)
    rows = tail.filter("p > 0").select("k", F.regr_slope(F.ln("p"), F.ln("k")).over(w).alias("slope"), F.count("*").over(w).alias("n"))
    return rows.filter(F.col("n") == points).select("k", "slope")


def er_counts(spark, mean: float, max_k: int, n: int) -> DataFrame:
    """k, expected count of a Poisson degree with this mean."""
    k = F.col("k")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = spark.range(max_k + 1).select(F.col("id").alias("k"))
    log = F.sum(F.when(k > 0, F.ln(F.lit(float(mean)) / k)).otherwise(0.0)).over(w)
    return steps.select("k", (F.exp(log - float(mean)) * n).alias("expected"))


def er_ccdf(spark, mean: float, max_k: int, floor: float = 1e-12) -> DataFrame:
    """k, p = P(K >= k), down to `floor`."""
    # The tail beyond max_k is what remains of 1.
    below = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    p = er_counts(spark, mean, max_k, 1).select("k", (1 - F.coalesce(F.sum("expected").over(below), F.lit(0.0))).alias("p"))
    return p.filter((F.col("k") > 0) & (F.col("p") > floor))


def ba_counts(spark, m: int, max_k: int, n: int) -> DataFrame:
    k = F.col("k").cast("double")
    first = max(1, m)
    return spark.range(first, max_k + 1).select(F.col("id").alias("k")).select("k", (2.0 * m * (m + 1) / (k * (k + 1) * (k + 2)) * n).alias("expected"))


def ba_ccdf(spark, m: int, max_k: int) -> DataFrame:
    k = F.col("k").cast("double")
    return spark.range(max(1, m), max_k + 1).select(F.col("id").alias("k")).select("k", (F.lit(1.0 * m * (m + 1)) / (k * (k + 1))).alias("p"))


def tail_verdict(tail: DataFrame, er: DataFrame, ba: DataFrame, points: int = 5) -> DataFrame:
    """Range of local slopes, and the three tails at the greatest degree."""
    slopes = local_slope(tail, points).agg(F.min("slope").alias("min_slope"), F.max("slope").alias("max_slope"))
    top = tail.agg(F.max("k").alias("k"))
    at = top.join(tail, "k").withColumnRenamed("p", "p_real")
    at = at.join(er.withColumnRenamed("p", "p_er"), "k", "left").join(ba.withColumnRenamed("p", "p_ba"), "k", "left")
    return at.crossJoin(slopes)


def hub_share(deg: DataFrame) -> DataFrame:
    return deg.agg(F.try_divide(F.max("deg"), F.sum("deg")).alias("hub_share"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of rows whose reverse exists; loops never match, duplicates count."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("hit", F.lit(1.0))
    return edges.join(back, ["src", "dst"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("reciprocity"))


def top_k(df: DataFrame, measure: str, k: int, key: str = "node") -> DataFrame:
    return df.orderBy(F.desc(measure), key).limit(k)


def direction_gap(deg: DataFrame, k: int, min_total: int = 5) -> DataFrame:
    """The k nodes with the largest in - out and the k with the smallest, among those with in + out >= min_total."""
    rows = deg.filter(F.col("indeg") + F.col("outdeg") >= min_total).select("node", (F.col("indeg") - F.col("outdeg")).alias("gap"))
    high = rows.orderBy(F.desc("gap"), "node").limit(k).withColumn("side", F.lit("in"))
    return high.union(rows.orderBy("gap", "node").limit(k).withColumn("side", F.lit("out")))


def hub_ratio(deg: DataFrame) -> DataFrame:
    """Greatest degree over the second one."""
    two = top_k(deg.select("node", "deg"), "deg", 2).agg(F.max("deg").alias("x"), F.min("deg").alias("y"), F.count("*").alias("n"))
    return two.select(F.when(F.col("n") == 2, F.try_divide("x", "y")).alias("hub_ratio"))


def friend_degree_ratio(deg: DataFrame) -> DataFrame:
    k = F.col("deg")
    return deg.agg(F.avg(k).alias("mean_degree"), F.try_divide(F.sum(k * k), F.sum(k)).alias("friend_mean_degree"))


def _neighbour_degrees(pairs: DataFrame) -> DataFrame:
    s = symmetrize(pairs.select("a", "b"))
    deg = s.groupBy("src").agg(F.count("*").alias("deg"))
    return s.join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("other_deg")), "dst").join(deg, "src")


def friend_gap(pairs: DataFrame) -> DataFrame:
    """node, deg, friend_mean, gap: mean neighbour degree less its own."""
    g = _neighbour_degrees(pairs).groupBy(F.col("src").alias("node")).agg(F.first("deg").alias("deg"), F.avg("other_deg").alias("friend_mean"))
    return g.withColumn("gap", F.col("friend_mean") - F.col("deg"))


def local_champions(pairs: DataFrame) -> DataFrame:
    g = _neighbour_degrees(pairs).groupBy(F.col("src").alias("node")).agg(F.first("deg").alias("deg"), F.max("other_deg").alias("top"))
    return g.filter("deg >= top").select("node", "deg")


def sample_friend_pairs(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    """draw, node, friend: a node with links uniformly, then one of its neighbours, with replacement; a function of the seed."""
    from netlex.operators.ranks import row_ordinals

    s = symmetrize(pairs.select("a", "b"))
    deg = s.groupBy("src").agg(F.count("*").alias("deg"))
    ranked = row_ordinals(deg, ["src"], "rank")
    size = ranked.agg(F.count("*").alias("size"))
    draws = pairs.sparkSession.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size))
    draws = draws.select("draw", F.pmod(F.xxhash64(F.lit(seed), "draw"), "size").alias("rank"))
    chosen = draws.join(ranked, "rank").select("draw", "src", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), "deg").alias("at"))
    places = s.withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    return chosen.join(places, ["src", "at"]).select("draw", F.col("src").alias("node"), F.col("dst").alias("friend"))


def degree_assortativity(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of end degrees over both orientations; null if degenerate."""
    rows = _neighbour_degrees(pairs)
    return rows.agg(pearson("deg", "other_deg").alias("assortativity"))


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each pair from its end of smaller (degree, node) to the other: no node has many outgoing pairs."""
    s = symmetrize(pairs.select("a", "b"))
    deg = s.groupBy("src").agg(F.count("*").alias("deg"))
    both = pairs.select("a", "b").join(deg.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"))


def triangles(pairs: DataFrame) -> DataFrame:
    """x, y, z: each triangle once, by wedges at its least corner closed by a pair."""
    o = _oriented(pairs)
    wedge = o.select(F.col("lo").alias("x"), F.col("hi").alias("y")).join(o.select(F.col("lo").alias("x"), F.col("hi").alias("z")), "x").filter("y <> z")
    return wedge.join(o.select(F.col("lo").alias("y"), F.col("hi").alias("z")), ["y", "z"]).select("x", "y", "z")


def triangles_per_node(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tri, deg, cc (0 below two neighbours)."""
    corners = triangles(pairs).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("tri"))
    deg = symmetrize(pairs.select("a", "b")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    all_nodes = nodes.select("node").distinct().join(deg, "node", "left").join(corners, "node", "left").fillna(0, ["tri", "deg"])
    cc = F.when(F.col("deg") >= 2, 2.0 * F.col("tri") / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0)
    return all_nodes.select("node", "tri", "deg", cc.alias("cc"))


def clustering_summary(per_node: DataFrame) -> DataFrame:
    """avg_clustering (over all nodes), transitivity, triangles."""
    possible = F.sum(F.col("deg") * (F.col("deg") - 1) / 2)
    return per_node.agg(F.avg("cc").alias("avg_clustering"), F.try_divide(F.sum("tri"), possible).alias("transitivity"), (F.sum("tri") / 3).cast("long").alias("triangles"))


def random_edges_gnp(spark, n: int, p: float, seed: int) -> DataFrame:
    """a < b < n, each pair on its own with probability p. Every pair is a candidate, held against a hash of itself; the
    rows of candidates are made in blocks, so no task holds a whole row."""
    block = 4096
    rows = spark.range(1, n).select(F.col("id").alias("b"))
    blocks = rows.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - 1) / block))).alias("block"))
    cells = blocks.select("b", F.explode(F.sequence(F.col("block") * block, F.least(F.col("block") * block + block, F.col("b")) - 1)).alias("a"))
    unit = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(1 << 53)) / float(1 << 53)
    return cells.filter(unit < p).select("a", "b")
