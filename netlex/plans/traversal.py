"""Queries on components, distances, paths and centralities of the follow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators import graph, sketches, spectral, traverse
from netlex.plans.inputs import FOLLOW, follow, follow_edges, sql, users

QUERIES, SQL = {}, {}


def add(name, run, select=None, ctes=(FOLLOW,), recursive=True):
    QUERIES[name] = run
    if select:
        SQL[name] = sql(list(ctes), select, recursive)


def r6(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


#: Components by propagation of the least node.
_PARTS = """walk AS (SELECT node AS root, node FROM v UNION SELECT root, dst FROM walk JOIN s ON src = node),
    comp AS (SELECT node, min(root) AS comp FROM walk GROUP BY node),
    size AS (SELECT comp, count(*) AS size FROM comp GROUP BY comp)"""
add("components", lambda s, d: traverse.ranked_components(*follow(s, d)), "SELECT node, comp, size, place FROM comp JOIN (SELECT comp, size, row_number() OVER (ORDER BY size DESC, comp) AS place FROM size) USING (comp)", (FOLLOW, _PARTS))
add("outside_giant", lambda s, d: traverse.outside_giant(*follow(s, d)), "SELECT node, comp, size FROM comp JOIN (SELECT comp, size, row_number() OVER (ORDER BY size DESC, comp) AS place FROM size) USING (comp) WHERE place > 1", (FOLLOW, _PARTS))
add("component_report", lambda s, d: r6(traverse.component_report(*follow(s, d)), "outside_share"), """SELECT count(*) AS components, max(size) AS giant, greatest(count(*) FILTER (size > 1) - 1, 0) AS clusters, count(*) FILTER (size = 1) AS isolated,
    round((sum(size) - max(size)) / sum(size), 6) AS outside_share FROM size""", (FOLLOW, _PARTS))


def _graph_summary(s, d):
    pairs, nodes = follow(s, d)
    deg = graph.degrees(graph.symmetrize(pairs), nodes)
    base = deg.agg(F.count("*").alias("n"), (F.sum("deg") / 2).cast("long").alias("m"), F.avg("deg").alias("mean_degree"), F.max("deg").alias("max_degree"), F.min_by("node", F.struct(-F.col("deg"), "node")).alias("leader"))
    report = traverse.component_report(pairs, nodes).select("giant")
    return r6(base.crossJoin(report).withColumn("giant_share", F.try_divide("giant", "n")), "mean_degree", "giant_share")


_WHOLE = """walk AS (SELECT node AS root, node FROM v UNION SELECT root, dst FROM walk JOIN s ON src = node),
    size AS (SELECT comp, count(*) AS size FROM (SELECT node, min(root) AS comp FROM walk GROUP BY node) GROUP BY comp)"""
add("graph_summary", _graph_summary, """SELECT count(*) AS n, CAST(sum(deg) // 2 AS BIGINT) AS m, round(avg(deg), 6) AS mean_degree, max(deg) AS max_degree, (SELECT node FROM d ORDER BY deg DESC, node LIMIT 1) AS leader,
    (SELECT max(size) FROM size) AS giant, round((SELECT max(size) FROM size) / count(*), 6) AS giant_share FROM d""", (FOLLOW, _WHOLE))

#: bd: distances of all pairs of the follow graph; bl: the levels of its search.
LEVELS = 12


def levels(edges: str, name: str, n: int, roots: str = "SELECT node FROM v") -> str:
    """Tables name0 .. name<n> of (root, node, sigma) by level, and name with all of them: unrolled breadth-first search."""
    parts = [f"{name}0 AS (SELECT node AS root, node, CAST(1 AS DOUBLE) AS sigma FROM ({roots}))"]
    for i in range(1, n + 1):
        seen = " UNION ALL ".join(f"SELECT root, node FROM {name}{j}" for j in range(i))
        parts.append(f"{name}{i} AS MATERIALIZED (SELECT f.root, e.dst AS node, sum(f.sigma) AS sigma FROM {name}{i - 1} f JOIN {edges} e ON e.src = f.node LEFT JOIN ({seen}) q ON q.root = f.root AND q.node = e.dst WHERE q.node IS NULL GROUP BY 1, 2)")
    parts.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT root, node, {i} AS dist, sigma FROM {name}{i}" for i in range(n + 1)) + ")")
    return ",\n".join(parts)


def _all(s, d):
    pairs, nodes = follow(s, d)
    return traverse.reach_counts(graph.symmetrize(pairs), nodes), nodes


_HUB = "hub AS (SELECT node FROM d ORDER BY deg DESC, node LIMIT 1)"


def _hub(s, d):
    pairs, nodes = follow(s, d)
    return graph.top_k(graph.degrees(graph.symmetrize(pairs), nodes), "deg", 1).select("node")


add("bfs", lambda s, d: traverse.bfs(graph.clean_edges(follow_edges(s, d), users(s, d)), users(s, d)), "SELECT root, node, dist FROM bl", (FOLLOW, levels("e", "bl", LEVELS)))
add("distance_summary", lambda s, d: r6(traverse.distance_summary(_all(s, d)[0]), "avg_path"), "SELECT round(avg(dist), 6) AS avg_path, max(dist) AS diameter FROM bl WHERE dist > 0", (FOLLOW, levels("s", "bl", LEVELS)))
add("eccentricity", lambda s, d: traverse.eccentricity(_all(s, d)[0]), "SELECT root AS node, max(dist) AS ecc FROM bl GROUP BY root", (FOLLOW, levels("s", "bl", LEVELS)))
for _mode in ("undirected", "outward", "inward"):

    def _reach(s, d, mode=_mode):
        nodes = users(s, d)
        e = graph.clean_edges(follow_edges(s, d), nodes)
        e = {"undirected": lambda: graph.symmetrize(graph.undirect(e)), "outward": lambda: e, "inward": lambda: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}[mode]()
        return traverse.reach(e, _hub(s, d), nodes)

    _edges = {"undirected": "s", "outward": "e", "inward": "(SELECT dst AS src, src AS dst FROM e)"}[_mode]
    add(f"reach_{_mode}", _reach, """SELECT max(dist) AS furthest, count(*) FILTER (dist = (SELECT max(dist) FROM bl)) AS nodes_there, count(*) AS reached, (SELECT count(*) FROM v) - 1 - count(*) AS unreachable
        FROM bl WHERE dist > 0""", (FOLLOW, _HUB, levels(_edges, "bl", LEVELS, "SELECT node FROM hub")))
add("distance_ring", lambda s, d: traverse.distance_ring(graph.symmetrize(follow(s, d)[0]), _hub(s, d), 2, users(s, d).filter("node % 4 = 0")), "SELECT node FROM bl WHERE dist = 2 AND node % 4 <> 0", (FOLLOW, _HUB, levels("s", "bl", 2, "SELECT node FROM hub")))


def _bands(s, d):
    dist = settle(_all(s, d)[0])
    return traverse.distance_bands(dist, traverse.eccentricity(dist)).groupBy("root", "band").agg(F.sum("n").alias("nodes"))


add("distance_bands", _bands, """SELECT root, CASE WHEN dist = 0 THEN 'here' WHEN dist / ecc <= 0.18 THEN 'core' WHEN dist / ecc <= 0.38 THEN 'close' WHEN dist / ecc <= 0.58 THEN 'near'
    WHEN dist / ecc <= 0.78 THEN 'far' WHEN dist / ecc <= 0.92 THEN 'remote' ELSE 'edge' END AS band, count(*) AS nodes FROM bl JOIN (SELECT root, max(dist) AS ecc FROM bl GROUP BY root) USING (root) GROUP BY 1, 2""", (FOLLOW, levels("s", "bl", LEVELS)))


def _path(s, d):
    """Between the users with the least and the greatest id, along directed edges."""
    ends = users(s, d).agg(F.min("node"), F.max("node")).first()
    return traverse.shortest_path(graph.clean_edges(follow_edges(s, d), users(s, d)), ends[0], ends[1]).select(F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), "reached")


def _back(n: int) -> str:
    """Tables t0 .. t<n>: the end of the path, and before each node the least one of those a step nearer to the start."""
    parts = ["ends AS (SELECT min(node) AS a, max(node) AS b FROM v)", "t0 AS (SELECT node, dist FROM bl WHERE node = (SELECT b FROM ends))"]
    for i in range(1, n + 1):
        parts.append(f"t{i} AS (SELECT min(src) AS node, any_value(bl.dist) AS dist FROM t{i - 1} t JOIN e ON e.dst = t.node JOIN bl ON bl.node = e.src AND bl.dist = t.dist - 1 HAVING count(*) > 0)")
    parts.append("way AS (" + " UNION ALL ".join(f"SELECT {i} AS i, node FROM t{i}" for i in range(n + 1)) + ")")
    return ",\n".join(parts)


add("shortest_path", _path, "SELECT (SELECT string_agg(CAST(node AS VARCHAR), ' ' ORDER BY i DESC) FROM way) AS path, (SELECT count(*) FROM bl) AS reached", (FOLLOW, levels("e", "bl", LEVELS, "SELECT min(node) AS node FROM v"), _back(LEVELS)))


def _sketched(s, d):
    pairs, nodes = follow(s, d)
    return graph.symmetrize(pairs), nodes


add("sketched_closeness", lambda s, d: r6(sketches.sketched_closeness(*_sketched(s, d)), "closeness", "harmonic"))
add("sketched_distances", lambda s, d: r6(sketches.sketched_distances(*_sketched(s, d)), "pairs"))
add("betweenness_within", lambda s, d: r6(traverse.betweenness_within(*_sketched(s, d), error=0.05), "betweenness", "error"))
add("closeness", lambda s, d: r6(traverse.closeness(*_all(s, d)), "closeness", "harmonic"), """SELECT node, round(coalesce(r * r / (far * (n - 1)), 0), 6) AS closeness, round(coalesce(inv / (n - 1), 0), 6) AS harmonic FROM v
    LEFT JOIN (SELECT root AS node, count(*) AS r, sum(dist) AS far, sum(1 / dist) AS inv FROM bl WHERE dist > 0 GROUP BY root) USING (node), (SELECT count(*) AS n FROM v)""", (FOLLOW, levels("s", "bl", LEVELS)))
#: Independent of the operator: paths through v are sigma(s, v) x sigma(v, t) where distances add up.
_BETWEEN = """SELECT v.node, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM v LEFT JOIN (
    SELECT p.node, sum(p.sigma * q.sigma / r.sigma) AS x FROM bl p JOIN {back} q ON q.root = p.node AND p.dist > 0 AND q.dist > 0 JOIN bl r ON r.root = p.root AND r.node = q.node AND r.dist = p.dist + q.dist GROUP BY 1) b ON b.node = v.node,
    (SELECT count(*) AS n FROM v)"""
add("betweenness", lambda s, d: r6(traverse.betweenness(graph.symmetrize(follow(s, d)[0]), users(s, d)), "betweenness"), _BETWEEN.format(back="bl"), (FOLLOW, levels("s", "bl", LEVELS)))
add("betweenness_directed", lambda s, d: r6(traverse.betweenness(graph.clean_edges(follow_edges(s, d), users(s, d)), users(s, d)), "betweenness"), _BETWEEN.format(back="bl"), (FOLLOW, levels("e", "bl", LEVELS)))
#: Rounds that bring the SQL within 1e-6 of convergence, up to which the operators run.
ROUNDS = 40


def _power(n: int) -> str:
    """Rounds of x + A x on the follow graph, each scaled to unit length."""
    parts = ["x0 AS (SELECT node, 1 / sqrt((SELECT count(*) FROM v)) AS x FROM v)"]
    for i in range(1, n + 1):
        parts.append(f"y{i} AS MATERIALIZED (SELECT p.node, p.x + coalesce(q.y, 0) AS x FROM x{i - 1} p LEFT JOIN (SELECT dst AS node, sum(x) AS y FROM s JOIN x{i - 1} ON node = src GROUP BY dst) q ON q.node = p.node)")
        parts.append(f"x{i} AS MATERIALIZED (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
    return ",\n".join(parts)


def _rank(n: int) -> str:
    parts = ["p0 AS (SELECT node, 1.0 / (SELECT count(*) FROM v) AS x FROM v)"]
    for i in range(1, n + 1):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT v.node, 0.85 * (coalesce(q.y, 0) + (SELECT coalesce(sum(x), 0) FROM p{i - 1} JOIN d USING (node) WHERE outdeg = 0) / (SELECT count(*) FROM v)) + 0.15 / (SELECT count(*) FROM v) AS x
            FROM v LEFT JOIN (SELECT e.dst AS node, sum(x / outdeg) AS y FROM e JOIN p{i - 1} ON node = src JOIN d ON d.node = src GROUP BY e.dst) q ON q.node = v.node)""")
    return ",\n".join(parts)


def _eigen(s, d):
    pairs, nodes = follow(s, d)
    x, value = spectral.eigenvector(graph.symmetrize(pairs), nodes)
    return r6(x.withColumn("eigenvalue", F.lit(float(value))), "eigenvector", "eigenvalue")


add("eigenvector", _eigen, f"""SELECT node, round(x, 6) AS eigenvector, round((SELECT sum(p.x * q.x) FROM s JOIN x{ROUNDS} p ON p.node = src JOIN x{ROUNDS} q ON q.node = dst), 6) AS eigenvalue FROM x{ROUNDS}""", (FOLLOW, _power(ROUNDS)))
add("pagerank", lambda s, d: r6(spectral.pagerank(graph.clean_edges(follow_edges(s, d), users(s, d)), users(s, d)), "pagerank"), f"SELECT node, round(x, 6) AS pagerank FROM p{ROUNDS}", (FOLLOW, _rank(ROUNDS)))
