"""Queries on backbones, sweeps, cliques, communities and partitions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from netlex.operators import cliques, communities, graph, sweep
from netlex.plans.inputs import CORETURN, FOLLOW, coreturn, follow, sql, table, users
from netlex.plans.graphs import r6

QUERIES, SQL = {}, {}


def add(name, run, select=None, ctes=(CORETURN,), recursive=False):
    QUERIES[name] = run
    if select:
        SQL[name] = sql(list(ctes), select, recursive)


GRID = [round(0.01 * i, 2) for i in range(1, 61)]
_ALPHA = """al AS (SELECT w.a, w.b, weight, least(CASE WHEN x.deg <= 1 THEN 0 ELSE pow(1 - weight / x.strength, x.deg - 1) END, CASE WHEN y.deg <= 1 THEN 0 ELSE pow(1 - weight / y.strength, y.deg - 1) END) AS alpha
    FROM w JOIN wk x ON x.node = w.a JOIN wk y ON y.node = w.b)"""


def _scored(s, d):
    return sweep.disparity_alpha(coreturn(s, d))


def _rounded(s, d):
    return _scored(s, d).select("a", "b", F.round("alpha", 6).alias("score"))


#: Components of the edges under a threshold, by propagation of the least label along union of both orientations.
def _under(name: str, condition: str, edges: str = "al") -> str:
    return f"""{name}_e AS (SELECT a AS src, b AS dst FROM {edges} WHERE {condition} UNION ALL SELECT b, a FROM {edges} WHERE {condition}),
    {name}_w AS (SELECT DISTINCT src AS root, src AS node FROM {name}_e UNION SELECT root, dst FROM {name}_w JOIN {name}_e ON src = node),
    {name} AS (SELECT node, min(root) AS comp FROM {name}_w GROUP BY node)"""


add("disparity_alpha", lambda s, d: r6(_scored(s, d), "alpha"), "SELECT a, b, weight, round(alpha, 6) AS alpha FROM al", (CORETURN, _ALPHA))
add("backbone", lambda s, d: r6(sweep.backbone_report(_scored(s, d), 0.05), "kept_share", "giant_share"), """SELECT (SELECT count(*) FROM al WHERE alpha < 0.05) AS kept, round((SELECT count(*) FROM al WHERE alpha < 0.05) / (SELECT count(*) FROM al), 6) AS kept_share,
    count(*) AS nodes, coalesce(max(n), 0) AS giant, coalesce(round(max(n) / count(*), 6), 0) AS giant_share FROM bb JOIN (SELECT comp, count(*) AS n FROM bb GROUP BY comp) USING (comp)""", (CORETURN, _ALPHA, _under("bb", "alpha < 0.05")), True)
add("backbone_nodes", lambda s, d: sweep.backbone_nodes(coreturn(s, d), 0.05, 8).select("node", "strength", "deg", "in_giant"), """SELECT node, strength, deg, comp = (SELECT comp FROM bb GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1) AS in_giant
    FROM bb JOIN wk USING (node) ORDER BY deg DESC, node LIMIT 8""", (CORETURN, _ALPHA, _under("bb", "alpha < 0.05")), True)


def _kruskal(edges: str) -> str:
    """mg (a, b, score, size_a, size_b): merges of components edge by edge, on a list of all nodes' labels; edges: a query of a, b, score."""
    same = "lab[pa] = lab[pb]"
    size = lambda p: f"CASE WHEN {same} THEN 0 ELSE len(list_filter(lab, lambda x: x = lab[{p}])) END"
    return f"""ko AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score, a, b) AS i, a, b, score FROM ({edges})),
    kn AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS p FROM (SELECT a AS node FROM ko UNION SELECT b FROM ko)),
    ke AS MATERIALIZED (SELECT i, a, b, score, x.p AS pa, y.p AS pb FROM ko JOIN kn x ON x.node = a JOIN kn y ON y.node = b),
    kr AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(p ORDER BY p) FROM kn) AS lab, CAST(0 AS BIGINT) AS size_a, CAST(0 AS BIGINT) AS size_b
        UNION ALL SELECT ke.i, CASE WHEN {same} THEN lab ELSE list_transform(lab, lambda x: CASE WHEN x = lab[pb] THEN lab[pa] ELSE x END) END, {size("pa")}, {size("pb")} FROM kr JOIN ke ON ke.i = kr.i + 1),
    mg AS MATERIALIZED (SELECT a, b, score, size_a, size_b, least(size_a, size_b) AS min_size FROM kr JOIN ke USING (i) WHERE size_a > 0)"""


_POINTS = f"(SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in GRID)}]) AS t)"
_MERGES = _kruskal("SELECT a, b, round(alpha, 6) AS score FROM al")
_SWEEP = f"sw AS (SELECT t, (SELECT count(*) FROM ko WHERE score < t) AS edges, (SELECT coalesce(max(size_a + size_b), 0) FROM mg WHERE score < t) AS giant FROM {_POINTS})"
add("threshold_sweep", lambda s, d: sweep.threshold_sweep(_rounded(s, d), GRID), "SELECT t, edges, giant FROM sw", (CORETURN, _ALPHA, _MERGES, _SWEEP), True)
add("merge_events", lambda s, d: sweep.merge_events(_rounded(s, d)), "SELECT a, b, score, size_a, size_b, min_size FROM mg", (CORETURN, _ALPHA, _MERGES), True)
add("load_bearing_merges", lambda s, d: sweep.merge_events(_rounded(s, d)).orderBy(F.desc("min_size"), "score", "a", "b").limit(6), "SELECT a, b, score, size_a, size_b, min_size FROM mg ORDER BY min_size DESC, score, a, b LIMIT 6", (CORETURN, _ALPHA, _MERGES), True)
add("threshold_edges", lambda s, d: sweep.threshold_edges(_rounded(s, d), GRID), f"SELECT t, count(al.a) AS edges FROM (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in GRID)}]) AS t) LEFT JOIN al ON round(alpha, 6) < t GROUP BY t", (CORETURN, _ALPHA))
add("threshold_giant", lambda s, d: sweep.threshold_sweep(_rounded(s, d), [0.02]).select("t", "giant"), "SELECT CAST(0.02 AS DOUBLE) AS t, coalesce(max(n), 0) AS giant FROM (SELECT count(*) AS n FROM bb GROUP BY comp)", (CORETURN, _ALPHA, _under("bb", "round(alpha, 6) < 0.02")), True)
add("critical_threshold", lambda s, d: r6(sweep.critical_threshold(sweep.threshold_sweep(_rounded(s, d), GRID)), "fall"), """SELECT t, round(fall, 6) AS fall FROM (SELECT t, lag(giant / (SELECT nullif(max(giant), 0) FROM sw)) OVER (ORDER BY t DESC) - giant / (SELECT nullif(max(giant), 0) FROM sw) AS fall FROM sw)
    WHERE fall > 0.15 ORDER BY t DESC LIMIT 1""", (CORETURN, _ALPHA, _MERGES, _SWEEP), True)


def _order(s, d):
    deg = graph.degrees(graph.symmetrize(follow(s, d)[0]), users(s, d))
    from netlex.operators.ranks import rank_desc

    return rank_desc(deg, ["deg"]).select("node", F.col("deg_rank").alias("place"))


def _random_order(s, d):
    from netlex.operators.ranks import row_ordinals

    return row_ordinals(users(s, d).withColumn("h", F.md5(F.concat(F.lit("17/"), F.col("node").cast("string")).cast("binary"))), [F.asc("h"), F.asc("node")], "i").select("node", (F.col("i") + 1).alias("place"))


def _central_order(s, d, measure):
    from netlex.operators import spectral, traverse
    from netlex.operators.ranks import rank_desc

    pairs, nodes = follow(s, d)
    sym = graph.symmetrize(pairs)
    df = traverse.betweenness(sym, nodes) if measure == "betweenness" else spectral.pagerank(sym, nodes)
    return rank_desc(df.withColumn(measure, F.round(measure, 9)), [measure]).select("node", F.col(f"{measure}_rank").alias("place"))


def _steps(s, d):
    """150 removals, or all but one node."""
    return min(150, users(s, d).count() - 1)


#: Places of removal by degree and by a hash; curves from the merges of the edges in the order of their ends' removal, backwards.
_PLACES = """by_degree AS (SELECT node, row_number() OVER (ORDER BY deg DESC, node) AS place FROM d), by_hash AS (SELECT node, row_number() OVER (ORDER BY md5('17/' || node), node) AS place FROM v),
    nn AS (SELECT count(*) AS n, least(150, count(*) - 1) AS steps FROM v)"""


def _curve(places: str, name: str) -> str:
    edges = f"SELECT u.a, u.b, -least(CASE WHEN x.place <= steps THEN x.place ELSE steps + 1 END, CASE WHEN y.place <= steps THEN y.place ELSE steps + 1 END) AS score FROM u JOIN {places} x ON x.node = u.a JOIN {places} y ON y.node = u.b, nn"
    made = _kruskal(edges)
    for t in ("ko", "kn", "ke", "kr", "mg"):
        made = re.sub(rf"\b{t}\b", f"{t}_{name}", made)
    return made + f""",
    curve_{name} AS (SELECT CAST(step AS INTEGER) AS step, greatest(1, coalesce((SELECT max(size_a + size_b) FROM mg_{name} WHERE score < -step), 0)) / (n - step) AS giant_frac FROM nn, range(0, 151) r(step) WHERE step <= steps)"""


add("removal_curve", lambda s, d: r6(sweep.removal_curve(follow(s, d)[0], _order(s, d), _steps(s, d)), "giant_frac"), "SELECT step, round(giant_frac, 6) AS giant_frac FROM curve_degree", (FOLLOW, _PLACES, _curve("by_degree", "degree")), True)
_GONE = """gone AS (SELECT node FROM d ORDER BY deg DESC, node LIMIT 5), left_u AS (SELECT a, b FROM u WHERE a NOT IN (SELECT node FROM gone) AND b NOT IN (SELECT node FROM gone))"""
add("removal_step", lambda s, d: r6(sweep.removal_curve(follow(s, d)[0], _order(s, d), 5).filter("step = 5"), "giant_frac"), "SELECT CAST(5 AS INTEGER) AS step, round(coalesce(max(n), 1) / ((SELECT count(*) FROM v) - 5), 6) AS giant_frac FROM (SELECT count(*) AS n FROM bb GROUP BY comp)", (FOLLOW, _GONE, _under("bb", "true", "left_u")), True)
add("compare_removals", lambda s, d: r6(sweep.compare_removals(follow(s, d)[0], {"degree": _order(s, d), "betweenness": _central_order(s, d, "betweenness"), "pagerank": _central_order(s, d, "pagerank"), "random": _random_order(s, d)}, _steps(s, d)), "end_frac"))
add("removal_gap", lambda s, d: r6(sweep.removal_gap(sweep.removal_curve(follow(s, d)[0], _order(s, d), _steps(s, d)), sweep.removal_curve(follow(s, d)[0], _random_order(s, d), _steps(s, d))), "max_gap"), "SELECT round(max(abs(p.giant_frac - q.giant_frac)), 6) AS max_gap FROM curve_degree p JOIN curve_hash q USING (step)", (FOLLOW, _PLACES, _curve("by_degree", "degree"), _curve("by_hash", "hash")), True)


def _worst(s, d):
    pairs, nodes = follow(s, d)
    top = graph.top_k(graph.degrees(graph.symmetrize(pairs), nodes), "deg", 5).select("node")
    return r6(sweep.worst_single_removal(pairs, nodes, top), "giant_share")


add("worst_single_removal", _worst, """SELECT c.node, round(coalesce(max(n), 1) / ((SELECT count(*) FROM v) - 1), 6) AS giant_share FROM cand c LEFT JOIN (SELECT gone, min_root, count(*) AS n FROM (SELECT gone, node, min(root) AS min_root FROM wr GROUP BY 1, 2) GROUP BY 1, 2) z ON z.gone = c.node GROUP BY c.node""",
    (FOLLOW, """tu AS (SELECT a, b FROM u), tk AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM tu UNION ALL SELECT b FROM tu) GROUP BY 1),
    cand AS (SELECT node FROM v LEFT JOIN tk USING (node) ORDER BY coalesce(n, 0) DESC, node LIMIT 5),
    te AS (SELECT c.node AS gone, a AS src, b AS dst FROM tu, cand c WHERE a <> c.node AND b <> c.node UNION ALL SELECT c.node, b, a FROM tu, cand c WHERE a <> c.node AND b <> c.node),
    wr AS (SELECT DISTINCT gone, src AS root, src AS node FROM te UNION SELECT wr.gone, root, dst FROM wr JOIN te ON te.gone = wr.gone AND src = node)"""), True)


def _some(s, d):
    return follow(s, d)[0]


_SOME = "hu AS (SELECT a, b FROM u)"
add("k_cliques", lambda s, d: cliques.k_cliques(_some(s, d), 4).select(F.array_join(F.col("clique").cast("array<string>"), " ").alias("clique")), """SELECT concat_ws(' ', p.a, p.b, q.b, r.b) AS clique FROM hu p JOIN hu q ON q.a = p.b JOIN hu pq ON pq.a = p.a AND pq.b = q.b
    JOIN hu r ON r.a = q.b JOIN hu pr ON pr.a = p.a AND pr.b = r.b JOIN hu qr ON qr.a = p.b AND qr.b = r.b""", (FOLLOW, _SOME))
add("maximal_cliques", lambda s, d: cliques.maximal_cliques(_some(s, d), 3).select(F.array_join(F.col("clique").cast("array<string>"), " ").alias("clique"), "size"))
add("maximal_triangles", lambda s, d: cliques.maximal_cliques(_some(s, d), 3).filter("size = 3").select(F.array_join(F.col("clique").cast("array<string>"), " ").alias("clique")), """SELECT concat_ws(' ', p.a, p.b, q.b) AS clique FROM hu p JOIN hu q ON q.a = p.b JOIN hu r ON r.a = p.a AND r.b = q.b
    WHERE NOT EXISTS (SELECT 1 FROM hs x JOIN hs y ON y.src = x.src JOIN hs z ON z.src = x.src WHERE x.dst = p.a AND y.dst = p.b AND z.dst = q.b)""", (FOLLOW, _SOME, "hs AS (SELECT a AS src, b AS dst FROM hu UNION ALL SELECT b, a FROM hu)"))
add("clique_families", lambda s, d: cliques.clique_families(cliques.maximal_cliques(_some(s, d), 3)).select(*(F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("lineup", "swaps", "members")), "size", "variants"))


def _labels(s, d):
    kinds = table(s, d, "events").groupBy(F.col("user_id").alias("node"), "event_type").agg(F.count("*").alias("n"))
    return kinds.groupBy("node").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("label")).filter("node % 4 <> 0")


_LABELS = """lab AS (SELECT user_id AS node, event_type AS label FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS i
    FROM events GROUP BY 1, 2) WHERE i = 1 AND user_id % 4 <> 0)"""
add("clique_mix", lambda s, d: cliques.clique_mix(cliques.k_cliques(_some(s, d), 3), _labels(s, d)).select(F.array_join(F.col("clique").cast("array<string>"), " ").alias("clique"), "size", "labelled", "labels", "top_label"), """SELECT clique, CAST(3 AS INTEGER) AS size, CAST(sum(n) FILTER (label IS NOT NULL) AS BIGINT) AS labelled, count(label) AS labels, arg_min(label, (-n, label)) FILTER (label IS NOT NULL) AS top_label FROM (
    SELECT clique, label, count(*) AS n FROM (SELECT concat_ws(' ', p.a, p.b, q.b) AS clique, unnest([p.a, p.b, q.b]) AS node FROM hu p JOIN hu q ON q.a = p.b JOIN hu r ON r.a = p.a AND r.b = q.b) LEFT JOIN lab USING (node) GROUP BY 1, 2) GROUP BY 1""".replace("CAST(sum(n) FILTER (label IS NOT NULL) AS BIGINT)", "CAST(coalesce(sum(n) FILTER (label IS NOT NULL), 0) AS BIGINT)"), (FOLLOW, _SOME, _LABELS))


def _percolated(s, d):
    return cliques.k_clique_communities(_some(s, d), 3)


def _percolation(k: int, rounds: int = 10) -> str:
    """pc<k> (k, comm, node): least labels go to and fro between k-cliques and their (k - 1)-subsets."""
    c = f"q{k}"
    joins = {3: "SELECT [p.a, p.b, q.b] AS m FROM hu p JOIN hu q ON q.a = p.b JOIN hu r ON r.a = p.a AND r.b = q.b"}
    parts = [f"{c}3 AS MATERIALIZED ({joins[3]})"]
    for i in range(4, k + 1):
        ties = " ".join(f"JOIN hu e{j} ON e{j}.a = m[{j}] AND e{j}.b = n.b" for j in range(1, i - 1))
        parts.append(f"{c}{i} AS MATERIALIZED (SELECT list_append(m, n.b) AS m FROM {c}{i - 1} JOIN hu n ON n.a = m[{i - 1}] {ties})")
    drop = ", ".join(f"list_concat(m[1:{i - 1}], m[{i + 1}:{k}])" if i > 1 else f"m[2:{k}]" for i in range(1, k + 1))
    parts.append(f"{c}s AS MATERIALIZED (SELECT m, unnest([{drop}]) AS part FROM {c}{k})")
    parts.append(f"{c}l0 AS (SELECT m, m AS label FROM {c}{k})")
    for i in range(1, rounds + 1):
        parts.append(f"{c}l{i} AS MATERIALIZED (SELECT s.m, min(x.label) AS label FROM {c}s s JOIN (SELECT part, min(label) AS label FROM {c}s JOIN {c}l{i - 1} USING (m) GROUP BY part) x USING (part) GROUP BY 1)")
    parts.append(f"{c}n AS (SELECT DISTINCT label, unnest(m) AS node FROM {c}l{rounds})")
    parts.append(f"pc{k} AS (SELECT CAST({k} AS INTEGER) AS k, comm, node FROM {c}n JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(node), label) - 1 AS comm FROM {c}n GROUP BY label) USING (label))")
    return ",\n".join(parts)


add("k_clique_communities", _percolated, "SELECT k, comm, node FROM pc3", (FOLLOW, _SOME, _percolation(3)))
add("k_clique_members", lambda s, d: _percolated(s, d).select("node").distinct(), "SELECT DISTINCT node FROM (SELECT unnest([p.a, p.b, q.b]) AS node FROM hu p JOIN hu q ON q.a = p.b JOIN hu r ON r.a = p.a AND r.b = q.b)", (FOLLOW, _SOME))
add("overlap_counts", lambda s, d: cliques.overlap_counts(_percolated(s, d).union(cliques.k_clique_communities(_some(s, d), 4)), users(s, d), [3, 4]), "SELECT node, coalesce(x.n, 0) AS k3_n, coalesce(y.n, 0) AS k4_n FROM v LEFT JOIN (SELECT node, count(*) AS n FROM pc3 GROUP BY 1) x USING (node) LEFT JOIN (SELECT node, count(*) AS n FROM pc4 GROUP BY 1) y USING (node)", (FOLLOW, _SOME, _percolation(3), _percolation(4)))


def _overlaps(s, d):
    return cliques.overlap_counts(_percolated(s, d).union(cliques.k_clique_communities(_some(s, d), 4)), users(s, d), [3, 4])


_COUNTS = "oc AS (SELECT node, coalesce(n, 0) AS k4_n FROM v LEFT JOIN (SELECT node, count(*) AS n FROM pc4 GROUP BY 1) USING (node))"
add("overlap_leaders", lambda s, d: cliques.overlap_leaders(_overlaps(s, d), "k4_n"), "SELECT node, k4_n, row_number() OVER (ORDER BY k4_n DESC, node) AS place FROM oc ORDER BY k4_n DESC, node LIMIT 10", (FOLLOW, _SOME, _percolation(4), _COUNTS))
add("overlap_place", lambda s, d: cliques.overlap_place(_overlaps(s, d), "k4_n", 1), "SELECT node, k4_n, (SELECT count(*) FROM oc q WHERE q.k4_n > oc.k4_n) + 1 AS place FROM oc WHERE node = 1", (FOLLOW, _SOME, _percolation(4), _COUNTS))
add("focal_subgraph", lambda s, d: cliques.focal_subgraph(_percolated(s, d), _some(s, d), 1), "SELECT a, b FROM hu WHERE a IN (SELECT node FROM fs) AND b IN (SELECT node FROM fs)", (FOLLOW, _SOME, _percolation(3), "fs AS (SELECT DISTINCT node FROM pc3 WHERE comm IN (SELECT comm FROM pc3 WHERE node = 1))"))
add("focal_communities", lambda s, d: cliques.focal_communities(_percolated(s, d), 1).select("k", "comm", "size", F.array_join(F.col("members").cast("array<string>"), " ").alias("members")), "SELECT k, comm, count(*) AS size, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY node) AS members FROM pc3 WHERE comm IN (SELECT comm FROM pc3 WHERE node = 1) GROUP BY 1, 2", (FOLLOW, _SOME, _percolation(3)))


def _louvain(s, d, weighted):
    return communities.relabel_by_size(communities.louvain(coreturn(s, d), weighted))


add("louvain_weighted", lambda s, d: _louvain(s, d, True))
add("louvain_unweighted", lambda s, d: _louvain(s, d, False))


def _partitions(s, d):
    """Two partitions of parts: by brand, and by size with a brand's tint; some labels are missing."""
    part = table(s, d, "part")
    return part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("p"), F.when(F.col("p_size") % 7 != 0, F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise(F.concat(F.lit("s"), (F.col("p_size") % 4).cast("string")))).alias("q"))


_PARTS = """pt AS (SELECT p_partkey AS node, p_brand AS p, CASE WHEN p_size % 7 <> 0 THEN CASE WHEN p_size > 20 THEN p_brand ELSE 's' || (p_size % 4) END END AS q FROM part),
    fl AS (SELECT p, q, count(*) AS count FROM pt WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY 1, 2),
    al2 AS (SELECT p, arg_min(q, (-count, q)) AS q FROM fl GROUP BY p)"""
add("flows", lambda s, d: communities.flows(_partitions(s, d), "p", "q"), "SELECT p, q, count FROM fl", (_PARTS,))
add("nmi", lambda s, d: r6(communities.nmi(_partitions(s, d), "p", "q"), "nmi"), """SELECT round(2 * (SELECT sum(count / n * ln(count * n / (mp * mq))) FROM fl JOIN (SELECT p, sum(count) AS mp FROM fl GROUP BY p) USING (p) JOIN (SELECT q, sum(count) AS mq FROM fl GROUP BY q) USING (q), (SELECT sum(count) AS n FROM fl))
    / ((SELECT -sum(m / n * ln(m / n)) FROM (SELECT sum(count) AS m FROM fl GROUP BY p), (SELECT sum(count) AS n FROM fl)) + (SELECT -sum(m / n * ln(m / n)) FROM (SELECT sum(count) AS m FROM fl GROUP BY q), (SELECT sum(count) AS n FROM fl))), 6) AS nmi""", (_PARTS,))
add("best_alignment", lambda s, d: communities.best_alignment(_partitions(s, d), "p", "q"), "SELECT p, q FROM al2", (_PARTS,))
add("movers", lambda s, d: communities.movers(_partitions(s, d), "p", "q", graph.strength(coreturn(s, d)), 12), "SELECT pt.node, pt.p, pt.q, strength FROM pt JOIN al2 ON al2.p = pt.p JOIN wk ON wk.node = pt.node WHERE pt.q <> al2.q ORDER BY strength DESC, pt.node LIMIT 12", (CORETURN, _PARTS))


def _by_brand(s, d):
    return _partitions(s, d).select("node", F.col("p").alias("comm"))


add("relabel_by_size", lambda s, d: communities.relabel_by_size(_by_brand(s, d)), "SELECT node, new AS comm FROM pt JOIN (SELECT p, row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS new FROM pt GROUP BY p) USING (p)", (_PARTS,))
add("community_profile", lambda s, d: communities.community_profile(_by_brand(s, d), graph.strength(coreturn(s, d))).select("comm", "size", F.array_join(F.col("top").cast("array<string>"), " ").alias("top")), """SELECT p AS comm, count(*) AS size, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY i) FILTER (i <= 5) AS top FROM (
    SELECT p, node, row_number() OVER (PARTITION BY p ORDER BY deg DESC, node) AS i FROM pt JOIN wk USING (node)) GROUP BY p""", (CORETURN, _PARTS))
add("within_share", lambda s, d: r6(communities.within_share(coreturn(s, d), _by_brand(s, d)), "within_share"), "SELECT round(sum(CASE WHEN x.p = y.p THEN weight ELSE 0 END) / sum(weight), 6) AS within_share FROM w JOIN pt x ON x.node = a JOIN pt y ON y.node = b", (CORETURN, _PARTS))
add("modularity", lambda s, d: r6(communities.modularity(graph.symmetrize(coreturn(s, d)), _by_brand(s, d)), "modularity"), """SELECT round(sum(CASE WHEN x.p = y.p THEN weight ELSE 0 END) / (SELECT sum(weight) FROM ws) - (SELECT sum(CAST(k AS DOUBLE) * k) FROM (SELECT sum(strength) AS k FROM wk JOIN pt USING (node) GROUP BY p)) / pow((SELECT sum(weight) FROM ws), 2), 6) AS modularity
    FROM ws JOIN pt x ON x.node = src JOIN pt y ON y.node = dst""", (CORETURN, _PARTS))
add("attribute_assortativity", lambda s, d: r6(communities.attribute_assortativity(follow(s, d)[0], _labels(s, d)), "assortativity"), """SELECT round((sum(n) FILTER (x = y) / sum(n) - (SELECT sum(pow(m, 2)) FROM (SELECT sum(n) AS m FROM mix GROUP BY x)) / pow(sum(n), 2)) / (1 - (SELECT sum(pow(m, 2)) FROM (SELECT sum(n) AS m FROM mix GROUP BY x)) / pow(sum(n), 2)), 6) AS assortativity FROM mix""",
    (FOLLOW, _LABELS, "mix AS (SELECT p.label AS x, q.label AS y, count(*) AS n FROM s JOIN lab p ON p.node = src JOIN lab q ON q.node = dst GROUP BY 1, 2)"))
