"""Queries on graph tables: building them, degrees, tails, clustering, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlex.operators import graph, ranks
from netlex.plans.inputs import CORETURN, FOLLOW, coreturn, follow, follow_degrees, follow_edges, sql, table, users

QUERIES, SQL = {}, {}


def add(name, run, select=None, ctes=(FOLLOW,)):
    QUERIES[name] = run
    if select:
        SQL[name] = sql(list(ctes), select)


def r6(df, *columns):
    """Rounded for comparison with SQL."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def counts(s, d):
    return graph.degree_counts(follow_degrees(s, d))


def _shape(s, d):
    """n, m, rounded mean degree and greatest degree of the follow graph, as scalars for the model curves."""
    row = follow_degrees(s, d).agg(F.count("*").alias("n"), F.avg("deg").alias("mean"), F.max("deg").alias("top")).first()
    return row["n"], row["mean"], row["top"]


add("clean_edges", lambda s, d: graph.clean_edges(follow_edges(s, d), users(s, d)), "SELECT src, dst FROM e0 WHERE src <> dst")
add("undirect", lambda s, d: follow(s, d)[0], "SELECT a, b FROM u")
add("undirect_weighted", lambda s, d: graph.undirect_weighted(follow_edges(s, d).withColumn("weight", F.lit(1).cast("long"))), "SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM e0 WHERE src <> dst GROUP BY 1, 2")
add("symmetrize", lambda s, d: graph.symmetrize(follow(s, d)[0]), "SELECT src, dst FROM s")
add("induced_hubs", lambda s, d: graph.induced(follow(s, d)[0], follow_degrees(s, d).filter("deg >= 20"), ("a", "b")), "SELECT a, b FROM u WHERE a IN (SELECT node FROM d WHERE deg >= 20) AND b IN (SELECT node FROM d WHERE deg >= 20)")


def _attributes(s, d):
    kinds = table(s, d, "events").filter("event_type <> 'purchase'").groupBy(F.col("user_id").alias("node"), "event_type").agg(F.count("*").alias("n"))
    modal = kinds.groupBy("node").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("label")).filter("node % 3 <> 0")
    return graph.with_attributes(users(s, d), modal, {"label": ""})


add("with_attributes", _attributes, """SELECT node, coalesce(label, '') AS label FROM v LEFT JOIN (
    SELECT user_id AS node, event_type AS label FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS i
    FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) WHERE i = 1 AND user_id % 3 <> 0) USING (node)""")
add("degrees", follow_degrees, "SELECT node, deg, indeg, outdeg FROM d")
add("top_hubs", lambda s, d: graph.top_k(follow_degrees(s, d), "deg", 15), "SELECT node, deg, indeg, outdeg FROM d ORDER BY deg DESC, node LIMIT 15")
add("strength", lambda s, d: graph.strength(coreturn(s, d)), "SELECT node, strength, deg FROM wk", (CORETURN,))
add("degree_counts", counts, "SELECT k, count FROM c")
add("degree_histogram", lambda s, d: graph.degree_histogram(follow_degrees(s, d), 5), """SELECT bin, coalesce(n, 0) AS count FROM (
    SELECT CAST(unnest(range(0, (SELECT CAST(max(deg) AS BIGINT) // 5 * 5 + 1 FROM d), 5)) AS BIGINT) AS bin) LEFT JOIN (SELECT deg // 5 * 5 AS bin, count(*) AS n FROM d GROUP BY 1) USING (bin)""")
_BINS = """bins AS (SELECT CAST(least(floor(log10(k) / t * {n} + 1e-12), {n} - 1) AS INTEGER) AS bin, t, CAST(sum(count) AS BIGINT) AS count
    FROM c, (SELECT log10(max(k) + 1) AS t FROM c) WHERE k > 0 GROUP BY 1, 2),
    edged AS (SELECT *, pow(10, t * bin / {n}) AS lo, pow(10, t * (bin + 1) / {n}) AS hi FROM bins)"""
add("log_binned", lambda s, d: r6(graph.log_binned(counts(s, d), 12), "lo", "hi", "mid", "density"), "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round(sqrt(lo * hi), 6) AS mid, count, round(count / (hi - lo), 6) AS density FROM edged", (FOLLOW, _BINS.format(n=12)))
add("density_histogram", lambda s, d: r6(graph.density_histogram(counts(s, d), 8), "mid", "density"), "SELECT bin, round(sqrt(lo * hi), 6) AS mid, count, round(count / (hi - lo) / (SELECT sum(count) FROM c WHERE k > 0), 6) AS density FROM edged", (FOLLOW, _BINS.format(n=8)))
_CCDF = "tail AS (SELECT k, sum(count) OVER (ORDER BY k DESC) / sum(count) OVER () AS p FROM c), pos AS (SELECT k, p FROM tail WHERE k > 0)"
add("ccdf", lambda s, d: r6(graph.ccdf(counts(s, d)), "p"), "SELECT k, round(p, 6) AS p FROM pos", (FOLLOW, _CCDF))
add("loglog_slope", lambda s, d: r6(graph.loglog_slope(counts(s, d)), "slope"), "SELECT CASE WHEN count(*) >= 3 THEN round(regr_slope(ln(count), ln(k)), 6) END AS slope FROM c WHERE k > 0")
_LOCAL = "loc AS (SELECT k, regr_slope(ln(p), ln(k)) OVER w AS slope, count(*) OVER w AS n FROM pos WINDOW w AS (ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"
add("local_slope", lambda s, d: r6(graph.local_slope(graph.ccdf(counts(s, d))), "slope"), "SELECT k, round(slope, 6) AS slope FROM loc WHERE n = 5", (FOLLOW, _CCDF, _LOCAL))


def _er(s, d):
    n, mean, top = _shape(s, d)
    return r6(graph.er_counts(s, mean, top, n), "expected")


def _er_ccdf(s, d):
    _, mean, top = _shape(s, d)
    return r6(graph.er_ccdf(s, mean, top), "p")


def _m(mean: float) -> int:
    return max(1, int(mean / 2 + 0.5))


_MODEL = """shape AS (SELECT count(*) AS n, avg(deg) AS mean, max(deg) AS top, greatest(1, CAST(floor(avg(deg) / 2 + 0.5) AS BIGINT)) AS m FROM d),
    ks AS (SELECT unnest(range(0, (SELECT top + 1 FROM shape))) AS k),
    er AS (SELECT k, exp(sum(CASE WHEN k > 0 THEN ln(mean / k) ELSE 0 END) OVER (ORDER BY k) - mean) AS pmf FROM ks, shape),
    ert AS (SELECT k, 1 - coalesce(sum(pmf) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM er)"""
add("er_counts", _er, "SELECT k, round(pmf * n, 6) AS expected FROM er, shape", (FOLLOW, _MODEL))
add("er_ccdf", _er_ccdf, "SELECT k, round(p, 6) AS p FROM ert WHERE k > 0 AND p > 1e-12", (FOLLOW, _MODEL))


def _ba(s, d):
    n, mean, top = _shape(s, d)
    return r6(graph.ba_counts(s, _m(mean), top, n), "expected")


add("ba_counts", _ba, "SELECT k, round(2.0 * m * (m + 1) / (CAST(k AS DOUBLE) * (k + 1) * (k + 2)) * n, 6) AS expected FROM ks, shape WHERE k >= m", (FOLLOW, _MODEL))


def _ba_ccdf(s, d):
    _, mean, top = _shape(s, d)
    return r6(graph.ba_ccdf(s, _m(mean), top), "p")


add("ba_ccdf", _ba_ccdf, "SELECT k, round(CAST(m * (m + 1) AS DOUBLE) / (CAST(k AS DOUBLE) * (k + 1)), 6) AS p FROM ks, shape WHERE k >= m", (FOLLOW, _MODEL))


def _verdict(s, d):
    _, mean, top = _shape(s, d)
    out = graph.tail_verdict(graph.ccdf(counts(s, d)), graph.er_ccdf(s, mean, top), graph.ba_ccdf(s, _m(mean), top))
    return r6(out, "p_real", "p_er", "p_ba", "min_slope", "max_slope")


add("tail_verdict", _verdict, """SELECT top AS k, round(pos.p, 6) AS p_real, round(CASE WHEN ert.p > 1e-12 THEN ert.p END, 6) AS p_er,
    round(CASE WHEN top >= m THEN CAST(m * (m + 1) AS DOUBLE) / (CAST(top AS DOUBLE) * (top + 1)) END, 6) AS p_ba,
    (SELECT round(min(slope), 6) FROM loc WHERE n = 5) AS min_slope, (SELECT round(max(slope), 6) FROM loc WHERE n = 5) AS max_slope
    FROM shape JOIN pos ON pos.k = top JOIN ert ON ert.k = top""", (FOLLOW, _CCDF, _LOCAL, _MODEL))
add("hub_share", lambda s, d: r6(graph.hub_share(follow_degrees(s, d)), "hub_share"), "SELECT round(max(deg) / sum(deg), 6) AS hub_share FROM d")
add("reciprocity", lambda s, d: r6(graph.reciprocity(follow_edges(s, d)), "reciprocity"), "SELECT round(avg(CASE WHEN src <> dst AND EXISTS (SELECT 1 FROM e WHERE e.src = e0.dst AND e.dst = e0.src) THEN 1.0 ELSE 0.0 END), 6) AS reciprocity FROM e0")
add("direction_gap", lambda s, d: graph.direction_gap(follow_degrees(s, d), 8), """SELECT node, gap, 'in' AS side FROM (SELECT node, indeg - outdeg AS gap FROM d WHERE indeg + outdeg >= 5 ORDER BY gap DESC, node LIMIT 8)
    UNION ALL SELECT node, gap, 'out' FROM (SELECT node, indeg - outdeg AS gap FROM d WHERE indeg + outdeg >= 5 ORDER BY gap, node LIMIT 8)""")
add("hub_ratio", lambda s, d: r6(graph.hub_ratio(follow_degrees(s, d)), "hub_ratio"), "SELECT round(max(deg) / min(deg), 6) AS hub_ratio FROM (SELECT deg FROM d ORDER BY deg DESC, node LIMIT 2)")


def _triangles(s, d):
    pairs, nodes = follow(s, d)
    return graph.triangles_per_node(pairs, nodes)


_TRI = """t AS (SELECT x.a AS x, x.b AS y, y.b AS z FROM u x JOIN u y ON x.b = y.a JOIN u q ON q.a = x.a AND q.b = y.b),
    tn AS (SELECT node, count(*) AS tri FROM (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY node),
    per AS (SELECT node, coalesce(tri, 0) AS tri, deg, CASE WHEN deg >= 2 THEN 2.0 * coalesce(tri, 0) / (deg * (deg - 1)) ELSE 0.0 END AS cc FROM d LEFT JOIN tn USING (node))"""
add("triangles_per_node", lambda s, d: r6(_triangles(s, d), "cc"), "SELECT node, tri, deg, round(cc, 6) AS cc FROM per", (FOLLOW, _TRI))
add("clustering_summary", lambda s, d: r6(graph.clustering_summary(_triangles(s, d)), "avg_clustering", "transitivity"), """SELECT round(avg(cc), 6) AS avg_clustering, round(sum(tri) / sum(deg * (deg - 1) / 2), 6) AS transitivity,
    CAST(sum(tri) // 3 AS BIGINT) AS triangles FROM per""", (FOLLOW, _TRI))
add("friend_degree_ratio", lambda s, d: r6(graph.friend_degree_ratio(follow_degrees(s, d)), "mean_degree", "friend_mean_degree"), "SELECT round(avg(deg), 6) AS mean_degree, round(sum(deg * deg) / sum(deg), 6) AS friend_mean_degree FROM d")
_FRIENDS = "f AS (SELECT src AS node, any_value(x.deg) AS deg, avg(y.deg) AS friend_mean, max(y.deg) AS top FROM s JOIN k x ON x.node = src JOIN k y ON y.node = dst GROUP BY src)"
add("friend_gap", lambda s, d: r6(graph.friend_gap(follow(s, d)[0]), "friend_mean", "gap"), "SELECT node, deg, round(friend_mean, 6) AS friend_mean, round(friend_mean - deg, 6) AS gap FROM f", (FOLLOW, _FRIENDS))
add("friend_gap_ties", lambda s, d: r6(graph.friend_gap(follow(s, d)[0]).agg(F.max("gap").alias("top"), F.count_if(F.col("gap") > 0).alias("below"), F.count("*").alias("nodes")), "top"), "SELECT round(max(friend_mean - deg), 6) AS top, count(*) FILTER (friend_mean - deg > 0) AS below, count(*) AS nodes FROM f", (FOLLOW, _FRIENDS))
add("local_champions", lambda s, d: graph.local_champions(follow(s, d)[0]), "SELECT node, deg FROM f WHERE deg >= top", (FOLLOW, _FRIENDS))
add("sample_friend_pairs", lambda s, d: graph.sample_friend_pairs(follow(s, d)[0], 2000, 5))
add("degree_assortativity", lambda s, d: r6(graph.degree_assortativity(follow(s, d)[0]), "assortativity"), "SELECT round(corr(x.deg, y.deg), 6) AS assortativity FROM s JOIN k x ON x.node = src JOIN k y ON y.node = dst", (FOLLOW,))
add("rank_desc", lambda s, d: ranks.rank_desc(follow_degrees(s, d), ["deg", "indeg"]), "SELECT node, deg, indeg, outdeg, row_number() OVER (ORDER BY deg DESC, node) AS deg_rank, row_number() OVER (ORDER BY indeg DESC, node) AS indeg_rank FROM d")
add("top_overlap", lambda s, d: ranks.top_overlap(follow_degrees(s, d), ["deg", "indeg", "outdeg"], 20), """SELECT node FROM (SELECT node FROM d ORDER BY deg DESC, node LIMIT 20) INTERSECT SELECT node FROM (SELECT node FROM d ORDER BY indeg DESC, node LIMIT 20)
    INTERSECT SELECT node FROM (SELECT node FROM d ORDER BY outdeg DESC, node LIMIT 20)""")
add("rank_shift", lambda s, d: ranks.rank_shift(ranks.rank_desc(follow_degrees(s, d), ["outdeg", "indeg"]).select("node", "outdeg_rank", "indeg_rank"), "outdeg_rank", "indeg_rank", 40, 8), """SELECT node, o AS outdeg_rank, i AS indeg_rank, o - i AS shift FROM (
    SELECT node, row_number() OVER (ORDER BY outdeg DESC, node) AS o, row_number() OVER (ORDER BY indeg DESC, node) AS i FROM d) WHERE o <= 40 ORDER BY abs(o - i) DESC, node LIMIT 8""")
add("spearman_ordinal", lambda s, d: r6(ranks.spearman(follow_degrees(s, d), "indeg", "outdeg", "ordinal", "node"), "spearman"), "SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT row_number() OVER (ORDER BY indeg, node) AS rx, row_number() OVER (ORDER BY outdeg, node) AS ry FROM d)")
add("spearman_least", lambda s, d: r6(ranks.spearman(follow_degrees(s, d), "indeg", "outdeg", "least"), "spearman"), "SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY indeg) AS rx, rank() OVER (ORDER BY outdeg) AS ry FROM d)")
add("spearman", lambda s, d: r6(ranks.spearman(follow_degrees(s, d), "indeg", "outdeg"), "spearman"), """SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY indeg) + (count(*) OVER (PARTITION BY indeg) - 1) / 2 AS rx,
    rank() OVER (ORDER BY outdeg) + (count(*) OVER (PARTITION BY outdeg) - 1) / 2 AS ry FROM d)""")


def _gnp(s, d):
    """As many nodes as users and the follow graph's density."""
    n, mean, _ = _shape(s, d)
    return graph.random_edges_gnp(s, n, mean / max(1, n - 1), 3)


add("random_edges_gnp", _gnp)
