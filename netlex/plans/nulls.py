"""Queries on null models."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators import graph, lexical, null_models, nulls
from netlex.operators.communities import attribute_assortativity
from netlex.plans.communities import _labels
from netlex.plans.graphs import r6
from netlex.plans.inputs import FOLLOW, follow, follow_degrees, follow_edges, lines, sql, users
from netlex.plans.text import pair_values, predictors
from netlex.plans.traversal import LEVELS, levels

QUERIES, SQL = {}, {}

QUERIES["rewired_edges"] = lambda s, d: nulls.rewire(follow(s, d)[0], 2, swaps_per_edge=10)
QUERIES["label_shuffle"] = lambda s, d: nulls.label_shuffle(_labels(s, d), 5)
QUERIES["homophily"] = lambda s, d: r6(nulls.homophily(follow(s, d)[0], _labels(s, d), 1000), "real", "mean", "sd", "z", "p")


def _histogram(s, d):
    pairs, labels = follow(s, d)[0], _labels(s, d)
    value = lambda df: df.withColumnRenamed("assortativity", "value")
    samples = value(nulls.shuffled_assortativity(pairs, labels, 1000))
    return r6(nulls.padded_histogram(samples, value(attribute_assortativity(pairs, labels))), "low", "high")


QUERIES["null_histogram"] = _histogram


def _mantel(s, d):
    """Nine tests: three kinds of similarity on samples of equal size against three measures of talk, among speakers of 2,000 tokens or more."""
    from netlex.operators import dialogue

    every = settle(lines(s, d))
    core = settle(dialogue.core_speakers(every))
    said = every.join(core, "speaker", "left_semi").select(every.columns)
    kc = dialogue.speaker_terms(every)
    alike = lexical.equalized_similarity(said, dialogue.term_counts(kc))
    talk = settle(dialogue.pair_table(dialogue.talk_lift(dialogue.turn_network(every), core), dialogue.episode_jaccard(said), alike))
    tests = nulls.mantel_tests(predictors(talk), {k: pair_values(talk, k) for k in lexical.KINDS}, core.withColumnRenamed("speaker", "node"), 1999)
    return r6(tests, "real", "mean", "sd", "z", "p")


QUERIES["mantel"] = _mantel
QUERIES["rewired_arcs"] = lambda s, d: nulls.rewire(graph.clean_edges(follow_edges(s, d), users(s, d)).select(F.col("src").alias("a"), F.col("dst").alias("b")), 2, directed=True)
QUERIES["shuffle_test"] = lambda s, d: r6(null_models.shuffle_test(*follow(s, d), graph.clean_edges(follow_edges(s, d), users(s, d)), 20), "real", "mean", "sd", "z")
QUERIES["centrality_null"] = lambda s, d: r6(null_models.centrality_null(*follow(s, d)), "real", "mean", "sd", "z", "ratio")
QUERIES["broker_lists"] = lambda s, d: r6(null_models.broker_lists(null_models.centrality_null(*follow(s, d)), follow_degrees(s, d)), "z")
QUERIES["clique_null"] = lambda s, d: r6(null_models.clique_null(*follow(s, d), 200, 5), "mean", "sd")
QUERIES["model_ledger"] = lambda s, d: r6(null_models.model_ledger({"purchases": follow(s, d)[0]}, users(s, d)), "value")
QUERIES["verdict_counts"] = lambda s, d: r6(null_models.verdict_counts(null_models.centrality_null(*follow(s, d))), "least_ratio", "most_ratio")
SQL["model_ledger"] = sql(
    [FOLLOW, levels("s", "bl", LEVELS), """walk AS (SELECT node AS root, node FROM v UNION SELECT root, dst FROM walk JOIN s ON src = node),
    tr AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM u p JOIN u q ON q.a = p.b JOIN u r ON r.a = p.a AND r.b = q.b),
    tn AS (SELECT node, count(*) AS t FROM (SELECT unnest([x, y, z]) AS node FROM tr) GROUP BY 1),
    cc AS (SELECT CASE WHEN deg >= 2 THEN 2.0 * coalesce(t, 0) / (deg * (deg - 1)) ELSE 0 END AS c FROM d LEFT JOIN tn USING (node))"""],
    """SELECT 'purchases' AS name, statistic, round(value, 6) AS value FROM (SELECT 'clustering' AS statistic, (SELECT avg(c) FROM cc) AS value UNION ALL SELECT 'triangles', (SELECT CAST(count(*) AS DOUBLE) FROM tr)
    UNION ALL SELECT 'components', (SELECT CAST(count(DISTINCT c) AS DOUBLE) FROM (SELECT min(root) AS c FROM walk GROUP BY node)) UNION ALL SELECT 'hub_share', (SELECT max(deg) / sum(deg) FROM d)
    UNION ALL SELECT 'assortativity', (SELECT corr(x.deg, y.deg) FROM s JOIN d x ON x.node = src JOIN d y ON y.node = dst)
    UNION ALL SELECT 'n', (SELECT CAST(count(*) AS DOUBLE) FROM v) UNION ALL SELECT 'm', (SELECT CAST(count(*) AS DOUBLE) FROM u) UNION ALL SELECT 'mean_degree', (SELECT avg(deg) FROM d) UNION ALL SELECT 'max_degree', (SELECT CAST(max(deg) AS DOUBLE) FROM d)
    UNION ALL SELECT 'gamma', (SELECT CASE WHEN count(*) >= 3 THEN 1 - regr_slope(ln(count), ln(k)) END FROM c WHERE k > 0) UNION ALL SELECT 'path_length', (SELECT avg(dist) FROM bl WHERE dist > 0))""", True)
