"""The given tables as graph and utterance inputs, in Spark and as common table expressions of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlex.operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def follow_edges(spark: SparkSession, sf_dir: str, kind: str | None = "purchase") -> DataFrame:
    """src, dst: each user's event is followed by the next one's of the same day; raw, with loops and duplicates."""
    events = table(spark, sf_dir, "events")
    if kind:
        events = events.filter(F.col("event_type") == kind)
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst")).filter("dst is not null")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct()


def follow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b, nodes) of the follow graph."""
    nodes = users(spark, sf_dir)
    return graph.undirect(graph.clean_edges(follow_edges(spark, sf_dir), nodes)), nodes


def follow_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = users(spark, sf_dir)
    return graph.degrees(graph.clean_edges(follow_edges(spark, sf_dir), nodes), nodes)


def coreturn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a < b, weight: parts returned in the same order, by number of orders."""
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("p")).distinct()
    pairs = back.select("l_orderkey", F.col("p").alias("a")).join(back.select("l_orderkey", F.col("p").alias("b")), "l_orderkey").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, pos, speaker, text: documents as utterances of their source, grouped by language."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("pos"), F.col("source").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


#: e0: raw edges; v: nodes; e: clean distinct edges; u: pairs; s: both orientations; d: degrees.
FOLLOW = """
e0 AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst
       FROM events WHERE event_type = 'purchase') WHERE dst IS NOT NULL),
v AS (SELECT DISTINCT user_id AS node FROM events),
e AS (SELECT DISTINCT src, dst FROM e0 WHERE src <> dst),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
s AS (SELECT a AS src, b AS dst FROM u UNION ALL SELECT b, a FROM u),
k AS (SELECT src AS node, count(*) AS deg FROM s GROUP BY src),
d AS (SELECT node, coalesce(deg, 0) AS deg, coalesce(i, 0) AS indeg, coalesce(o, 0) AS outdeg FROM v LEFT JOIN k USING (node)
      LEFT JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst) USING (node)
      LEFT JOIN (SELECT src AS node, count(*) AS o FROM e GROUP BY src) USING (node)),
c AS (SELECT deg AS k, count(*) AS count FROM d GROUP BY deg)"""

CORETURN = """
r AS (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
w AS (SELECT x.p AS a, y.p AS b, count(*) AS weight FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.p < y.p GROUP BY 1, 2),
ws AS (SELECT a AS src, b AS dst, weight FROM w UNION ALL SELECT b, a, weight FROM w),
wk AS (SELECT src AS node, CAST(sum(weight) AS BIGINT) AS strength, count(*) AS deg FROM ws GROUP BY src)"""

LINES = """
l AS (SELECT lang AS conv_id, doc_id AS pos, source AS speaker, coalesce(text, '') AS text FROM documents)"""

CHATS = """
l AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn AS pos, role AS speaker, coalesce(text, '') AS text FROM conversations)"""

#: kt: tokens of l, one row each; kc: their counts by speaker; kw: counts in the corpus.
TOKENS = """
kt AS (SELECT conv_id, pos, speaker, unnest(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?')) AS term FROM l),
kc AS (SELECT speaker AS owner, term, count(*) AS n FROM kt GROUP BY 1, 2),
kw AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM kc GROUP BY 1)"""


def sql(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}\n{select}"
