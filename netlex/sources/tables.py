"""Reading and writing of the library's text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlex.functions.shared import settle
from netlex.operators.ranges import running


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Tab-separated rows; blank lines and `#` lines are dropped; empty cells are null; quotes are ordinary characters.

    With header=False the schema names the columns (a file whose header itself is a `#` line)."""
    return spark.read.csv(path, sep="\t", comment="#", header=header, schema=schema, quote="", mode="PERMISSIVE")


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """node_id, text of files that each hold one JSON object of id to text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("node_id", "text"))


def read_json_lines(spark: SparkSession, path: str, key: str = "node_id", text: str = "text") -> DataFrame:
    """node_id, text of files with one JSON object {key: ..., text: ...} a line, which large files should have: they are read in parts."""
    rows = spark.read.schema(T.StructType([T.StructField(key, T.StringType()), T.StructField(text, T.StringType())])).json(path)
    return rows.select(F.col(key).alias("node_id"), F.col(text).alias("text"))


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """file, place (line, cell), cell: every non-blank CSV cell, with its place as the order key.

    Files are read in parts by several tasks. Whether a line begins inside quotes follows from the quotes before it in the file, and its
    number from the records before it: both are running values over range parts, so quotes that span parts are right. Line feeds inside quotes
    belong to the cell. A record comes together in one row; the widest one sets the number of cells."""
    order = ["block", "at"]
    parts = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = running(parts, ["file"], order, {"before": (F.sum, quotes.cast("long"))}, inclusive=False)
    starts = (F.coalesce("before", F.lit(0)) % 2 == 0).cast("long")
    records = running(lines.withColumn("starts", starts), ["file"], order, {"line": (F.sum, F.col("starts"))})
    whole = records.groupBy("file", (F.col("line") - 1).cast("int").alias("line")).agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("rows"))
    whole = settle(whole.select("file", "line", F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["value"]), "\n"), r"\r\z", "").alias("row")))
    cells = (whole.agg(F.max(F.length("row") - F.length(F.replace("row", F.lit(","), F.lit(""))))).first()[0] or 0) + 1
    schema = ", ".join(f"c{i} string" for i in range(cells))
    parsed = whole.select("file", "line", F.from_csv("row", schema, {"quote": '"', "escape": '"'}).alias("r"))
    listed = parsed.select("file", "line", F.posexplode(F.array(*[F.col(f"r.c{i}") for i in range(cells)])).alias("k", "cell"))
    return listed.filter(F.trim("cell") != "").select("file", F.struct("line", "k").alias("place"), "cell")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row, cast by the schema."""
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str, key: list[str], form: str = "parquet", provenance: dict[str, str] | None = None) -> None:
    """Sorted by key; as parquet, or as tab-separated text with a header in each file.

    provenance (what, from where, with which settings) stands in the metadata of the first key column; text has no place for it."""
    rows = df.sort(*key)
    if form == "tsv":
        if provenance:
            raise ValueError("tab-separated text has no metadata; write parquet")
        rows.write.csv(path, sep="\t", header=True, quote="")
        return
    if provenance:
        rows = rows.withMetadata(key[0], {"provenance": provenance})
    rows.write.format(form).save(path)


def provenance_of(df: DataFrame) -> dict[str, str]:
    """What write_table was told of the table's provenance; empty if nothing."""
    return next((dict(f.metadata["provenance"]) for f in df.schema.fields if "provenance" in f.metadata), {})


def nested(df: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """by and `name`: the other columns of each group's rows as an array of structs, in `order`; for groups that fit a row."""
    rest = [c for c in df.columns if c not in by]
    first = [*order, *(c for c in rest if c not in order)]
    rows = F.array_sort(F.collect_list(F.struct(*first)))
    return df.groupBy(*by).agg(F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in rest))).alias(name))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each section; sections of sections come from `nested`."""
    for name, df in sections.items():
        df.write.json(f"{path}/{name}")
