import os
import tempfile

from netlex.operators import dialogue
from netlex.sources import tables


def test_round_trips(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/nodes.tsv", "w") as f:
        f.write("# made by hand\nnode_id\tteam\tdecade\na\t\t1960\n\nb\t\"X\t1970\n")
    rows = tables.read_tsv(spark, f"{folder}/nodes.tsv", "node_id string, team string, decade int").collect()
    assert [tuple(r) for r in rows] == [("a", None, 1960), ("b", '"X', 1970)]
    with open(f"{folder}/articles.json", "w") as f:
        f.write('{"a": "one", "b": "two"}')
    assert dict(map(tuple, tables.read_json_map(spark, f"{folder}/articles.json").collect())) == {"a": "one", "b": "two"}
    with open(f"{folder}/lines.csv", "w") as f:
        f.write('"01x02 - T;Ann: at 11:30, then [waves]","01x02 - T;Bob: yes"\n,"01x02 - Deleted;Ann: no"\n"01x02 - T;nothing here"\n')
    parsed = dialogue.parse_lines(tables.read_transcript(spark, f"{folder}/lines.csv")).orderBy("pos").collect()
    assert [(r.conv_id, r.speaker, r.raw) for r in parsed] == [("01x02", "Ann", "at 11:30, then [waves]"), ("01x02", "Bob", "yes")]
    assert dialogue.skipped_directions(tables.read_transcript(spark, f"{folder}/lines.csv")).first().skipped == 1
    double = spark.createDataFrame([("f", 1, "03x10/11 - A Title; Ann: hi"), ("f", 2, "03x10 - A - B;[laughs]"), ("f", 3, "x;y: z"), ("f", 4, f"03x10 - T;{'n' * 41}: z"), ("f", 5, "04x02 - no body")], "file string, place int, cell string")
    assert [tuple(r)[2:] for r in dialogue.parse_lines(double).collect()] == [("Ann", "hi", 3, 10, 11, "A Title")]
    assert dialogue.skipped_directions(double).first().skipped == 3
    tables.write_table(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), f"{folder}/out", ["k"])
    assert spark.read.parquet(f"{folder}/out").count() == 2
    tables.write_report({"x": spark.range(3)}, f"{folder}/report")
    assert os.listdir(f"{folder}/report") == ["x"]


def test_cleaning(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" ann.  lee. ", "Hi [waves]  there", "It’s o'clock, don't!", "{{x\n| team = {{Plainlist}} Blue Reds\n| since = 119305 to 1931 and 1999\n}}\n2001")], "a string, b string, c string, d string")
    r = df.select(dialogue.clean_name(F.col("a")), dialogue.strip_directions(F.col("b")), dialogue.tokenize(F.col("c")), dialogue.first_listed(dialogue.infobox_field(F.col("d"), "team"), ["reds", "blue"]), dialogue.decade(dialogue.infobox_field(F.col("d"), "since"))).first()
    assert tuple(r) == ("Ann. lee", "Hi there", ["it's", "o'clock", "don't"], "reds", 1930)
    assert df.select(dialogue.clean_name(F.lit("J.D."), {"J.D": "John"}), dialogue.clean_name(F.lit("j.d. x"))).first()[:] == ("John", "J.d. x")


def test_wide_and_broken_cells(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(70))
    (tmp_path / "t.csv").write_text(f'{wide}\r\n"a\nb","say ""x"", y",\n\nlast')
    got = [r.cell for r in tables.read_transcript(spark, str(tmp_path / "t.csv")).orderBy("place").collect()]
    assert got == [*(f"c{i}" for i in range(70)), "a\nb", 'say "x", y', "last"]


def test_transcript_in_parts(spark, tmp_path):
    """Parts of 40 bytes cut records and quotes; places and cells are those of the csv module."""
    import csv
    import io
    import random

    from netlex.sources import tables

    rng = random.Random(2)
    rows = [[rng.choice(["01x02 - A;Jim: hi, there", 'say "no"\nor\n\nyes', "", " ", "plain", "x" * 60]) for _ in range(rng.randrange(1, 4))] for _ in range(60)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    (tmp_path / "one.csv").write_text(text.getvalue())
    (tmp_path / "two.csv").write_text('a,"b\r\nc"\r\nd\r\n')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((r.file.rsplit("/", 1)[1], r.place.line, r.place.k, r.cell) for r in tables.read_transcript(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [("one.csv", i, k, c) for i, row in enumerate(csv.reader(io.StringIO(text.getvalue()))) for k, c in enumerate(row) if c.strip()]
    assert got == sorted([*want, ("two.csv", 0, 0, "a"), ("two.csv", 0, 1, "b\r\nc"), ("two.csv", 1, 0, "d")])


def test_provenance_nesting_and_json_lines(spark, tmp_path):
    from netlex.sources import tables

    df = spark.createDataFrame([(2, "b", 1), (1, "a", 2), (1, "c", 1)], "k int, x string, n int")
    tables.write_table(df, str(tmp_path / "t"), ["k", "x"], provenance={"from": "test", "seed": "1"})
    back = spark.read.parquet(str(tmp_path / "t"))
    assert tables.provenance_of(back) == {"from": "test", "seed": "1"} and tables.provenance_of(df) == {}
    assert {(r.k, tuple(map(tuple, r.rows))) for r in tables.nested(df, ["k"], "rows", ["n"]).collect()} == {(1, (("c", 1), ("a", 2))), (2, (("b", 1),))}
    (tmp_path / "m.json").write_text('{"node_id": "p", "text": "one"}\n{"node_id": "q"}\n')
    assert {tuple(r) for r in tables.read_json_lines(spark, str(tmp_path / "m.json")).collect()} == {("p", "one"), ("q", None)}
