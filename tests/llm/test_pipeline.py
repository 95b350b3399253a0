"""The pipeline's stages on the smallest tables, each held against brute force on its own input."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netlex.llm import decontaminate, simhash
from netlex.llm._common import table, written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs, out = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name.replace(" ", "_"))
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_columns(spark, stages):
    first = table(spark, DATA, "documents")
    assert all(s.columns == first.columns and s.dtypes == first.dtypes for s in stages[:-1])


def test_quality_keeps_good_and_drops_bad(spark, stages):
    kept, labels = set(texts(stages[0])), table(spark, DATA, "labels").collect()
    good, bad = ({r.doc_id for r in labels if r.quality == q} for q in (1, 0))
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_near_duplicates(stages):
    before, kept = texts(stages[0]), set(texts(stages[1]))
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in before.items()}
    least = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        old = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if old == least:
            break
    copies = {i for i in least if least[i] != i}
    gone = set(before) - kept
    assert gone == copies
    equal = {i for i, t in before.items() if any(u == t and j < i for j, u in before.items())}
    assert equal <= gone


def test_repeated_strings(stages):
    before, after, n = texts(stages[1]), texts(stages[2]), corpus_pipeline.REPEAT
    seen: dict[bytes, int] = {}
    for t in before.values():
        b = t.encode()
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    for i, t in before.items():
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\x01" * n
        # Characters go if all their bytes do.
        kept, at = [], 0
        for c in t:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        assert after[i] == "".join(kept)


def test_decontaminated(spark, stages):
    plain = lambda t: b" ".join(decontaminate.words(t.encode()))
    items = [plain(r.text) for r in table(spark, DATA, "benchmark").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    leaking = {i for i, t in before.items() if any(x in plain(t) for x in items)}
    assert leaking and not leaking & set(after)
    # Beyond whole items, only near copies of them go.
    assert len(set(before) - set(after) - leaking) <= 0.02 * len(before)


def test_packed(stages):
    rows = stages[4].collect()
    assert {r.doc_id for r in rows} == set(texts(stages[3]))
    assert len({(r.bucket_tokens, r.batch, r.place) for r in rows}) == len(rows)


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    import random

    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c, item = text(), text(), text(), text()
    docs = spark.createDataFrame([(None, a), (None, a), (4, b), (4, b), (4, c), (7, a), (None, c + " " + item), (8, item + " x")], "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(7, a), (4, b), (4, c), (0, c + " " + item), (8, item + " x")])
    clean = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in clean) == sorted([a, a, a, b, b, c])


def test_extra_columns_keep_their_values(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 11, True, 5, "a"), (1, text + " more words here", 12, False, 6, "b"), (2, text, 13, None, 7, "c"), (3, "else", 14, True, 8, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, repeated boolean, repeated_id int, Odd string").withColumn("id_", F.lit(1))
    out = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    again = corpus_pipeline.decontaminated(spark, docs, DATA)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))
    good = corpus_pipeline.quality_rules(spark, docs.withColumn("Statistics", F.lit(2)), DATA)
    assert good.columns == [*docs.columns, "Statistics"]


def test_learning_is_bounded_by_rows(spark):
    from netlex.llm import quality

    docs = spark.range(5000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = quality.statistics(docs.union(spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.lit("good text.").alias("text"))))
    known = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    seen, fit = [], quality.fit
    quality.fit = lambda x, y, **o: (seen.append(len(x)), fit(x, y, **o))[1]
    try:
        quality.learn(rows, known, max_rows=100)
    finally:
        quality.fit = fit
    assert seen and seen[0] <= 100


def test_hot_keys_stay_few(spark, monkeypatch):
    from netlex.llm import _windows

    monkeypatch.setattr(_windows, "HOT_ROWS", 3)
    monkeypatch.setattr(_windows, "MOST_HOT", 5)
    # Every key has more than HOT_ROWS rows: only those with a fifth of all or more may be hot.
    rows = written(spark.createDataFrame([(k, i) for k, n in [(1, 400), (2, 4), (3, 5), (4, 1), (5, 90)] for i in range(n)], "key long, i long"), "rows")
    got = _windows.repeating(rows, F.count(F.lit(1)), {"most": F.max("i")})
    assert sorted(map(tuple, got.groupBy("key").agg(F.count("*"), F.max("most")).collect())) == [(1, 400, 399), (2, 4, 3), (3, 5, 4), (5, 90, 89)]
    assert _windows.hot_cut(10_000) == 2_000


def test_crowded_near_copies(spark):
    """A large group of near copies, and texts just under the similarity: every pair at 0.8 or more is linked, others not."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]

    def changed(share):
        return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base)

    rows = [(i, changed(0.004)) for i in range(120)] + [(500 + i, changed(0.02 + 0.0004 * i)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    least = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least and 2 < len(set(least.values())) < 120


def test_hot_segments_give_the_same(spark, monkeypatch):
    """With nearly every key hot, op5's and op10's results are those without hot keys."""
    from netlex.llm import _windows, substring_dedup, suffix_dedup

    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, f"a{i} " * 12 + shared + f" b{i}" * 9) for i in range(12)] + [(50 + i, shared) for i in range(6)] + [(60, shared + " x " + shared), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    strings = lambda: sorted(map(str, suffix_dedup.dedup(docs, 60, 16, shorter=(40, 21)).collect()))
    words = lambda: sorted(map(str, substring_dedup.dedup(docs, 10, 3).collect()))
    want = strings(), words()
    monkeypatch.setattr(_windows, "HOT_ROWS", 2)
    assert (strings(), words()) == want
