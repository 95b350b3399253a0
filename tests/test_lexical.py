"""Cleaning variants, equal-size samples and vectors against plain Python on a small fixture."""

import collections
import itertools
import math
import re

import pytest

from netlex.operators import dialogue, lexical, nulls

ROWS = [
    ("c1", 1, "ann", "The cat [laughs] saw THE dog, the cat; well oh"),
    ("c1", 2, "bob", "dog dog the it’s a dog cat"),
    ("c2", 1, "ann", "A bird and the dog and a cat cat cat"),
    ("c2", 2, "cy", "bird bird the the"),
    ("c2", 3, "cy", None),
    ("c3", 1, "dee", ""),
    ("c3", 2, "bob", "[walks off]"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(ROWS, "conv_id string, pos int, speaker string, text string").repartition(3)


def _tokens(text):
    return re.findall(r"[a-z]+(?:'[a-z]+)?", (text or "").lower().replace("’", "'"))


def test_variant_counts(lines):
    terms = lexical.variant_terms(lines)
    got = collections.defaultdict(dict)
    for r in terms.collect():
        got[r.variant][r.term] = r.n
    assert len(got) == 32
    for bits in itertools.product("01", repeat=5):
        low, words, bare, stop, filler = bits
        want = collections.Counter()
        for *_, text in ROWS:
            t = text or ""
            t = re.sub(r"\[[^\]]*\]", " ", t) if bare == "1" else t
            t = t.replace("’", "'")
            t = t.lower() if low == "1" else t
            for w in re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?", t) if words == "1" else t.split():
                if not (stop == "1" and w in dialogue.STOP) and not (filler == "1" and w in dialogue.FILLER):
                    want[w] += 1
        assert got["".join(bits)] == dict(want), bits
    ranked = lexical.variant_ranks(terms)
    by = collections.defaultdict(list)
    for r in ranked.collect():
        by[r.variant].append((r.rank, -r.n, r.term))
    for rows in by.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
    report = {r.variant: r for r in lexical.variant_counts(ranked, 1, 5000).collect()}
    assert all(report[v].tokens == sum(c.values()) and report[v].types == len(c) and report[v].slope <= 0 for v, c in got.items())
    ends = {(r.variant, r.rank) for r in lexical.variant_points(ranked, 5).collect()}
    assert all((v, 1) in ends and (v, len(c)) in ends for v, c in got.items())


def _cosines(counts, kind, least):
    corpus = collections.Counter()
    for c in counts.values():
        corpus.update(c)
    vec = {}
    for s, c in counts.items():
        if kind == "style":
            v = {w: n for w, n in c.items() if w in dialogue.STOP}
            v = {w: n / sum(v.values()) for w, n in v.items()}
        else:
            v = {w: float(n) for w, n in c.items() if corpus[w] >= least}
            if kind == "content":
                v = {w: n * math.log(len(counts) / sum(w in o for o in counts.values())) for w, n in v.items() if w not in dialogue.STOP + dialogue.FILLER}
        vec[s] = v
    out = {}
    for a, b in itertools.combinations(sorted(vec), 2):
        x, y = vec[a], vec[b]
        norm = math.sqrt(sum(i * i for i in x.values()) * sum(i * i for i in y.values()))
        out[a, b] = sum(x[w] * y.get(w, 0) for w in x) / norm if norm else 0.0
    return out


def test_similarities_full_and_equalized(lines):
    counts = collections.defaultdict(collections.Counter)
    for *_, s, t in ROWS:
        if _tokens(t):
            counts[s].update(_tokens(t))
    kc = dialogue.speaker_terms(lines)
    corpus = dialogue.term_counts(kc)
    full = {(r.a, r.b): r for r in lexical.pair_similarities(kc, corpus, 2).collect()}
    # Samples larger than any speaker are the whole corpus.
    drawn = {(r.a, r.b): r for r in lexical.equalized_similarity(lines, corpus, 3, 1000, 2).collect()}
    for kind in lexical.KINDS:
        for pair, want in _cosines(counts, kind, 2).items():
            for got in (full, drawn):
                assert abs((got[pair][kind] if pair in got else 0.0) - want) < 1e-9, (kind, pair)


def test_samples_have_equal_size(lines):
    got = collections.Counter()
    for r in lexical.line_samples(lines, 4, 6).collect():
        got[r.draw, r.owner] += r.n
    assert got == {(d, s): n for d in range(4) for s, n in (("ann", 6), ("bob", 6), ("cy", 4))}


def test_types_in_sample(lines):
    whole = {r.speaker: r.types for r in lexical.types_in_sample(lines, 1000, 4).collect()}
    assert whole == {s: len({w for *_, x, t in ROWS if x == s for w in _tokens(t)}) for s in ("ann", "bob", "cy")}
    one = {r.speaker: r.types for r in lexical.types_in_sample(lines, 1, 4).collect()}
    assert one == {"ann": 1.0, "bob": 1.0, "cy": 1.0}
    assert lexical.types_in_sample(lines.limit(0), 5).count() == 0


def test_padded_histogram(spark):
    samples = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 10)], "value double")
    real = spark.createDataFrame([(12.0,)], "value double")
    rows = sorted((r.bin, r.count_, r.has_real) for r in nulls.padded_histogram(samples, real, 10, 0.0).withColumnRenamed("count", "count_").collect())
    assert [r[0] for r in rows] == list(range(1, 11)) and sum(r[1] for r in rows) == 5
    assert [r[1] for r in rows] == [3, 1, 0, 0, 0, 0, 0, 0, 1, 0] and [r[0] for r in rows if r[2]] == [10]
    assert nulls.padded_histogram(samples.limit(0), real.limit(0), 10).count() == 0


def test_runs_of_tokens_cross_lines(spark):
    """Against plain lists: runs of 5 from the same starts, over lines of 3, 0 and 4 tokens, and a line without speaker."""
    texts = ["a b a", "", "c d e f", None, "a g c", "b b b"]
    df = spark.createDataFrame([("e", i, "s", t) for i, t in enumerate(texts)] + [("e", 9, None, "x y")], "conv_id string, pos long, speaker string, text string")
    words = " ".join(t or "" for t in texts).split()
    draws = spark.range(6).selectExpr("cast(id as int) k").selectExpr(f"pmod(xxhash64(1, k, 's'), {len(words) - 5}) at").collect()
    want = sum(len(set(words[r["at"] : r["at"] + 5])) for r in draws) / 6
    assert [(r.speaker, round(r.types, 9)) for r in lexical.types_in_sample(df, 5, 6).collect()] == [("s", round(want, 9))]


def test_bigrams_count_a_line_once(spark):
    df = spark.createDataFrame([("e", 0, "s", "big cat big cat"), ("e", 1, "s", "big cat"), ("e", 2, "t", "big dog"), ("e", 3, "t", None)], "conv_id string, pos long, speaker string, text string")
    phrases = spark.createDataFrame([("big", "cat"), ("big", "dog"), ("cat", "big")], "first string, second string")
    assert {tuple(r) for r in dialogue.who_says_bigrams(df, phrases).collect()} == {("big", "cat", "s", 2), ("cat", "big", "s", 1), ("big", "dog", "t", 1)}
