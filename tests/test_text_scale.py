"""Text statistics that count pieces or buckets first, against plain Python; and what they hold on the way."""

import collections
import random
import re

import pytest

from netlex.operators import communities, dialogue, flow, lexical

WORDS = ["the", "Cat", "cat", "dog's", "oh", "[sighs]", "É", "x1", "it’s", "ΣΑΣ", "of", "in", "end[a", "b]c"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [(f"c{i % 3}", i, f"s{i % 4}", rng.choice([" ", "\t", "\n", " "]).join(rng.choices(WORDS, k=rng.randrange(40)))) for i in range(60)]


@pytest.fixture(scope="module")
def lines(spark, texts):
    return spark.createDataFrame(texts, "conv_id string, pos int, speaker string, text string").repartition(3)


def held_by(monkeypatch, module):
    held, settle = [], module.settle
    monkeypatch.setattr(module, "settle", lambda df: held.append((df, settle(df))) or held[-1][1])
    return held


def tokens(text):
    return re.findall(r"[a-z]+(?:'[a-z]+)?", text.lower().replace("’", "'"))


def test_variants_count_pieces_and_sort_few(monkeypatch, lines, texts):
    held = held_by(monkeypatch, lexical)
    terms = lexical.variant_terms(lines)
    pieces = {p for *_, text in texts for p in re.findall(r"[^ \t\n\r\f\x0B]+", text.replace("’", "'"))}
    assert held[0][1].filter("sort <> '1'").select("piece").distinct().count() == len(pieces)
    ranked = collections.defaultdict(dict)
    for r in lexical.variant_ranks(terms).collect():
        ranked[r.variant][r.rank] = (r.term, r.n)
    top = {(r.variant, r.rank): (r.term, r.n) for r in lexical.variant_top(terms, 4).collect()}
    assert top == {(v, i): x for v, rows in ranked.items() for i, x in rows.items() if i <= 4}
    points = {(r.variant, r.rank): (r.term, r.n) for r in lexical.variant_points(terms, 6).collect()}
    assert points and all(ranked[v][i] == x for (v, i), x in points.items()) and {(v, len(rows)) for v, rows in ranked.items()} <= set(points)
    found = {r.variant: (r.tokens, r.types) for r in lexical.variant_counts(terms, 1, 5).collect()}
    assert found == {v: (sum(n for _, n in rows.values()), len(rows)) for v, rows in ranked.items()}


def test_stages_count_pieces(monkeypatch, lines, texts):
    held = held_by(monkeypatch, dialogue)
    got = {r.stage: (r.tokens, r.types) for r in dialogue.stage_counts(lines).collect()}
    assert len(held) == 1
    stages = [[w for *_, t in texts for w in t.split()], [w for *_, t in texts for w in t.lower().split()], [w for *_, t in texts for w in tokens(t)]]
    stages.append([w for *_, t in texts for w in tokens(re.sub(r"\[[^\]]*\]", " ", t))])
    stages.append([w for w in stages[3] if w not in dialogue.STOP])
    stages.append([w for w in stages[4] if w not in dialogue.FILLER])
    assert got == {i: (len(s), len(set(s))) for i, s in enumerate(stages)}


def test_trigrams_of_full_buckets(monkeypatch, lines, texts):
    counts = collections.Counter(" ".join(t[i : i + 3]) for *_, text in texts for t in [tokens(text)] for i in range(len(t) - 2))
    low = set(dialogue.STOP + dialogue.FILLER)
    for buckets, pool in ((7, 5), (1 << 10, 40), (1 << 10, 10_000)):
        monkeypatch.setattr(dialogue, "BUCKETS", buckets)
        monkeypatch.setattr(dialogue, "FULLEST", 2)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:pool]
        want = [x for x in best if sum(w in low for w in x[0].split()) <= 1][:4]
        assert [tuple(r) for r in dialogue.trigrams(lines, pool, 4).collect()] == want


def test_bigrams_are_counted_once(monkeypatch, lines):
    held = held_by(monkeypatch, dialogue)
    assert dialogue.bigram_g2(lines, 2).count() and len(held) == 1


def test_heaps_sorts_no_tokens(lines):
    plan = dialogue.heaps_curve(lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_similarities_join_a_term_once(monkeypatch, lines):
    held = held_by(monkeypatch, lexical)
    kc = dialogue.speaker_terms(lines)
    assert lexical.pair_similarities(kc, dialogue.term_counts(kc), 2).count() == 6
    assert len(held) == 1 and held[0][1].count() == held[0][1].select("owner", "term").distinct().count()


def test_louvain_sweeps_shuffle_little(spark, monkeypatch):
    rng = random.Random(3)
    pairs = spark.createDataFrame(sorted({(a, b, 1 + (a + b) % 3) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(150))}), "a long, b long, weight long")
    held = held_by(monkeypatch, communities)
    communities.louvain(pairs, sweeps=2, levels=1)
    plans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0] for df, _ in held if "went" in df.columns]
    assert plans and all(len(re.findall(r"Exchange hashpartitioning", p)) <= 5 for p in plans)


def test_undirected_search_reads_two_levels(spark, monkeypatch):
    links = [(i, i + 1) for i in range(11)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "src long, dst long")
    seen, met = [], flow._met
    monkeypatch.setattr(flow, "_met", lambda tiles, old, front, lone: (seen.append(old.count()) if not lone else None) or met(tiles, old, front, lone))
    got = {r.node: r.delta for r in flow.dependency_sums(edges, spark.range(1).withColumnRenamed("id", "node")).collect()}
    assert got == {i: 11.0 - i for i in range(1, 12)} and max(seen) <= 2
