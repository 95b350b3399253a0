"""Spelling variants against brute force: edits of every kind, ties, chains, hot cells in several blocks, edge cases."""

import collections
import random
import re
import zlib

import pytest

from netlex.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, cell long, block int"


def edits(w, alphabet):
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in alphabet)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in alphabet)


def brute(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k > 1 and len(w) >= 7}
    alphabet = sorted(set("".join(n)))
    near = {w: {e for e in edits(w, alphabet) if e in n and e != w} for w in n if len(w) < 5000}
    form = {}
    for w in n:
        best = min(near.get(w, ()), key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near.get(w, ())), n[form[w]] if w in form else None))
    return out


def rows_of():
    rng = random.Random(3)
    base = ["lettering", "kitchens", "überkeit", "STRASSEN", "naïvetés", "aaaaaaa", "abcdefgh", "hgfedcba"]
    words = list(base)
    for w in base:
        words += rng.sample(sorted(set(edits(w, "abtüß"))), 12)
    rows = [(i, " ".join(rng.choice(base if rng.random() < 0.9 else words) for _ in range(120)) + "...x1y") for i in range(40)]
    # Chains: 200 times, 20 times, twice.
    rows += [(100 + i, "abcdefghi " * 5) for i in range(40)] + [(200 + i, "abcdefghij " * 2) for i in range(10)] + [(300, "abcdefghijk"), (301, "abcdefghijk")]
    long = "z" * 60_000
    return [*rows, (400, None), (None, "lettering lettering"), (401, ""), (404, f"{long} {long}"), (404, f"{long}q"), (405, f"{long}q {long}q"), rows[0]]


@pytest.mark.parametrize("block", [2048, 3])
def test_spelling(spark, block):
    docs = spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows_of()], SCHEMA).repartition(4)
    got = [tuple(r) for r in spelling.variants(spelling.words(docs), block=block).collect()]
    want = brute(rows_of())
    long = {w for w, *_ in want if len(w) > 5000}
    assert {r for r in got if r[0] not in long} == {r for r in want if r[0] not in long} and len(got) == len(want)
    # The long ones: one letter apart, nothing else near.
    assert {r[0]: r[4] for r in got if r[0] in long} == dict.fromkeys(long, len(long) - 1) and len(long) == 2
    assert any(f and r != f for _, f, r, *_ in want)


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short words only here", "w", 1, 1, 1)], SCHEMA)).count() == 0
