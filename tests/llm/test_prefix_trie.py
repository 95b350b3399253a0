"""The prefix trie against brute force: shared and single prefixes, long and turnless conversations, nulls, repeats."""

import collections
import hashlib
import random
import zlib

import pytest

from netlex.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place long, n int, d string"


def rows_of(seed=1):
    rng = random.Random(seed)
    said = [None, "", "é", "hi there", "x" * 50]
    rows = []
    for c in [*range(40), 100, 101, 1007]:
        shape = rng.randrange(4)
        talk = [(rng.choice(["user", "assistant", None]), rng.choice(said)) for _ in range(rng.randrange(1, 12))] if shape else [("user", "same"), ("assistant", "same")]
        rows += [(c, t if t else None, r, x) for t, (r, x) in enumerate(talk)]
    long = [(i, "user" if i % 2 else "assistant", f"t{i}") for i in range(130)]
    rows += [(200, *x) for x in long] + [(205, *x) for x in long[:120]] + [(206, *x) for x in [*long[:70], (70, "user", "other"), *long[71:]]]
    rows += [(45, 3, "user", "twice"), (45, 3, "user", "twice"), (None, 0, "user", "nobody's")]
    return [(*r, 7, 7, "d") for r in rows]


def ordered(rows):
    talks = collections.defaultdict(list)
    for c, t, r, x, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        talks[c].append((r or "", x or ""))
    return dict(talks)


def brute(talks):
    members = collections.defaultdict(list)
    for c, t in talks.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(talks[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(talks):
    out = {}
    for c, t in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + t[h:]
    return out


@pytest.mark.parametrize("most_cells", [1 << 16, 1 << 4])
def test_trie(spark, most_cells):
    conversations = spark.createDataFrame(rows_of(), SCHEMA).repartition(7)
    got = sorted(map(tuple, prefix_trie.trie(conversations, most_cells).collect()), key=str)
    assert got == brute(ordered(rows_of()))


def test_rebuilt(spark):
    conversations = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    got = prefix_trie.trie_of(*prefix_trie.rebuilt(prefix_trie.turn_digests(conversations)))
    talks = rebuilt(ordered(rows_of()))
    assert any(not t for t in talks.values())
    assert sorted(map(tuple, got.collect()), key=str) == brute(talks)


def test_screening_proves_tails(spark):
    conversations = spark.createDataFrame([(c, t, "user", f"{c} {t}" if t > 2 else "same") for c in range(30) for t in range(20)], "conv_id long, turn long, role string, text string").coalesce(1)
    turns = prefix_trie.turn_digests(conversations)
    hashed = turns.selectExpr("conv_id", "place + 1 as d", "xxhash64(place, t1) as p1", "xxhash64(place, t2, conv_id * int(place > 2)) as p2")
    marked = prefix_trie.screened(hashed.repartitionByRange(3, "conv_id").sortWithinPartitions("conv_id", "d"))
    assert marked.filter("tail").count() == 30 * 16 and marked.filter("tail").agg({"d": "min"}).first()[0] == 5


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(none).count() == 0
    # All turns are replaced by those of an absent conversation: only the root is left.
    one = spark.createDataFrame([(c, 0, "user", "x") for c in (1, 2, 3, 4) if zlib.crc32(str(c).encode()) % 9], "conv_id long, turn long, role string, text string")
    ids = [r.conv_id for r in one.collect()]
    got = prefix_trie.trie_of(*prefix_trie.rebuilt(prefix_trie.turn_digests(one))).collect()
    assert [tuple(r) for r in got] == [(min(ids), 0, None, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())]


def test_conversations_over_many_parts(spark):
    # Small parts are merged by adaptive execution, so only without that does a conversation span several of them.
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("false", "37"), strict=True):
            spark.conf.set(n, v)
        test_rebuilt(spark)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_equal_turns_in_the_order_of_their_texts(spark):
    rows = [(c, t, r, x) for c in range(12) for t in (None, 3) for r in (None, "", "user") for x in (f"b{c}", "a", None, "", "é")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    key = lambda x: (x is not None, x if x is not None else 0)
    said = lambda x: (x is not None, (x or "").encode())
    talks = {c: [(r or "", x or "") for _, _, r, x in sorted((row for row in rows if row[0] == c), key=lambda row: (key(row[1]), said(row[2]), said(row[3])))] for c in range(12)}
    got = prefix_trie.trie(conversations).collect()
    assert sorted(map(tuple, got), key=str) == brute(talks)
