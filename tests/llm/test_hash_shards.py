"""The hash tree: its laws, weights, slots, and edge cases."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from netlex.llm import hash_shards

SCHEMA = "doc_id long, text string, shard string, part int, n int, line long"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(None, "x", "s", 1, 1, 1), (None, None, "s", 1, 1, 1), (3, "é" * 90_000, "s", 1, 1, 1), (4, "", "s", 1, 1, 1), (4, "other", "s", 1, 1, 1)]
    return spark.createDataFrame(odd + [odd[2]] + [(i, f"text {i % 50}", "s", 1, 1, 1) for i in range(10, 4010)], SCHEMA).repartition(5)


def least(key, children):
    draw = lambda c, w: -math.log((int(hashlib.md5(f"{key}/{c}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w
    return min(children, key=lambda c: draw(*children[c]))


def brute(key, tree):
    total = lambda *at: sum(w for k, w in tree.items() if k[: len(at)] == at)
    r = least(key, {r: (f"region {r}", total(r)) for r, _, _ in tree})
    k = least(key, {k: (f"region {r} rack {k}", total(r, k)) for q, k, _ in tree if q == r})
    return least(key, {s: (f"shard {s}", w) for (q, p, s), w in tree.items() if (q, p) == (r, k)})


def test_shard(spark, docs):
    rows = hash_shards.shard(docs).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"key"}
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert texts == collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    small, grown = hash_shards.layout(24), hash_shards.layout(25)
    slots = collections.defaultdict(list)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute(key, small) and r.grown_shard == brute(key, grown) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
    assert set(slots) == set(range(24)) and 80 < sum(r.grown_shard == 24 for r in rows) < 260
    for s in slots.values():
        assert [x for x, _ in sorted(s)] == list(range(len(s))) and [d for _, d in sorted(s)] == sorted(d for _, d in s)
    assert hash_shards.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_growth_moves_into_the_new_shard_only(docs):
    out = docs
    for n in (24, 25, 26, 27):
        out = hash_shards.descend(out, hash_shards.layout(n), f"at_{n}")
    for n in (24, 25, 26):
        assert out.filter((F.col(f"at_{n}") != F.col(f"at_{n + 1}")) & (F.col(f"at_{n + 1}") != n)).count() == 0


def test_changed_weight_moves_within_its_subtrees(docs):
    before, after = hash_shards.layout(24), dict(hash_shards.layout(24))
    changed = next(k for k in after if k[0] == 1)
    after[changed] = 3.0
    out = hash_shards.descend(hash_shards.descend(docs, before, "x"), after, "y")
    region = {s: r for r, _, s in before}
    moved = [(r.x, r.y) for r in out.filter("x <> y").select("x", "y").collect()]
    assert moved and all(region[y] == 1 for _, y in moved)
    share = out.filter(F.col("y") == changed[2]).count() / docs.count()
    assert 0.09 < share < 0.14  # 3 of 26


def test_write_shards(docs, tmp_path):
    back = hash_shards.write_shards(docs, str(tmp_path / "out"), hash_shards.layout(24))
    assert back.count() == docs.count() and len(list((tmp_path / "out").glob("shard_number=*"))) == 24


def test_fewer_shards_than_base():
    with pytest.raises(ValueError):
        hash_shards.layout(23)
