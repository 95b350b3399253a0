"""Queries on the smallest tables and operators on made ones against plain Python, where SQL has no form: op2, op3, op4, op7."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from netlex.llm import decontaminate, packing, queries
from netlex.llm._common import table

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}


@needs_tables
def test_token_output(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer())
    want, start = [], 0
    for i, t in sorted(texts(spark).items()):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_simple8b_token_output(spark, DATA).collect())
    assert got == want


@needs_tables
def test_media_columns(spark):
    rows = {r.doc_id: r for r in queries.op4_flac_media(spark, DATA).collect()}
    features = collections.defaultdict(set)
    for i, t in texts(spark).items():
        raw = t.encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        features[t].add((r.media_bytes, r.media_sha256, r.feature))
    assert len(rows) == len(texts(spark)) and all(len(x) == 1 for x in features.values())


def plain_pack(sizes, buckets, step, most, budget):
    pieces = []
    for doc, n in sizes:
        k = max(1, -(-n // most))
        pieces += [(doc, i, min(most, n - i * most)) for i in range(k)]
    cell = lambda n: max(step, -(-n // step) * step)
    cells = sorted({cell(n) for *_, n in pieces})
    count = collections.Counter(cell(n) for *_, n in pieces)
    # All ways to choose boundaries.
    import itertools

    best = None
    for k in range(min(buckets, len(cells))):
        for inner in itertools.combinations(cells[:-1], k):
            ends = [*inner, cells[-1]]
            cost = sum(c * (min(e for e in ends if e >= x) - x) for x, c in count.items())
            best = min(best, cost) if best is not None else cost
    return pieces, best, cell


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_against_all_choices(spark, seed):
    rng = random.Random(seed)
    # Ties in length, ids that repeat with equal and other lengths, null ids, empty texts, texts over the limit.
    sizes = [(i % 40, rng.choice([0, 1, 8, 9, 16, 17, 40, 41, 63, 64, 65, 200])) for i in range(90)] + [(None, 5), (None, 5), (3, 7), (3, 7)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(5), buckets=3, step=8, max_tokens=64, budget=256).collect()
    pieces, best, cell = plain_pack(sizes, 3, 8, 64, 256)
    assert collections.Counter((r.doc_id, r.piece, r.n_tokens) for r in rows) == collections.Counter(pieces)
    assert len({r.bucket_tokens for r in rows}) <= 3 and sum(r.bucket_tokens - cell(r.n_tokens) for r in rows) == best
    full = collections.defaultdict(list)
    for r in rows:
        assert r.bucket_tokens >= r.n_tokens
        full[r.bucket_tokens].append((r.batch, r.place))
    for size, places in full.items():
        n = 256 // size
        assert sorted(places) == [(i // n, i % n) for i in range(len(places))]


def reworded(words, share, vocabulary, rng):
    """Words replaced in place by others of the corpus, the answer's last ones kept."""
    return [w if rng.random() > share or i >= len(words) - 3 else rng.choice(vocabulary) for i, w in enumerate(words)]


@pytest.mark.parametrize("length", [24, 48, 120])
def test_recall_of_rewordings(spark, length):
    """Items of several lengths in two groups; copies of which 10 to 30 % of the words are others: at least nine of ten are found."""
    rng = random.Random(length)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(4000)]
    weights = [1 / (i + 10) for i in range(4000)]
    noise = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [(i, [*noise(length), "The", "answer", "is", *rng.choices(vocabulary, k=3)]) for i in range(60)]
    docs, planted = [(i, " ".join(noise(260))) for i in range(150)], {}
    for k, (i, words) in enumerate(items):
        for share in (0.1, 0.2, 0.3):
            planted[len(docs)] = (i, share)
            docs.append((len(docs), " ".join(noise(60) + reworded(words, share, vocabulary, rng) + noise(60))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, max_items=40).collect()}
    found = collections.Counter(share for d, (i, share) in planted.items() if (d, i) in got)
    print("RECALL", length, {s: n / 60 for s, n in sorted(found.items())}, "clean", len({d for d, _ in got} - set(planted)))
    assert all(found[s] >= 54 for s in (0.1, 0.2, 0.3)) and not {d for d, _ in got} - set(planted)
