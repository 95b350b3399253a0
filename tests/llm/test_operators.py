"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, clashing names."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlex.llm import _windows, chat, decontaminate, flac, licenses, packing, quality, simhash, substring_dedup, suffix_dedup, token_output

SCHEMA = "doc_id long, text string, key string, h int, seg string, n long, label int"


def rows_of(seed=0, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ß,", "end.\nNext"]
    body = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, one = body(90), body(words)
    texts = [None, "", "   ", "x", one, one, body(40) + " " + shared + " " + body(10), shared, "ab " * 400, body(3000), one + " tail", shared[3:] + body(30)]
    rows = [(i, t, "k", 1, "s", 2, 0) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, shared, "k", 1, "s", 2, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_strings(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(60, 16), (40, 40)])
def test_suffix_array_dedup(docs, empty, length, gram):
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, length, gram, whole_characters=False).collect()]
    assert sorted(got) == sorted(brute_strings([(r[1] or "").encode() for r in rows_of()], length))
    assert suffix_dedup.dedup(empty, length, gram).count() == 0
    again = suffix_dedup.rewrite(docs, length, gram)
    assert again.columns == docs.columns and again.count() == docs.count()


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(100):
        data = bytes(rng.choice([97, 98, 0, 255]) for _ in range(rng.randint(1, 80)))
        text = np.frombuffer(data, np.uint8)
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        plcp, before = suffix_dedup.permuted_prefixes(text, sa)
        for i, j in enumerate(before.tolist()):
            if j >= 0:
                assert plcp[i] == len(os.path.commonprefix([data[i:], data[j:]]))


def test_induced_order_of_integers():
    rng = random.Random(2)
    for _ in range(300):
        top = rng.choice([1, 2, 5, 40])
        x = [rng.randrange(top) for _ in range(rng.randint(0, 60))]
        assert suffix_dedup.induced_order(x) == sorted(range(len(x)), key=lambda i: x[i:])


def hot_rows(seed=5, n=60):
    """A passage, or most of one, in every document, with others' words around it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    hot = [word() for _ in range(50)]
    rows = []
    for i in range(n):
        cut = hot[rng.randint(0, 12) : 50 - rng.randint(0, 12)]
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 30))] + cut + [word() for _ in range(rng.randint(0, 30))])))
    return rows + [(n + i, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize("shard", [1, 3000])
def test_segments_of_a_hot_key_are_split(spark, monkeypatch, shard):
    monkeypatch.setattr(_windows.resolved, "__defaults__", (shard,))
    rows = hot_rows()
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.dedup(some, 100, 24, whole_characters=False, shorter=(40, 21), most=shard).collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert sorted(got) == sorted(brute_strings([t.encode() for _, t in rows], 100))
    texts = dict(rows)
    long, short = (dict(zip(texts, brute_strings([t.encode() for t in texts.values()], n), strict=True)) for n in (60, 40))
    assert all((r.n_shared > 0) >= (long[r.doc_id][1] > 0) and (r.n_shared > 0) <= (short[r.doc_id][1] > 0) for r in found)
    got = [(r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(some, 12, 4).collect()]
    assert sorted(got) == sorted(brute_words(rows, 12))


def test_long_texts_are_taken_in_pieces():
    values = _windows.byte_units(os.urandom(3000) + b"ab" * 500)
    whole = [np.concatenate(x) for x in zip(*_windows.segments_of([values], 60, 20), strict=True)]
    parts = [np.concatenate(x) for x in zip(*_windows.segments_of([values], 60, 20, chunk=257), strict=True)]
    spread = lambda s: {int(a) + i: int(k) for a, n, k in zip(s[1], s[2], s[3], strict=True) for i in range(int(n))}
    assert spread(whole) == spread(parts) and len(spread(whole)) == len(values) - 59


def brute_words(rows, length):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for r in order:
        words = (r[1] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            k = tuple(words[i : i + length])
            if k in seen:
                gone[i : i + length] = [True] * length
            seen.add(k)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[r[0]] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return [out[r[0]] for r in rows]


@pytest.mark.parametrize(("length", "gram"), [(20, 5), (6, 2)])
def test_suffix_tree_dedup(docs, empty, length, gram):
    got = [(r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs, length, gram).collect()]
    assert sorted(got) == sorted(brute_words([r[:2] for r in rows_of()], length))
    assert substring_dedup.dedup(empty, length, gram).count() == 0


def test_suffix_tree_groups_by_prefix():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    starts = np.arange(391)
    want = [min(j for j in starts.tolist() if words[j : j + 10].tolist() == words[i : i + 10].tolist()) for i in starts.tolist()]
    for most in (10, 50, 10_000):
        assert substring_dedup.deep_nodes(words, starts, 10, most=most).tolist() == want


def test_simhash(docs, empty):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, size=3, threshold=2).collect()}
    fps = {}
    for i, t, *_ in rows_of():
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [simhash.xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in fps}
    for _ in fps:
        for a, b in itertools.product(fps, fps):
            if a is not None and b is not None and (fps[a] ^ fps[b]).bit_count() <= 2:
                least[a] = min(least[a], least[b])
    for a in fps:
        if a is None:
            least[a] = min(least[b] for b in fps if b is not None and (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {(i, f"{f:016x}", least[i]) for i, f in fps.items()}
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_documents(spark, empty):
    rng = random.Random(5)
    base = [f"word{rng.randint(0, 500)}" for _ in range(300)]
    edited = list(base)
    for at in (40, 150, 260):
        edited[at] = "changed"
    other = [f"other{rng.randint(0, 500)}" for _ in range(300)]
    rows = [(3, " ".join(base)), (5, " ".join(edited)), (7, " ".join(other)), (9, " ".join(base)), (11, None), (12, "")]
    got = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got[3] == got[5] == got[9] == 3 and got[7] == 7
    assert simhash.similar_documents(empty).count() == 0


def linked(rows, similarity=0.8):
    """Least id of each set linked by Jaccard similarity, by brute force."""
    sets = {i: frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    least, old = {i: i for i in sets}, None
    while old != least:
        old = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_similar_documents_of_one_word_set(spark):
    # All fingerprints of word sets are equal, so a forest of candidates misses nearly all true pairs.
    rng, rows = random.Random(6), []
    words = [f"word{i}" for i in range(40)] * 5
    for i in range(30):
        rng.shuffle(words)
        rows += [(i, " ".join(words)), (100 + i, " ".join(words[:-8]))]
    got = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == linked(rows) and len(set(got.values())) == 30


def test_similar_documents_of_large_keys(spark):
    """Without the anchors: templates whose band keys hold far more texts than hubs can tell apart, in any row order."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, rows = [word() for _ in range(120)], []
    for _ in range(150):
        own = list(base)
        start = rng.randrange(80)
        own[start : start + 30] = [word() for _ in range(30)]
        for _ in range(2):
            copy = list(own)
            copy[rng.randrange(120)] = word()
            rows.append((len(rows), " ".join(copy)))
    want = linked(rows)
    assert len(set(want.values())) > 40
    for tables in (0, 3):
        rng.shuffle(rows)
        got = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), tables=tables).collect()))
        assert got == want


def test_similar_documents_at_the_threshold(spark):
    # Scattered edits, text appended, text cut off: Jaccard 0.8 to 0.85, beyond what fingerprints cover.
    rng, rows = random.Random(7), []
    for i in range(20):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        edited = [f"edit{k}" if k % 50 == 20 else w for k, w in enumerate(words)]
        more = words + [f"m{rng.randint(0, 5000)}" for _ in range(70)]
        rows += [(1000 * k + i, " ".join(x)) for k, x in enumerate((words, edited, more, words[:-58]))]
    got = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == linked(rows) == {1000 * k + i: i for k in range(4) for i in range(20)}


def test_flac(docs, empty):
    texts = [b"", b"a", b" " * 192, bytes(range(256)) * 9, b"ab" * 4000, os.urandom(5000)]
    payloads = [flac.payload(t) for t in texts]
    media = flac.encode(payloads)
    assert [b"".join(b for _, b in blocks) for blocks in flac.decode(media)] == payloads
    broken = bytearray(media[-1])
    broken[-7] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        flac.decode([bytes(broken)])
    stored = flac.store(docs)
    for r in flac.features(stored).collect():
        t = (dict((x[0], x[1]) for x in rows_of())[r.doc_id] or "").encode()
        p = flac.payload(t)
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(t), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    blocks = flac.pcm_blocks(stored)
    assert blocks.filter("first_sample % 1152 <> 0").count() == 0
    assert flac.features(flac.store(empty)).count() == 0


def test_simple8b():
    rng = np.random.default_rng(0)
    for _ in range(30):
        ids = (rng.integers(0, 2**63, int(rng.integers(0, 900))).astype(np.uint64) * np.uint64(2)) >> rng.integers(0, 64, 1).astype(np.uint64)[0]
        assert np.array_equal(token_output.unpack(token_output.pack(ids, 128)), ids)
    ids = np.arange(1000, dtype=np.uint64)
    assert np.array_equal(token_output.unpack(token_output.pack(ids, 128), 2, 4), ids[256:512])


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_pieces_equal_whole_texts(docs, empty):
    import pyarrow as pa

    z = token_output.pieces(tokenizer())
    rng = random.Random(2)
    texts = ["", " a  b ", "a \n b", "<|endoftext|> x", "日本 語"] + ["".join(rng.choice("ab \n\t.1é'") for _ in range(20)) for _ in range(60)]
    ids, n = z.encode(pa.array(texts), 0)
    want = [z.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    rows = token_output.read_ids(token_output.write_ids(docs, tokenizer())).orderBy("start").collect()
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1] and len(rows) == docs.count()
    assert token_output.read_ids(token_output.write_ids(empty, tokenizer())).count() == 0


def test_bucket_sizes_pad_least():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(40, n, replace=False)) + 1, rng.integers(1, 9, n), int(rng.integers(1, 5))
        pad = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(pad([*s, lengths[-1]]) for m in range(k) for s in itertools.combinations(lengths[:-1], m))
        got = packing.bucket_sizes(lengths, counts, k)
        assert len(got) <= k and pad(got) == best


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, tokenizer(), buckets=3, step=8, max_tokens=256, budget=512).collect()
    assert all(r.n_tokens <= r.bucket_tokens and (r.place + 1) * r.bucket_tokens <= 512 for r in rows)
    assert len({(r.bucket_tokens, r.batch, r.place) for r in rows}) == len(rows)
    assert packing.pack_documents(empty, tokenizer()).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be [INST] kind</s>"), (1, 1, "user", None), (1, 2, "assistant", "<\\/s> ok <|im_end|>"), (1, 3, "user", "bye"), (2, 0, "user", ""), (None, 0, "assistant", "x"), (3, 1, "assistant", "b"), (3, 0, None, "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    made = chat.expand(df)
    assert all("</s>" not in r.formatted.replace("<|im_start|>", "") for r in made.collect())
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(made).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    assert {r.conv_id: r.loss for r in chat.read_back(made).collect()} == {1: "<\\/s> ok <|im_end|>", 2: "", None: "x", 3: "b"}
    assert chat.digests(chat.read_back(chat.expand(df.limit(0)))).count() == 0


def test_licenses(spark, empty):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 A. Person\n" + mit.upper()), (3, mit + " more"), (4, None), (5, "text\nLicensed under CC BY-NC 4.0.\nmore"), (6, mit.replace("license", "licence"))]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == got[2][0] == got[6][0] == "MIT" and got[3][0] is None and got[4] == (None, "") and got[5] == (None, "CC-BY-NC-4.0")
    assert licenses.scan(empty).count() == 0


def test_quality(spark, empty):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "house", "stands", "near", "water."]) for _ in range(80)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "###"]) for _ in range(80)) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(good + bad), (None, ""), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(5, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in known)
    assert np.mean([r.predicted == int(r.doc_id < 150) for r in known if r.held_out]) > 0.95
    assert len(rows) == 302 and all(0 <= r.score <= 1 for r in rows)
    kept = quality.accepted(docs.withColumn("statistics_0", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "statistics_0"] and 100 < kept.count() < 200
    assert quality.classify(empty, labels).count() == 0


def test_decontamination(spark, empty):
    rng = random.Random(4)
    noise = lambda n: [f"n{rng.randint(0, 3000)}" for _ in range(n)]
    items = [(i, " ".join([f"q{i}x{k}" for k in range(25)]) + ". The answer is " + f"a{i}b a{i}c a{i}d.") for i in range(12)]
    docs = [(i, " ".join(noise(300))) for i in range(60)]
    docs += [(100, " ".join(noise(90)) + " " + items[3][1] + " " + " ".join(noise(50)))]
    words = items[5][1].split()
    words[4], words[11] = "changed", "altered"
    docs += [(101, " ".join(noise(33) + words + noise(20))), (102, None), (103, ""), (None, items[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(100, 3), (101, 5), (None, 7)}
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_decontamination_of_widespread_leaks(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(40)]
    noise = lambda n: [rng.choice(common) if rng.random() < 0.3 else f"n{rng.randint(0, 3000)}" for _ in range(n)]
    hot = [f"h{k}" for k in range(26)] + "The answer is h1b h1c".split()
    plain = rng.sample(common, 30)  # every word is common in the corpus
    other = [(10 + i, " ".join(f"q{i}x{k}" for k in range(25))) for i in range(5)]
    docs = [(i, " ".join(noise(200))) for i in range(60)]
    docs += [(100 + i, " ".join(noise(40) + hot + noise(40))) for i in range(30)]
    changed = ["changed" if k % 6 == 3 else w for k, w in enumerate(hot)]  # no eight words in a row
    docs += [(200, " ".join(noise(40) + changed + noise(40))), (201, " ".join(noise(40) + plain + noise(40)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(hot)), (2, " ".join(plain)), *other], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(100 + i, 1) for i in range(30)} | {(200, 1), (201, 2)}


def test_decontamination_of_long_items(spark):
    rng = random.Random(9)
    noise = lambda n: [f"n{rng.randint(0, 3000)}" for _ in range(n)]
    long = {i: [f"q{i}x{k}" for k in range(n)] for i, n in ((1, 400), (2, 110), (3, 90), (4, 49))}
    # A third of the words changed: no eight words in a row.
    paraphrase = lambda w: ["changed" if k % 3 == 1 else x for k, x in enumerate(w)]
    docs = [(i, " ".join(noise(300))) for i in range(40)]
    docs += [(100 + i, " ".join(noise(37) + w + noise(50))) for i, w in long.items()]
    docs += [(200 + i, " ".join(noise(37) + paraphrase(w) + noise(50))) for i, w in long.items()]
    docs += [(300 + i, " ".join(noise(37) + w[: len(w) // 3] + noise(50))) for i, w in long.items()]  # too little
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in long.items()], "item_id long, text string")
    want = {(at + i, i) for at in (100, 200) for i in long}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, max_items=20).collect()} == want


def test_wrapped_licences(spark):
    import textwrap

    rows = []
    for i, (name, text) in enumerate(licenses.KNOWN):
        if len(text) > 300:
            body = [textwrap.fill(p, w) for w in range(60, 100) for p in ["\n".join(text.split("\n"))]]
            rows += [(i, name, f"Copyright (c) 2020 Some One\nAll rights reserved.\n\n{b}") for b in body]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()
    want = {(i, n) for i, n, _ in rows}
    assert len(got) == len(rows) and {(r.doc_id, r.license_id) for r in got} == want


def test_roles_with_marks_read_back(spark):
    roles = ["a\x00b", "a\\nb", "a\nb", "\\\\n\n\\", "</s>\\"]
    made = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert [t["role"] for t in chat.read_back(chat.expand(made)).first()["turns"]] == roles
