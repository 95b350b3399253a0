"""SimHash near-duplicates by anchor-point covering.

Fingerprints: XXH64 (seed 42) of each word shingle, majority per bit. Linking: the first 46 bits are two blocks of 23,
each covered by the perfect binary Golay code (covering radius 3), so a pair of codewords is an anchor. A fingerprint
lives at its nearest anchor and is replicated to every anchor within covering radius plus threshold that can be the
nearest one of a fingerprint at most `threshold` bits away; two linked fingerprints therefore meet at the home of
either. Per anchor, residents are compared with visitors on all 64 bits, and only a spanning star of each linked set is
emitted, so a large set of near copies costs as many rows as members. Equal fingerprints are made one before.

Nulls: a null text has no words and gets fingerprint zero, like an empty one; rows with a null doc_id are linked as
any other but can't name a component. Repeated rows stay repeated. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.llm._common import release, slices, utf8, written
from netlex.llm._windows import gram_hashes, mixed, repeating, word_units
from netlex.operators.components import star_labels

BLOCK = 23
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Of lower-cased (A-Z) words between ASCII white space; fewer words than size: one shingle of all of them."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array: a bit is set if it is in over half the values; empty: zero."""
    out = np.zeros(len(hashes), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(64, np.int64)
            for part in range(0, len(h), 1 << 16):
                bits = np.unpackbits(h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(0, dtype=np.int64)
            out[i] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for b in slices(batches, "text"):
            fp = majority([shingle_hashes(t, size) for t in utf8(b, "text")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndrome(x: int) -> int:
    for i in range(BLOCK - 1, 10, -1):
        if x >> i & 1:
            x ^= GOLAY << (i - 11)
    return x


@functools.cache
def _tables(threshold: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Syndromes of single bits; the least error of each syndrome; by flips w, the offsets (padded with -1) from a
    block to the codewords that are nearest after w flips and not after fewer, for each syndrome."""
    patterns = lambda most: [sum(1 << i for i in c) for w in range(most + 1) for c in itertools.combinations(range(BLOCK), w)]
    leader = np.zeros(2048, np.int64)
    for e in reversed(patterns(3)):
        leader[_syndrome(e)] = e
    flips = np.array(patterns(threshold), np.int64)
    weight, syn = np.bitwise_count(flips), np.array([_syndrome(int(e)) for e in flips])
    by_weight: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in range(threshold + 1)]
    for s in range(2048):
        seen: set[int] = set()
        for off, w in zip((flips ^ leader[s ^ syn]).tolist(), weight.tolist(), strict=True):
            if off not in seen:
                seen.add(off)
                by_weight[w][s].append(off)
    padded = []
    for rows in by_weight:
        m = max(map(len, rows))
        padded.append(np.array([r + [-1] * (m - len(r)) for r in rows], np.int64).reshape(2048, m))
    return np.array([_syndrome(1 << i) for i in range(BLOCK)], np.int64), leader, padded


def _syndromes(block: np.ndarray, single: np.ndarray) -> np.ndarray:
    out = np.zeros(len(block), np.int64)
    for i in range(BLOCK):
        out ^= np.where(block >> i & 1, single[i], 0)
    return out


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, home) rows: every anchor that a fingerprint visits, its own one marked."""
    single, _, tables = _tables(threshold)
    mask = (1 << BLOCK) - 1
    low, high = (fp & np.uint64(mask)).astype(np.int64), (fp >> np.uint64(BLOCK) & np.uint64(mask)).astype(np.int64)
    s_low, s_high = _syndromes(low, single), _syndromes(high, single)
    index, out, home = [], [], []
    for a, b in itertools.product(range(threshold + 1), repeat=2):
        if a + b > threshold:
            continue
        x, y = tables[a][s_low], tables[b][s_high]
        ok = (x >= 0)[:, :, None] & (y >= 0)[:, None, :]
        key = (low[:, None] ^ x)[:, :, None] | ((high[:, None] ^ y) << BLOCK)[:, None, :]
        i = np.nonzero(ok)[0]
        index.append(i)
        out.append(key[ok])
        home.append(np.full(len(i), a + b == 0))
    return np.concatenate(index), np.concatenate(out), np.concatenate(home)


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Indices of the links that form the spanning forest of least distances (Boruvka). a and b are rows, node the names
    that break ties, so the forest does not depend on the order of the links."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    rank = np.empty(len(d), np.int64)
    order = np.lexsort((np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), d))
    rank[order] = np.arange(len(d))
    label, taken, live = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        live = live[label[x[live]] != label[y[live]]]
        if not len(live):
            return np.unique(np.concatenate([np.empty(0, np.int64), *taken]))
        best = np.full(len(nodes), len(d))
        np.minimum.at(best, label[x[live]], rank[live])
        np.minimum.at(best, label[y[live]], rank[live])
        pick = order[np.unique(best[best < len(d)])]
        taken.append(pick)
        while True:
            m = np.minimum(label[x[pick]], label[y[pick]])
            new = label.copy()
            np.minimum.at(new, label[x[pick]], m)
            np.minimum.at(new, label[y[pick]], m)
            new = new[new[label]]
            if np.array_equal(new, label):
                break
            label = new


@functools.cache
def _masks(threshold: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for w in range(threshold + 1) for c in itertools.combinations(range(64), w)], np.uint64)


def _compare(fp: np.ndarray, node: np.ndarray, residents: int, within: int):
    """The spanning forest of one large anchor's links (its first rows are the residents), thinned as they gather.

    Work is members x min(residents, masks of up to `within` bits)."""
    found = [(np.empty(0, np.int64),) * 3]

    def thin():
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = _forest(a, b, d, node)
        found[:] = [(a[keep], b[keep], d[keep])]

    def add(i, j):
        far = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
        ok = node[i] != node[j]
        found.append((i[ok], j[ok], far[ok]))
        if sum(len(x[0]) for x in found) > 2_000_000:
            thin()

    if within > 2 or residents <= len(_masks(within)):
        for r in range(residents):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[r]) <= within)
            add(np.full(len(near), r), near)
    else:
        order = np.argsort(fp[:residents], kind="stable")
        known = fp[:residents][order]
        for m in _masks(within):
            x = fp ^ m
            at = np.minimum(np.searchsorted(known, x), residents - 1)
            hit = np.flatnonzero(known[at] == x)
            add(order[at[hit]], hit)
    thin()
    a, b, d = found[0]
    return node[a], node[b], d


def _links(anchor: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, within: int, most: int = 1 << 16):
    """(node, node, distance) inside whole anchors, the spanning forest of each; arrays sorted by anchor, residents first."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    residents = np.add.reduceat(home.astype(np.int64), starts)
    work = residents * sizes
    for g in np.flatnonzero(work > most):
        part = slice(starts[g], starts[g] + sizes[g])
        yield _compare(fp[part], node[part], int(residents[g]), within)
    small = np.flatnonzero((work <= most) & (residents > 0) & (sizes > 1))
    cuts = np.searchsorted(np.cumsum(work[small]), np.arange(1_000_000, max(1, work[small].sum()), 1_000_000))
    for part in np.split(small, cuts):
        if not len(part):
            continue
        # One row for each (resident, member) of the group.
        n = work[part]
        g = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        size, first = sizes[part][g], starts[part][g]
        i, j = first + k // size, first + k % size
        far = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
        near = (node[i] != node[j]) & (far <= within)
        if near.any():
            # Rows of different anchors are different ends, so each anchor keeps a forest of its own.
            i, j, far = i[near], j[near], far[near]
            keep = _forest(i, j, far, node)
            yield node[i[keep]], node[j[keep]], far[keep]


def links(marked: DataFrame, threshold: int = 2, within: int | None = None) -> DataFrame:
    """marked (node, table, fp) -> links (a, b, bits that differ in the table where they are closest), a < b: they connect whatever is linked pair by pair.

    Linked: at most `threshold` bits differ among the anchored 46 and at most `within` (default: threshold) of all 64.
    Fingerprints meet only in the same table."""
    within = threshold if within is None else within

    def replicate(batches):
        for batch in batches:
            node, table = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 2000):
                part = slice(i, i + 2000)
                index, anchor, home = anchors(fp[part], threshold)
                anchor |= table[part][index].astype(np.int64) << (2 * BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[part][index].view(np.int64)), pa.array(node[part][index]), pa.array(home)], ["anchor", "fp", "node", "home"])

    def compare(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                new[1] = new[1].view(np.uint64)
                rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
                # The last anchor may go on in the next batch.
                cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
                whole, rest = [x[:cut] for x in rest], [x[cut:] for x in rest]
            else:
                whole, rest = rest, None
            if batch is None:
                release()
            if whole is None or not len(whole[0]):
                continue
            for a, b, d in _links(*whole, within):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "bits"])

    rows = marked.select("node", "table", "fp").mapInArrow(replicate, "anchor long, fp long, node long, home boolean")
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", F.col("home").desc())
    return dealt.mapInArrow(compare, "a long, b long, bits long").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def _closest(near: DataFrame) -> DataFrame:
    """Of links (a, b, bits), the closest one of each node to a greater and to a lesser one."""
    up = near.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    down = near.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    return up.union(down).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the linked set)."""
    marked = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    near = links(classes.select(F.col("fp").alias("node"), F.lit(0).alias("table"), "fp"), threshold)
    labels = star_labels(near)
    sets = labels.join(classes, labels["node"] == classes["fp"]).select("fp", "comp", "first_id")
    firsts = sets.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = sets.join(firsts, "comp").select("fp", "component_id")
    reach = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(reach, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _word_marks(docs: DataFrame, tables: int) -> DataFrame:
    """node, table, fp: fingerprints of the sets of words, under one seed for each table."""

    def run(batches):
        for b in slices(batches, "text"):
            sets = [set(t.lower().split()) for t in utf8(b, "text")]
            for k in range(tables):
                h = [np.fromiter((xxhash.xxh64_intdigest(w, 42 + k) for w in x), np.uint64, len(x)) for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(h), k, np.int32)), pa.array(majority(h).view(np.int64))], ["node", "table", "fp"])

    return docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(run, "node long, table int, fp long")


def _shingle_values(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of lower-cased (A-Z) words as 64-bit rolling hashes; fewer words than size: one of them all."""
    words = word_units(text.lower())
    return np.unique(gram_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


#: 64-bit words of a set's parity bits: of each bit, whether an odd number of the set's shingles fall on it. Two sets differ in
#: at least as many shingles as parity bits, so sets with too many unlike bits can't be similar.
PARITY = 16


def _parity(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount(shingles.view(np.uint32) % np.uint32(64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _shingle_sets(docs: DataFrame, size: int, parity: bool = False) -> DataFrame:
    """node, shingles (32 bits of each hash) and, if asked for, parity."""
    names = ["node", "shingles", *(["parity"] if parity else [])]

    def run(batches):
        for b in slices(batches, "text"):
            sets = [np.unique((_shingle_values(t, size) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in utf8(b, "text")]
            cols = [b.column(0), pa.array(sets, pa.list_(pa.int32())), *([pa.array([_parity(x) for x in sets], pa.list_(pa.int64()))] if parity else [])]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(run, "node long, shingles array<int>" + ", parity array<long>" * parity)


#: Least-hash bands: a pair of similarity 0.8 shares one of BANDS keys of ROWS least hashes with probability 1 - (1 - 0.8^4)^20 = 0.99997.
BANDS, ROWS = 20, 4
#: Texts of a band key are compared with HUBS of them, then those still apart with each other: in keys of up to SMALL texts
#: as they are, in larger ones where they share one of their rarest shingles.
SMALL, HUBS = 32, 3


def _bands(docs: DataFrame, size: int) -> DataFrame:
    """key, node: the band keys that two or more texts share; a table in the shared folder."""
    factors = np.random.default_rng(3).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for b in slices(batches, "text"):
            sets = [_shingle_values(t, size) for t in utf8(b, "text")]
            sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
            first = np.cumsum([0, *map(len, sets[:-1])])
            h = np.concatenate(sets)
            least = np.stack([np.minimum.reduceat(h * f, first) for f in factors]).reshape(BANDS, ROWS, -1)
            for band in range(BANDS):
                key = np.full(len(sets), band + 1, np.uint64)
                for x in least[band]:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + x)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], ["key", "node"])

    rows = written(docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(run, "key long, node long"), "bands")
    return written(repeating(rows, F.count(F.lit(1)), {}), "shared_bands")


#: So many ids (8 bytes each) are broadcast; more are joined.
MOST_IDS = 1_000_000


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have the Jaccard similarity."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    some = texts.join(F.broadcast(ends) if ends.count() <= MOST_IDS else ends, "doc_id", "left_semi")
    sets = written(_shingle_sets(some, size), "shingles")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    near = pairs.join(left, "a").join(right, "b").filter(common >= similarity * (F.size("x") + F.size("y") - common))
    return written(near.select("a", "b"), "similar")


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """nodes (node, comp) -> pairs (a, b) of different comps, among them all with the Jaccard similarity.

    Exact prefix search: shingles are ordered from rare to common among the nodes; two sets of the similarity share one of
    their first |x| - similarity |x| + 1. Of each shingle only those outside its most frequent comp seek partners, and a
    pair goes on only if sizes and what follows the shared places leave room for the overlap, and if the parity bits differ
    by no more than similar sets of these sizes can."""
    some = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = written(_shingle_sets(some, size, parity=True), "open_shingles")
    flat = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    shared = flat.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    x = F.sort_array(F.collect_list(F.struct("n", "s"))).alias("x")
    ordered = flat.join(shared, "s").groupBy("node").agg(F.first("size").alias("size"), x)
    # Shingles of one set only come first and need no rows.
    ordered = ordered.withColumn("own", F.col("size") - F.size("x"))
    ordered = ordered.withColumn("most", (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1 - F.col("own")).cast("int")).filter("most > 0")
    first = ordered.select("node", "size", "own", F.posexplode(F.slice("x", F.lit(1), F.col("most"))).alias("i", "x"))
    first = first.select("node", "size", (F.col("size") - F.col("own") - F.col("i")).alias("left"), F.col("x.s").alias("s"))
    first = written(first.join(nodes, "node").join(sets.select("node", "parity"), "node"), "prefixes")
    by_comp = first.groupBy("s", "comp").agg(F.count("*").alias("n"))
    main = by_comp.groupBy("s").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1").select("s", F.col("m.comp").alias("main"))
    live = first.join(main, "s")
    seek = live.filter("comp <> main").select("s", *(F.col(c).alias(f"{c}_a") for c in ("node", "comp", "size", "left", "parity")))
    overlap = F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("size_a")) - 1e-9
    unlike = F.aggregate(F.zip_with("parity", "parity_a", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("size") + F.col("size_a")) + 1e-9
    fits = (F.col("comp") != F.col("comp_a")) & (F.least("left", "left_a") >= overlap) & (unlike <= most)
    return seek.join(live, "s").filter(fits).select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct()


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5, tables: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: documents linked by a Jaccard similarity of their `size`-word shingles.

    Most links are found cheaply on fingerprints of the sets of words, in several tables with seeds of their own, and held
    against the exact similarity. Of these candidates each text keeps the closest, which is not complete, so a second search takes bands of least
    hashes: texts of a band key that are not linked yet are compared with its hubs (the least by a hash, another one each
    round), then those still apart with each other: in small keys as they are, in larger ones by an exact prefix search.
    So every two texts that share a band key are in one component or were tested. Pairs inside a component need no test.
    Equal texts are made one before. A null text is an empty one; rows with a null doc_id have no component of their own."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Two independent 64-bit hashes stand for the text.
    keyed = texts.select("doc_id", F.xxhash64("text", F.lit(1)).alias("h"), F.xxhash64(F.lit(2), "text").alias("h2"))
    classes = written(keyed.groupBy("h", "h2").agg(F.min("doc_id").alias("first_id")), "texts")
    firsts = classes.select(F.col("first_id").alias("doc_id"))
    distinct = texts.join(firsts, "doc_id", "left_semi")
    # Written first: the two Python steps would else run side by side in one stage, in twice the workers.
    marks = written(_word_marks(distinct, tables), "marks")
    pairs = written(_closest(written(links(marks, threshold=2, within=10), "links")), "pairs")
    labels = star_labels(_verified(pairs, texts, size, similarity))
    bands = _bands(distinct, size)
    named = lambda: bands.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    tried = None
    for k in range(HUBS + 2):
        rows = named()
        if k < HUBS:
            hub = F.min(F.struct(F.xxhash64("node", F.lit(k)), F.col("node").alias("a"), F.col("comp").alias("comp_a"))).alias("hub")
            met = rows.join(rows.groupBy("key").agg(hub).select("key", "hub.a", "hub.comp_a"), "key").select("a", F.col("node").alias("b"), "comp_a", F.col("comp").alias("comp_b"))
            met = met.filter("comp_a <> comp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            fits = f"n <= {SMALL}" if k == HUBS else f"n > {SMALL}"
            held = rows.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n")).filter(f"least < most and {fits}")
            open_ = rows.join(held.select("key"), "key")
            if k == HUBS:
                met = open_.select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a")).join(open_.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b")), "key")
                met = met.filter("a < b and comp_a <> comp_b").select("a", "b").distinct()
            else:
                apart = written(open_.select("node", "comp").distinct(), "apart")
                if apart.isEmpty():
                    break
                met = _prefix_pairs(apart, distinct, size, similarity)
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        met = written(met, "met")
        labels = star_labels(_verified(met, texts, size, similarity).union(labels.select("node", "comp")))
        tried = met if tried is None else tried.union(met)
    labels = labels.withColumnsRenamed({"node": "first_id", "comp": "component_id"})
    named_texts = classes.join(labels, "first_id", "left").select("h", "h2", F.coalesce("component_id", "first_id").alias("component_id"))
    return keyed.join(named_texts, ["h", "h2"]).select("doc_id", "component_id")
