"""Benchmark decontamination by latent semantic retrieval.

Documents are read as sequences of benchmark words (others cannot match) with their positions. Passages of three blocks
of 16 words get TF-IDF rows; document frequencies and a randomised SVD of all these rows (their Gram matrix times a
Gaussian sketch, and the small factor that follows) are summed over the whole corpus by Spark; for the SVD the
passages don't overlap, for the search they start at every block. A passage whose
latent vector is near an item's (cosine) and holds enough of it is a candidate; of an item longer than a passage, its
parts of a passage's length count like items here. So is a passage with eight words of the item in a row a candidate,
whatever they weigh in the corpus; a candidate leaks if the longest common subsequence of the item and
the words around the passage covers enough of the item, and so for the item's answer (its last sentence).

The benchmark is taken in groups of about `max_items` items and parts, chosen by a hash of item_id, so what is broadcast (one group's
words, vectors and texts) has a fixed bound. Nulls: items and documents with a null or empty text can't match; null ids
are kept. Items with equal texts all match. Repeated documents repeat in the grouping by doc_id just once. Empty tables
give empty results.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.llm._common import slices, utf8, written

BLOCK, SPAN = 16, 3
#: So many words in a row (all of a shorter item) make a candidate.
GRAM = 8
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _PUNCTUATION.encode(), bytes(range(97, 123)) + b" " * 32)


def words(text: bytes) -> list[bytes]:
    """Lower case (A-Z), ASCII punctuation as white space."""
    return text.translate(_PLAIN).split()


def _answer(text: str) -> int:
    """Number of words in the last sentence (at least three words; else of the whole)."""
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]
    n = len(words(sentences[-1].encode())) if sentences else 0
    return n if n >= 3 else len(words(text.encode()))


class _Item:
    def __init__(self, item_id: int, text: str, ids: list[int]):
        self.item_id, self.ids, self.answer, self.each = item_id, ids, _answer(text), [(x,) for x in ids]


def _parts(parsed: list[_Item]) -> tuple[list[list[int]], np.ndarray]:
    """What passages are compared with, and of which item each is: all items whole, then the parts of those longer than a
    passage, which start at every block of the item; the last ends with it."""
    parts, owner = [p.ids for p in parsed], list(range(len(parsed)))
    wide = BLOCK * SPAN
    for k, p in enumerate(parsed):
        last = len(p.ids) - wide
        if last > 0:
            for at in [*range(0, last, BLOCK), last]:
                parts.append(p.ids[at : at + wide])
                owner.append(k)
    return parts, np.array(owner, np.int64)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest one, by bits of a whole row at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _gram_hashes(term: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(term) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + term[k : k + len(out)].astype(np.uint64) + np.uint64(1)
    return out


def _grams(parsed: list[_Item]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, sorted hashes, items) of all runs of GRAM words of the items; of an item with fewer, the whole."""
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, p in enumerate(parsed):
        n = min(GRAM, len(p.ids))
        by_length.setdefault(n, []).append((np.unique(_gram_hashes(np.array(p.ids), n)), k))
    out = []
    for n, found in by_length.items():
        keys, items = np.concatenate([h for h, _ in found]), np.concatenate([np.full(len(h), k) for h, k in found])
        order = np.argsort(keys, kind="stable")
        out.append((n, keys[order], items[order]))
    return out


def _runs(term: np.ndarray, spot: np.ndarray, doc: np.ndarray, grams) -> tuple[np.ndarray, np.ndarray]:
    """(hit, item): where a run of an item's words starts."""
    hit, item = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n, keys, items in grams:
        h = _gram_hashes(term, n)
        m = len(h)
        at = np.flatnonzero((spot[n - 1 :][:m] - spot[:m] == n - 1) & (doc[n - 1 :][:m] == doc[:m]))
        lo = np.searchsorted(keys, h[at])
        at, lo = at[keys[np.minimum(lo, len(keys) - 1)] == h[at]], lo[keys[np.minimum(lo, len(keys) - 1)] == h[at]]
        count = np.searchsorted(keys, h[at], side="right") - lo
        hit.append(np.repeat(at, count))
        item.append(items[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
    return np.concatenate(hit), np.concatenate(item)


def _read_hits(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, position, document) of all hits of a batch of the compact table."""
    terms = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    spots = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
    doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
    empty = [np.empty(0, np.int32)]
    return np.concatenate(terms + empty), np.concatenate(spots + empty), doc


def _passages(term: np.ndarray, spot: np.ndarray, doc: np.ndarray, idf: np.ndarray, apart: bool = False):
    """TF-IDF entries (row, term, weight; rows of length 1) of passages with hits of terms that carry weight, sorted by
    row; and the rows' documents, first blocks and lengths before scaling. With apart, passages don't overlap."""
    keep = idf[term] > 0
    term, block, doc = term[keep].astype(np.int64), spot[keep].astype(np.int64) // BLOCK, doc[keep].astype(np.int64)
    # A passage starts at any of SPAN blocks; those before the first block hold what the one at the first does.
    if apart:
        start = block - block % SPAN
    else:
        start = np.concatenate([block - k for k in range(SPAN)])
        term, doc = np.tile(term, SPAN), np.tile(doc, SPAN)
        ok = start >= 0
        start, term, doc = start[ok], term[ok], doc[ok]
    if not len(term):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),) + (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    wide = int(start.max()) + 1
    key = (doc * wide + start) * len(idf) + term
    key, tf = np.unique(key, return_counts=True)
    passage, term = key // len(idf), key % len(idf)
    rows, row = np.unique(passage, return_inverse=True)
    weight = tf * idf[term]
    norm = np.sqrt(np.bincount(row, weight**2))
    return row, term, weight / norm[row], rows // wide, rows % wide, norm


def _project(row: np.ndarray, term: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of the sparse matrix times basis."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return _summed_runs(np.ascontiguousarray(basis.T), term, weight, first).T


def _latent(term: np.ndarray, spot: np.ndarray, doc: np.ndarray, axes: np.ndarray, docs_of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of axes[term] over the hits of passages, by way of those of blocks."""
    key = doc.astype(np.int64) << 32 | spot.astype(np.int64) // BLOCK  # ascending
    wanted = np.unique(np.concatenate([docs_of << 32 | (starts + k) for k in range(SPAN)]))
    some = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
    key, term = key[some], term[some]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    blocks = np.ascontiguousarray(_summed_runs(np.ascontiguousarray(axes.T), term, np.ones(len(term), np.float32), first).T)
    blocks = np.concatenate((blocks, np.zeros((1, blocks.shape[1]), np.float32)))
    have = key[first]
    out = np.zeros((len(starts), blocks.shape[1]), np.float32)
    for k in range(SPAN):
        want = docs_of << 32 | (starts + k)
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        out += blocks[np.where(have[at] == want, at, len(have))]
    return out


def _summed_runs(columns: np.ndarray, index: np.ndarray, weight: np.ndarray, first: np.ndarray, most: int = 4000) -> np.ndarray:
    """Sums of columns[:, index] * weight over the runs that start at `first`; about `most` entries at once, for caches."""
    out = np.empty((len(columns), len(first)), columns.dtype)
    ends = np.append(first[1:], len(index))
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends, first[i] + most, side="right")))
        a, b = first[i], ends[j - 1]
        out[:, i:j] = np.add.reduceat(columns[:, index[a:b]] * weight[a:b].astype(columns.dtype, copy=False), first[i:j] - a, axis=1)
        i = j
    return out


def _project_back(row: np.ndarray, term: np.ndarray, weight: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
    """Adds the transposed sparse matrix times y to total (columns, terms)."""
    order = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[order], prepend=-1))
    total[:, term[order][first]] += _summed_runs(np.ascontiguousarray(y.T), row[order], weight[order], first)


def _hits(docs: DataFrame, vocabulary, terms: int) -> DataFrame:
    """doc_id, terms, spots (32-bit integers): the benchmark words of a document and where they stand; and, in the first
    row of a batch (else null), seen: in how many of its blocks each term stands, and last how many blocks have a hit."""

    def run(batches):
        known = vocabulary.value
        for b in slices(batches, "text"):
            found, spots = [], []
            for t in utf8(b, "text"):
                of = np.array([known.get(w, -1) for w in words(t)], np.int32)
                at = np.flatnonzero(of >= 0).astype(np.int32)
                found.append(of[at])
                spots.append(at)
            block = np.repeat(np.arange(len(spots)) << 32, [len(x) for x in spots]) | np.concatenate(spots).astype(np.int64) // BLOCK
            rank = np.cumsum(np.diff(block, prepend=-1) != 0)
            once = np.unique(rank * terms + np.concatenate(found)) % terms
            seen = np.append(np.bincount(once, minlength=terms), rank[-1] if len(rank) else 0)
            cols = [b.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in spots], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([seen.tolist(), *[None] * (b.num_rows - 1)], pa.list_(pa.int64()))], ["doc_id", "terms", "spots", "seen"])

    return written(docs.mapInArrow(run, "doc_id long, terms binary, spots binary, seen array<long>"), "benchmark_words")


def _summed(df: DataFrame, key: str, n: int):
    """Sums of the vectors `v` by key, in Spark; a bounded number of keys comes to the driver."""
    total = df.groupBy(key).agg(F.array(*[F.sum(F.col("v")[i]) for i in range(n)]).alias("v"))
    return total.toPandas()


def _frequencies(hits: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many blocks each term stands, and how many blocks have a hit."""
    rows = hits.filter("seen is not null").select(F.posexplode("seen").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(terms + 1, np.int64)
    out[rows["term"]] = rows["n"]
    return out[:terms], int(out[terms])


def _basis(hits: DataFrame, idf: np.ndarray, rank: int, spare: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms, rank) of the TF-IDF rows of all passages, by randomised SVD in one pass: from the
    product of the rows' Gram matrix with a Gaussian sketch (Nystrom's approximation of that matrix)."""
    spark, terms = hits.sparkSession, len(idf)
    width = min(rank + spare, terms)
    sketch = np.random.default_rng(seed).standard_normal((terms, width)).astype(np.float32)
    share = spark.sparkContext.broadcast((idf, sketch))

    def back(batches):
        weights, omega = share.value
        total = np.zeros((width, terms))
        for b in slices(batches, "terms", 500_000):
            row, term, weight, _, _, _ = _passages(*_read_hits(b), weights, apart=True)
            if len(row):
                _project_back(row, term, weight, _project(row, term, weight, omega), total)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total.T[at]), pa.list_(pa.float64()))], ["term", "v"])

    found = _summed(hits.select("doc_id", "terms", "spots").mapInArrow(back, "term long, v array<double>"), "term", width)
    if not len(found):
        return np.zeros((terms, 1))
    y = np.zeros((terms, width))
    y[found["term"].to_numpy()] = np.stack(found["v"].to_numpy())
    # A small shift keeps the core positive; its eigenvectors give the factor whose left singular vectors are the basis.
    y += (shift := 1e-6 * np.linalg.norm(y)) * sketch
    core = sketch.astype(np.float64).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * values.max()
    left, size, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank][:, size[:rank] ** 2 > shift + 1e-12]


def _leaks(docs: DataFrame, items: list[tuple[int, str]], rank: int, cosine: float, held: float, overlap: float, answer: float) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    parsed = [_Item(i, t, [vocabulary.setdefault(w, len(vocabulary)) for w in words(t.encode())]) for i, t in items]
    parsed = [p for p in parsed if p.ids]
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    if not parsed:
        return spark.createDataFrame([], schema)
    hits = _hits(docs, spark.sparkContext.broadcast(vocabulary), len(vocabulary))
    seen, blocks = _frequencies(hits, len(vocabulary))
    # Positive for every term: a leak in many documents must not take the weight from its own words.
    idf = np.log1p(blocks / np.maximum(seen, 1))
    basis = _basis(hits, idf, rank, 16)
    parts, owner = _parts(parsed)
    vectors = np.zeros((len(parts), basis.shape[1]))
    keys, values = [], []
    for k, part in enumerate(parts):
        ids, tf = np.unique(part, return_counts=True)
        vectors[k] = (tf * idf[ids]) @ basis[ids]
        keys.append(ids.astype(np.int64) * len(parts) + k)
        values.append(tf * idf[ids] / max(((tf * idf[ids]) ** 2).sum(), 1e-12))
    length = np.linalg.norm(vectors, axis=1)  # of the part's unscaled row in the latent space
    unit = (vectors / np.maximum(length, 1e-12)[:, None]).astype(np.float32)
    own = np.where(length > 1e-9, length, np.inf).astype(np.float32)
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys)
    # By term: where its rows start, how many there are; their parts and shares of the parts' mass.
    rows = np.searchsorted(keys[order], np.arange(len(vocabulary) + 1) * len(parts))
    exact = rows[:-1], np.diff(rows), (keys[order] % len(parts)).astype(np.int32), values[order].astype(np.float32)
    top = np.zeros(len(vocabulary))
    np.maximum.at(top, keys // len(parts), values)
    share = spark.sparkContext.broadcast((idf, (basis * idf[:, None]).astype(np.float32), parsed, unit, own, exact, top, owner, _grams(parsed)))

    def search(batches):
        weights, axes, known, unit, own, exact, top, owner, grams = share.value
        for b in slices(batches, "terms", 500_000):
            term, spot, doc = _read_hits(b)
            row, t, w, docs_of, starts, mass = _passages(term, spot, doc, weights)
            if not len(row):
                continue
            # Runs of an item's words, at the passage that starts with their block.
            hit, item = _runs(term, spot, doc, grams)
            run_at = np.searchsorted(docs_of << 32 | starts, doc[hit].astype(np.int64) << 32 | spot[hit].astype(np.int64) // BLOCK)
            # A passage without a run goes on only if its words, each at its greatest share of any part, could be enough.
            keep = np.bincount(row, w * top[t], len(mass)) * mass >= held - 1e-6
            keep[run_at] = True
            place = np.cumsum(keep) - 1
            some = keep[row]
            row, t, w = place[row[some]], t[some], w[some]
            docs_of, starts, mass, run_at = docs_of[keep], starts[keep], mass[keep], place[run_at]
            if not len(mass):
                continue
            latent = _latent(term, spot, doc, axes, docs_of, starts) / mass[:, None].astype(np.float32)
            norm = np.linalg.norm(latent, axis=1)
            bounds_of = np.searchsorted(row, np.arange(len(mass) + 1))
            found = []
            # So many passages at once that the comparisons stay small.
            step = max(1, 250_000 // len(own))
            for low in range(0, len(mass), step):
                near = latent[low : low + step] @ unit.T
                # near / norm is the cosine; mass x near against own tells how much of the part the passage holds.
                enough = np.maximum(np.float32(cosine) * np.maximum(norm[low : low + step], 1e-9)[:, None], np.float32(held) * own / mass[low : low + step, None].astype(np.float32))
                # The same held against all terms, entry by entry, before texts are compared.
                part = slice(bounds_of[low], bounds_of[min(low + step, len(mass))])
                begin, n = exact[0][t[part]], exact[1][t[part]]
                at = np.repeat((begin - np.cumsum(n) + n).astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)
                cell = np.repeat(((row[part] - low) * len(own)).astype(np.int32), n) + exact[2][at]
                weight = np.repeat((w[part] * mass[row[part]]).astype(np.float32), n) * exact[3][at]
                share_of = np.bincount(cell, weight, near.size).reshape(near.shape)
                i, j = np.nonzero((share_of >= held - 1e-6) & (near >= enough - 1e-5))
                i += low
                # Each passage and item once; the first of its rows is the item as a whole, if that is near.
                _, once = np.unique(i * len(known) + owner[j], return_index=True)
                found.append((i[once], j[once]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            extra = np.unique(run_at * len(known) + item)
            i, j = np.concatenate((i, extra // len(known))), np.concatenate((j, extra % len(known)))
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1))
            ids, done = b.column(0).to_pylist(), {}
            for passage, part_of in zip(i.tolist(), j.tolist(), strict=True):
                item = int(owner[part_of])
                p, d = known[item], int(docs_of[passage])
                if done.get((d, item), (0,))[0] == 1:
                    continue
                first = int(starts[passage]) * BLOCK
                lo = bounds[d] + np.searchsorted(spot[bounds[d] : bounds[d + 1]], first - len(p.ids))
                hi = bounds[d] + np.searchsorted(spot[bounds[d] : bounds[d + 1]], first + SPAN * BLOCK + len(p.ids))
                part = term[lo:hi].tolist()
                if len(p.ids) - sum(map(set(part).isdisjoint, p.each)) < overlap * len(p.ids):
                    continue  # too few of its words are here at all
                lcs = common_subsequence(p.ids, part) / len(p.ids)
                if lcs >= overlap:
                    said = common_subsequence(p.ids[-p.answer :], part) / p.answer
                    if said >= answer and done.get((d, item), (0,))[0] < lcs:
                        done[d, item] = (lcs, float(latent[passage] @ unit[part_of] / max(norm[passage], 1e-12)), said)
            rows = [(ids[d], known[item].item_id, c, lcs, said) for (d, item), (lcs, c, said) in done.items()]
            if rows:
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return hits.select("doc_id", "terms", "spots").mapInArrow(search, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 64, cosine: float = 0.3, held: float = 0.3, overlap: float = 0.6, answer: float = 0.5, max_items: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share: each document with each item that it gives away."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = F.size(F.split(F.trim(F.translate("text", _PUNCTUATION, " " * len(_PUNCTUATION))), r"\s+"))
    parts = items.select(1 + F.ceil(F.greatest(size - BLOCK * SPAN, F.lit(0)) / BLOCK) + F.when(size > BLOCK * SPAN, 1).otherwise(0)).toDF("n").agg(F.sum("n")).first()[0] or 0
    groups = max(1, math.ceil(parts / max_items * 1.25)) if parts > max_items else 1
    out = None
    for g in range(groups):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").collect()
        part = _leaks(texts, [(r["item_id"], r["text"]) for r in some], rank, cosine, held, overlap, answer)
        out = part if out is None else out.unionByName(part)
    best = F.struct("lcs_share", "cosine", "answer_share")
    return out.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share")
