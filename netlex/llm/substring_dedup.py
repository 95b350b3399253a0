"""Substring dedup by prefix-partitioned suffix trees over words.

A word goes if a window of `length` words covers it whose word sequence also starts earlier (smaller doc_id, or the same
document at an earlier start); windows are judged on the input. Candidate segments meet by content (see _windows). In
a task, the suffixes at window starts are split by a variable-length prefix into groups that fit in memory; each
group's subtree is grown edge by edge, leaves that stand alone are dropped, and the nodes at a depth of `length` words
with two leaves or more are the repeats: all their leaves but the earliest are marked.

Words are compared by 64-bit hashes. Nulls: a null text has no words; a null doc_id sorts before all others. A
repeated row is the same document: its first copy decides for both (windows of equal rows don't start earlier than
themselves). Rows that repeat an id with another text are ordered by a hash of the text. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.llm._common import slices
from netlex.llm._windows import candidates, distinct_segments, gram_hashes, joined_spans, repeated_keys, repeating, resolved, runs, shifted, squeezed, texts_of, whole, with_key, word_spans, word_units

LENGTH, GRAM = 20, 5
#: Suffixes in a group of one prefix.
MEMORY = 2_000_000


def _groups(first: np.ndarray, following, most: int, depth: int, limit: int):
    """Index arrays of suffixes by prefix: one word, and one more while a group holds over `most` and the depth allows."""
    todo = [(np.arange(len(first)), first, 1)]
    while todo:
        index, word, n = todo.pop()
        order = np.argsort(word, kind="stable")
        cuts = np.flatnonzero(np.diff(word[order])) + 1
        bounds = np.concatenate(([0], cuts, [len(order)]))
        sizes = np.diff(bounds)
        # Small prefixes share a group.
        held: list[np.ndarray] = []
        total = 0
        for g in np.flatnonzero(sizes > 1) if most < len(index) else [None]:
            part = order if g is None else order[bounds[g] : bounds[g + 1]]
            if g is not None and len(part) > most and n < limit:
                todo.append((index[part], following(index[part], n), n + 1))
                continue
            if total + len(part) > most and held:
                yield index[np.concatenate(held)]
                held, total = [], 0
            held.append(part)
            total += len(part)
        if held:
            yield index[np.concatenate(held)]


def deep_nodes(words: np.ndarray, starts: np.ndarray, length: int, most: int = MEMORY, edge: int = 4) -> np.ndarray:
    """For each start, the first start whose window of `length` words is equal (itself, if none is earlier).

    An edge of the tree is read `edge` words at a time."""
    out = np.arange(len(starts))
    if not len(starts):
        return out
    grams = {k: gram_hashes(words, k) for k in {min(edge, length), length % edge or edge}}
    for group in _groups(words[starts], lambda i, n: words[starts[i] + n], most, 1, length):
        live, depth = group, 0
        node = np.zeros(len(live), np.int64)
        while depth < length and len(live):
            step = min(edge, length - depth)
            label = grams[step][starts[live] + depth]
            order = np.lexsort((live, label, node))
            live, node, label = live[order], node[order], label[order]
            new = np.concatenate(([True], (node[1:] != node[:-1]) | (label[1:] != label[:-1])))
            node = np.cumsum(new) - 1
            keep = np.bincount(node)[node] > 1
            live, node = live[keep], node[keep]
            depth += step
        if len(live):
            first = np.concatenate(([True], node[1:] != node[:-1]))
            out[live] = live[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return out


def _pack(text: bytes):
    words = word_units(text)
    return lambda a, b: words[a:b].tobytes()


def judge(frame, length: int) -> list[list[tuple[int, int]]]:
    """Spans of the first copies of distinct segments of whole keys: starts whose window also starts earlier."""
    # Keys apart, earliest segments first: a smaller index is then an earlier start.
    order = frame.sort_values(["key", "id0", "h", "start"], kind="stable").index.to_numpy()
    segs = [np.frombuffer(frame["seg"].iloc[i], np.uint64) for i in order]
    n = np.array([len(s) for s in segs])
    base = np.cumsum(n) - n
    count = n - length + 1
    seg = np.repeat(np.arange(len(n)), count)
    starts = base[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    later = deep_nodes(np.concatenate(segs), starts, length) != np.arange(len(starts))
    spans: list[list[tuple[int, int]]] = [[] for _ in order]
    for i, e, c in zip(order, np.cumsum(count), count, strict=True):
        spans[i] = list(zip(*(x.tolist() for x in runs(later[e - c : e])), strict=True))
    return spans


def later_starts(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """id0, h, spans: stretches (first, last + 1) of window starts whose words also start earlier."""
    cuts = candidates(keyed, repeated_keys(keyed, word_units, length, gram), _pack, length)
    distinct = distinct_segments(cuts.filter("not plain"))
    hits = resolved(distinct, judge, 8, length, gram, (6, 1), later=True)
    here = F.struct("id0", "h", "start")
    # An equal segment that stands later repeats throughout; what holds for a first copy stands in the hits.
    where = repeating(cuts.drop("seg"), F.count(F.lit(1)), {"first": F.min(here)}, ("key", "d1", "d2")).filter(here != F.col("first"))
    others = where.select("id0", "h", whole("start", "starts").alias("spans"))
    first = hits.join(distinct.select("key", "d1", "d2", "id0", "h", "start"), ["key", "d1", "d2"]).select("id0", "h", shifted("spans", "start").alias("spans"))
    return joined_spans(others.union(first))


def _kept(text: bytes, spans: list, length: int) -> tuple[int, int, bytes]:
    a, b = word_spans(text)
    if not spans:
        return len(a), 0, b" ".join(text.split())
    gone = np.zeros(len(a) + 1, np.int64)
    for s in spans:
        gone[s["a"]] += 1
        gone[min(s["b"] + length - 1, len(a))] -= 1
    out = np.cumsum(gone[:-1]) > 0
    words = text.split()
    return len(a), int(out.sum()), b" ".join(words[i] for i in np.flatnonzero(~out))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (remaining words joined by one space), n_words, n_removed, kept_sha256."""
    keyed = with_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    spans = later_starts(keyed, length, gram)

    def apply(batches):
        for b in slices(batches, "z", 700_000):
            rows = [_kept(t, s, length) for t, s in zip(texts_of(b), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([r[2].decode() for r in rows]), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "kept", "n_words", "n_removed", "kept_sha256"])

    joined = squeezed(keyed).join(spans, ["id0", "h"], "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(apply, "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string")
