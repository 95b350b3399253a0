"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere are removed.

Method: candidate segments meet by content (see _windows); each shard of whole keys is one text, whose suffix array is
induced: suffixes are classified, leftmost-smaller substrings are sorted by induction and named, the shorter string of
names is sorted by the same means, recursively, and the shard array is induced from it, bucket by bucket in numpy
batches. Permuted common prefixes then tell, for each window, whether a neighbour in the array shares `length` bytes.
Before that, equal segments are made one, and stretches whose windows' rolling hashes stand once in the shard are left
out; what stays is decided by the array.

Nulls: a null text is empty; a null doc_id is a document like any other. A repeated row counts as another document, so
all its long strings repeat. Texts shorter than `length` are kept. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlex.llm._common import slices, utf8, written
from netlex.llm._windows import CHUNK, SHARD, byte_units, candidates, distinct_segments, gram_hashes, joined_spans, repeated_keys, repeating, resolved, runs, segments_of, shifted, squeezed, texts_of, whole, with_key

LENGTH, GRAM = 400, 64
#: Never in UTF-8, so no common prefix of two segments is longer than a segment.
SEPARATOR = 0xFF


def induced_order(s: list[int]) -> list[int]:
    """Suffix array of a string of integers from 0 (the end counts as least), by induced sorting; its names are sorted by
    another level of the same."""
    n = len(s)
    if n < 2:
        return list(range(n))
    small = [False] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    counts = [0] * (max(s) + 1)
    for c in s:
        counts[c] += 1
    ends = list(itertools.accumulate(counts))
    begins = [e - c for e, c in zip(ends, counts, strict=True)]

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        tail = ends.copy()
        for i in reversed(seeds):
            tail[s[i]] -= 1
            out[tail[s[i]]] = i
        head = begins.copy()
        out[head[s[n - 1]]] = n - 1
        head[s[n - 1]] += 1
        for k in range(n):
            j = out[k] - 1
            if j >= 0 and not small[j]:
                out[head[s[j]]] = j
                head[s[j]] += 1
        tail = ends.copy()
        for k in range(n - 1, -1, -1):
            j = out[k] - 1
            if j >= 0 and small[j]:
                tail[s[j]] -= 1
                out[tail[s[j]]] = j
        return out

    leftmost = [i for i in range(1, n) if small[i] and not small[i - 1]]
    if not leftmost:
        return induce([])
    stop = dict(zip(leftmost, [*(i + 1 for i in leftmost[1:]), n], strict=True))
    order = [i for i in induce(leftmost) if i in stop]
    names, name, last = {}, -1, None
    for i in order:
        part = s[i : stop[i]] + [-1] * (stop[i] == n)  # to the end: unlike any other
        name += part != last
        names[i], last = name, part
    seeds = order if name + 1 == len(order) else [leftmost[k] for k in induced_order([names[i] for i in leftmost])]
    return induce(seeds)


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes sorted by induction from sorted `seeds` (leftmost-smaller positions, each at its bucket's end).

    A bucket is taken in batches: those that stand in it, then those of the same byte that they bring, and so on."""
    n = len(text)
    sizes = np.bincount(text, minlength=256)
    heads = np.cumsum(sizes) - sizes
    tails = heads + sizes
    seed_bytes = text[seeds]
    large: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(batch: np.ndarray, want_smaller: bool, lists) -> np.ndarray | None:
        """Puts what stands before the batch's suffixes into its bucket's list, in order."""
        before = batch[batch > 0] - 1
        before = before[smaller[before] == want_smaller]
        if not len(before):
            return
        b = text[before]
        order = np.argsort(b, kind="stable")
        before, b = before[order], b[order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        for part in np.split(before, cuts):
            lists[text[part[0]]].append(part)

    # The empty suffix stands first and brings the last position, if that is larger-type.
    if not smaller[n - 1]:
        large[text[n - 1]].append(np.array([n - 1]))
    seed_of = np.split(seeds, np.searchsorted(seed_bytes, np.arange(1, 256)))
    larger = []
    for c in range(256):
        done = 0
        while done < len(large[c]):
            todo, done = large[c][done:], len(large[c])
            deal(np.concatenate(todo), False, large)
        larger.append(np.concatenate(large[c]) if large[c] else np.empty(0, np.int64))
        if len(seed_of[c]):
            deal(seed_of[c], False, large)
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = np.empty(n, np.int64)
    for c in range(255, -1, -1):
        # Right to left: what larger buckets brought, then its own, then the larger-type part; lists are in reverse.
        done = 0
        while done < len(small[c]):
            todo, done = small[c][done:], len(small[c])
            deal(np.concatenate(todo), True, small)
        part = np.concatenate(small[c])[::-1] if small[c] else np.empty(0, np.int64)
        deal(larger[c][::-1], True, small)
        out[heads[c] : heads[c] + len(larger[c])] = larger[c]
        out[tails[c] - len(part) : tails[c]] = part
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a non-empty uint8 text, by induced sorting."""
    n = len(text)
    t = text.astype(np.int64)
    # A suffix is smaller-type if the next different byte is larger; the end counts as least.
    change = np.flatnonzero(np.diff(t)) if n > 1 else np.empty(0, np.int64)
    ends = np.append(change, n - 1)
    kind = np.append(t[change + 1] > t[change], False)
    smaller = np.repeat(kind, np.diff(np.concatenate(([-1], ends))))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return _induce(text, smaller, lms)
    first = _induce(text, smaller, lms[np.argsort(text[lms], kind="stable")])
    # Leftmost-smaller substrings in sorted order; equal neighbours get one name.
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    span = np.diff(np.append(lms, n)) + 1
    length = np.zeros(n, np.int64)
    length[lms] = span
    length[lms[-1]] = n - lms[-1] + 1  # to the end: unlike any other
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    d = 0
    while len(live):
        x, y = a[live] + d, b[live] + d
        inside = y < n
        inside &= x < n
        equal = np.zeros(len(live), bool)
        equal[inside] = text[x[inside]] == text[y[inside]]
        same[live[~equal]] = False
        d += 1
        live = live[equal]
        live = live[length[a[live]] > d]
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate(([0], np.cumsum(~same)))
    sequence = names[lms]
    if sequence.max() + 1 < len(lms):
        seeds = lms[np.array(induced_order(sequence.tolist()), np.int64)]
    else:
        seeds = order
    return _induce(text, smaller, seeds)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix of each suffix with the one before it in the array, by position; that suffix's position or -1).

    Only where the bytes before the two differ is a prefix compared; elsewhere it is one less than at the position before."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    own = (before <= 0) | (i == 0)
    rest = ~own
    own[rest] = text[i[rest] - 1] != text[before[rest] - 1]
    at = np.flatnonzero(own & (before >= 0))
    plcp = np.zeros(n, np.int64)
    words = np.zeros(n + 8, np.uint8)
    words[:n] = text
    wide = np.lib.stride_tricks.sliding_window_view(words, 8)
    packed = wide[: n + 1].copy().view(np.uint64).ravel()
    length, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        x, y = at[live] + length[live], before[at[live]] + length[live]
        ok = np.maximum(x, y) < n
        equal = np.zeros(len(live), bool)
        equal[ok] = packed[x[ok]] == packed[y[ok]]
        stop = live[~equal]
        length[live[equal]] += 8
        if len(stop):
            for k in range(8):
                p, q = at[stop] + length[stop], before[at[stop]] + length[stop]
                ok = np.maximum(p, q) < n
                stop, p, q = stop[ok], p[ok], q[ok]
                hit = text[p] == text[q]
                stop = stop[hit]
                length[stop] += 1
        live = live[equal]
    # The zero bytes past the end may have counted as equal.
    length = np.minimum(length, n - np.maximum(at, before[at]))
    plcp[at] = length
    last = np.maximum.accumulate(np.where(own, i, 0))
    return np.where(before >= 0, np.maximum(plcp[last] - (i - last), 0), 0), before


def repeated(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, whether the window of `length` bytes at each start also stands elsewhere in the segments."""
    text = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in segments), np.uint8)
    plcp, before = permuted_prefixes(text, suffix_array(text))
    hit = plcp >= length
    flags = hit.copy()
    flags[before[hit]] = True
    ends = np.cumsum([len(s) + 1 for s in segments])
    return [flags[e - len(s) - 1 : max(e - length, e - len(s) - 1)] for s, e in zip(segments, ends, strict=True)]


def _twice(segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, first, last + 1) of the stretches of window starts whose rolling hash stands twice in the segments."""
    values = byte_units(b"".join(segments))
    sizes = np.array([len(s) for s in segments])
    count = np.maximum(sizes - length + 1, 0)
    seg = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    h = gram_hashes(values, length)[(np.cumsum(sizes) - sizes)[seg] + start]
    ordered = np.sort(h)
    double = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(double):
        return []
    hit = np.flatnonzero(double[np.minimum(np.searchsorted(double, h), len(double) - 1)] == h)
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(seg[hit]) != 0)) + 1
    return [(int(seg[p[0]]), int(start[p[0]]), int(start[p[-1]]) + 1) for p in np.split(hit, cut)]


def judge(frame, length: int) -> list[list[tuple[int, int]]]:
    """Spans of the distinct segments of whole keys: one with equals repeats throughout; of the others, stretches whose
    windows' hashes stand twice are sorted, and the suffix array decides."""
    segments = list(frame["seg"])
    spans = [[(0, len(s) - length + 1)] if n > 1 else [] for s, n in zip(segments, frame["n"], strict=True)]
    found = _twice(segments, length)
    if found:
        for (i, a, _), flags in zip(found, repeated([segments[i][a : b + length - 1] for i, a, b in found], length), strict=True):
            if frame["n"].iloc[i] < 2:
                spans[i] += [(x + a, y + a) for x, y in zip(*(r.tolist() for r in runs(flags)), strict=True)]
    return spans


def _pack(text: bytes):
    return lambda a, b: text[a:b]


def repeated_starts(keyed: DataFrame, length: int, gram: int, most: int = SHARD) -> DataFrame:
    """id0, h, spans: stretches (first, last + 1) of window starts whose window also stands elsewhere. A shard has about `most` bytes."""
    cuts = candidates(keyed, repeated_keys(keyed, byte_units, length, gram), _pack, length)
    distinct = distinct_segments(cuts.filter("not plain"))
    hits = resolved(distinct, judge, 1, length, gram, (64, 8, 1), later=False, most=most)
    whole_spans = cuts.filter("plain").select("id0", "h", whole("start", "starts").alias("spans"))
    # A segment with equals repeats throughout: only segments without any meet their spans in a join.
    alike = repeating(cuts.filter("not plain").drop("seg"), F.count(F.lit(1)), {}, ("key", "d1", "d2"))
    single = distinct.filter("n = 1").select("key", "d1", "d2", "id0", "h", "start").join(hits, ["key", "d1", "d2"])
    spans = whole_spans.union(alike.select("id0", "h", whole("start", "starts").alias("spans")))
    return joined_spans(spans.union(single.select("id0", "h", shifted("spans", "start").alias("spans"))))


def shared_grams(keyed: DataFrame, gram: int, window: int) -> DataFrame:
    """id0, h, n_shared: of the least-hash grams of each `window` consecutive ones, how many also stand elsewhere.

    A string of gram + window - 1 bytes that stands elsewhere has one; no string shorter than gram has."""

    def find(batches):
        for b in slices(batches, "text", CHUNK):
            ids, hs = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for doc, _, _, key, _, marks in segments_of([byte_units(t) for t in utf8(b, "text")], gram + window - 1, gram):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[doc]), pa.array(hs[doc]), pa.array(marks.astype(np.int8))], ["key", "id0", "h", "marks"])

    found = written(keyed.select("id0", "h", "text").mapInArrow(find, "key long, id0 long, h long, marks byte"), "grams")
    return repeating(found, F.sum("marks"), {}).groupBy("id0", "h").agg(F.count("*").alias("n_shared"))


def _covered(size: int, spans: list, length: int) -> np.ndarray:
    gone = np.zeros(size + 1, np.int64)
    for s in spans or []:
        gone[s["a"]] += 1
        gone[min(s["b"] + length - 1, size)] -= 1
    return np.cumsum(gone[:-1]) > 0


def _kept(text: bytes, spans: list, length: int, whole_characters: bool) -> tuple[bytes, int, int]:
    out = _covered(len(text), spans, length)
    data = np.frombuffer(text, np.uint8)
    if whole_characters and out.any():
        # A character goes only if all its bytes do.
        first = (data & 0xC0) != 0x80
        char = np.cumsum(first) - 1
        out = (np.bincount(char, ~out) == 0)[char]
    return data[~out].tobytes(), int(out.sum()), len(runs(out)[0])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = True, carry: list[str] | None = None, shorter: tuple[int, int] | None = None, most: int = SHARD) -> DataFrame:
    """doc_id, the columns in carry, kept (the remaining text), n_bytes, n_removed, n_spans, kept_sha256, n_shared.

    With whole_characters a character goes only if all its bytes are covered; without, `kept` is null, and the other
    columns count bytes. shorter: (gram, window) of shared_grams, whose count is n_shared (else null); it removes nothing."""
    names = [f"carried_{i}" for i in range(len(carry or []))]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry or [], names, strict=True)))
    keyed = with_key(texts, names)
    spans = repeated_starts(keyed, length, gram, most)
    if shorter:
        spans = spans.join(shared_grams(keyed, *shorter), ["id0", "h"], "full")

    def apply(batches):
        for b in slices(batches, "z", 700_000):
            rows = []
            for text, s in zip(texts_of(b), b.column(1).to_pylist(), strict=True):
                kept, removed, n = _kept(text, s, length, whole_characters)
                rows.append((kept.decode() if whole_characters else None, len(text), removed, n, hashlib.sha256(kept).hexdigest()))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            own = [b.column(i) for i in range(3, 4 + len(names))]
            yield pa.RecordBatch.from_arrays([*own, *made, b.column(2)], ["doc_id", *names, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    n_shared = F.coalesce("n_shared", F.lit(0)).cast("long") if shorter else F.lit(None).cast("long")
    joined = squeezed(keyed).join(spans, ["id0", "h"], "left").select("z", "spans", n_shared.alias("n_shared"), "doc_id", *names)
    made = T._parse_datatype_string("kept string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")
    out = joined.mapInArrow(apply, T.StructType([joined.schema["doc_id"], *(joined.schema[n] for n in names), *made]))
    return out.withColumnsRenamed(dict(zip(names, carry or [], strict=True)))


def rewrite(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, most: int = SHARD) -> DataFrame:
    """docs with repeated strings cut out of the text; size_col, if given, gets the new number of characters."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    out = dedup(docs.toDF(*docs.columns), length, gram, id_col, text_col, carry=others, most=most)
    cut = {text_col: F.coalesce("kept", F.lit(""))} | ({size_col: F.char_length("kept").cast("long")} if size_col else {})
    kind = dict(docs.dtypes)
    return out.select([(F.col("doc_id").cast(kind[c]) if c == id_col else cut.get(c, F.col(c))).alias(c) for c in docs.columns])
