"""Windows that may repeat, brought together by content.

A window of `length` units (bytes or words) is keyed by the least hash of the `gram`-unit grams in it, so equal windows
have equal keys wherever they stand. Consecutive window starts with one key form a segment. Only keys that occur twice
can hold a repeated window; their segments are cut from the texts. Where all segments of a key are equal (by a 128-bit
digest of their contents) they repeat throughout. Elsewhere equal segments are made one, and each key's distinct segments
meet in one task, whose exact structure (suffix array or suffix tree) decides what repeats.

No task gets more than about SHARD bytes of a key: the segments of a larger key are split into stretches of window
starts that hold the key's gram at about the same place (`block` places), and a stretch is keyed by all that its windows
have in common, which is a longer prefix than the gram; what is still too large is split again by finer blocks, down to
single windows, of which equal ones are one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlex.llm._common import release, slices, utf8, written

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTE_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Window starts handled at once; a longer text is taken in overlapping pieces.
CHUNK = 1_000_000
#: Bytes of one key's distinct segments that may meet in a task.
SHARD = 1_500_000
#: A key with more segments than HOT_ROWS and than a MOST_HOT-th part of all is looked up by broadcast: so fewer than MOST_HOT keys are.
HOT_ROWS, MOST_HOT = 2_000, 200_000


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    make = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))))
    return make(_BASE), make(pow(_BASE, -1, 2**64))


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value x base^i (modulo 2^64) and the powers that shift a difference back."""
    power, back = _powers(1 << max(10, len(values).bit_length()))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64))), back


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    if len(values) < k:
        return np.empty(0, np.uint64)
    p, back = _prefix(values)
    return mixed((p[k:] - p[:-k]) * back[: len(values) - k + 1])


def byte_units(text: bytes) -> np.ndarray:
    return _BYTE_VALUE[np.frombuffer(text, np.uint8)]


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    inside = np.concatenate(([False], ~_IS_SPACE[np.frombuffer(text, np.uint8)], [False])).view(np.int8)
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_units(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word."""
    starts, ends = word_spans(text)
    p, back = _prefix(byte_units(text))
    return mixed((p[ends] - p[starts]) * back[starts])


def _sliding(ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """ufunc over every w consecutive values, by running values from both ends of blocks."""
    n = len(x) - w + 1
    blocks = np.resize(x, -(-len(x) // w) * w)
    blocks[len(x) :] = x[-1]
    blocks = blocks.reshape(-1, w)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    back = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[:n], ahead[w - 1 : w - 1 + n])


def _segments(values: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(document, start, starts, key, digest, marks) of the segments; documents stand at offsets[i]:offsets[i + 1] of values.

    marks: 2 if the key's gram stands more than once in the segment, else 1."""
    w = length - gram + 1
    if len(values) < length:
        return None
    p, back = _prefix(values)
    g = mixed((p[gram:] - p[:-gram]) * back[: len(values) - gram + 1])
    key = _sliding(np.minimum, g, w)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
    valid = np.arange(len(key)) + length <= offsets[1:][doc]
    turn = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])))
    first = np.flatnonzero(turn)
    n = np.diff(np.append(first, len(key)))
    keep = valid[first]
    first, n = first[keep], n[keep]
    if not len(first):
        return None
    # A gram is the least of some window if it equals the greatest key of the windows around it.
    padded = np.concatenate((np.full(w - 1, key[0]), key, np.full(w - 1, key[-1])))
    least = np.flatnonzero(g == _sliding(np.maximum, padded, w)[: len(g)])
    lo, hi = np.searchsorted(least, first), np.searchsorted(least, first + n + w - 1)
    size = np.maximum(hi - lo, 1)
    i = np.repeat(np.arange(len(first)), size)
    at = np.minimum(lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size), len(least) - 1)
    same = np.bincount(i, g[least[at]] == key[first[i]], len(first))
    digest = mixed((p[first + n + length - 1] - p[first]) * back[first] + n.astype(np.uint64) * _MIX)
    return doc[first], first - offsets[doc[first]], n, key[first].view(np.int64), digest.view(np.int64), np.where(same > 1, 2, 1)


def segments_of(units: list[np.ndarray], length: int, gram: int, chunk: int = CHUNK):
    """As _segments, for a list of documents; in pieces of about `chunk` window starts."""
    group, base, total = [], 0, 0
    for i, u in enumerate([*units, None]):
        if u is None or total + len(u) > chunk:
            if group and (made := _segments(np.concatenate(group), np.concatenate(([0], np.cumsum([len(x) for x in group]))), length, gram)):
                yield made[0] + base, *made[1:]
            group, base, total = [], i, 0
        if u is None:
            return
        if len(u) <= chunk:
            group.append(u)
            total += len(u)
            continue
        for a in range(0, len(u) - length + 1, chunk):
            piece = u[a : a + chunk + length - 1]
            if made := _segments(piece, np.array([0, len(piece)]), length, gram):
                yield made[0] + i, made[1] + a, *made[2:]
        base = i + 1


def with_key(docs: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, text, the columns in carry and the key of a row (id0, h). h is a hash of the text only where ids repeat or are null, so that
    rows with one id and other texts keep apart; elsewhere it is 0."""
    repeats = docs.groupBy("doc_id").count().filter("`count` > 1 or doc_id is null").limit(1).count()
    h = F.xxhash64(F.coalesce("text", F.lit(""))) if repeats else F.lit(0).cast("long")
    return docs.select("doc_id", "text", *carry, F.coalesce("doc_id", F.lit(-(2**63))).alias("id0"), h.alias("h"))


def squeezed(keyed: DataFrame) -> DataFrame:
    """keyed with the text compressed, as z, to be shuffled."""
    others = [c for c in keyed.columns if c != "text"]

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches, "text"):
            cols = [*(b.column(i) for i in range(len(others))), pa.array([squeeze(t) for t in utf8(b, "text")], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*others, "z"])

    return keyed.select(*others, "text").mapInArrow(run, T.StructType([*(keyed.schema[c] for c in others), T.StructField("z", T.BinaryType())]))


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    back = zstandard.ZstdDecompressor().decompress
    return [back(z) for z in batch.column(batch.schema.get_field_index("z")).to_pylist()]


def hot_cut(total: int) -> int:
    """A key with more rows than this is hot. Fewer than MOST_HOT keys can be, however many rows there are in all, and no
    other key has more than HOT_ROWS rows or a MOST_HOT-th part of all."""
    return max(HOT_ROWS, total // MOST_HOT)


def _joined_key(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for the key columns of a row."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mixed(out * np.uint64(_BASE) + c.view(np.uint64))
    return out


def _looked_up(rows: DataFrame, hot: pa.Table, by: list[str], adds: list[str]) -> DataFrame:
    """rows with hot, whether the key (columns `by`) stands in the table `hot`, and that one's columns `adds` if it does.

    The table has fewer than MOST_HOT rows, so every task can have it; a row is looked up where it stands."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, hot.schema) as writer:
        writer.write_table(hot)
    shared = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    at = [rows.columns.index(c) for c in by]

    def mark(batches):
        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        keys = [table.column(c).to_numpy() for c in by]
        joined = _joined_key(keys)
        order = np.argsort(joined)
        joined, keys = joined[order], [k[order] for k in keys]
        values = [table.column(c).take(pa.array(order)).combine_chunks() for c in adds]
        values = [v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in values]
        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(i).to_numpy(zero_copy_only=False) for i in at]
            place = np.minimum(np.searchsorted(joined, _joined_key(own)), len(joined) - 1)
            hit = np.logical_and.reduce([k[place] == o for k, o in zip(keys, own, strict=True)])
            index = pa.array(place, mask=~hit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit), *(v.take(index) for v in values)], [*b.schema.names, "hot", *adds])

    kinds = {f.name: f for f in rows.sparkSession.createDataFrame(hot.slice(0, 1)).schema}
    schema = T.StructType([*rows.schema, T.StructField("hot", T.BooleanType()), *(T.StructField(c, kinds[c].dataType) for c in adds)])
    return rows.mapInArrow(mark, schema)


def repeating(rows: DataFrame, n: Column, adds: dict[str, Column], by: tuple[str, ...] = ("key",), least: int = 2) -> DataFrame:
    """Those rows whose key (columns `by`, long) has an n (a sum over its rows) of `least` or more, with further aggregates of the key; rows is a table.

    Hot keys are few: their aggregates go to every task, and their rows aren't shuffled. The rows of any other key meet in a
    window of bounded size."""
    by = list(by)
    cut = hot_cut(rows.agg(n.alias("n")).first()[0] or 0)
    hot = rows.groupBy(*by).agg(n.alias("n"), *(c.alias(a) for a, c in adds.items())).filter(F.col("n") > cut).drop("n").toArrow()
    same = Window.partitionBy(*by)
    among = lambda df: df.withColumns({"n_": n.over(same)} | {a: c.over(same) for a, c in adds.items()}).filter(F.col("n_") >= least).drop("n_")
    if not hot.num_rows:
        return among(rows)
    marked = _looked_up(rows, hot, by, list(adds))
    return marked.filter("hot").drop("hot").unionByName(among(marked.filter("not hot").drop("hot", *adds)))


def repeated_keys(keyed: DataFrame, units: Callable[[bytes], np.ndarray], length: int, gram: int) -> DataFrame:
    """key, id0, h, start, starts, plain: the segments whose key occurs twice; plain: all segments of the key seem equal."""

    def find(batches):
        for b in slices(batches, "text", CHUNK):
            ids, hs = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for doc, start, n, key, digest, marks in segments_of([units(t) for t in utf8(b, "text")], length, gram):
                cols = [pa.array(key), pa.array(digest), pa.array(ids[doc]), pa.array(hs[doc]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(marks.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "digest", "id0", "h", "start", "starts", "marks"])

    found = written(keyed.select("id0", "h", "text").mapInArrow(find, "key long, digest long, id0 long, h long, start long, starts int, marks int"), "segments")
    marked = repeating(found, F.sum("marks"), {"low": F.min("digest"), "high": F.max("digest"), "most": F.max("marks")})
    return marked.select("key", "id0", "h", "start", "starts", ((F.col("low") == F.col("high")) & (F.col("most") == 1)).alias("plain"))


def joined_spans(rows: DataFrame) -> DataFrame:
    """All spans of a document in one row."""
    return rows.groupBy("id0", "h").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def shifted(spans: str, by: str) -> Column:
    return F.transform(spans, lambda s: F.struct((s["a"] + F.col(by)).alias("a"), (s["b"] + F.col(by)).alias("b")))


def whole(start: str, starts: str) -> Column:
    return F.array(F.struct(F.col(start).alias("a"), (F.col(start) + F.col(starts)).alias("b")))


def candidates(keyed: DataFrame, segments: DataFrame, pack: Callable[[bytes], Callable[[int, int], bytes]], length: int) -> DataFrame:
    """key, anchor (the key), plain, d1, d2 (digest of the segment), id0, h, start, starts, n (1), seg; a table in the shared folder.

    seg, the segment's content as pack(text)(start, end) gives it, is null where this task has written it before, and
    for plain keys, whose digests are equal."""
    # A row that stands in the table several times has its segments that often in the list: once is enough for each.
    kept = segments.groupBy("id0", "h").agg(F.array_distinct(F.collect_list(F.struct("key", "start", "starts", "plain"))).alias("segs"))

    def cut(batches):
        done: set[tuple[int, bytes]] = set()
        for b in slices(batches, "z", CHUNK // 3):
            rows = []
            for id0, h, segs, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b), strict=True):
                content = pack(text)
                for s in segs:
                    key, start, n, plain = s["key"], s["start"], s["starts"], s["plain"]
                    seg = content(start, start + n + length - 1)
                    digest = xxhash.xxh3_128_digest(seg)
                    new = not plain and (key, digest) not in done
                    if new:
                        done.add((key, digest))
                    rows.append((key, key, plain, digest, id0, h, start, n, 1, seg if new else None))
                if len(done) > 500_000:
                    done.clear()
            if rows:
                columns = list(zip(*rows, strict=True))
                d = np.frombuffer(b"".join(columns[3]), np.int64).reshape(-1, 2)
                columns[3:4] = [np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["key", "anchor", "plain", "d1", "d2", "id0", "h", "start", "starts", "n", "seg"]
    types = [pa.bool_() if c == "plain" else pa.binary() if c == "seg" else pa.int64() for c in names]
    schema = ", ".join(f"{c} {'boolean' if c == 'plain' else 'binary' if c == 'seg' else 'long'}" for c in names)
    joined = squeezed(keyed).join(kept, ["id0", "h"]).select("id0", "h", "segs", "z")
    cuts = written(joined.mapInArrow(cut, schema), "cuts")
    # A key that only seemed plain (the rolling digest collided) is cut again, with contents.
    digests = [f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)]
    unlike = written(cuts.filter("plain").groupBy("key").agg(*digests).filter("min_d1 < max_d1 or min_d2 < max_d2").select("key"), "unlike")
    if unlike.isEmpty():
        return cuts
    again = segments.join(unlike, "key", "left_semi").withColumn("plain", F.lit(False))
    return cuts.join(unlike, "key", "left_anti").unionByName(candidates(keyed, again, pack, length))


def distinct_segments(cuts: DataFrame) -> DataFrame:
    """key, anchor, d1, d2, n (copies), id0, h, start (of the first copy), size, seg; a table in the shared folder."""
    seen = cuts.groupBy("key", "anchor", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("id0", "h", "start")).alias("at"), F.max("seg").alias("seg"))
    return written(seen.select("key", "anchor", "d1", "d2", "n", "at.*", F.length("seg").cast("long").alias("size"), "seg"), "distinct")


def _stretches(seg: bytes, anchor: int, unit: int, length: int, gram: int, block: int):
    """(key, first start, starts) of the stretches of a segment; unit: bytes of one unit (1: bytes, 8: word hashes)."""
    values = byte_units(seg) if unit == 1 else np.frombuffer(seg, np.uint64)
    at = np.flatnonzero(gram_hashes(values, gram).view(np.int64) == anchor)
    start = np.arange(len(values) - length + 1)
    spot = at[np.searchsorted(at, start)]  # of the first such gram in each window
    part = (spot - start) // block
    first = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (part[1:] != part[:-1]))))
    for a, n in zip(first.tolist(), np.diff(np.append(first, len(start))).tolist(), strict=True):
        low = int(spot[a]) - block * int(part[a])
        core = seg[low * unit : (low - block + 1 + length) * unit]
        yield xxhash.xxh64_intdigest(core, (anchor ^ int(part[a])) & (1 << 64) - 1), a, n


def _split(rows: DataFrame, unit: int, length: int, gram: int, block: int) -> DataFrame:
    """Stretches of distinct segments: those of keys that occur twice, as cuts, with p_key, p_d1, p_d2, off and starts (where in which segment)."""
    names = ["key", "anchor", "d1", "d2", "n", "id0", "h", "start", "seg", "p_key", "p_d1", "p_d2", "off", "starts"]

    def run(batches):
        for b in slices(batches, "seg", CHUNK // 4):
            out = []
            for key, anchor, d1, d2, n, id0, h, start, seg in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for part, a, m in _stretches(seg, anchor, unit, length, gram, block):
                    piece = seg[a * unit : (a + m + length - 1) * unit]
                    d = np.frombuffer(xxhash.xxh3_128_digest(piece), np.int64)
                    out.append((part - (1 << 64) if part >> 63 else part, anchor, int(d[0]), int(d[1]), n, id0, h, start + a, piece, key, d1, d2, a, m))
            types = [pa.binary() if c == "seg" else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = ", ".join(f"{c} binary" if c == "seg" else f"{c} long" for c in names)
    made = written(rows.select("key", "anchor", "d1", "d2", "n", "id0", "h", "start", "seg").mapInArrow(run, schema), "stretches")
    return repeating(made, F.sum("n"), {})


SPANS = "key long, d1 long, d2 long, spans array<struct<a:long,b:long>>"


def resolved(distinct: DataFrame, judge: Callable, unit: int, length: int, gram: int, blocks: tuple[int, ...], later: bool, most: int = SHARD) -> DataFrame:
    """key, d1, d2, spans: stretches (first, last + 1) of starts that repeat in a distinct segment.

    judge(frame, length) gives the spans of each segment of whole keys; keys of more than `most` bytes are split. later: the spans are those of the first copy, while all
    others repeat throughout; else the spans hold for all copies."""

    def shard(batches):
        for frame in by_key(batches, most):
            spans = judge(frame, length)
            hit = [i for i, s in enumerate(spans) if s]
            made = [[{"a": a, "b": b} for a, b in spans[i]] for i in hit]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(pa.array(frame[c].to_numpy()[hit]) for c in ("key", "d1", "d2")), pa.array(made, kind)], ["key", "d1", "d2", "spans"])
        release()

    columns = ["key", "d1", "d2", "n", "id0", "h", "start", "seg"]
    sizes = distinct.groupBy("key").agg(F.sum("size").alias("size"))
    large = written(sizes.filter(F.col("size") > most).select("key"), "large_keys") if blocks else None
    some = large.count() if large is not None else 0
    small = distinct
    if some:
        # Beyond the bound the lookup is a join of keys, whose rows are distinct segments.
        looked_up = F.broadcast(large) if some <= MOST_HOT else large
        small = distinct.join(looked_up, "key", "left_anti")
    dealt = small.select(*columns).repartition("key").sortWithinPartitions("key", "d1", "d2")
    hits = dealt.mapInArrow(shard, SPANS)
    if not some:
        return hits
    parts = _split(distinct.join(looked_up, "key"), unit, length, gram, blocks[0])
    pieces = distinct_segments(parts)
    found = resolved(pieces, judge, unit, length, gram, blocks[1:], later, most)
    if later:
        first = pieces.select("key", "d1", "d2", *[F.col(c).alias(f"{c}_1") for c in ("id0", "h", "start")])
        own = (F.col("id0") == F.col("id0_1")) & (F.col("h") == F.col("h_1")) & (F.col("start") == F.col("start_1"))
        where = parts.drop("seg").join(first, ["key", "d1", "d2"]).join(found, ["key", "d1", "d2"], "left")
        back = where.select("p_key", "p_d1", "p_d2", F.when(own, F.coalesce(shifted("spans", "off"), F.array().cast("array<struct<a:long,b:long>>"))).otherwise(whole("off", "starts")).alias("spans"))
    else:
        # A piece with equals repeats throughout: only pieces without any meet their spans in a join.
        counted = repeating(parts.drop("seg"), F.sum("n"), {"copies": F.sum("n")}, ("key", "d1", "d2"), least=1)
        alike = counted.filter("copies > 1").select("p_key", "p_d1", "p_d2", whole("off", "starts").alias("spans"))
        back = counted.filter("copies = 1").join(found, ["key", "d1", "d2"]).select("p_key", "p_d1", "p_d2", shifted("spans", "off").alias("spans")).union(alike)
    back = back.groupBy("p_key", "p_d1", "p_d2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return hits.union(back.filter(F.size("spans") > 0))


def by_key(batches, most: int = SHARD):
    """Whole keys from batches sorted by key (first column; the column `seg` is measured), as pandas frames of about `most` bytes."""
    import pandas as pd

    rest: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        for part in slices([batch], "seg", most // 2):
            frame = part.to_pandas()
            if rest and size >= most and frame["key"].iloc[0] != rest[-1]["key"].iloc[-1]:
                yield pd.concat(rest, ignore_index=True)
                rest, size = [], 0
            rest.append(frame)
            size += int(frame["seg"].map(len).sum())
            if size >= most and frame["key"].iloc[0] != frame["key"].iloc[-1]:
                # The last key may go on.
                cut = int(np.searchsorted(frame["key"].to_numpy(), frame["key"].iloc[-1]))
                yield pd.concat([*rest[:-1], frame.iloc[:cut]], ignore_index=True)
                rest = [frame.iloc[cut:]]
                size = int(rest[0]["seg"].map(len).sum())
    if rest:
        yield pd.concat(rest, ignore_index=True)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    turn = np.diff(np.concatenate(([False], flags, [False])).view(np.int8))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
