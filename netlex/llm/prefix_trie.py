"""Conversation prefix trie with count-min screening of prefix digests.

Every distinct sequence of first d turns (role, text) is a node; conversations that start with it are its members. A turn
is known by two 64-bit hashes from the start, so no text is shuffled. A prefix is known by the running exclusive-or of its
turns' hashes, salted with their places: it needs no whole conversation in one task, so a conversation of any length is
spread over range parts.

Screening: a count-min sketch (DEPTH rows of a power of two of cells, counters that stop at two) counts the prefixes of all
conversations at the depths of a ladder (1 to 4, then steps that grow). A count-min sketch never underestimates, so an estimate of
one proves a prefix to be of one conversation only, and all longer ones with it: these tails are emitted where they stand,
without a shuffle. Only prefixes above, possibly shared ones, are grouped exactly. The sketch is built from sparse pieces, one
set a task, merged block by block; it has at most MOST_CELLS cells a row (2 bits each: 25 MB in all), which bounds what is
broadcast. With more prefixes than that it proves fewer tails and more rows are grouped; the result is the same.

Values of whole subtrees need no walk: each node's weight is put down to its least member, whose nodes are the lower end of
its path, so a subtree's sum is its members' sums less what stands above the node on its own least member's path.

Nulls: a null role or text is empty; null turns come first; rows with a null conv_id belong to no conversation and are left
out. Turns of one number are ordered by role, then by text (nulls first); repeated rows are turns of their own. An empty table
gives an empty result. Other columns are ignored. The digest of a node's ends is one SHA-256 over a sorted list and so
computed in one task a node, as a stream.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.llm._common import release, written
from netlex.llm._windows import mixed
from netlex.operators.ranges import running

DEPTH, MOST_CELLS = 3, 1 << 25
#: Cells that are merged together.
BLOCK = 1 << 16


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), t1, t2 (hashes of role and text), bytes (of the text); a table in the shared folder."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    at = ["conv_id", "turn", "role"]
    # Only texts of turns with the same number and role are compared; all others are ordered without them.
    tied = written(own.groupBy(*at).agg(F.count("*").alias("n_")).filter("n_ > 1").select(*(F.col(c).alias(f"{c}_") for c in at)), "tied")
    same = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in at))
    hashed = own.join(tied, same, "left").select(
        *at,
        F.when(F.col("conv_id_").isNotNull(), F.col("text")).alias("tie"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = running(written(hashed, "turns"), ["conv_id"], ["turn", "role", "tie"], {"place": (F.count, F.lit(1))})
    return written(placed.select("conv_id", (F.col("place") - 1).alias("place"), "t1", "t2", "bytes"), "digests")


def ladder(place: str = "d"):
    """Whether a depth is counted: 1 to 4 and those with at most two leading binary digits (6, 8, 12, 16, ...)."""
    return F.expr(f"{place} <= 4 or {place} & ({place} - 1) = 0 or ({place} % 3 = 0 and ({place} div 3) & (({place} div 3) - 1) = 0)")


def _cells(p1: np.ndarray, p2: np.ndarray, width: int) -> np.ndarray:
    """Cell numbers of each prefix, DEPTH rows of `width` cells one after the other."""
    p1, p2 = p1.view(np.uint64), p2.view(np.uint64)
    return np.stack([(mixed(p1 + p2 * np.uint64(2 * j + 1)) & np.uint64(width - 1)).astype(np.int64) + j * width for j in range(DEPTH)])


def sketch(prefixes: DataFrame, width: int) -> bytes:
    """The counters (0, 1, 2: more) of the distinct rows (p1, p2) times their number, four to a byte."""

    def count(batches):
        cells = [_cells(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), width).ravel() for b in batches]
        if not cells:
            return
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        block = cell // BLOCK
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=True):
            places = (cell[a:z] % BLOCK).astype(np.uint16)
            piece = places.tobytes() + places[n[a:z] > 1].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a])]), pa.array([z - a]), pa.array([zstandard.compress(piece)])], ["block", "n", "piece"])
        release()

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, n, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places = np.frombuffer(zstandard.decompress(piece), np.uint16)
                total = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                for part in (places[:n], places[n:]):
                    total[part] = np.minimum(total[part] + 1, 2)
        for block, total in sums.items():
            q = total.reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([zstandard.compress((q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes())])], ["block", "cells"])

    pieces = prefixes.select("p1", "p2").mapInArrow(count, "block long, n long, piece binary")
    rows = pieces.repartition("block").mapInArrow(merge, "block long, cells binary").collect()
    out = np.zeros(DEPTH * max(width, BLOCK) // 4, np.uint8)
    for r in rows:
        out[r.block * BLOCK // 4 : (r.block + 1) * BLOCK // 4] = np.frombuffer(zstandard.decompress(r.cells), np.uint8)
    return out.tobytes()


def screened(paths: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """paths (conv_id, d, p1, p2, ...) with tail: whether a shorter prefix of the conversation is proven to be its own alone.

    Rows of a conversation that stand one after the other in a task are ascending in d; what an earlier task has proven is not
    known to a later one, which costs rows but no correctness."""
    steps = paths.filter(ladder())
    n = steps.count()
    width = min(most_cells, max(BLOCK, 1 << (2 * n).bit_length()))
    shared = paths.sparkSession.sparkContext.broadcast(sketch(steps, width))
    at = [paths.columns.index(c) for c in ("conv_id", "d", "p1", "p2")]

    def mark(batches):
        table = np.frombuffer(shared.value, np.uint8)
        last, depth, proven = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            conv, d, p1, p2 = (b.column(i).to_numpy(zero_copy_only=False) for i in at)
            cell = _cells(p1, p2, width)
            single = ((table[cell >> 2] >> ((cell & 3) << 1).astype(np.uint8)) & 3).min(axis=0) == 1
            low, third = d & (d - 1), d // 3
            single &= (d <= 4) | (low == 0) | ((d % 3 == 0) & (third & (third - 1) == 0))
            goes_on = np.concatenate(([conv[0] == last and d[0] > depth], (conv[1:] == conv[:-1]) & (d[1:] > d[:-1])))
            before = np.cumsum(single) - single
            first = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(d))))
            tail = before - before[first] > 0
            if goes_on[0] and proven:
                end = int(np.argmin(goes_on)) if not goes_on.all() else len(d)
                tail[:end] = True
            last, depth, proven = conv[-1], d[-1], bool(tail[-1] or single[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tail)], [*b.schema.names, "tail"])

    schema = ", ".join(f"{c} {t}" for c, t in paths.dtypes)
    return paths.mapInArrow(mark, schema + ", tail boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """rows (d, p1, p2, conv_id) -> d, p1, p2, ends: SHA-256 of the ids of each node, ascending, with commas."""

    def digest(batches):
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]]))))
            made = []
            for a, z in zip(new.tolist(), [*new[1:].tolist(), b.num_rows], strict=True):
                this = tuple(int(c[a]) for c in cols[:3])
                listed = ",".join(map(str, cols[3][a:z].tolist())).encode()
                if this == key:
                    state.update(b"," + listed)
                    continue
                if key is not None:
                    made.append((*key, state.hexdigest()))
                key, state = this, hashlib.sha256(listed)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names)

    names = ["d", "p1", "p2", "ends"]
    dealt = rows.select("d", "p1", "p2", "conv_id").repartition("d", "p1", "p2").sortWithinPartitions("d", "p1", "p2", "conv_id")
    return dealt.mapInArrow(digest, "d long, p1 long, p2 long, ends string")


def trie_of(turns: DataFrame, conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """turns (conv_id, place, t1, t2, bytes), with places from 0, and all conversations (conv_id, length: their turns)
    -> one row a node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    salted = lambda t: F.xxhash64("place", t)
    hashed = turns.join(conversations, "conv_id").select("conv_id", (F.col("place") + 1).alias("d"), salted("t1").alias("x1"), salted("t2").alias("x2"), "bytes", "length")
    paths = running(written(hashed, "salted"), ["conv_id"], ["d"], {"p1": (F.bit_xor, F.col("x1")), "p2": (F.bit_xor, F.col("x2"))})
    marked = written(screened(written(paths, "paths"), most_cells), "screened")

    # Tails: nodes of one conversation under a node of that conversation alone.
    last = F.col("d") == F.col("length")
    none, own = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    one = F.lit(1).cast("long")
    tails = marked.filter("tail").select("conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, own).otherwise(none).alias("ends_sha256"))

    # Possibly shared: exact groups.
    shared = marked.filter("not tail").select("*", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))
    least = lambda c: F.min(c).alias(c)
    groups = shared.groupBy("d", "p1", "p2").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.max("length").alias("longest"), least("bytes"), least("q1"), least("q2"))
    groups = written(groups.withColumn("w", (F.col("n") - 1) * F.col("bytes")), "groups")
    above = running(groups.select("d", "p1", "p2", "m", "w"), ["m"], ["d"], {"above": (F.sum, F.col("w"))}, inclusive=False).select("d", "p1", "p2", F.coalesce("above", F.lit(0)).alias("above"))
    children = groups.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("below"))
    nodes = groups.join(children, ["d", "p1", "p2"], "left")
    # A node without shared children whose member goes on has that one's tail below it.
    nodes = written(nodes.withColumn("n_children", F.coalesce("below", (F.col("longest") > F.col("d")).cast("long"))).join(above, ["d", "p1", "p2"]), "nodes")
    by_conv = nodes.groupBy(F.col("m").alias("conv_id")).agg(F.sum("w").alias("weight"), F.max(F.col("below").isNull().cast("long")).alias("leaf"))
    by_conv = written(by_conv, "by_conversation")
    sums = shared.select("d", "p1", "p2", "conv_id").join(by_conv, "conv_id").groupBy("d", "p1", "p2").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaves"))
    ending = shared.filter(last).select("d", "p1", "p2", "conv_id")
    zero = F.lit(0).cast("long")
    empty = conversations.filter("length = 0").select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"), "conv_id")
    ends = written(_ends(ending.union(empty)), "ends")

    # The root is no row of any join: its values are sums over all.
    every = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("m"))
    top = nodes.agg(F.sum((F.col("d") == 1).cast("long")).alias("below")).crossJoin(by_conv.agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaves"))).crossJoin(every)
    top = top.join(ends.filter("d = 0").select("ends"), how="left").filter("n > 0")
    root = top.select(F.col("m").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("below", zero).alias("n_children"), F.coalesce("leaves", one).alias("n_leaves"), F.coalesce("weight", zero).alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))

    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("m").alias("parent"))
    named = nodes.filter("d > 1").join(parents, ["d", "q1", "q2"], "left").withColumn("parent", F.coalesce("parent", "m"))
    firsts = nodes.filter("d = 1").join(F.broadcast(every.select(F.col("m").alias("parent"))))
    columns = ["d", "p1", "p2", "m", "parent", "n", "n_children", "above"]
    full = named.select(columns).union(firsts.select(columns)).join(sums, ["d", "p1", "p2"]).join(ends, ["d", "p1", "p2"], "left")
    rows = full.select(F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), (F.col("weight") - F.col("above")).alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))
    return rows.union(root).union(tails)


def trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text) as they are; columns as in trie_of."""
    turns = turn_digests(conversations)
    return trie_of(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")), most_cells)


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """turns (as of turn_digests) -> (turns, conversations with length) in which each conversation c begins with the first h
    turns of conversation c - c % group, h = crc32(c) % most, and goes on with its own after its first h."""
    held = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = held.select("conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    convs = convs.join(held.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base")), "base", "left")
    convs = written(convs.select("conv_id", "own", "base", "h", F.least("h", F.coalesce("of_base", F.lit(0).cast("long"))).alias("led")), "conversations")
    # A conversation leads at most 2 x group - 1 others, by fewer than `most` turns.
    lead = turns.filter((F.col("place") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    led = lead.join(convs.filter("led > 0").select("base", "conv_id", "led"), "base").filter("place < led").select("conv_id", "place", "t1", "t2", "bytes")
    rest = turns.join(convs.select("conv_id", "h", "led"), "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("led")).alias("place"), "t1", "t2", "bytes")
    return led.union(rest), convs.select("conv_id", (F.col("led") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("length"))
