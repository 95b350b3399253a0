"""Token ids in word-aligned Simple-8b blocks.

Texts are encoded with a tokenizers file. The file's splitter never joins a word to the space after it, so a text may be
cut before every single space between two non-space characters; the pieces of a batch are made distinct and each is
encoded once a process (exact, as tests check against whole texts). Documents are dealt by ranges of doc_id, so shards
follow each other in order.

A row of the output table is a shard's next run of whole documents: their ids and token counts, and a payload:

    8 bytes `NLS8B\\0\\0\\1`, u64 ids, u64 ids a block, u64 blocks, u64 word offset of each block, u64 words

Each word holds a selector in its upper four bits and below as many ids as fit at one width (least index lowest).
Selector 0 is an escape: the next word is one raw 64-bit id. Blocks start on a word of their own, so they decode apart.

Nulls: a null text is empty and still gets the end id; null doc_ids come first. Rows of one doc_id are ordered by text.
An empty table writes no rows and returns none.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlex.llm._common import slices, written

#: Fixed values: (ids in a word, bits of each) by selector, as published for Simple-8b; 0 is the escape.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC = b"NLS8B\0\0\1"
BLOCK = 4096
#: Distinct pieces that a process keeps, and their characters; beyond either, it drops the newer half.
KEPT_PIECES, KEPT_CHARACTERS = 1_000_000, 20_000_000


_BITS = np.array([b for _, b in SELECTORS], np.uint8)


def _needed(ids: np.ndarray) -> np.ndarray:
    """The selector width that each id takes; 64 for the escape."""
    out = np.zeros(len(ids), np.uint8)
    for low, high in zip(_BITS[1:-1].tolist(), _BITS[2:].tolist(), strict=True):
        out[ids >= np.uint64(1 << low)] = high
    out[ids >= np.uint64(1 << 60)] = 64
    return out


_NEEDED = _needed(np.arange(1 << 16, dtype=np.uint64))


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """uint64 ids -> (words, word offset of each block)."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = _NEEDED[ids] if ids.max() < 1 << 16 else _needed(ids)
    # For each position the widest id among the next c; what lies beyond the block never fits.
    most = max(c for c, _ in SELECTORS)
    rows = -(-n // block)
    padded = np.full((rows, block + most), 255, np.uint8)
    filled = np.full(rows * block, 255, np.uint8)
    filled[:n] = width
    padded[:, :block] = filled.reshape(rows, block)
    widest = {1: padded.ravel()}
    for k in range(1, 7):
        x = widest[1 << (k - 1)]
        widest[1 << k] = np.maximum(x, np.append(x[1 << (k - 1) :], np.full(1 << (k - 1), 255, np.uint8)))
    choice = np.zeros(rows * (block + most), np.uint8)
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[s]
        half = 1 << (count.bit_length() - 1)
        x = widest[half]
        fits = x <= bits
        if count > half:
            fits[: len(x) - (count - half)] &= x[count - half :] <= bits
        choice[fits] = s
    choice = choice.reshape(rows, -1)[:, :block].ravel()[:n]
    end = np.minimum((np.arange(rows) + 1) * block, n)
    counts = np.array([c for c, _ in SELECTORS], np.int64)
    step = counts[choice]
    begins = np.zeros(n, bool)
    pos, stop = np.arange(0, n, block), end
    while len(pos):  # all blocks in step
        begins[pos] = True
        pos = pos + step[pos]
        live = pos < stop
        pos, stop = pos[live], stop[live]
    starts = np.flatnonzero(begins)
    sel = choice[starts]
    slots = np.where(sel == 0, 2, 1)
    where = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    words[where] = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        hit = np.flatnonzero(sel == s)
        if len(hit) and s == 0:
            words[where[hit] + 1] = ids[starts[hit]]
        elif len(hit) and bits:
            part = ids[starts[hit][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[where[hit]] |= np.bitwise_or.reduce(part, axis=1)
    return words, where[np.searchsorted(starts, np.arange(0, n, block))]


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, all words at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    # In a stretch of words with selector 0 every other one is an escape; the word after an escape is raw.
    zero = sel == 0
    at = np.arange(len(words))
    begin = np.maximum.accumulate(np.where(zero & ~np.concatenate(([False], zero[:-1])), at, 0)) if len(words) else at
    escape = zero & ((at - begin) % 2 == 0)
    raw = np.concatenate(([False], escape[:-1]))
    counts = np.array([c for c, _ in SELECTORS], np.int64)[sel]
    counts[raw] = 0
    out = np.zeros(int(counts.sum()), np.uint64)
    where = np.cumsum(counts) - counts
    for s, (count, bits) in enumerate(SELECTORS):
        hit = np.flatnonzero((sel == s) & ~raw)
        if len(hit) and s == 0:
            out[where[hit]] = words[hit + 1]
        elif len(hit) and bits:
            part = words[hit][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
            out[where[hit][:, None] + np.arange(count)] = part
    return out


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = encode_blocks(ids, block)
    return MAGIC + struct.pack("<QQQ", len(ids), block, len(offsets)) + offsets.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids, or only those of blocks first:last."""
    if payload[:8] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, block, blocks = struct.unpack_from("<QQQ", payload, 8)
    offsets = np.frombuffer(payload, "<u8", blocks, 32)
    words = np.frombuffer(payload, "<u8", -1, 32 + 8 * blocks)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, np.uint64)
    ids = decode_words(words[int(offsets[first]) : int(offsets[last]) if last < blocks else len(words)])
    if len(ids) != min(last * block, n) - first * block:
        raise ValueError("a block has lost ids")
    return ids


class Pieces:
    """Encodes texts piece by piece; pieces are kept for the process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.tokenizer.get_vocab_size())])
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.characters = 0
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def halve(self):
        """Keeps the older half, in which the common pieces are."""
        n = len(self.known) // 2
        self.known = dict(itertools.islice(self.known.items(), n))
        self.characters = sum(map(len, self.known))
        self.ids, self.ends = self.ids[: self.ends[n]].copy(), self.ends[: n + 1].copy()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has."""
        ids, of = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(words), 2000):
            e = self.tokenizer.encode(words[i : i + 2000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            of.append(np.array(e.word_ids, np.int64) + i)
        return np.concatenate(ids), np.bincount(np.concatenate(of), minlength=len(words))

    def _encoded_spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encoded, for words with a space before each: those without another space are encoded as one text, in
        which just their first tokens start with a space."""
        if any(" " in w or not w for w in words):
            return self._encoded([" " + w for w in words])
        texts = [" " + " ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        first = np.flatnonzero(self.spaced[ids])
        if len(first) != len(words):
            return self._encoded([" " + w for w in words])
        return ids, np.diff(np.append(first, len(ids)))

    def _index(self, distinct: pa.Array) -> np.ndarray:
        """The place of each piece (taken with a space before it), new ones being encoded."""
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        size = sum(map(len, new))
        while self.known and (len(self.known) + len(new) > KEPT_PIECES or self.characters + size > KEPT_CHARACTERS):
            self.halve()
            new = [w for w in words if w not in self.known]
            size = sum(map(len, new))
        if new:
            ids, sizes = self._encoded_spaced(new)
            self.ends = np.concatenate((self.ends, np.cumsum(sizes) + len(self.ids)))
            self.ids = np.concatenate((self.ids, ids))
            self.known.update(zip(new, itertools.count(len(self.known)), strict=False))
            self.characters += size
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def lay_out(self, texts: pa.Array):
        """(index of every piece; pieces by document; ids and ends of what is indexed: kept pieces, then firsts of texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(texts, " ")
        flat, bounds = parts.flatten(), parts.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        last = pc.utf8_slice_codeunits(coded.dictionary, -1)
        odd = pc.or_(pc.equal(last, ""), pc.utf8_is_space(last)).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
        if odd.any():  # spaces beside spaces: cut those texts by a pattern
            bad = np.flatnonzero(np.add.reduceat(odd, bounds[:-1]))
            lists = parts.to_pylist() if len(bad) > len(texts) // 2 else None
            if lists is None:
                pieces, low = [], 0
                for i in [*bad.tolist(), len(texts)]:
                    pieces.append(parts.slice(low, i - low))
                    if i < len(texts):
                        pieces.append(pa.array([re.split(r"(?<=\S) (?=\S)", texts[i].as_py())], parts.type))
                    low = i + 1
                parts = pa.concat_arrays(pieces)
            else:
                for i in bad.tolist():
                    lists[i] = re.split(r"(?<=\S) (?=\S)", texts[i].as_py())
                parts = pa.array(lists, parts.type)
            flat, bounds = parts.flatten(), parts.offsets.to_numpy()
            bounds = bounds - bounds[0]
            coded = flat.dictionary_encode()
        at = self._index(coded.dictionary)[coded.indices.to_numpy()]
        # A text's first piece has no space before it.
        extra, sizes = self._encoded(flat.take(pa.array(bounds[:-1])).to_pylist())
        at[bounds[:-1]] = len(self.known) + np.arange(len(texts))
        return at, bounds, np.concatenate((self.ids, extra)), np.concatenate((self.ends, len(self.ids) + np.cumsum(sizes)))

    def counts(self, texts: pa.Array) -> np.ndarray:
        at, bounds, _, ends = self.lay_out(texts)
        return np.add.reduceat(np.diff(ends)[at], bounds[:-1])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each text has (with it)."""
        at, bounds, ids, ends = self.lay_out(texts)
        at, bounds = np.insert(at, bounds[1:], len(ends) - 1), bounds + np.arange(len(bounds))
        ids, ends = np.append(ids, np.int32(end)), np.append(ends, len(ids) + 1)
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids))
        sizes = np.add.reduceat(np.diff(ends)[at], bounds[:-1])
        return lists.take(pa.array(at)).flatten().to_numpy(), sizes


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens (without an end id)."""

    def run(batches):
        for b in slices(batches, "text", 6_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces(tokenizer).counts(b.column(1)).astype(np.int64))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def write_ids(docs: DataFrame, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table: shard, start (of the row in its shard), doc_ids, n_tokens (each with the end id), payload."""

    def run(batches):
        shard, start = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", 6_000_000):
            ids, sizes = pieces(tokenizer).encode(b.column(1), end)
            row = [pa.array([shard], pa.int64()), pa.array([start], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([pack(ids.astype(np.uint64))], pa.binary())]
            start += len(ids)
            yield pa.RecordBatch.from_arrays(row, ["shard", "start", "doc_ids", "n_tokens", "payload"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, "shard long, start long, doc_ids array<long>, n_tokens array<long>, payload binary"), "token_ids")


def read_ids(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the payloads."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"]).astype("<u4")
                ends = np.cumsum(r["n_tokens"])
                starts = ends - r["n_tokens"]
                if int(ends[-1]) != len(ids):
                    raise ValueError("token counts and payload differ")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                cols = [pa.array([r["shard"]] * len(crc), pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"]), pa.array(r["n_tokens"], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = table.mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    # One row a shard: their number is that of the files.
    sizes = table.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
