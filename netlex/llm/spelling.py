"""Spelling variants by blocked Gram matrices.

A word is a vector of letter counts. One inserted or deleted letter moves it by a squared distance of 1, one replaced letter by
2, so words one edit apart are at most 2 apart, in blocks of equal or adjacent length. Squared distances of a block against its
neighbours come from one NumPy product (|x|^2 + |y|^2 - 2 x.y); pairs at 1 or 2 are kept and their edit is verified.

Blocks of a length are made smaller by letter classes (CLASSES groups of letters): one edit changes the class counts by one up, one
down, or one of each, so a word meets only words of its own cell of counts and of the cells beside it. Each unordered pair of cells is
met from one side: a word is resident in its own cell and visits CLASSES + CLASSES x (CLASSES - 1) / 2 others. Cells of more than BLOCK
words are dealt into blocks, and each block meets all visitors, taken in pieces, so memory is bounded. All words are compared; nothing is sampled.

Nulls: a null text has no words; a null doc_id hashes as an empty one. Texts are taken whole, repeated rows count again. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlex.llm._common import release, written

#: Fixed value: the letters of a word, and those that are lower-cased.
LETTERS, UPPER, LOWER = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES, BLOCK = 5, 2048
#: Numbers that make a cell's key of class counts: below 2^31, so that no sum passes 2^62.
_WEIGHTS = np.random.default_rng(11).integers(1 << 28, 1 << 31, CLASSES).tolist()
#: From a cell to those that it visits: one letter more, or one of a class replaced by one of a later class.
STEPS = [_WEIGHTS[i] for i in range(CLASSES)] + [_WEIGHTS[j] - _WEIGHTS[i] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
#: Column of the count vector for each Latin-1 code: letters that can occur, in the order of their codes.
_KNOWN = [c for c in range(256) if chr(c) in LOWER or c >= 0xC0]
_COLUMN = np.zeros(256, np.int64)
_COLUMN[_KNOWN] = np.arange(len(_KNOWN))


def words(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters in whole texts, lower-cased (A-Z), of which one in `every` (by a hash of document and run)
    loses a letter; those of a length and count."""
    # A shorter run stays too short, so it is not even cut out of the text.
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    found = found.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.expr("left(run, cast(pmod(h, char_length(run)) as int))"), F.substr("run", place + 2))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return found.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _codes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' Latin-1 codes one after the other, and where each word starts (with the end)."""
    data = [w.encode("latin-1") for w in found]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def _counts(codes: np.ndarray, starts: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.bincount(row * width + columns[codes], minlength=(len(starts) - 1) * width).reshape(-1, width)


def cells(vocabulary: DataFrame) -> DataFrame:
    """word, n, cell: the key of a word's class counts."""
    classes = np.arange(256) % CLASSES

    def run(batches):
        for b in batches:
            codes, starts = _codes(b.column(0).to_pylist())
            cell = _counts(codes, starts, classes, CLASSES) @ np.array(_WEIGHTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["word", "n", "cell"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, cell long")


class _Words:
    """Words with their codes in rows of equal width and their letter counts."""

    def __init__(self, found: list[str], n: np.ndarray):
        self.words, self.n = np.array(found, object), n
        self.codes, self.starts = _codes(found)
        self.length = np.diff(self.starts)
        # Products are exact while sums of squares stay below 2^24 (single precision) or 2^53.
        kind = np.float32 if self.length.max(initial=0) <= 4000 else np.float64
        self.x = _counts(self.codes, self.starts, _COLUMN, len(_KNOWN)).astype(kind)
        self.square = (self.x * self.x).sum(axis=1)

    def one_edit(self, i: np.ndarray, other: _Words, j: np.ndarray) -> np.ndarray:
        """Whether word i is exactly one edit from the other's word j: what is equal from the left and from the right leaves one letter."""
        out = np.zeros(len(i), bool)
        width = np.maximum(self.length[i], other.length[j])
        for some in np.split(np.argsort(width, kind="stable"), np.searchsorted(np.sort(width), [16, 24, 32, 48, 64])):
            if not len(some):
                continue
            step = max(1, 4_000_000 // int(width[some].max()))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                out[part] = self._one_edit(i[part], other, j[part], int(width[part].max()))
        return out

    def _one_edit(self, i, other, j, width):
        at = np.arange(width)
        la, lb = self.length[i], other.length[j]

        def padded(w: _Words, k, size, right):
            place = w.starts[k][:, None] + (size[:, None] - width + at if right else at)
            inside = (place >= w.starts[k][:, None]) & (place < w.starts[k + 1][:, None])
            return np.where(inside, w.codes[np.clip(place, 0, len(w.codes) - 1)].astype(np.int16), -1)

        both = [padded(self, i, la, right) == padded(other, j, lb, right) for right in (False, True)]
        short = np.minimum(la, lb)
        ahead = np.minimum(np.where(both[0].all(axis=1), width, both[0].argmin(axis=1)), short)
        back = np.minimum(np.where(both[1].all(axis=1), width, both[1][:, ::-1].argmin(axis=1)), short)
        same = la == lb
        # Equal lengths: exactly one place between what is equal on both sides; else the shorter one is used up.
        return np.where(same, ahead + back == short - 1, (np.abs(la - lb) == 1) & (ahead + back >= short))


def _near(a: _Words, b: _Words, same: bool):
    """Index pairs at a squared distance of 1 or 2, one edit apart; same: a is b, each pair once."""
    for k in range(0, len(b.words), 4096):
        part = slice(k, k + 4096)
        far = a.square[:, None] + b.square[None, part] - 2 * (a.x @ b.x[part].T)
        i, j = np.nonzero((far > 0.5) & (far < 2.5))
        j = j + k
        if same:
            i, j = i[i < j], j[i < j]
        ok = a.one_edit(i, b, j)
        yield i[ok], j[ok]


def _pairs(batches):
    """Batches sorted by (cell, block, visitor), residents first -> both directions of every near pair."""
    key, residents, waiting, home = None, [], [], None

    def rows(a: _Words, b: _Words, same: bool):
        for i, j in _near(a, b, same):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a.words[i], b.words[j]))), pa.array(np.concatenate((b.words[j], a.words[i]))), pa.array(np.concatenate((b.n[j], a.n[i])))], ["word", "near", "near_n"])

    def meet():
        nonlocal home, residents, waiting
        if home is None and residents:
            home = _Words([w for x in residents for w in x[0]], np.concatenate([x[1] for x in residents]))
            residents = []
            yield from rows(home, home, True)
        if home is not None and waiting:
            yield from rows(home, _Words([w for x in waiting for w in x[0]], np.concatenate([x[1] for x in waiting])), False)
        waiting = []

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, block, visitor, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
        found = batch.column(3).to_pylist()
        turn = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (visitor[1:] != visitor[:-1]))))
        for a, z in zip(turn.tolist(), [*turn[1:].tolist(), batch.num_rows], strict=True):
            if (cell[a], block[a]) != key:
                yield from meet()
                key, residents, waiting, home = (cell[a], block[a]), [], [], None
            (waiting if visitor[a] else residents).append((found[a:z], n[a:z]))
            if sum(len(x[0]) for x in waiting) >= 8192:
                yield from meet()
    yield from meet()
    release()


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """vocabulary (word, n) -> word, near, near_n: every word one edit away."""
    placed = written(cells(vocabulary), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = lambda blocks: F.pmod(F.xxhash64("word"), blocks.cast("long")).cast("int")
    home = placed.join(sizes, "cell").withColumn("block", own(F.col("blocks")))
    residents = home.select("cell", "block", F.lit(False).alias("visitor"), "word", "n")
    # Words of other blocks of the cell come as visitors of the earlier ones.
    among = home.filter("block > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), F.lit(True).alias("visitor"), "word", "n")
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in STEPS]))
    abroad = placed.select("word", "n", "cell", steps.alias("step")).select((F.col("cell") + F.col("step")).alias("cell"), "word", "n").join(sizes, "cell")
    abroad = abroad.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"), "word", "n")
    dealt = residents.union(among).union(abroad).repartition("cell", "block").sortWithinPartitions("cell", "block", "visitor")
    return dealt.mapInArrow(_pairs, "word string, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """links (word, form) -> word, root. Counts grow tenfold a link, so some twenty links are the most and five rounds of doubling do."""
    roots = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = written(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        roots = step.drop("moved")
        if step.filter("moved").isEmpty():
            return roots


def variants(vocabulary: DataFrame, times: int = 10, block: int = BLOCK) -> DataFrame:
    """vocabulary (word, n) -> word, form, root, n, n_near, form_n."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(vocabulary, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong: Column = -F.col("best.less") >= F.col("n") * times
    rows = vocabulary.join(near, "word", "left").select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n"))
    rows = written(rows, "forms")
    roots = _roots(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return variants(written(words(docs, id_col=id_col, text_col=text_col), "vocabulary"))
