"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of depth 3 are grown on statistics of labelled documents; every path from a root becomes a conjunctive
rule; a logistic regression with an L1 penalty keeps few rules; and what is left is compiled into one Spark column
expression over the statistics. Only the fit sees a bounded sample (at most `max_rows` labelled documents, chosen by a hash
of doc_id); statistics and scores cover every document. Labels, language, source and doc_id are never inputs of a score.

Nulls: a null text is an empty one and gets a score too; null labels are left out; a document labelled twice counts as
its worse label; without labels of both kinds the score is the share of good labels (or 0.5). A null doc_id is scored
and not held out. Repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlex.llm._common import fresh, release, slices, utf8, written

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "punctuation", "pipes", "breaks",
    "beyond_ascii", "distinct_words", "repeats", "commonest", "tailed", "line_words", "long_words",
]
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _PUNCTUATION = b"#$%&*+<=>@[\\]^_`{}~!", b".,;:?\"'()-/"


def _statistics(t: bytes) -> list[float]:
    n = len(t)
    words = t.split()
    m = len(words)
    if not m:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)
    without = lambda drop: (n - len(t.translate(None, drop))) / n
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in t.split(b"\n") if x.strip()]
    return [
        math.log1p(n), math.log1p(m), sum(map(len, words)) / m, without(_UPPER), without(_DIGITS), without(_SYMBOLS), without(_PUNCTUATION),
        t.count(b"|") / m, t.count(b"\n") / m, (n - len(t.translate(None, bytes(range(128, 256))))) / n, len(counts) / m,
        sum(map(operator.eq, words, words[1:])) / m, max(counts.values()) / m, sum(1 for w in words if w[-1] in b"#$%&*!|") / m,
        m / max(1, len(lines)), sum(1 for w in words if len(w) > 14) / m,
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double for each of STATISTICS."""

    def run(batches):
        for b in slices(batches, "text"):
            x = np.array([_statistics(t) for t in utf8(b, "text")])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], ["doc_id", *STATISTICS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: A rule: ((statistic, above, threshold), ...).
Rule = tuple[tuple[int, bool, float], ...]


def _grow(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Rule, np.ndarray]], np.ndarray]:
    """All nodes but the root as (rule, rows) and the leaf values of all rows; splits by gain on binned statistics."""
    nodes, value = [], np.zeros(len(bins))

    def split(rows: np.ndarray, rule: Rule, level: int) -> None:
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                size = len(e) + 1
                b = bins[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, None))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
                if size > 1 and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
        _, f, at = best
        if f is None:
            value[rows] = -g.sum() / (h.sum() + 1)
            return
        low = bins[rows, f] <= at
        for part, above in ((rows[low], False), (rows[~low], True)):
            longer = (*rule, (f, above, float(edges[f][at])))
            nodes.append((longer, part))
            split(part, longer, level + 1)

    split(np.arange(len(bins)), (), 0)
    return nodes, value


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in rule])


def _short(rule: Rule) -> Rule:
    """The same conjunction with one bound for each statistic and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, above, t in rule:
        bounds[f, above] = (max if above else min)(t, bounds.get((f, above), t))
    return tuple(sorted((f, above, t) for (f, above), t in bounds.items()))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, rounds: int = 400) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]) of the rules that the L1 penalty leaves."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    prior = math.log(share / (1 - share))
    if len(y) < 20 or y.min() == y.max():
        return prior, []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    score, rules = np.full(len(y), prior), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes, value = _grow(bins, edges, p - y, p * (1 - p), depth, max(5, len(y) // 500))
        score += rate * value
        for rule, _ in nodes:
            rules.setdefault(_short(rule))
    rules = list(rules)
    if not rules:
        return prior, []
    z = np.stack([_holds(x, r) for r in rules], axis=1)
    seen, keep = set(), []
    for j, column in enumerate(z.T):  # rules that hold for the same rows are one
        if (k := column.tobytes()) not in seen and 0 < column.mean() < 1:
            seen.add(k)
            keep.append(j)
    # One matrix of numbers, changed in place: the driver's memory is small.
    z, rules = z[:, keep].astype(np.float64), [rules[j] for j in keep]
    if not rules:
        return prior, []
    mean, scale = z.mean(axis=0), np.empty(len(rules))
    for j in range(0, len(rules), 32):
        scale[j : j + 32] = z[:, j : j + 32].std(axis=0)
    z -= mean
    z /= scale
    # Proximal gradient with momentum; the step is the bound on the logistic loss's curvature.
    step = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w, v, b, t = np.zeros(len(rules)), np.zeros(len(rules)), prior, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        new = v - step * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4 * float((p - y).mean())
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / later * (new - w), new, later
    weights = w / scale
    return b - float(weights @ mean), [(float(a), r) for a, r in zip(weights, rules, strict=True) if abs(a) > 1e-9]


def score(intercept: float, rules: list[tuple[float, Rule]], of=lambda name: F.col(name)) -> Column:
    """The model as one expression; `of` gives the column of a name in STATISTICS."""

    def holds(rule: Rule) -> Column:
        return functools.reduce(operator.and_, [(of(STATISTICS[f]) > t) if above else (of(STATISTICS[f]) <= t) for f, above, t in rule])

    total = functools.reduce(operator.add, [F.when(holds(r), F.lit(w)).otherwise(0.0) for w, r in rules], F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labelled rows that are not held out, at most max_rows of them."""
    rows = written(statistics(docs, id_col, text_col), "statistics")
    known = known_labels(labels, label_col, max_rows)
    intercept, rules = learn(rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"), known, max_rows)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(intercept, rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def known_labels(labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """doc_id, label of at most max_rows labelled documents that are not held out: those whose hash is below a cut that
    follows from their number (five deviations under the bound)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = written(known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label")), "labels")
    return _cut(known, F.xxhash64("doc_id"), max_rows)


def _cut(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """rows, or if there are more than `most` those of a low hash: some `most` of them, less five deviations."""
    n, parts = rows.count(), 1 << 30
    if n <= most:
        return rows
    return rows.filter(F.pmod(key, F.lit(parts)) < int(parts * max(1.0, most - 5 * math.sqrt(most)) / n))


def learn(rows: DataFrame, known: DataFrame, max_rows: int = 20_000) -> tuple[float, list[tuple[float, Rule]]]:
    """The model from statistics of the documents in known, a bounded table. Equal rows count once; where ids stand for so
    many texts that there are more than max_rows other rows, a hash of the row cuts them too."""
    labelled = written(rows.distinct().join(F.broadcast(known), "doc_id"), "labelled")
    labelled = _cut(labelled, F.xxhash64("doc_id", *STATISTICS), max_rows).limit(max_rows)
    sample = labelled.toArrow().to_pandas().sort_values(["doc_id", *STATISTICS])
    x, y = sample[STATISTICS].to_numpy(np.float64), (sample["label"].to_numpy() >= 1).astype(np.float64)
    del sample
    try:
        return fit(x, y)
    finally:
        # What the fit has freed goes back to the system before the next stages take the driver's memory.
        release()


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of 0.5 or more, all columns as they were; no shuffle of texts."""
    known = known_labels(labels, label_col, max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    intercept, rules = learn(statistics(texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")), known, max_rows)
    name = fresh(docs, "statistics")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for b in slices([batch], text_col):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_statistics(t or b"") for t in b.column(at).cast(pa.large_binary()).to_pylist()], pa.list_(pa.float64()))], [*b.schema.names, name])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.ArrayType(T.DoubleType()))]))
    total = score(intercept, rules, lambda c: F.col(name)[STATISTICS.index(c)])
    return marked.filter(total >= 0.5).select(*docs.columns)
