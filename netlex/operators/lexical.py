"""Vocabulary under other cleanings, at equal sizes, and three kinds of speaker vectors.

Lines are (conv_id, pos, speaker, text) rows; a (conv_id, pos) names one line. Null texts count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators.dialogue import FILLER, STOP, strip_directions, tokenize
from netlex.operators.ranges import running
from netlex.operators.ranks import row_ordinals

ANY_CASE_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
BLANKLESS = r"[^ \t\n\r\f\x0B]+"
KINDS = ("raw", "style", "content")


def variant_terms(lines: DataFrame) -> DataFrame:
    """variant, term, n: counts under each of 32 cleanings, named by five 0/1 digits: lower case, words only (else split at
    white space), without [directions], without stop words, without fillers. The lists are lower-case, so what keeps its
    case or its punctuation escapes them.

    Texts are only split at white space, which no word crosses, once as they are and, where they have a bracket, once without
    directions. Pieces are counted; the first two digits act on distinct pieces, the last two on the counts."""
    raw = F.coalesce("text", F.lit(""))
    sort = lambda name, text: F.struct(F.lit(name).alias("sort"), F.replace(text, F.lit("’"), F.lit("'")).alias("t"))
    sorts = F.when(F.contains(raw, F.lit("[")), F.array(sort("0", raw), sort("1", strip_directions(raw)))).otherwise(F.array(sort("01", raw)))
    found = lines.select(F.inline(sorts)).select("sort", F.explode(F.regexp_extract_all("t", F.lit(BLANKLESS), F.lit(0))).alias("piece"))
    pieces = settle(found.groupBy("piece", "sort").agg(F.count("*").alias("n")))
    streams = []
    for low in "01":
        for words in "01":
            t = F.lower("piece") if low == "1" else F.col("piece")
            terms = F.regexp_extract_all(t, F.lit(ANY_CASE_WORD), F.lit(0)) if words == "1" else F.array(t)
            streams.append(F.struct(F.lit(low + words).alias("head"), terms.alias("terms")))
    one = pieces.select("sort", "n", F.inline(F.array(*streams))).select("sort", "n", "head", F.explode("terms").alias("term"))
    one = one.groupBy("head", "term").agg(*[F.sum(F.when(F.contains(F.col("sort"), F.lit(bare)), F.col("n"))).alias(f"n{bare}") for bare in "01"])
    counts = one.select("head", "term", F.inline(F.array(*[F.struct(F.lit(bare).alias("bare"), F.col(f"n{bare}").alias("n")) for bare in "01"]))).filter("n is not null")
    stop, filler = F.col("term").isin(STOP), F.col("term").isin(FILLER)
    masks = F.filter(F.array(*[F.lit(x) for x in ("00", "01", "10", "11")]), lambda m: ~((F.substring(m, 1, 1) == "1") & stop) & ~((F.substring(m, 2, 1) == "1") & filler))
    return counts.select(F.concat("head", "bare").alias("stream"), "term", "n", F.explode(masks).alias("mask")).select(F.concat("stream", "mask").alias("variant"), "term", "n")


def variant_ranks(terms: DataFrame) -> DataFrame:
    """variant, term, n, rank from 1 (count descending, then term); ranks come from range partitions."""
    placed = row_ordinals(terms, [F.asc("variant"), F.desc("n"), F.asc("term")], "at")
    sizes = terms.groupBy("variant").agg(F.count("*").alias("types"))
    # At most 32 rows.
    first = sizes.withColumn("before", F.coalesce(F.sum("types").over(Window.orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(first.select("variant", "before")), "variant").select("variant", "term", "n", (F.col("at") - F.col("before") + 1).alias("rank"))


def _runs(terms: DataFrame) -> DataFrame:
    """variant, n, terms, first: how many terms of a variant have a count, and the rank of the first of them. A row for each
    count that occurs, so a variant's rows are fewer than the root of twice its tokens."""
    sizes = settle(terms.groupBy("variant", "n").agg(F.count("*").alias("terms")))
    before = Window.partitionBy("variant").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first", F.coalesce(F.sum("terms").over(before), F.lit(0)) + 1)


def variant_counts(terms: DataFrame, low: int = 10, high: int = 5000) -> DataFrame:
    """variant, tokens, types, slope of log10 n on log10 rank over ranks low..high (null with fewer than two) of terms (variant,
    term, n). Which term has a rank does not matter here, so terms are counted by n and not sorted."""
    runs = settle(_runs(terms))
    last = F.col("first") + F.col("terms") - 1
    ranks = runs.filter((F.col("first") <= high) & (last >= low)).select("variant", "n", F.explode(F.sequence(F.greatest("first", F.lit(low)), F.least(last, F.lit(high)))).alias("rank"))
    slopes = ranks.groupBy("variant").agg(F.regr_slope(F.log10("n"), F.log10("rank")).alias("slope"))
    sums = runs.groupBy("variant").agg(F.sum(F.col("n") * F.col("terms")).alias("tokens"), F.sum("terms").alias("types"))
    return sums.join(slopes, "variant", "left").select("variant", "tokens", "types", "slope")


def _at_ranks(terms: DataFrame, runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """variant, term, n, rank of the ranks wanted (variant, rank; few). Only terms that share count and beginning with one wanted are put in order."""
    inside = F.col("rank").between(F.col("first"), F.col("first") + F.col("terms") - 1)
    hit = settle(runs.join(F.broadcast(wanted), "variant").filter(inside).select("variant", "n", "rank", (F.col("rank") - F.col("first")).alias("skip")))
    key = ["variant", "n"]
    near = terms.select("variant", "term", "n").join(F.broadcast(hit.select(*key).distinct()), key).withColumn("start", F.substring("term", 1, 4))
    starts = near.groupBy(*key, "start").agg(F.count("*").alias("terms"))
    placed = row_ordinals(starts, [F.asc(c) for c in (*key, "start")], "i")
    placed = running(placed, key, ["i"], {"upto": (F.sum, F.col("terms"))}).withColumn("before", F.col("upto") - F.col("terms"))
    open_ = placed.join(F.broadcast(hit), key).filter((F.col("skip") >= F.col("before")) & (F.col("skip") < F.col("upto")))
    open_ = settle(open_.select(*key, "start", "before", "rank", (F.col("skip") - F.col("before")).alias("skip")))
    some = near.join(F.broadcast(open_.select(*key, "start").distinct()), [*key, "start"])
    order = row_ordinals(some, [F.asc(c) for c in (*key, "start", "term")], "at")
    base = order.groupBy(*key, "start").agg(F.min("at").alias("base"))
    order = order.join(base, [*key, "start"]).withColumn("skip", F.col("at") - F.col("base"))
    return order.join(F.broadcast(open_.select(*key, "start", "skip", "rank")), [*key, "start", "skip"]).select("variant", "term", "n", "rank")


def variant_top(terms: DataFrame, top: int = 10) -> DataFrame:
    """variant, term, n, rank: the `top` of each variant by count, then term."""
    runs = settle(_runs(terms))
    least = runs.filter(F.col("first") <= top).groupBy("variant").agg(F.min("n").alias("least"))
    some = terms.join(F.broadcast(least), "variant").filter("n >= least").select("variant", "term", "n")
    w = Window.partitionBy("variant").orderBy(F.desc("n"), "term")
    return some.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def variant_points(terms: DataFrame, points: int = 60) -> DataFrame:
    """variant, rank, term, n at up to `points` ranks, spaced evenly in the logarithm from 1 to the last."""
    terms = terms.select("variant", "term", "n")
    runs = settle(_runs(terms))
    sizes = runs.groupBy("variant").agg(F.sum("terms").alias("types"))
    step = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.rint(F.pow(F.col("types").cast("double"), i / F.lit(float(points - 1)))).cast("long"))
    # At most 32 x points rows.
    wanted = sizes.select("variant", F.explode(F.array_distinct(step)).alias("rank"))
    return _at_ranks(terms, runs, wanted).select("variant", "rank", "term", "n")


def kind_vectors(counts: DataFrame, corpus: DataFrame, kind: str, least: int = 5) -> DataFrame:
    """owner, term, weight of (owner, term, n) counts, by kind.

    raw: n of terms with a corpus count (term, n) of `least` or more; style: share of each stop word among the owner's stop
    words; content: n x ln(N / df) of raw terms that are no stop or filler words. With a column draw, each draw is a set of
    its own and the draw becomes a part of owner and term."""
    own = counts.select(*(["draw"] if "draw" in counts.columns else [F.lit(0).alias("draw")]), "owner", "term", "n")
    common = corpus.filter(F.col("n") >= least).select("term")
    if kind == "style":
        kept = own.filter(F.col("term").isin(STOP))
        rows = kept.join(kept.groupBy("draw", "owner").agg(F.sum("n").alias("all")), ["draw", "owner"]).withColumn("weight", F.col("n") / F.col("all"))
    elif kind == "raw":
        rows = own.join(common, "term").withColumn("weight", F.col("n").cast("double"))
    elif kind == "content":
        kept = own.join(common, "term").filter(~F.col("term").isin(STOP + FILLER))
        owners = own.select("owner").distinct().agg(F.count("*").alias("owners"))
        df = kept.groupBy("draw", "term").agg(F.count("*").alias("df"))
        rows = kept.join(df, ["draw", "term"]).crossJoin(F.broadcast(owners)).withColumn("weight", F.col("n") * F.ln(F.col("owners") / F.col("df")))
    else:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    if "draw" not in counts.columns:
        return rows.select("owner", "term", "weight")
    return rows.select(F.struct("draw", "owner").alias("owner"), F.struct("draw", "term").alias("term"), "weight")


def pair_similarities(counts: DataFrame, corpus: DataFrame, least: int = 5) -> DataFrame:
    """a < b, raw, style, content: cosines of all pairs that share a weight of any kind; 0 where one kind has none.

    The kinds' unit vectors stand side by side, so a term joins its owners once for all of them."""
    sides = None
    for kind in KINDS:
        vectors = kind_vectors(counts, corpus, kind, least).filter("weight <> 0")
        norms = vectors.groupBy("owner").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).filter("norm > 0")
        unit = vectors.join(norms, "owner").select("owner", "term", *[(F.col("weight") / F.col("norm") if k == kind else F.lit(None).cast("double")).alias(k) for k in KINDS])
        sides = unit if sides is None else sides.union(unit)
    sides = settle(sides.groupBy("owner", "term").agg(*[F.max(k).alias(k) for k in KINDS]))
    side = lambda x: sides.select("term", F.col("owner").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in KINDS])
    both = side("a").join(side("b"), "term").filter("a < b")
    pairs = both.groupBy("a", "b").agg(*[F.sum(F.col(f"{k}_a") * F.col(f"{k}_b")).alias(k) for k in KINDS])
    return pairs.filter(" or ".join(f"{k} is not null" for k in KINDS)).na.fill(0.0, list(KINDS))


def line_samples(lines: DataFrame, draws: int, size: int, seed: int = 1) -> DataFrame:
    """draw, owner, term, n: for each draw, a speaker's lines in an order by hash until they have `size` tokens, the last
    one cut there. Speakers with less give all they have.

    Lines are first counted in about 500 steps of the hash's logarithm, so that only the least of them, some 1.1 x size
    tokens and one line, are ordered for a speaker, however many they have."""
    toks = lines.select("conv_id", "pos", "speaker", tokenize(F.coalesce("text", F.lit(""))).alias("toks"))
    every = toks.select("conv_id", "pos", "speaker", F.size("toks").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).filter("len > 0")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "draw", "speaker", "conv_id", "pos"), 1)
    every = every.withColumn("h", h).withColumn("step", F.floor(F.log2(F.col("h") + 1.0) * 8).cast("int"))
    steps = every.groupBy("draw", "speaker", "step").agg(F.sum("len").alias("len"))
    upto = Window.partitionBy("draw", "speaker").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    open_ = steps.withColumn("before", F.coalesce(F.sum("len").over(upto), F.lit(0))).filter(F.col("before") < size)
    last = open_.groupBy("draw", "speaker").agg(F.max("step").alias("last"))
    near = every.join(last, ["draw", "speaker"]).filter("step <= last")
    order = Window.partitionBy("draw", "speaker").orderBy("h", "conv_id", "pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("before", F.coalesce(F.sum("len").over(order), F.lit(0))).filter(F.col("before") < size)
    cut = placed.select("conv_id", "pos", "speaker", "draw", F.least("len", F.lit(size) - F.col("before")).cast("int").alias("take"))
    words = toks.join(cut, ["conv_id", "pos", "speaker"]).select("draw", F.col("speaker").alias("owner"), F.explode(F.slice("toks", F.lit(1), F.col("take"))).alias("term"))
    return words.groupBy("draw", "owner", "term").agg(F.count("*").alias("n"))


def equalized_similarity(lines: DataFrame, corpus: DataFrame, draws: int = 30, size: int = 2000, least: int = 5, seed: int = 1) -> DataFrame:
    """a < b, raw, style, content: mean cosines over draws of `size` tokens a speaker; the vocabulary is the corpus's."""
    pairs = pair_similarities(line_samples(lines, draws, size, seed), corpus, least)
    sums = pairs.groupBy(F.col("a.owner").alias("a"), F.col("b.owner").alias("b")).agg(*[F.sum(k).alias(k) for k in KINDS])
    return sums.select("a", "b", *[(F.col(k) / draws).alias(k) for k in KINDS])


def types_in_sample(lines: DataFrame, size: int, draws: int = 30, seed: int = 1) -> DataFrame:
    """speaker, types: mean distinct terms in `draws` runs of `size` consecutive tokens from starts by hash; a speaker with
    fewer tokens gives all of them each time. Speakers without tokens are left out."""
    order = ["conv_id", "pos"]
    toks = lines.filter("speaker is not null").select("speaker", *order, tokenize(F.coalesce("text", F.lit(""))).alias("toks"))
    # Only lengths are summed along a speaker's lines; of the tokens, those of lines that a run meets are read.
    held = toks.select("speaker", *order, F.size("toks").cast("long").alias("len")).filter("len > 0")
    placed = settle(running(held, ["speaker"], order, {"upto": (F.sum, F.col("len"))}))
    room = F.greatest(F.lit(1), F.col("all") - size)
    starts = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.struct(k.alias("draw"), F.pmod(F.xxhash64(F.lit(seed), k, F.col("speaker")), room).alias("start")))
    runs = placed.groupBy("speaker").agg(F.sum("len").alias("all")).select("speaker", starts.alias("runs"))
    base = F.col("upto") - F.col("len")
    hit = F.filter("runs", lambda r: (r["start"] < F.col("upto")) & (r["start"] + size > base))
    met = placed.join(runs, "speaker").select(F.col("speaker").alias("of"), *(F.col(c).alias(f"{c}_") for c in order), base.alias("base"), hit.alias("hit")).filter("size(hit) > 0")
    same = F.col("of").eqNullSafe(F.col("speaker")) & F.col("conv_id_").eqNullSafe(F.col("conv_id")) & F.col("pos_").eqNullSafe(F.col("pos"))
    cut = toks.join(met, same).select("speaker", "toks", "base", F.explode("hit").alias("r"))
    skip = F.greatest(F.lit(0), F.col("r.start") - F.col("base"))
    take = F.col("r.start") + size - F.col("base") - skip
    terms = cut.select("speaker", "r.draw", F.explode(F.slice("toks", (skip + 1).cast("int"), take.cast("int"))).alias("term"))
    found = terms.groupBy("speaker", "draw", "term").agg(F.lit(1).alias("one"))
    return found.groupBy("speaker").agg((F.count("*") / draws).alias("types"))
