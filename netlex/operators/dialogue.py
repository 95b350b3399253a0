"""Utterance tables: cleaning, tokens, vocabularies, talk networks, distinctive words, authorship.

Lines are (conv_id, pos, speaker, text) rows; tokens are (owner, term, n) counts unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.functions.stats import pearson
from netlex.operators.ranges import neighbours, running
from netlex.operators.ranks import average_ranks, row_ordinals

WORD = r"[a-z]+(?:'[a-z]+)?"
#: The customary list of English stop words (with contractions, as tokens are), and words that fill speech.
STOP = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these
those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn
didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan
shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
FILLER = "ah eh er hey hmm oh okay uh um well yeah yes".split()


def infobox_field(text: Column, name: str) -> Column:
    """The value of `| name = value` up to a line that starts the next field or closes the box; empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s)\|\s*{name}\s*=(.*?)(?=\n\s*\||\n\}}\}})", 1))


def first_listed(text: Column, terms: list[str]) -> Column:
    """The first term, in list order, that stands in the text, case aside; null if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms])


def decade(text: Column) -> Column:
    """The first year from 1930 to 2029, down to its decade; null if none."""
    year = F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(19[3-9][0-9]|20[0-2][0-9])\b", 1)
    return (F.floor(F.try_to_number(F.nullif(year, F.lit("")), F.lit("9999")) / 10) * 10).cast("int")


def extract_attributes(nodes: DataFrame, articles: DataFrame, field: str, terms: list[str], date_field: str = "debut") -> DataFrame:
    """node, value (of `field`), decade (of the first year in `date_field`): one row a node; a missing article counts as an empty one."""
    rows = nodes.select("node").distinct().join(articles.select("node", "text"), "node", "left")
    value = first_listed(infobox_field(F.col("text"), field), terms)
    return rows.select("node", value.alias("value"), decade(infobox_field(F.col("text"), date_field)).alias("decade"))


def attribute_coverage(attributes: DataFrame) -> DataFrame:
    """nodes, with_value, with_decade."""
    return attributes.agg(F.count("*").alias("nodes"), F.count("value").alias("with_value"), F.count("decade").alias("with_decade"))


def _episodes(cells: DataFrame) -> DataFrame:
    """(file, place, cell) -> file, place, conv_id, season, episode, second, title, body of cells `SSxEE[/EE] - title;body`; scenes that were cut are dropped."""
    head = F.trim(F.substring_index("cell", ";", 1))
    body = F.when(F.contains(F.col("cell"), F.lit(";")), F.expr("substring(cell, locate(';', cell) + 1)")).otherwise("")
    rows = cells.select("file", "place", head.alias("head"), body.alias("body"))
    rows = rows.filter(F.col("head").rlike(r"^\d+x\d+(/\d+)?\s*-") & ~F.col("head").rlike(r"(?i)webisode|deleted|gag reel"))
    part = lambda i: F.regexp_extract("head", r"^(\d+)x(\d+)(?:/(\d+))?\s*-\s*(.*)$", i)
    number = lambda i: F.try_to_number(F.nullif(part(i), F.lit("")), F.lit("9999")).cast("int")
    return rows.select("file", "place", F.regexp_extract("head", r"(\d+x\d+)", 1).alias("conv_id"), number(1).alias("season"), number(2).alias("episode"), number(3).alias("second"), F.trim(part(4)).alias("title"), "body")


def _said(rows: DataFrame) -> DataFrame:
    """With speaker, null where the body is no line: without a colon, or with a blank or over-long speaker."""
    speaker = F.substring_index("body", ":", 1)
    ok = F.contains(F.col("body"), F.lit(":")) & (F.length(F.trim(speaker)) > 0) & (F.length(speaker) <= 40)
    return rows.withColumn("speaker", F.when(ok, F.trim(speaker)))


def parse_lines(cells: DataFrame) -> DataFrame:
    """(file, place, cell) -> conv_id, pos, speaker, raw, season, episode, second (of a double episode, or null), title from
    `SSxEE[/EE] - title;Speaker: text`."""
    rows = _said(_episodes(cells)).filter("speaker is not null")
    return rows.select("conv_id", F.struct("file", "place").alias("pos"), "speaker", F.trim(F.expr("substring(body, locate(':', body) + 1)")).alias("raw"), "season", "episode", "second", "title")


def skipped_directions(cells: DataFrame) -> DataFrame:
    """skipped: cells of an episode that are no line (bare stage directions)."""
    return _said(_episodes(cells)).agg(F.count_if(F.col("speaker").isNull()).alias("skipped"))


def clean_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Without white space and dots at its ends, single spaces, first letter upper case; then its alias, if it has one."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"^\.+|\.+$", ""), r"\s+", " ")
    c = F.trim(c)
    c = F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))
    if not aliases:
        return c
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), c)


def strip_directions(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\[[^\]]*\]", " "), r"[ \t\n\r\f\x0B]+", " "))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit(WORD), F.lit(0))


def tokens(lines: DataFrame) -> DataFrame:
    """conv_id, pos, speaker, i, term: one row a token."""
    return lines.select("conv_id", "pos", "speaker", F.posexplode(tokenize(F.col("text"))).alias("i", "term"))


def speaker_terms(lines: DataFrame) -> DataFrame:
    return tokens(lines).groupBy(F.col("speaker").alias("owner"), "term").agg(F.count("*").alias("n"))


def term_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


#: Fixed value: what counts as white space between raw words.
WHITE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def stage_counts(lines: DataFrame) -> DataFrame:
    """stage (from 0), tokens, types after each of six cumulative cleaning stages of text with directions in brackets: split at
    white space; lower-cased; words only; without directions; without stop words; without fillers.

    Texts are only split at white space, which no word crosses: pieces are counted, and the stages act on distinct pieces."""
    text = F.coalesce("text", F.lit(""))
    # Directions change a text only if it has a bracket: the pieces of one without count for both sorts.
    bare = F.regexp_replace(text, r"\[[^\]]*\]", " ")
    same = F.lit("both")
    sorts = F.when(F.contains(text, F.lit("[")), F.array(F.struct(F.lit("raw").alias("sort"), text.alias("t")), F.struct(F.lit("bare").alias("sort"), bare.alias("t"))))
    rows = lines.select(F.inline(sorts.otherwise(F.array(F.struct(same.alias("sort"), text.alias("t"))))))
    found = rows.select("sort", F.explode(F.regexp_extract_all("t", F.lit(f"[^{WHITE}]+"), F.lit(0))).alias("piece"))
    found = settle(found.groupBy("piece", "sort").agg(F.count("*").alias("n")))
    raw, spoken = found.filter("sort <> 'bare'"), found.filter("sort <> 'raw'")
    words = lambda rows: rows.select(F.explode(tokenize(F.col("piece"))).alias("term"), "n")
    summed = lambda rows, stage: rows.groupBy("term").agg(F.sum("n").alias("n")).groupBy().agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).select(F.lit(stage).alias("stage"), "tokens", "types")
    said = words(spoken).groupBy("term").agg(F.sum("n").alias("n"))
    kept = [F.lit(True), ~F.col("term").isin(STOP), ~F.col("term").isin(STOP + FILLER)]
    tail = said.select(F.explode(F.filter(F.array(*[F.when(k, F.lit(i + 3)) for i, k in enumerate(kept)]), lambda x: x.isNotNull())).alias("stage"), "n")
    out = summed(raw.select(F.col("piece").alias("term"), "n"), 0).union(summed(raw.select(F.lower("piece").alias("term"), "n"), 1)).union(summed(words(raw), 2))
    return out.filter("types > 0").union(tail.groupBy("stage").agg(F.sum("n").alias("tokens"), F.count("*").alias("types")))


def zipf(counts: DataFrame, low: int = 10, high: int = 5000) -> DataFrame:
    """slope and intercept of log10 n on log10 rank over ranks low..high (count descending, term ascending)."""
    ranked = row_ordinals(counts, [F.desc("n"), F.asc("term")], "rank").select((F.col("rank") + 1).alias("rank"), "n").filter(F.col("rank").between(low, high))
    x, y = F.log10("rank"), F.log10("n")
    return ranked.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def speaker_profile(lines: DataFrame) -> DataFrame:
    """speaker, lines, episodes, tokens, tokens_per_line (over lines that have any)."""
    rows = lines.select("speaker", "conv_id", F.size(tokenize(F.col("text"))).alias("n"))
    return rows.groupBy("speaker").agg(F.count("*").alias("lines"), F.countDistinct("conv_id").alias("episodes"), F.sum("n").alias("tokens"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("tokens_per_line"))


def top_share(counts: DataFrame, top: int = 10) -> DataFrame:
    """tokens, top_tokens, share: how much of the corpus its `top` commonest terms make up."""
    words = term_counts(counts)
    best = words.orderBy(F.desc("n"), "term").limit(top).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top_tokens"))
    return words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).crossJoin(best).withColumn("share", F.try_divide("top_tokens", "tokens"))


def speaker_cards(lines: DataFrame, late: Column, least: int = 2000) -> DataFrame:
    """speaker, lines, episodes, tokens, tokens_per_line, late_share (of lines where `late` holds), degree (speakers talked with, of all) and
    strength (turns with other core speakers) of the core: speakers of `least` tokens or more."""
    core = settle(speaker_profile(lines).filter(F.col("tokens") >= least))
    turns = settle(turn_network(lines))
    both = turns.select(F.col("a").alias("speaker"), F.col("b").alias("other"), "weight").union(turns.select("b", "a", "weight"))
    held = both.join(core.select(F.col("speaker").alias("other"), F.lit(True).alias("in_core")), "other", "left")
    ties = held.groupBy("speaker").agg(F.count("*").alias("degree"), F.sum(F.when(F.col("in_core"), F.col("weight")).otherwise(0)).alias("strength"))
    shares = lines.groupBy("speaker").agg(F.avg(F.when(late, 1.0).otherwise(0.0)).alias("late_share"))
    rows = core.join(shares, "speaker").join(ties, "speaker", "left")
    return rows.select("speaker", "lines", "episodes", "tokens", "tokens_per_line", "late_share", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0)).alias("strength"))


def speaker_ranks(lines: DataFrame, least: int = 2000) -> DataFrame:
    """speaker, types, types_rank, tokens_per_line, line_rank among speakers of `least` tokens or more: 1 for the most; equal ones share the better rank."""
    types = speaker_terms(lines).groupBy(F.col("owner").alias("speaker")).agg(F.count("*").alias("types"))
    rows = speaker_profile(lines).filter(F.col("tokens") >= least).join(types, "speaker").select("speaker", "types", F.round("tokens_per_line", 6).alias("tokens_per_line"))
    for value, name in (("types", "types_rank"), ("tokens_per_line", "line_rank")):
        # Ranks over range parts: the best place of each value.
        places = row_ordinals(rows.select("speaker", value), [F.desc(value), F.asc("speaker")], "place").groupBy(value).agg((F.min("place") + 1).alias(name))
        rows = rows.join(places, value)
    return rows.select("speaker", "types", "types_rank", "tokens_per_line", "line_rank")


def turn_network(lines: DataFrame) -> DataFrame:
    """a < b, weight: consecutive lines of one conversation by different speakers. A conversation of any length is spread over range parts."""
    rows = neighbours(lines.select("conv_id", "pos", "speaker"), ["conv_id"], ["pos"], {"other": "speaker"}, ahead=True).filter("speaker <> other")
    return rows.groupBy(F.least("speaker", "other").alias("a"), F.greatest("speaker", "other").alias("b")).agg(F.count("*").alias("weight"))


def core_speakers(lines: DataFrame, least: int = 2000) -> DataFrame:
    """speaker of those with `least` tokens or more."""
    return lines.groupBy("speaker").agg(F.sum(F.size(tokenize(F.col("text")))).alias("n")).filter(F.col("n") >= least).select("speaker")


def talk_lift(pairs: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """a, b, weight, lift = weight / (s_a s_b / 2W), null where a strength is 0; on the subgraph of `core` speakers, if given.

    Pairs that never talk have no row: their weight and lift are 0."""
    if core is not None:
        for end in ("a", "b"):
            pairs = pairs.join(core.select(F.col("speaker").alias(end)).distinct(), end, "left_semi")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("s"))
    total = pairs.agg(F.sum("weight").alias("w"))
    rows = pairs.join(ends.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(ends.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").crossJoin(F.broadcast(total))
    return rows.select("a", "b", "weight", F.try_divide(2.0 * F.col("weight") * F.col("w"), F.col("sa").cast("double") * F.col("sb")).alias("lift"))


def episode_jaccard(lines: DataFrame) -> DataFrame:
    """a < b, jaccard of the conversations of two speakers that share one."""
    held = lines.select("speaker", "conv_id").distinct()
    size = held.groupBy("speaker").agg(F.count("*").alias("n"))
    both = held.select("conv_id", F.col("speaker").alias("a")).join(held.select("conv_id", F.col("speaker").alias("b")), "conv_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    rows = both.join(size.select(F.col("speaker").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("speaker").alias("b"), F.col("n").alias("nb")), "b")
    return rows.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def term_vectors(counts: DataFrame, least: int = 5) -> DataFrame:
    """owner, term, weight = n x ln(N / df) over terms with a corpus count of `least` or more that are no stop or filler words."""
    owners = counts.select("owner").distinct().agg(F.count("*").alias("owners"))
    kept = counts.groupBy("term").agg(F.sum("n").alias("all"), F.count("*").alias("df")).filter((F.col("all") >= least) & ~F.col("term").isin(STOP + FILLER))
    rows = counts.join(kept, "term").crossJoin(F.broadcast(owners))
    return rows.select("owner", "term", (F.col("n") * F.ln(F.col("owners") / F.col("df"))).alias("weight"))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """a < b, cosine; owners without weight are left out. A term joins only owners that use it."""
    norms = vectors.groupBy("owner").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).filter("norm > 0")
    unit = vectors.filter("weight <> 0").join(norms, "owner").select("owner", "term", (F.col("weight") / F.col("norm")).alias("x"))
    both = unit.select("term", F.col("owner").alias("a"), F.col("x").alias("xa")).join(unit.select("term", F.col("owner").alias("b"), F.col("x").alias("xb")), "term").filter("a < b")
    return both.groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("cosine"))


def heaps_curve(lines: DataFrame, points: int = 40, first: int = 10) -> DataFrame:
    """speaker, i, types: distinct terms among a speaker's first i tokens, at log-spaced i from `first` on and at the end.

    Only lengths are summed along a speaker's lines, over range parts; of the tokens, each term's first place is kept before
    anything is shuffled. (speaker, pos) should be unique; lines with equal ones come in the order of conv_id."""
    order = ["pos", "conv_id"]
    text = F.coalesce("text", F.lit(""))
    held = lines.select("speaker", *order, F.size(tokenize(text)).cast("long").alias("len"))
    base = settle(running(held, ["speaker"], order, {"upto": (F.sum, F.col("len"))}).select("speaker", *order, "upto", (F.col("upto") - F.col("len")).alias("base")))
    # A place is one number, so the least ones are found by hash, without sorting tokens.
    at = base.filter("upto > base").select(F.col("speaker").alias("of"), *(F.col(c).alias(f"{c}_") for c in order), "base")
    same = F.col("of").eqNullSafe(F.col("speaker")) & F.col("pos_").eqNullSafe(F.col("pos")) & F.col("conv_id_").eqNullSafe(F.col("conv_id"))
    met = lines.select("speaker", *order, text.alias("text")).join(at, same).select("speaker", "base", F.posexplode(tokenize(F.col("text"))).alias("i", "term"))
    places = met.groupBy("speaker", "term").agg(F.min(F.col("base") + F.col("i") + 1).alias("place"))
    ends = base.groupBy("speaker").agg(F.max("upto").alias("end")).filter("end > 0")
    step = lambda k: F.floor(F.pow(F.lit(10.0), F.log10(F.lit(float(first))) + k * (F.log10(F.col("end")) - F.log10(F.lit(float(first)))) / (points - 1)))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(points - 2)), lambda k: step(k).cast("long"))
    grid = ends.select("speaker", F.array_distinct(F.array_append(F.filter(spaced, lambda x: x < F.col("end")), F.col("end"))).alias("grid"))
    # At most `points` rows a speaker from here on.
    here = F.col("of").eqNullSafe(F.col("speaker"))
    new = places.withColumnRenamed("speaker", "of").join(grid, here).groupBy("speaker", F.array_min(F.filter("grid", lambda x: x >= F.col("place"))).alias("i")).agg(F.count("*").alias("new"))
    every = grid.select("speaker", F.explode("grid").alias("i")).join(new.withColumnsRenamed({"speaker": "of", "i": "at"}), here & (F.col("i") == F.col("at")), "left")
    upto = Window.partitionBy("speaker").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return every.select("speaker", "i", F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("types"))


def distinctive_terms(counts: DataFrame, top: int = 12, least: int = 5) -> DataFrame:
    """owner, term, n, z: log-odds with the corpus as an informative Dirichlet prior; the `top` of each owner, ties to the greater term.

    An owner's total leaves stop words out, the corpus total has them."""
    corpus = counts.groupBy("term").agg(F.sum("n").alias("a"))
    said = counts.filter(~F.col("term").isin(STOP))
    total, own = counts.agg(F.sum("n").alias("a0")), said.groupBy("owner").agg(F.sum("n").alias("ni"))
    rows = said.filter(F.col("n") >= least).join(corpus, "term").join(own, "owner").crossJoin(F.broadcast(total))
    y, a, n, a0 = (F.col(c).cast("double") for c in ("n", "a", "ni", "a0"))
    rest, nrest = a - y, a0 - n
    delta = F.ln(F.try_divide(y + a, n + a0 - y - a)) - F.ln(F.try_divide(rest + a, nrest + a0 - rest - a))
    z = F.round(delta / F.sqrt(1 / (y + a) + 1 / (rest + a)), 6)
    ranked = rows.select("owner", "term", "n", z.alias("z")).filter("z is not null").withColumn("i", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("z"), F.desc("term"))))
    return ranked.filter(F.col("i") <= top).drop("i")


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.ln(c)).otherwise(0.0)


def bigram_g2(lines: DataFrame, least: int = 15, top: int = 30) -> DataFrame:
    """first, second, n, g2 (Dunning) of bigrams inside lines without stop words; the `top` by g2."""
    toks = lines.select(tokenize(F.col("text")).alias("t")).filter("size(t) > 1")
    pairs = toks.select(F.explode(F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("first"), F.expr("slice(t, 2, size(t) - 1)").alias("second"))).alias("p")).select("p.first", "p.second")
    # Counted once; filters below would else be pushed into the counting, which then runs anew for each use.
    c = settle(pairs.groupBy("first", "second").agg(F.count("*").alias("n"))).withColumn("n", F.col("n").cast("double"))
    left, right = c.groupBy("first").agg(F.sum("n").alias("r")), c.groupBy("second").agg(F.sum("n").alias("s"))
    total = c.agg(F.sum("n").alias("t"))
    rows = c.filter((F.col("n") >= least) & ~F.col("first").isin(STOP) & ~F.col("second").isin(STOP)).join(left, "first").join(right, "second").crossJoin(F.broadcast(total))
    k11, k12, k21 = F.col("n"), F.col("r") - F.col("n"), F.col("s") - F.col("n")
    k22 = F.col("t") - F.col("r") - F.col("s") + F.col("n")
    g2 = 2 * (_xlogx(k11) + _xlogx(k12) + _xlogx(k21) + _xlogx(k22) - _xlogx(k11 + k12) - _xlogx(k21 + k22) - _xlogx(k11 + k21) - _xlogx(k12 + k22) + _xlogx(F.col("t")))
    return rows.select("first", "second", k11.cast("long").alias("n"), F.round(g2, 6).alias("g2")).orderBy(F.desc("g2"), "first", "second").limit(top)


#: Buckets that trigrams are counted in by hash, and how many of the fullest ones give the first bound.
BUCKETS, FULLEST = 1 << 20, 2000


def trigrams(lines: DataFrame, pool: int = 400, top: int = 25) -> DataFrame:
    """trigram, n: of the `pool` commonest, the first `top` with at most one stop or filler word.

    Most trigrams are rare, and no bucket of hashes holds less than any trigram in it. So buckets are counted first; the trigrams
    of the fullest buckets give a count that the pool surely reaches, and only trigrams of buckets that reach it are counted."""
    t = lines.select(tokenize(F.col("text")).alias("t")).filter("size(t) > 2")
    zipped = F.arrays_zip(*[F.expr(f"slice(t, {i}, size(t) - 2)").alias(f"w{i}") for i in (1, 2, 3)])
    grams = t.select(F.explode(zipped).alias("w")).select(F.concat_ws(" ", "w.w1", "w.w2", "w.w3").alias("trigram"))
    grams = grams.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)))
    load = settle(grams.groupBy("bucket").agg(F.count("*").alias("load")))
    of = lambda buckets: grams.join(F.broadcast(buckets.select("bucket")), "bucket", "left_semi").groupBy("trigram").agg(F.count("*").alias("n"))
    # At most BUCKETS numbers are broadcast.
    sure = of(load.orderBy(F.desc("load"), "bucket").limit(max(FULLEST, pool))).orderBy(F.desc("n")).limit(pool).agg(F.count("*").alias("held"), F.min("n").alias("n"))
    held, least = sure.first()
    reach = load.filter(F.col("load") >= (least if held == pool else 0))
    common = of(reach).orderBy(F.desc("n"), "trigram").limit(pool)
    low = F.array(*[F.lit(w) for w in STOP + FILLER])
    return common.filter(F.size(F.filter(F.split("trigram", " "), lambda x: F.array_contains(low, x))) <= 1).orderBy(F.desc("n"), "trigram").limit(top)


def who_says(lines: DataFrame, phrases: list[str], top: int = 3) -> DataFrame:
    """phrase, speaker, lines: speakers with most lines that hold the phrase."""
    low = F.concat(F.lit(" "), F.array_join(tokenize(F.col("text")), " "), F.lit(" "))
    held = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.concat(F.lit(" "), p, F.lit(" "))))
    rows = lines.select("speaker", F.explode(held).alias("phrase")).groupBy("phrase", "speaker").agg(F.count("*").alias("lines"))
    w = Window.partitionBy("phrase").orderBy(F.desc("lines"), "speaker")
    return rows.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= top).drop("i")


def concordance(lines: DataFrame, pattern: str) -> DataFrame:
    """conv_id, pos, speaker, text, before_speaker, before_text of matching lines; typographic apostrophes are made plain.

    Places find their forerunners over range parts, without texts; only matching lines and those before them are looked
    up. (conv_id, pos) should be unique."""
    plain = F.replace(F.col("text"), F.lit("’"), F.lit("'"))
    slim = lines.select("conv_id", "pos", F.lower(plain).rlike(pattern).alias("hit"))
    found = neighbours(slim, ["conv_id"], ["pos"], {"before": "pos"}).filter("hit")
    found = settle(found.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), "before"))
    at = lambda p: F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos").eqNullSafe(F.col(p)))
    rows = lines.select("conv_id", "pos", "speaker", "text").join(found, at("p")).select("c", "p", "before", "speaker", "text")
    prior = lines.select("conv_id", "pos", F.col("speaker").alias("before_speaker"), F.col("text").alias("before_text"))
    return rows.join(prior, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("before")), "left").select(F.col("c").alias("conv_id"), F.col("p").alias("pos"), "speaker", "text", "before_speaker", "before_text")


def concordance_speakers(found: DataFrame) -> DataFrame:
    """speaker, lines: matching lines of each speaker."""
    return found.groupBy("speaker").agg(F.count("*").alias("lines"))


def episode_table(lines: DataFrame, ratings: DataFrame, crosswalk: DataFrame, focal: str) -> DataFrame:
    """conv_id, lines, tokens, focal_share, rating: by crosswalk (conv_id, rated), or the same id where it has none."""
    n = F.size(tokenize(F.col("text")))
    rows = lines.groupBy("conv_id").agg(F.count("*").alias("lines"), F.sum(n).alias("tokens"), F.try_divide(F.sum(F.when(F.col("speaker") == focal, n).otherwise(0)), F.sum(n)).alias("focal_share"))
    keyed = rows.join(crosswalk, "conv_id", "left").withColumn("rated", F.coalesce("rated", "conv_id"))
    return keyed.join(ratings, "rated", "left").select("conv_id", "lines", "tokens", "focal_share", "rating")


def rating_correlation(episodes: DataFrame) -> DataFrame:
    here = F.col("focal_share") > 0
    return episodes.agg(pearson("focal_share", "rating").alias("corr_all"), pearson(F.when(here, F.col("focal_share")), F.when(here, F.col("rating"))).alias("corr_present"), F.avg(F.when(here, F.col("rating"))).alias("mean_present"), F.avg(F.when(~here, F.col("rating"))).alias("mean_absent"))


def holdout_quotes(lines: DataFrame, per_speaker: int = 40, low: int = 10, high: int = 32, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(held-out lines, the rest): per speaker the lines of least hash among those of low..high tokens without a bracket."""
    fit = F.size(tokenize(F.col("text"))).between(low, high) & ~F.contains(F.col("text"), F.lit("["))
    w = Window.partitionBy("speaker").orderBy(F.xxhash64(F.lit(seed), "conv_id", "pos"), "conv_id", "pos")
    quotes = lines.filter(fit).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= per_speaker).drop("i")
    return quotes, lines.join(quotes.select("conv_id", "pos"), ["conv_id", "pos"], "left_anti")


def author_profiles(train: DataFrame, least: int = 3, top: int = 600) -> DataFrame:
    """owner, term, weight: tf x ln(N / df), terms but stop words with n >= least that not all owners use; the `top` of each, scaled to unit length."""
    counts = speaker_terms(train).filter(~F.col("term").isin(STOP))
    owners = counts.select("owner").distinct().agg(F.count("*").alias("owners"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    rows = counts.filter(F.col("n") >= least).join(df, "term").crossJoin(F.broadcast(owners)).filter("df < owners")
    weighed = rows.select("owner", "term", (F.col("n") * F.ln(F.col("owners") / F.col("df"))).alias("weight"))
    best = weighed.withColumn("i", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc(F.round("weight", 9)), "term"))).filter(F.col("i") <= top).drop("i")
    norm = best.groupBy("owner").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return best.join(norm, "owner").select("owner", "term", (F.col("weight") / F.col("norm")).alias("weight"))


def classify(quotes: DataFrame, profiles: DataFrame) -> DataFrame:
    """conv_id, pos, speaker, guess, score: the owner with the largest sum of weights (ties to the least name); a quote
    without any word of a profile has a null guess and a score of 0."""
    hits = tokens(quotes).join(profiles, "term").groupBy("conv_id", "pos", "speaker", "owner").agg(F.round(F.sum("weight"), 9).alias("score"))
    best = hits.groupBy("conv_id", "pos").agg(F.min(F.struct((-F.col("score")).alias("s"), "owner")).alias("b"))
    return quotes.select("conv_id", "pos", "speaker").join(best, ["conv_id", "pos"], "left").select("conv_id", "pos", "speaker", F.col("b.owner").alias("guess"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("score"))


def word_class_mix(lines: DataFrame) -> DataFrame:
    """conv_id, pos, content, stop, filler: tokens of each class in a line."""
    stops, fillers = (F.array(*[F.lit(w) for w in ws]) for ws in (STOP, FILLER))
    t = tokenize(F.col("text"))
    count = lambda words: F.size(F.filter(t, lambda x: F.array_contains(words, x)))
    rows = lines.select("conv_id", "pos", F.size(t).alias("all"), count(stops).alias("stop"), count(fillers).alias("filler"))
    return rows.select("conv_id", "pos", (F.col("all") - F.col("stop") - F.col("filler")).alias("content"), "stop", "filler")


def balanced_lines(mix: DataFrame, low: int = 10, high: int = 22, each: int = 4) -> DataFrame:
    """The lines of word_class_mix with low to high tokens, of which `each` or more are content words and as many are stop words."""
    return mix.filter((F.col("content") + F.col("stop") + F.col("filler")).between(low, high) & (F.col("content") >= each) & (F.col("stop") >= each))


def class_shares(mix: DataFrame) -> DataFrame:
    """tokens, stop_share, filler_share of all lines."""
    total = F.sum(F.col("content") + F.col("stop") + F.col("filler"))
    return mix.agg(total.alias("tokens"), F.try_divide(F.sum("stop"), total).alias("stop_share"), F.try_divide(F.sum("filler"), total).alias("filler_share"))


def top_partners(pairs: DataFrame, value: str, k: int = 3) -> DataFrame:
    """node, partner, value, place: the k partners of largest value."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("partner"), value).union(pairs.select("b", "a", value))
    w = Window.partitionBy("node").orderBy(F.desc(value), "partner")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def pair_table(talk: DataFrame, jaccard: DataFrame, similarities: DataFrame) -> DataFrame:
    """a, b, weight, lift, jaccard and the similarities of all pairs that have any of them; what a pair lacks is 0, and so is all of
    a pair without a row."""
    out = talk.join(jaccard, ["a", "b"], "full").join(similarities, ["a", "b"], "full")
    return out.fillna(0, [c for c in out.columns if c not in ("a", "b")])


def who_says_bigrams(lines: DataFrame, phrases: DataFrame, top: int = 3) -> DataFrame:
    """first, second, speaker, lines: the speakers with most lines that hold a bigram of phrases (first, second); a line counts once."""
    t = lines.select("speaker", tokenize(F.coalesce("text", F.lit(""))).alias("t")).filter("size(t) > 1")
    # Two words as one string, which no other two make: distinct strings are found by hash, distinct structs by comparing all of a line.
    both = lambda x, y: F.concat(x, F.lit(" "), y)
    pairs = F.zip_with(F.expr("slice(t, 1, size(t) - 1)"), F.expr("slice(t, 2, size(t) - 1)"), both)
    held = t.select("speaker", F.explode(F.array_distinct(pairs)).alias("p"))
    wanted = phrases.select("first", "second").distinct().withColumn("p", both(F.col("first"), F.col("second")))
    rows = held.join(wanted, "p").groupBy("first", "second", "speaker").agg(F.count("*").alias("lines"))
    w = Window.partitionBy("first", "second").orderBy(F.desc("lines"), "speaker")
    return rows.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= top).drop("i")


def mean_similarity(pairs: DataFrame, value: str, owners: DataFrame) -> DataFrame:
    """owner, mean over all other owners (absent pairs count as 0)."""
    n = owners.select("owner").distinct().agg((F.count("*") - 1).alias("n"))
    sums = pairs.select(F.explode(F.array("a", "b")).alias("owner"), value).groupBy("owner").agg(F.sum(value).alias("s"))
    return owners.select("owner").distinct().join(sums, "owner", "left").crossJoin(F.broadcast(n)).select("owner", F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("mean"))


def partial_rank_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Correlation of the ranks of x and y with the ranks of z held fixed."""
    ranked = average_ranks(average_ranks(average_ranks(df.select(x, y, z), x, "rx_"), y, "ry_"), z, "rz_")
    c = ranked.agg(pearson("rx_", "ry_").alias("xy"), pearson("rx_", "rz_").alias("xz"), pearson("ry_", "rz_").alias("yz"))
    return c.select(partial("xy", "xz", "yz").alias("partial"))


def partial(xy: str, xz: str, yz: str) -> Column:
    """Partial correlation of x and y given z from the three correlations; null where z explains all of one."""
    xy, xz, yz = (F.col(c) for c in (xy, xz, yz))
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz**2) * (1 - yz**2)))


def corpus_meta(lines: DataFrame, counts: DataFrame) -> DataFrame:
    a = lines.agg(F.count("*").alias("lines"), F.countDistinct("conv_id").alias("episodes"), F.countDistinct("speaker").alias("speakers"))
    return a.crossJoin(counts.groupBy("term").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types")))
