"""Queries on utterances: documents as lines of their source, and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators import dialogue as dl
from netlex.operators import lexical, nulls
from netlex.plans.graphs import r6
from netlex.plans.inputs import CHATS, LINES, TOKENS, chats, lines, sql, table

QUERIES, SQL = {}, {}
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in dl.STOP)
_LOW = ", ".join("'" + w.replace("'", "''") + "'" for w in dl.STOP + dl.FILLER)


def add(name, run, select=None, ctes=(LINES, TOKENS)):
    QUERIES[name] = run
    if select:
        SQL[name] = sql(list(ctes), select)


def counts(s, d):
    return dl.speaker_terms(lines(s, d))


add("speaker_terms", counts, "SELECT owner, term, n FROM kc")
add("term_counts", lambda s, d: dl.term_counts(counts(s, d)).orderBy(F.desc("n"), "term").limit(25), "SELECT term, n FROM kw ORDER BY n DESC, term LIMIT 25")
add("zipf", lambda s, d: r6(dl.zipf(dl.term_counts(counts(s, d))), "slope", "intercept"), "SELECT round(regr_slope(log10(n), log10(r)), 6) AS slope, round(regr_intercept(log10(n), log10(r)), 6) AS intercept FROM (SELECT n, row_number() OVER (ORDER BY n DESC, term) AS r FROM kw) WHERE r BETWEEN 10 AND 5000")
add("speaker_profile", lambda s, d: r6(dl.speaker_profile(lines(s, d)), "tokens_per_line"), """SELECT speaker, count(*) AS lines, count(DISTINCT conv_id) AS episodes, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n) FILTER (n > 0), 6) AS tokens_per_line
    FROM (SELECT conv_id, speaker, len(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?')) AS n FROM l) GROUP BY speaker""", (LINES,))
_WORDS_SQL = "regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?')"
_TURNS = """tn AS (SELECT least(speaker, o) AS a, greatest(speaker, o) AS b, count(*) AS weight FROM (SELECT speaker, lead(speaker) OVER (PARTITION BY conv_id ORDER BY pos) AS o FROM l) WHERE speaker <> o GROUP BY 1, 2),
    st AS (SELECT node, sum(weight) AS s FROM (SELECT a AS node, weight FROM tn UNION ALL SELECT b, weight FROM tn) GROUP BY node),
    lf AS (SELECT a, b, weight, 2.0 * weight * (SELECT sum(weight) FROM tn) / (CAST(x.s AS DOUBLE) * y.s) AS lift FROM tn JOIN st x ON x.node = a JOIN st y ON y.node = b)"""
add("turn_network", lambda s, d: dl.turn_network(lines(s, d)), "SELECT a, b, weight FROM tn", (LINES, _TURNS))
add("turn_network_chats", lambda s, d: dl.turn_network(chats(s, d)), "SELECT a, b, weight FROM tn", (CHATS, _TURNS))
add("talk_lift", lambda s, d: r6(dl.talk_lift(dl.turn_network(lines(s, d))), "lift"), "SELECT a, b, weight, round(lift, 6) AS lift FROM lf", (LINES, _TURNS))
_JAC = """hd AS (SELECT DISTINCT speaker, conv_id FROM l), hn AS (SELECT speaker, count(*) AS n FROM hd GROUP BY 1),
    jc AS (SELECT x.speaker AS a, y.speaker AS b, count(*) AS m FROM hd x JOIN hd y ON x.conv_id = y.conv_id AND x.speaker < y.speaker GROUP BY 1, 2)"""
add("top_share", lambda s, d: r6(dl.top_share(counts(s, d)), "share"), "SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) FILTER (i <= 10) AS BIGINT) AS top_tokens, round(sum(n) FILTER (i <= 10) / sum(n), 6) AS share FROM (SELECT n, row_number() OVER (ORDER BY n DESC, term) AS i FROM kw)")
_CARDS = f"""tk AS (SELECT speaker, conv_id, len({_WORDS_SQL}) AS n FROM l),
    co AS (SELECT speaker, count(*) AS lines, count(DISTINCT conv_id) AS episodes, CAST(sum(n) AS BIGINT) AS tokens, avg(n) FILTER (n > 0) AS tokens_per_line, avg(CASE WHEN conv_id >= 'es' THEN 1.0 ELSE 0.0 END) AS late_share FROM tk GROUP BY 1 HAVING sum(n) >= 2000),
    tb AS (SELECT a AS speaker, b AS other, weight FROM tn UNION ALL SELECT b, a, weight FROM tn),
    ti AS (SELECT t.speaker, count(*) AS degree, CAST(coalesce(sum(weight) FILTER (co.speaker IS NOT NULL), 0) AS BIGINT) AS strength FROM tb t LEFT JOIN co ON co.speaker = other GROUP BY 1)"""
add("speaker_cards", lambda s, d: r6(dl.speaker_cards(lines(s, d), F.col("conv_id") >= "es"), "tokens_per_line", "late_share"), "SELECT speaker, lines, episodes, tokens, round(tokens_per_line, 6) AS tokens_per_line, round(late_share, 6) AS late_share, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength FROM co LEFT JOIN ti USING (speaker)", (LINES, _TURNS, _CARDS))
add("speaker_ranks", lambda s, d: dl.speaker_ranks(lines(s, d)), "SELECT speaker, types, rank() OVER (ORDER BY types DESC) AS types_rank, round(tokens_per_line, 6) AS tokens_per_line, rank() OVER (ORDER BY round(tokens_per_line, 6) DESC) AS line_rank FROM co JOIN (SELECT owner AS speaker, count(*) AS types FROM kc GROUP BY 1) USING (speaker)", (LINES, TOKENS, _TURNS, _CARDS))
add("episode_jaccard", lambda s, d: r6(dl.episode_jaccard(lines(s, d)), "jaccard"), "SELECT a, b, round(m / (p.n + q.n - m), 6) AS jaccard FROM jc JOIN hn p ON p.speaker = a JOIN hn q ON q.speaker = b", (LINES, _JAC))
_VEC = f"""vt AS (SELECT term, count(*) AS df FROM kc WHERE term NOT IN ({_LOW}) GROUP BY term HAVING sum(n) >= 5),
    vc AS (SELECT owner, term, n * ln((SELECT count(DISTINCT owner) FROM kc) / df) AS weight FROM kc JOIN vt USING (term)),
    vu AS (SELECT owner, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY owner)) AS x FROM vc WHERE weight <> 0),
    cs AS (SELECT p.owner AS a, q.owner AS b, sum(p.x * q.x) AS cosine FROM vu p JOIN vu q ON p.term = q.term AND p.owner < q.owner GROUP BY 1, 2)"""
add("term_vectors", lambda s, d: r6(dl.term_vectors(counts(s, d)), "weight"), "SELECT owner, term, round(weight, 6) AS weight FROM vc", (LINES, TOKENS, _VEC))


def _cosine(s, d):
    return dl.cosine_pairs(dl.term_vectors(counts(s, d)))


add("cosine_pairs", lambda s, d: r6(_cosine(s, d), "cosine"), "SELECT a, b, round(cosine, 6) AS cosine FROM cs", (LINES, TOKENS, _VEC))


def _pairs(s, d):
    kc = settle(counts(s, d))
    return dl.pair_table(dl.talk_lift(dl.turn_network(lines(s, d))), dl.episode_jaccard(lines(s, d)), lexical.pair_similarities(kc, dl.term_counts(kc)))


_KINDS = f"""xr AS (SELECT kc.owner, kc.term, CAST(kc.n AS DOUBLE) AS w FROM kc JOIN kw USING (term) WHERE kw.n >= 5),
    xs AS (SELECT owner, term, n / sum(n) OVER (PARTITION BY owner) AS w FROM kc WHERE term IN ({_STOP})),
    xk AS (SELECT 'raw' AS kind, * FROM xr UNION ALL SELECT 'style', * FROM xs UNION ALL SELECT 'content', owner, term, weight FROM vc),
    xu AS (SELECT kind, owner, term, w / sqrt(sum(w * w) OVER (PARTITION BY kind, owner)) AS x FROM xk WHERE w <> 0),
    xp AS (SELECT p.owner AS a, q.owner AS b, sum(p.x * q.x) FILTER (p.kind = 'raw') AS raw, sum(p.x * q.x) FILTER (p.kind = 'style') AS style, sum(p.x * q.x) FILTER (p.kind = 'content') AS content
        FROM xu p JOIN xu q ON p.kind = q.kind AND p.term = q.term AND p.owner < q.owner GROUP BY 1, 2)"""
#: All pairs of speakers, whatever they share: what they lack is 0.
_EVERY = """sp AS (SELECT DISTINCT speaker FROM l), jx AS (SELECT a, b, m / (p.n + q.n - m) AS jaccard FROM jc JOIN hn p ON p.speaker = a JOIN hn q ON q.speaker = b),
    pt AS (SELECT x.speaker AS a, y.speaker AS b, coalesce(weight, 0) AS weight, coalesce(lift, 0) AS lift, coalesce(jaccard, 0) AS jaccard, coalesce(raw, 0) AS raw, coalesce(style, 0) AS style, coalesce(content, 0) AS content
        FROM sp x JOIN sp y ON x.speaker < y.speaker LEFT JOIN lf ON lf.a = x.speaker AND lf.b = y.speaker LEFT JOIN jx ON jx.a = x.speaker AND jx.b = y.speaker LEFT JOIN xp ON xp.a = x.speaker AND xp.b = y.speaker)"""
_TABLES = (LINES, TOKENS, _TURNS, _JAC, _VEC, _KINDS, _EVERY)
add("pair_table", lambda s, d: r6(_pairs(s, d), "lift", "jaccard", *lexical.KINDS), "SELECT a, b, weight, round(lift, 6) AS lift, round(jaccard, 6) AS jaccard, round(raw, 6) AS raw, round(style, 6) AS style, round(content, 6) AS content FROM pt WHERE weight + jaccard + abs(raw) + abs(style) + abs(content) > 0", _TABLES)


def pair_values(table, column, log=False):
    """One column of the pair table as values of pairs, without noise in the last digits."""
    value = F.log1p(column) if log else F.col(column)
    return table.select("a", "b", F.round(value, 9).alias("value"))


def predictors(table):
    return {"lift": pair_values(table, "lift"), "turns": pair_values(table, "weight", log=True), "episodes": pair_values(table, "jaccard")}


def _rank_correlations(s, d):
    t = settle(_pairs(s, d))
    return nulls.pair_correlations(predictors(t), {k: pair_values(t, k) for k in lexical.KINDS}, lines(s, d).select(F.col("speaker").alias("node")))


_RANKS = "rk AS (SELECT a, b, " + ", ".join(f"rank() OVER (ORDER BY {e}) + (count(*) OVER (PARTITION BY {e}) - 1) / 2 AS {n}" for n, e in [("lift", "round(lift, 9)"), ("turns", "round(ln(1 + weight), 9)"), ("episodes", "round(jaccard, 9)"), *((k, f"round({k}, 9)") for k in lexical.KINDS)]) + " FROM pt)"
add("pair_rank_corr", lambda s, d: r6(_rank_correlations(s, d), "value"), " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS value FROM rk" for x in ("lift", "turns", "episodes") for y in lexical.KINDS), (*_TABLES, _RANKS))


def _partial(s, d):
    """Talk and sounding alike, shared episodes held fixed."""
    t = settle(_pairs(s, d))
    of = {k: pair_values(t, k) for k in ("style", "content")} | {"lift": pair_values(t, "lift"), "episodes": pair_values(t, "jaccard")}
    c = settle(nulls.pair_correlations({k: of[k] for k in ("lift", "episodes")}, of, lines(s, d).select(F.col("speaker").alias("node"))))
    one = lambda x, name: c.filter(F.col("x") == x).select("y", F.col("value").alias(name))
    xz = c.filter("x = 'lift' and y = 'episodes'").select(F.col("value").alias("xz"))
    rows = one("lift", "xy").join(one("episodes", "yz"), "y").filter("y in ('style', 'content')").crossJoin(F.broadcast(xz))
    return rows.select(F.col("y").alias("kind"), dl.partial("xy", "xz", "yz").alias("partial"))


add("top_partners", lambda s, d: r6(dl.top_partners(_cosine(s, d).select("a", "b", F.round("cosine", 6).alias("cosine")), "cosine"), "cosine"), """SELECT node, partner, cosine, CAST(i AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, partner) AS i FROM (
    SELECT a AS node, b AS partner, round(cosine, 6) AS cosine FROM cs UNION ALL SELECT b, a, round(cosine, 6) FROM cs)) WHERE i <= 3""", (LINES, TOKENS, _VEC))
add("mean_similarity", lambda s, d: r6(dl.mean_similarity(_cosine(s, d), "cosine", counts(s, d)), "mean"), "SELECT owner, round(coalesce(m / ((SELECT count(DISTINCT owner) FROM kc) - 1), 0), 6) AS mean FROM (SELECT DISTINCT owner FROM kc) LEFT JOIN (SELECT owner, sum(cosine) AS m FROM (SELECT a AS owner, cosine FROM cs UNION ALL SELECT b, cosine FROM cs) GROUP BY owner) USING (owner)", (LINES, TOKENS, _VEC))
add("partial_rank_corr", lambda s, d: r6(_partial(s, d), "partial"), " UNION ALL ".join(f"SELECT '{k}' AS kind, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM (SELECT corr(lift, {k}) AS xy, corr(lift, episodes) AS xz, corr({k}, episodes) AS yz FROM rk)" for k in ("style", "content")), (*_TABLES, _RANKS))
add("heaps_curve", lambda s, d: dl.heaps_curve(lines(s, d)), """SELECT speaker, i, (SELECT count(*) FROM hf WHERE hf.speaker = hg.speaker AND met <= i) AS types FROM (SELECT speaker, unnest(list_distinct(list_append(list_filter(list_transform(range(0, 39), lambda k: CAST(floor(pow(10, 1 + k * (log10(n) - 1) / 39)) AS BIGINT)), lambda x: x < n), n))) AS i FROM he) hg""",
    (LINES, """ht AS (SELECT speaker, term, row_number() OVER (PARTITION BY speaker ORDER BY pos, j) AS r FROM (SELECT speaker, pos, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS j FROM (
        SELECT speaker, pos, regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?') AS t FROM l))),
    he AS (SELECT speaker, count(*) AS n FROM ht GROUP BY 1), hf AS (SELECT speaker, term, min(r) AS met FROM ht GROUP BY 1, 2)"""))
add("distinctive_terms", lambda s, d: dl.distinctive_terms(counts(s, d)), f"""SELECT owner, term, n, z FROM (SELECT owner, term, n, z, row_number() OVER (PARTITION BY owner ORDER BY z DESC, term DESC) AS i FROM (
    SELECT owner, term, y AS n, round((ln((y + a) / (ni + a0 - y - a)) - ln((a - y + a) / (a0 - ni + a0 - (a - y) - a))) / sqrt(1 / (y + a) + 1 / (a - y + a)), 6) AS z FROM (
    SELECT kc.owner, kc.term, kc.n AS y, CAST(kw.n AS DOUBLE) AS a, sum(kc.n) FILTER (WHERE kc.term NOT IN ({_STOP})) OVER (PARTITION BY kc.owner) AS ni, (SELECT sum(n) FROM kw) AS a0 FROM kc JOIN kw USING (term)) WHERE y >= 5 AND term NOT IN ({_STOP}))) WHERE i <= 12""")
_BI = """bt AS (SELECT t FROM (SELECT regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?') AS t FROM l) WHERE len(t) > 1),
    bc AS (SELECT f AS first, g AS second, CAST(count(*) AS DOUBLE) AS n FROM (SELECT unnest(t[1:len(t) - 1]) AS f, unnest(t[2:]) AS g FROM bt) GROUP BY 1, 2)"""
_X = "CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END"
_G2 = " ".join(f"{sign} {_X.format(e)}" for sign, e in (("", "n"), ("+", "r - n"), ("+", "q - n"), ("+", "t - r - q + n"), ("-", "r"), ("-", "t - r"), ("-", "q"), ("-", "t - q"), ("+", "t")))
add("bigram_g2", lambda s, d: dl.bigram_g2(lines(s, d)), f"""SELECT first, second, CAST(n AS BIGINT) AS n, round(2 * ({_G2}), 6) AS g2 FROM bc JOIN (SELECT first, sum(n) AS r FROM bc GROUP BY 1) USING (first) JOIN (SELECT second, sum(n) AS q FROM bc GROUP BY 1) USING (second), (SELECT sum(n) AS t FROM bc)
    WHERE n >= 15 AND first NOT IN ({_STOP}) AND second NOT IN ({_STOP}) ORDER BY g2 DESC, first, second LIMIT 30""", (LINES, _BI))
add("trigrams", lambda s, d: dl.trigrams(lines(s, d)), f"""SELECT trigram, n FROM (SELECT a || ' ' || b || ' ' || c AS trigram, count(*) AS n, any_value([a, b, c]) AS w FROM (SELECT unnest(t[1:len(t) - 2]) AS a, unnest(t[2:len(t) - 1]) AS b, unnest(t[3:]) AS c FROM bt WHERE len(t) > 2) GROUP BY 1 ORDER BY n DESC, trigram LIMIT 400)
    WHERE len(list_filter(w, lambda x: x IN ({_LOW}))) <= 1 ORDER BY n DESC, trigram LIMIT 25""", (LINES, _BI))
add("who_says_bigrams", lambda s, d: dl.who_says_bigrams(lines(s, d), dl.bigram_g2(lines(s, d))), f"""SELECT first, second, speaker, lines FROM (SELECT first, second, speaker, count(*) AS lines, row_number() OVER (PARTITION BY first, second ORDER BY count(*) DESC, speaker) AS i FROM (
    SELECT DISTINCT conv_id, pos, speaker, f AS first, g AS second FROM (SELECT conv_id, pos, speaker, unnest(t[1:len(t) - 1]) AS f, unnest(t[2:]) AS g FROM (SELECT conv_id, pos, speaker, {_WORDS_SQL} AS t FROM l) WHERE len(t) > 1)) JOIN (
    SELECT first, second, round(2 * ({_G2}), 6) AS g2 FROM bc JOIN (SELECT first, sum(n) AS r FROM bc GROUP BY 1) USING (first) JOIN (SELECT second, sum(n) AS q FROM bc GROUP BY 1) USING (second), (SELECT sum(n) AS t FROM bc)
    WHERE n >= 15 AND first NOT IN ({_STOP}) AND second NOT IN ({_STOP}) ORDER BY g2 DESC, first, second LIMIT 30) USING (first, second) GROUP BY 1, 2, 3) WHERE i <= 3""", (LINES, _BI))
_SAY = ["in the", "of the", "on the", "de la"]
add("who_says", lambda s, d: dl.who_says(lines(s, d), _SAY), f"""SELECT phrase, speaker, lines FROM (SELECT phrase, speaker, count(*) AS lines, row_number() OVER (PARTITION BY phrase ORDER BY count(*) DESC, speaker) AS i FROM (
    SELECT speaker, ' ' || array_to_string(regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?'), ' ') || ' ' AS t FROM l), (SELECT unnest({_SAY}) AS phrase) WHERE contains(t, ' ' || phrase || ' ') GROUP BY 1, 2) WHERE i <= 3""", (LINES,))
add("concordance", lambda s, d: dl.concordance(chats(s, d), "that was"), "SELECT * FROM (SELECT conv_id, pos, speaker, text, lag(speaker) OVER w AS before_speaker, lag(text) OVER w AS before_text FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY pos)) WHERE contains(replace(lower(text), '’', ''''), 'that was')", (CHATS,))


def _episodes(s, d):
    """Sources as episodes; ratings are mean quality labels; a crosswalk sends two sources to others."""
    rows = table(s, d, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rated = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", F.col("source").alias("rated")), "doc_id").groupBy("rated").agg(F.avg("quality").alias("rating"))
    cross = s.range(1).select(F.inline(F.array(F.struct(F.lit("src1").alias("conv_id"), F.lit("src2").alias("rated")), F.struct(F.lit("src3").alias("conv_id"), F.lit("src4").alias("rated")))))
    return dl.episode_table(rows, rated, cross, "de")


_EP = """ep AS (SELECT conv_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS tokens, sum(CASE WHEN speaker = 'de' THEN n ELSE 0 END) / sum(n) AS focal_share FROM (
    SELECT source AS conv_id, lang AS speaker, len(regexp_extract_all(replace(lower(coalesce(text, '')), '’', ''''), '[a-z]+(?:''[a-z]+)?')) AS n FROM documents) GROUP BY 1),
    rt AS (SELECT source AS rated, avg(quality) AS rating FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    et AS (SELECT conv_id, lines, tokens, focal_share, rating FROM ep LEFT JOIN rt ON rated = CASE conv_id WHEN 'src1' THEN 'src2' WHEN 'src3' THEN 'src4' ELSE conv_id END)"""
add("episode_table", lambda s, d: r6(_episodes(s, d), "focal_share", "rating"), "SELECT conv_id, lines, tokens, round(focal_share, 6) AS focal_share, round(rating, 6) AS rating FROM et", (_EP,))
add("rating_correlation", lambda s, d: r6(dl.rating_correlation(_episodes(s, d)), "corr_all", "corr_present", "mean_present", "mean_absent"), """SELECT round(corr(focal_share, rating), 6) AS corr_all, round(corr(focal_share, rating) FILTER (focal_share > 0), 6) AS corr_present,
    round(avg(rating) FILTER (focal_share > 0), 6) AS mean_present, round(avg(rating) FILTER (focal_share <= 0), 6) AS mean_absent FROM et""", (_EP,))
add("word_class_mix", lambda s, d: dl.word_class_mix(chats(s, d)), f"""SELECT conv_id, pos, CAST(len(t) - st - fi AS INTEGER) AS content, CAST(st AS INTEGER) AS stop, CAST(fi AS INTEGER) AS filler FROM (SELECT conv_id, pos, t, len(list_filter(t, lambda x: x IN ({_STOP}))) AS st,
    len(list_filter(t, lambda x: x IN ({", ".join(f"'{w}'" for w in dl.FILLER)}))) AS fi FROM (SELECT conv_id, pos, regexp_extract_all(replace(lower(text), '’', ''''), '[a-z]+(?:''[a-z]+)?') AS t FROM l))""", (CHATS,))
_MIX = f"""mx AS (SELECT conv_id, pos, len(t) - st - fi AS content, st AS stop, fi AS filler FROM (SELECT conv_id, pos, t, len(list_filter(t, lambda x: x IN ({_STOP}))) AS st,
    len(list_filter(t, lambda x: x IN ({", ".join(f"'{w}'" for w in dl.FILLER)}))) AS fi FROM (SELECT conv_id, pos, {_WORDS_SQL} AS t FROM l)))"""
add("balanced_lines", lambda s, d: dl.balanced_lines(dl.word_class_mix(chats(s, d)), 3, 60, 1), "SELECT conv_id, pos, CAST(content AS INTEGER) AS content, CAST(stop AS INTEGER) AS stop, CAST(filler AS INTEGER) AS filler FROM mx WHERE content + stop + filler BETWEEN 3 AND 60 AND content >= 1 AND stop >= 1", (CHATS, _MIX))
add("class_shares", lambda s, d: r6(dl.class_shares(dl.word_class_mix(lines(s, d))), "stop_share", "filler_share"), "SELECT CAST(sum(content + stop + filler) AS BIGINT) AS tokens, round(sum(stop) / sum(content + stop + filler), 6) AS stop_share, round(sum(filler) / sum(content + stop + filler), 6) AS filler_share FROM mx", (LINES, _MIX))
add("concordance_speakers", lambda s, d: dl.concordance_speakers(dl.concordance(lines(s, d), "that")), "SELECT speaker, count(*) AS lines FROM l WHERE contains(replace(lower(text), '’', ''''), 'that') GROUP BY 1", (LINES,))
add("corpus_meta", lambda s, d: dl.corpus_meta(lines(s, d), counts(s, d)), "SELECT (SELECT count(*) FROM l) AS lines, (SELECT count(DISTINCT conv_id) FROM l) AS episodes, (SELECT count(DISTINCT speaker) FROM l) AS speakers, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types FROM kw")
_SPLIT = r"regexp_extract_all({0}, '[^\x{{9}}-\x{{D}}\x{{1C}}-\x{{20}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')"
_BARE = r"regexp_replace(text, '\[[^\]]*\]', ' ', 'g')"
_WORDS = "regexp_extract_all(replace(lower({0}), '’', ''''), '[a-z]+(?:''[a-z]+)?')"
add("stage_counts", lambda s, d: dl.stage_counts(lines(s, d)), f"""SELECT CAST(stage AS INTEGER) AS stage, count(*) AS tokens, count(DISTINCT term) AS types FROM (
    SELECT 0 AS stage, unnest({_SPLIT.format("text")}) AS term FROM l UNION ALL SELECT 1, unnest({_SPLIT.format("lower(text)")}) FROM l UNION ALL SELECT 2, unnest({_WORDS.format("text")}) FROM l
    UNION ALL SELECT 3, term FROM sw UNION ALL SELECT 4, term FROM sw WHERE term NOT IN ({_STOP}) UNION ALL SELECT 5, term FROM sw WHERE term NOT IN ({_LOW})) GROUP BY stage""",
    (LINES, f"sw AS (SELECT unnest({_WORDS.format(_BARE)}) AS term FROM l)"))


def _guesses(s, d):
    quotes, train = dl.holdout_quotes(lines(s, d))
    return dl.classify(quotes, dl.author_profiles(train))


add("authorship", _guesses)
add("authorship_accuracy", lambda s, d: _guesses(s, d).agg(F.avg((F.col("speaker") == F.col("guess")).cast("int")).alias("accuracy"), F.count("*").alias("quotes")))


def _articles(s, d):
    """The pages' whole html behind a box whose fields hold inner braces, the url and a year."""
    box = F.concat(F.lit("{{Box\n| kind = {{Plainlist}} "), F.col("url"), F.lit("\n| debut = no "), (F.lit(1920) + F.col("page_id") % 110).cast("string"), F.lit("\n}}\nfrom 1999: "), F.coalesce("html", F.lit("")))
    return table(s, d, "pages").select(F.col("page_id").alias("node"), box.alias("text"))


def _attributes(s, d):
    return dl.extract_attributes(table(s, d, "pages").select(F.col("page_id").alias("node")), _articles(s, d), "kind", ["https", "http"])


_ATTR = """attr AS (SELECT page_id AS node, CASE WHEN contains(lower(url), 'https') THEN 'https' WHEN contains(lower(url), 'http') THEN 'http' END AS value,
    CASE WHEN page_id % 110 >= 10 THEN CAST((1920 + page_id % 110) // 10 * 10 AS INTEGER) END AS decade FROM pages)"""
add("extract_attributes", _attributes, "SELECT node, value, decade FROM attr", (_ATTR,))
add("attribute_coverage", lambda s, d: dl.attribute_coverage(_attributes(s, d)), "SELECT count(*) AS nodes, count(value) AS with_value, count(decade) AS with_decade FROM attr", (_ATTR,))


def _variants(s, d):
    return settle(lexical.variant_terms(lines(s, d)))


#: Texts under the first three cleanings, the counts under all five, and their ranks.
_VARIANTS = f"""y0 AS (SELECT bare, replace(CASE bare WHEN '1' THEN regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g') ELSE text END, '’', '''') AS y FROM l, (VALUES ('0'), ('1')) t(bare)),
    y1 AS (SELECT low, bare, CASE low WHEN '1' THEN lower(y) ELSE y END AS y FROM y0, (VALUES ('0'), ('1')) t(low)),
    y2 AS (SELECT low || words || bare AS stream, unnest(CASE words WHEN '1' THEN regexp_extract_all(y, '[A-Za-z]+(?:''[A-Za-z]+)?') ELSE regexp_extract_all(y, '[^ \\t\\n\\r\\f\\x0B]+') END) AS term FROM y1, (VALUES ('0'), ('1')) t(words)),
    y3 AS (SELECT stream, term, count(*) AS n FROM y2 GROUP BY 1, 2),
    y4 AS (SELECT stream || stop || fill AS variant, term, n FROM y3, (VALUES ('0'), ('1')) t(stop), (VALUES ('0'), ('1')) f(fill) WHERE NOT (stop = '1' AND term IN ({_STOP})) AND NOT (fill = '1' AND term IN ({", ".join(f"'{w}'" for w in dl.FILLER)}))),
    y5 AS (SELECT variant, term, n, row_number() OVER (PARTITION BY variant ORDER BY n DESC, encode(term)) AS rank FROM y4)"""
add("variant_counts", lambda s, d: r6(lexical.variant_counts(_variants(s, d)), "slope"), """SELECT variant, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, round(regr_slope(log10(n), log10(rank)) FILTER (rank BETWEEN 10 AND 5000), 6) AS slope FROM y5 GROUP BY variant""", (LINES, _VARIANTS))
add("variant_top", lambda s, d: lexical.variant_top(_variants(s, d)), "SELECT variant, term, n, rank FROM y5 WHERE rank <= 10", (LINES, _VARIANTS))
add("variant_points", lambda s, d: lexical.variant_points(_variants(s, d)))


def _similarities(s, d):
    kc = settle(counts(s, d))
    return lexical.pair_similarities(kc, dl.term_counts(kc))


add("pair_similarities", lambda s, d: r6(_similarities(s, d), *lexical.KINDS), "SELECT a, b, round(coalesce(raw, 0), 6) AS raw, round(coalesce(style, 0), 6) AS style, round(coalesce(content, 0), 6) AS content FROM xp", (LINES, TOKENS, _VEC, _KINDS))
add("equalized_similarity", lambda s, d: r6(lexical.equalized_similarity(lines(s, d), dl.term_counts(counts(s, d))), *lexical.KINDS))
add("types_in_sample", lambda s, d: r6(lexical.types_in_sample(lines(s, d), 2000), "types"))
