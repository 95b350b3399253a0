"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from netlex.llm import chat, licenses


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(c: str) -> str:
    """The canonical form, with patterns and spellings of its own, so that a fault in the operator's shows."""
    c = f"replace(lower(coalesce({c}, '')), chr(13) || chr(10), chr(10))"
    for pattern, by in [
        (r"(?m)(^[ \t]*|[.,:;][ \n\t]+|\band[ \n\t]+|\bor[ \n\t]+)[(]?(\d{1,2}|[a-z]|[ivx]{2,4})[.)][ \n\t]+", r"\1"),
        (r"(?m)^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(c\)|©|\d\d\d\d|[\[<{])|[(]c[)][^a-z0-9\n]*\d\d\d\d|©|all rights reserved[^a-z0-9\n]*$).*$", ""),
        (r"(\A\s*|\n[ \t]*\n)([ \t]*copyright[ \t]+[^\n]{1,60}(\n|\z))+([ \t]*\n|\s*\z)", r"\1"),
        ("&", " and "),
        (r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "),
    ]:
        c = f"regexp_replace({c}, {_text(pattern)}, {_text(by)}, 'g')"
    c = f"trim({c})"
    pairs = "licence license, licencing licensing, sub_license sublicense, non_commercial noncommercial, per_cent percent, copyright_owner copyright_holder, wilful willful, https_ http_"
    for a, b in (x.split() for x in pairs.split(", ")):
        c = f"replace({c}, '{a.replace('_', ' ')}', '{b.replace('_', ' ')}')"
    return c


_KNOWN = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in licenses.KNOWN)
_DIGESTS = ", ".join(f"({_text(i)}, {_text(d)})" for i, d in licenses.DIGESTS)
LICENSES = f"""WITH texts AS (SELECT DISTINCT license_id, sha256({_canonical('t')}) AS digest FROM (VALUES {_KNOWN}) AS k(license_id, t)),
known AS (FROM texts UNION VALUES {_DIGESTS}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
notices AS (SELECT doc_id, count(*) AS n, string_agg(license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN texts ON sha256({_canonical('line')}) = digest
    WHERE regexp_matches(line, '(?i)licen[sc]|released under|permission') GROUP BY doc_id)
SELECT d.doc_id, d.digest, license_id, coalesce(n, 0) AS n_notices, coalesce(ids, '') AS notices
FROM (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM documents) d LEFT JOIN known USING (digest) LEFT JOIN notices ON notices.doc_id = d.doc_id"""

_SAID = "</s>[INST] ok [/INST]"
_ESC = f"regexp_replace({{0}}, {_text('([<[])([\\\\]*)(' + chat.CONTROL_REST + ')')}, '\\1\\\\\\2\\3', 'g')"
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length(role) + length({_ESC.format('text')})) OVER w AS upto
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

SUBSTRINGS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
marked AS (SELECT w.doc_id, word, j, max(CASE WHEN l.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.i = w.j)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(gone) AS removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id) g USING (doc_id)"""

_CRC_TABLE = "SELECT list(c ORDER BY i) AS crc_t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) AS c FROM range(256) r(i))"


def _crc32(s: str) -> str:
    """CRC-32 of the UTF-8 bytes of s; crc_t is in scope."""
    data = f"list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda y: ('0x' || y)::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, y: xor(c >> 8, crc_t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


TRIE = f"""WITH crc AS ({_CRC_TABLE}),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
led AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = base WHERE i < h),
k AS (SELECT c.conv_id, h, count(led.conv_id) AS led FROM c LEFT JOIN led USING (conv_id) GROUP BY ALL),
r AS (SELECT * FROM led UNION ALL SELECT conv_id, i - h + led, role, text FROM t JOIN k USING (conv_id) WHERE i >= h),
p AS (SELECT conv_id, i + 1 AS d, strlen(text) AS b, string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY i) AS k FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (SELECT conv_id, max(d) AS len FROM p GROUP BY 1),
n AS (SELECT d, k, min(conv_id) AS m, count(*) AS n, max(b) AS b, coalesce(string_agg(CASE WHEN d = len THEN conv_id END, ',' ORDER BY conv_id), '') AS ids FROM p JOIN ends USING (conv_id) GROUP BY 1, 2),
kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
below AS (SELECT p.k, sum((n.n - 1) * n.b) AS saved, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves FROM n LEFT JOIN kids USING (k) JOIN p ON p.conv_id = n.m AND p.d <= n.d GROUP BY 1)
SELECT n.m AS conv_id, n.d::BIGINT AS depth, up.m AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN n up ON n.d > 0 AND up.k = left(n.k, length(n.k) - 32)"""


def _descend(name: str, shards: int) -> str:
    """SQL of (doc, name): the shard of each distinct doc_id among `shards`; three regions of two racks of four, others alone."""
    leaf = lambda s: (s // 8, s % 8 // 4, s) if s < 24 else (s - 21, 0, s)
    rows = ", ".join(str(leaf(s)) for s in range(shards))
    draw = lambda child, w: f"-ln((('0x' || substr(md5(doc || '/' || {child}), 1, 13))::BIGINT + 0.5) / 4503599627370496) / {w}"
    return f"""{name}_t AS (SELECT * FROM (VALUES {rows}) v(region, rack, shard)),
{name}_1 AS (SELECT doc, arg_min(region, {draw("'region ' || region", "w")}) AS region FROM docs, (SELECT region, count(*) AS w FROM {name}_t GROUP BY 1) GROUP BY 1),
{name}_2 AS (SELECT doc, region, arg_min(rack, {draw("'region ' || region || ' rack ' || rack", "w")}) AS rack FROM {name}_1 JOIN (SELECT region, rack, count(*) AS w FROM {name}_t GROUP BY 1, 2) USING (region) GROUP BY 1, 2),
{name}_3 AS (SELECT doc, arg_min(shard, {draw("'shard ' || shard", "1")}) AS {name} FROM {name}_2 JOIN {name}_t USING (region, rack) GROUP BY 1)"""


SHARDS = f"""WITH crc AS ({_CRC_TABLE}), docs AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS doc FROM documents),
{_descend("shard", 24)},
{_descend("grown_shard", 25)},
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS doc, strlen(coalesce(text, '')) + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM d JOIN shard_3 USING (doc) JOIN grown_shard_3 USING (doc)"""

SPELLING = f"""WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
hashed AS (SELECT run, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM low, crc),
w AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
parts AS (SELECT DISTINCT word, n, left(word, i) || '*' || substr(word, i + 2) AS part FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
    UNION SELECT word, n, left(word, i) || '*' || substr(word, i + 1) FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM parts a JOIN parts b USING (part) WHERE a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near COLLATE "C") AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(root, step) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM f"""

SQL = {
    "op1_license_scan": LICENSES,
    "op9_chat_formatting": CHAT,
    "op10_substring_dedup": SUBSTRINGS,
    "op11_prefix_trie": TRIE,
    "op12_hash_tree_shards": SHARDS,
    "op13_spelling_variants": SPELLING,
}
