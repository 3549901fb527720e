"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from .quality import RULES, STEPS, cutoff_at

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
  FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM g),
x AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, s, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
h AS (SELECT doc_id, k, x.n, item FROM x JOIN g USING (win)),
p AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM h, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""

_RULES = ", ".join(f"('{rule}', {i}, CAST({c} AS DOUBLE))" for rule, (_, _, grid) in RULES.items() for i, c in enumerate(grid))
_VALUES = " UNION ALL ".join(f"SELECT doc_id, lang, '{rule}' AS rule, {above} / CAST(greatest({below}, 1) AS DOUBLE) AS v FROM f WHERE NOT base_failed" for rule, (above, below, _) in RULES.items())
_TOGETHER = ", ".join(f"('{rule}', {i}, CAST({cutoff_at(rule, i)} AS DOUBLE))" for rule in RULES for i in range(STEPS))
_TAIL = "(SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))) FROM unnest(range(0, k + 1)) AS u(j))"

OP4 = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 2], ' ') AS gram FROM s, unnest(range(1, len(w) - 1)) AS u(k) WHERE len(w) >= 3),
r AS (
  SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g), unnest([0, 1, 2]) AS u(j) WHERE n > 1 GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines FROM s LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS ({_VALUES}),
grid(rule, i, cutoff) AS (VALUES {_RULES}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
n0 AS (SELECT lang, count(*) AS n FROM f JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang HAVING count(*) >= 149),
m0 AS (SELECT count(*) AS m FROM n0),
n AS (SELECT n0.*, m, n >= ceil(ln(0.05 / (4 * m)) / ln(1 - 0.005)) AS each FROM n0, m0),
k AS (SELECT v.lang, grid.rule, i, cutoff, n, m, count(*) FILTER (v > cutoff) AS k FROM v JOIN good USING (doc_id) JOIN n ON n.lang IS NOT DISTINCT FROM v.lang AND each JOIN grid ON grid.rule = v.rule GROUP BY ALL),
tested AS (SELECT *, k < 0.005 * n AND {_TAIL.format(p="0.005")} <= 0.05 / (4 * m) AS passed FROM k),
path(rule, i, cutoff) AS (VALUES {_TOGETHER}),
k2 AS (
  SELECT lang, i, n, m, count(*) FILTER (hit) AS k FROM (
    SELECT v.lang, doc_id, i, n, m, bool_or(v > cutoff) AS hit FROM v JOIN good USING (doc_id) JOIN n ON n.lang IS NOT DISTINCT FROM v.lang AND NOT each JOIN path ON path.rule = v.rule GROUP BY ALL) GROUP BY ALL),
tested2 AS (SELECT *, k < 0.02 * n AND {_TAIL.format(p="0.02")} <= 0.05 / m AS passed FROM k2),
last2 AS (SELECT lang, max(i) AS i FROM tested2 a WHERE NOT EXISTS (SELECT 1 FROM tested2 b WHERE b.lang IS NOT DISTINCT FROM a.lang AND b.i <= a.i AND NOT b.passed) GROUP BY lang),
chosen AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM tested a WHERE NOT EXISTS (SELECT 1 FROM tested b WHERE b.lang IS NOT DISTINCT FROM a.lang AND b.rule = a.rule AND b.i <= a.i AND NOT b.passed) GROUP BY lang, rule
  UNION ALL SELECT lang, rule, cutoff FROM last2 JOIN path USING (i)),
bad AS (SELECT DISTINCT doc_id FROM v JOIN chosen ON chosen.rule = v.rule AND chosen.lang IS NOT DISTINCT FROM v.lang WHERE v > cutoff)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad ON bad.doc_id = f.doc_id
"""

#: Escapes in a text: one backslash for each mark or escaped mark (chat.ESCAPE).
_ESCAPES = r"""len(regexp_extract_all(text, '[\[<]\\*(?:INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|ROLE=[0-9A-F]*\]|/ROLE\])'))"""

OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + {_ESCAPES} + 3 + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + 2 * strlen(role) END) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM c GROUP BY conv_id
"""

#: A word never holds a space, so two words joined by one are one shingle.
OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, w[k] || ' ' || w[k + 1] AS g FROM d, unnest(range(1, len(w))) AS t(k) WHERE len(w) >= 2 UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(a, b) AS (SELECT u, v FROM e UNION SELECT a, e.v FROM reach JOIN e ON reach.b = e.u),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: Words with the white space behind them make up a line; a word that ends in one of .!? or a line ends a unit.
OP8 = rf"""
WITH l AS (
  SELECT doc_id, ln, lines[ln] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS t(ln)),
p AS (
  SELECT doc_id, ln, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS w, length(regexp_extract(line, '^[\x20\x09-\x0D]*')) AS lead,
    sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) - length(line) - 1 AS b FROM l),
x AS (
  SELECT doc_id, ln, j, w[j] AS piece, b + lead + coalesce(sum(length(w[j])) OVER (PARTITION BY doc_id, ln ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    CASE WHEN j = 1 OR regexp_matches(w[j - 1], '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS starts
  FROM p, unnest(range(1, len(w) + 1)) AS t(j)),
y AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ln, j) AS u FROM x),
units AS (
  SELECT doc_id, u, min(ln) AS ln, min(b) AS b, string_agg(piece, '' ORDER BY j) AS body, count(*) AS n,
    string_agg(regexp_replace(translate(piece, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+$', ''), ' ' ORDER BY j) AS words FROM y GROUP BY doc_id, u),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY u) AS upto FROM units),
r AS (SELECT a.doc_id, a.u AS first, z.u AS last FROM c a JOIN c z ON z.doc_id = a.doc_id AND z.upto >= a.upto - a.n + 25 AND z.upto - z.n < a.upto - a.n + 25),
g AS (SELECT r.doc_id, first, last, string_agg(words, ' ' ORDER BY u) AS passage FROM r JOIN c ON c.doc_id = r.doc_id AND c.u BETWEEN first AND last GROUP BY ALL),
o AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY passage ORDER BY doc_id, first) AS k FROM g),
gone AS (SELECT DISTINCT c.doc_id, c.u FROM o JOIN c ON c.doc_id = o.doc_id AND c.u BETWEEN first AND last WHERE k > 1),
m AS (SELECT units.*, gone.u IS NOT NULL AS out FROM units LEFT JOIN gone USING (doc_id, u)),
t AS (
  SELECT doc_id, count(*) AS n, sum(length(body)) AS chars, string_agg(CAST(b AS BIGINT) || ':' || CAST(b + length(body) AS BIGINT), ',' ORDER BY u) AS spans FROM m WHERE out GROUP BY doc_id),
k AS (SELECT doc_id, ln, coalesce(string_agg(body, '' ORDER BY u) FILTER (NOT out), '') AS body, bool_and(out) AS out FROM m GROUP BY doc_id, ln),
s AS (
  SELECT p.doc_id, string_agg(CASE WHEN k.ln IS NULL THEN line ELSE substr(line, 1, lead) || k.body END, chr(10) ORDER BY p.ln) AS kept
  FROM p LEFT JOIN k ON k.doc_id = p.doc_id AND k.ln = p.ln WHERE NOT coalesce(k.out, false) GROUP BY p.doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS removed_chars, coalesce(spans, '') AS removed_spans,
  CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_LEVEL = "SELECT side, archive, node // 8 AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM {0} GROUP BY side, archive, node // 8"
#: Records of a slot of their archive, 512 of them; then eight nodes at a time.
_SLOTS = "SELECT side, archive, slot AS node, sha256(string_agg(hash, '' ORDER BY page_id, url, digest)) AS hash FROM l0 GROUP BY side, archive, slot"

OP10 = f"""
WITH size AS (SELECT greatest(1, (count(*) + 511) // 512) AS archives FROM pages),
p AS (
  SELECT 'a' AS side, page_id, url, html FROM pages
  UNION ALL SELECT 'b', page_id, url, CASE WHEN page_id % 101 = 7 THEN html || '.' ELSE html END FROM pages WHERE coalesce(page_id % 101, 0) <> 11
  UNION ALL SELECT 'b', page_id, url || '#copy', html FROM pages WHERE page_id % 101 = 13),
q AS (SELECT side, coalesce(CAST(page_id AS VARCHAR), '') AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM p),
m AS (
  SELECT side, page_id, url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS record
  FROM q),
h AS (
  SELECT side, page_id, url, sha256(record) AS digest, strlen(record) + 4 AS length, count(*) AS copies,
    CAST('0x' || substr(sha256(page_id || chr(10) || url), 1, 8) AS UBIGINT) % (SELECT archives FROM size) AS archive,
    CAST('0x' || substr(sha256(page_id || chr(10) || url), 9, 8) AS UBIGINT) % 512 AS slot
  FROM m GROUP BY ALL),
l0 AS (
  SELECT *, sha256(digest || ':' || copies || ':' || length) AS hash FROM h),
l1 AS ({_SLOTS}), l2 AS ({_LEVEL.format("l1")}), l3 AS ({_LEVEL.format("l2")}),
roots AS (SELECT side, archive, sha256(string_agg(hash, '' ORDER BY node)) AS root FROM l3 GROUP BY side, archive),
k AS (SELECT side, archive, page_id, url, string_agg(digest || ':' || copies, ',' ORDER BY digest) AS c FROM h GROUP BY ALL),
d AS (
  SELECT coalesce(x.archive, y.archive) AS archive, coalesce(x.page_id, y.page_id) || ':' || CASE WHEN y.c IS NULL THEN 'missing' WHEN x.c IS NULL THEN 'extra' ELSE 'altered' END AS what
  FROM (SELECT * FROM k WHERE side = 'a') x FULL JOIN (SELECT * FROM k WHERE side = 'b') y ON x.archive = y.archive AND x.page_id = y.page_id AND x.url = y.url
  WHERE x.c IS DISTINCT FROM y.c),
e AS (SELECT archive, string_agg(what, ',' ORDER BY what) AS damaged FROM d GROUP BY archive),
n AS (SELECT archive, sum(copies) AS n_records, sum(copies * length) AS n_bytes FROM h WHERE side = 'a' GROUP BY archive)
SELECT CAST(archive AS BIGINT) AS archive, CAST(coalesce(n_records, 0) AS BIGINT) AS n_records, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes,
  x.root, y.root AS replica_root, x.root IS NOT DISTINCT FROM y.root AS intact, coalesce(damaged, '') AS damaged
FROM (SELECT archive, root FROM roots WHERE side = 'a') x FULL JOIN (SELECT archive, root FROM roots WHERE side = 'b') y USING (archive)
LEFT JOIN n USING (archive) LEFT JOIN e USING (archive)
"""

#: A filter's document is met by an earlier one, or removed, or neither; E compares whole texts.
OP11 = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
f AS (
  SELECT w.doc_id, part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END AS fails
  FROM w JOIN firsts USING (text)),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, k AS step, filter_order[k] AS x, substr(filter_order, 1, k - 1) AS before FROM o, unnest(range(1, 6)) AS u(k) WHERE length(filter_order) = 5),
j AS (SELECT m.*, filter_order, step, x, contains(fails, x) AS hit, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS met FROM m, s),
r AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT met AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT met AND hit), 0) AS removed, coalesce(sum(n) FILTER (met AND hit), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT met AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT met AND hit), 0) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""

#: crc32 of each distinct word from its table of 256 entries, which the rule makes here too.
OP12 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
e AS (SELECT row, unnest(w) AS word FROM d),
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM e UNION SELECT word FROM b)),
bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS x FROM v),
z AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), x), lambda c, y: xor(c >> 8, entries[CAST(xor(c, y) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM e JOIN z USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN z USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM e) AS big_s, (SELECT count(*) FROM b) AS big_t),
g AS (
  SELECT word, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(big_s + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(big_t + 10000 AS DOUBLE)))) AS gain
  FROM z LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
q AS (SELECT row, sum(gain) AS weight FROM e JOIN g USING (word) GROUP BY row),
r AS (
  SELECT d.row, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS noise
  FROM d LEFT JOIN q ON q.row = d.row),
k AS (SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place FROM r WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score, CASE WHEN place <= 10 * (SELECT count(*) FROM k) // 100 THEN CAST(place AS BIGINT) END AS rank
FROM r LEFT JOIN k ON k.row = r.row
"""

SQL: dict[str, str] = {"op2_decontaminate": OP2, "op4_quality_rules": OP4, "op5_chat_format": OP5, "op7_minhash_dedup": OP7, "op8_line_dedup": OP8, "op10_warc_fixity": OP10, "op11_filter_audit": OP11, "op12_importance": OP12}
