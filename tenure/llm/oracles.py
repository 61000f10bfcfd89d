"""DuckDB SQL for the corpus queries that SQL can express, by plain definition rather than by method."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM b WHERE len(words) > 0) x),
p AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
            FROM d CROSS JOIN (SELECT DISTINCT n FROM w) s WHERE len(words) >= n) x),
h AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON w.n = p.n AND w.win = p.win),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) x GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) x GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lowered('text')}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
      FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM d WHERE len(words) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

OP4 = rf"""
WITH RECURSIVE o AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no,
             trim(regexp_replace(unnest(parts), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
      FROM (SELECT doc_id, string_split({lowered('text')}, chr(10)) AS parts FROM documents) x),
k AS (SELECT doc_id, line_no, line, length(line) AS n_chars FROM o WHERE length(line) >= 20),
u AS (SELECT DISTINCT line, n_chars AS n FROM k),
near AS (SELECT a.line AS a, b.line AS b FROM u a JOIN (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM u) b
         ON a.n = b.m AND a.line <> b.line WHERE levenshtein(a.line, b.line) <= 2),
r(line, other) AS (SELECT line, line FROM u UNION SELECT r.line, near.b FROM r JOIN near ON near.a = r.other),
place AS (SELECT line, min({{'doc_id': doc_id, 'line_no': line_no}}) AS p FROM k GROUP BY 1),
c AS (SELECT r.line, min(p) AS f FROM r JOIN place ON place.line = r.other GROUP BY 1)
SELECT doc_id, line_no, n_chars, f.doc_id AS class_doc_id, f.line_no AS class_line_no,
       f.doc_id = doc_id AND f.line_no = line_no AS kept
FROM k JOIN c ON c.line = k.line"""

_DIGEST = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * (i // 4) + 1}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31) + 1, 1)"
    for i in range(32))
OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m"""

# CRC-32 byte by byte, over its table of 256 remainders.
OP11 = rf"""
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) x(i) UNION ALL
      SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
w AS (SELECT doc_id, {lowered('run')} AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) x
      WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(2 * strlen(key) AS BIGINT), 2),
             lambda i: CAST('0x' || substr(hex(encode(key)), i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
      FROM (SELECT run, n, doc_id || ':' || run AS key FROM w) x, tab),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS len FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
      FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM v) x),
e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.len = b.len AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.rest
      UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.rest),
b AS (SELECT e.word, count(*) AS n_near, min({{'less': -other_n, 'form': encode(other)}}) AS best FROM e GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * v.n THEN decode(best.form) END AS form,
             CASE WHEN -best.less >= 5 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM f JOIN r ON r.word = f.word JOIN f z ON z.word = r.root AND z.form IS NULL"""
