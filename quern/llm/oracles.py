"""SQL (DuckDB) for the rows of those corpus queries that SQL can express."""

from __future__ import annotations

import math

from quern.llm import licenses
from quern.llm.textual import WIDTH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the column text.
WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Shingle sets, links between any two rows that share a shingle, and their closure.
OP3 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sized AS (SELECT doc_id, w, least(len(w), {WIDTH}) AS k FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM sized, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach ON d.doc_id = reach.doc_id LEFT JOIN sizes ON d.doc_id = sizes.doc_id GROUP BY d.doc_id
"""

_NIBBLE = "(instr('0123456789abcdef', substr(sha, {at}, 1)) - 1)"
_FIRST, _SECOND = _NIBBLE.format(at="1 + (5 * i) // 4"), _NIBBLE.format(at="2 + (5 * i) // 4")
#: Each letter of base32 is five bits, which lie in two hexadecimal digits.
_BASE32 = f"list_aggregate(list_transform(range(32), lambda i: substr('{_UPPER}234567', 1 + ((({_FIRST} * 16 + {_SECOND}) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), 'string_agg', '')"
OP9 = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
known AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM known
"""

OP10 = f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, least(len(w), {WIDTH}) AS k FROM items WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS t(i)),
sizes AS (SELECT item_id, count(*) AS n FROM wanted GROUP BY item_id),
words AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
there AS (SELECT DISTINCT rid, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM words, (SELECT DISTINCT k FROM wanted) widths, unnest(range(1, len(w) - k + 2)) AS t(i)),
shared AS (SELECT rid, doc_id, item_id, count(*) AS shared FROM there JOIN wanted USING (k, s) GROUP BY rid, doc_id, item_id)
SELECT doc_id, item_id, shared, n AS n_shingles FROM shared JOIN sizes USING (item_id) WHERE 100 * shared >= 80 * n
"""


def op8() -> str:
    """The licence scan over documents, with the path that the query makes."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    notices = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.NOTICES)
    header, size = quoted(licenses.HEADER), float(len(licenses.NOTICES))
    terms = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
    count = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> ''))"
    parts = lambda cut: f"list_transform(list_filter(regexp_split_to_array(text, '{cut}'), lambda x: regexp_matches(x, {header})), lambda x: trim(x))"
    least, share, name = licenses.LEAST, licenses.FILE_SHARE, quoted(licenses.FILE_NAME)
    return rf"""
WITH notices(licence, notice) AS (VALUES {notices}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), (doc_id // 512)::VARCHAR, doc_id::VARCHAR) AS path FROM documents),
heads AS (SELECT rid, text, {parts(r'\r\n|\r|\n')} AS lines, {parts(r'(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)')} AS paragraphs
  FROM docs WHERE text IS NOT NULL AND (regexp_matches(text, {header}) OR regexp_matches(path, {name}))),
shares AS (SELECT rid, coalesce(list_sum(list_transform(lines, lambda x: {count('x')})), 0) / greatest({count('text')}, 1) AS share FROM heads),
found AS (SELECT term, count(*) AS found FROM (SELECT DISTINCT rid, unnest({terms('line')}) AS term FROM (SELECT rid, unnest(lines) AS line FROM heads)) GROUP BY term),
own AS (SELECT term, count(*) AS own FROM (SELECT DISTINCT notice, unnest({terms('notice')}) AS term FROM notices) GROUP BY term),
weights AS (SELECT term, ln({2 * size + 1} / (coalesce(own, 0) + coalesce(found, 0) / (SELECT greatest(count(*), 1) FROM heads) * {size} + 1)) + 1 AS idf FROM found FULL JOIN own USING (term)),
given AS (SELECT licence, notice, term, count(*) * any_value(idf) AS w FROM (SELECT licence, notice, unnest({terms('notice')}) AS term FROM notices) JOIN weights USING (term) GROUP BY ALL),
vectors AS (SELECT licence, notice, term, w / sqrt(sum(w * w) OVER (PARTITION BY notice)) AS tw FROM given),
blocks AS (SELECT DISTINCT rid, block, block = trim(text) AS whole FROM (SELECT rid, text, unnest(list_concat(lines, paragraphs, [trim(text)])) AS block FROM heads)),
weighed AS (SELECT block, term, count(*) * coalesce(any_value(idf), {math.log(2 * size + 1) + 1}) AS w
  FROM (SELECT block, unnest({terms('block')}) AS term FROM (SELECT DISTINCT block FROM blocks)) LEFT JOIN weights USING (term) GROUP BY block, term),
lengths AS (SELECT block, sqrt(sum(w * w)) AS length FROM weighed GROUP BY block),
scored AS (SELECT block, licence, round(sum(w * tw) / any_value(length), 6) AS score FROM weighed JOIN vectors USING (term) JOIN lengths USING (block) GROUP BY block, licence, notice),
matched AS (SELECT block, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score FROM scored WHERE score >= {least} GROUP BY block),
best AS (SELECT rid, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score, bool_or(whole) AS whole FROM blocks JOIN matched USING (block) GROUP BY rid),
placed AS (SELECT doc_id, path, licence, score, whole, share, regexp_replace(path, '/[^/]*$', '') AS dir FROM docs LEFT JOIN best USING (rid) LEFT JOIN shares USING (rid)),
chosen AS (SELECT dir AS above, first(licence ORDER BY score DESC, licence, path) AS licence, max(score) AS score FROM placed
  WHERE licence IS NOT NULL AND (whole OR share >= {share} OR regexp_matches(path, {name})) GROUP BY dir),
reach AS (SELECT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS above FROM (SELECT DISTINCT dir FROM placed), unnest(range(0, len(string_split(dir, '/')) + 1)) AS t(k)),
nearest AS (SELECT dir, first(above ORDER BY length(above) DESC) AS above, first(licence ORDER BY length(above) DESC) AS licence, first(score ORDER BY length(above) DESC) AS score FROM reach JOIN chosen USING (above) GROUP BY dir)
SELECT doc_id, path, coalesce(p.licence, n.licence) AS licence, coalesce(p.score, n.score) AS score,
CASE WHEN p.licence IS NOT NULL THEN 'header' WHEN n.licence IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN p.licence IS NULL THEN above END AS inherited_from
FROM placed p LEFT JOIN nearest n USING (dir)
"""


OP8 = op8()
