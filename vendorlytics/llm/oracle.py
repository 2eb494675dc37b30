"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op6_warc"] = """
WITH page AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
ranked AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM page)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> smallest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> smallest THEN smallest END AS refers_to
FROM ranked
"""

_WORD4 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op4_decontaminate"] = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD4}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD4}') AS w FROM benchmark),
item_run AS (
    SELECT item_id, least(len(w), 13) AS n,
           unnest(list_transform(range(0, greatest(len(w) - 12, 1)), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS run
    FROM item WHERE len(w) > 0),
width AS (SELECT DISTINCT n FROM item_run),
doc_run AS (
    SELECT doc_id, n, unnest(list_transform(range(0, len(w) - n + 1),
                                            lambda i: {{'begins': i, 'run': array_to_string(w[i + 1:i + n], ' ')}})) AS x
    FROM doc, width WHERE len(w) >= n),
hit AS (
    SELECT d.doc_id, d.x.begins AS begins, d.n, i.item_id FROM doc_run d JOIN item_run i ON d.x.run = i.run AND d.n = i.n),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
        SELECT DISTINCT doc_id, unnest(range(begins, begins + n)) AS p FROM hit) GROUP BY 1),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_WORD5 = r"[^\x20\x09-\x0D]+"

ORACLE["op5_passages"] = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD5}') AS w FROM documents),
win AS (
    SELECT doc_id, unnest(list_transform(range(0, len(w) - 19), lambda i: {{'begins': i, 'run': array_to_string(w[i + 1:i + 20], ' ')}})) AS x
    FROM doc WHERE len(w) >= 20),
placed AS (
    SELECT doc_id, x.begins AS begins,
           row_number() OVER (PARTITION BY x.run ORDER BY doc_id, x.begins) AS turn FROM win),
gone AS (
    SELECT doc_id, list(DISTINCT p) AS ps FROM (
        SELECT DISTINCT doc_id, unnest(range(begins, begins + 20)) AS p FROM placed WHERE turn > 1) GROUP BY 1),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM doc),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS d, unnest(ps) AS q FROM gone) g WHERE g.d = word.doc_id AND g.q = word.p)
    GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TERM13 = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op13_divergence"] = f"""
WITH doc AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all({_LOWER}, '{_TERM13}') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM doc),
tok AS (SELECT d, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY 1),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
own AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY 1, 2),
share AS (
    SELECT lang, source, term, total, coalesce(c, 0)::HUGEINT AS c,
           1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (own.n + v) AS p,
           1 + (1000000000::HUGEINT * (total + 1)) // (size.n + v) AS q
    FROM grp JOIN kept USING (lang) JOIN size USING (lang) JOIN own USING (lang, source) LEFT JOIN cnt USING (lang, source, term)),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
    FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    UNION ALL
    SELECT a.lang, a.source, 'pair', b.source, 0 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    WHERE a.lang NOT IN (SELECT lang FROM size)),
more AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
    FROM share WHERE c > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
