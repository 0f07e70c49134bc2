"""DuckDB SQL for the operators that SQL can express in full."""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[i:least(i + 12, len(w))] AS g FROM bw, unnest(range(1, greatest(1, len(w) - 12) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
occ AS (SELECT doc_id, i AS s, n, w[i:i + n - 1] AS g FROM dw, lens, unnest(range(1, len(w) - n + 2)) t(i)),
m AS (SELECT doc_id, s, n, item_id FROM occ JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: By definition: a line goes if it lies in a run of equal lines, 50 words or more, that stands at an earlier place as well.
LINE_DEDUP = r"""
WITH raw AS (SELECT doc_id, i, trim(l[i], E' \t\r' || chr(11) || chr(12) || chr(160) || chr(12288)) AS line, l[i] AS whole FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents), unnest(range(1, len(l) + 1)) t(i)),
lines AS (SELECT doc_id, i, line, len(string_split(regexp_replace(translate(line, E'\t\r' || chr(11) || chr(12) || chr(160) || chr(12288), '      '), ' +', ' ', 'g'), ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM raw WHERE line <> ''),
pairs AS (SELECT a.doc_id AS d, a.pos AS p, a.words, b.doc_id AS e, b.pos - a.pos AS shift FROM lines a JOIN lines b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, shift ORDER BY p) AS island FROM pairs),
long AS (SELECT d, e, shift, island FROM runs GROUP BY ALL HAVING sum(words) >= 50),
dead AS (SELECT DISTINCT d AS doc_id, p AS pos FROM runs JOIN long USING (d, e, shift, island)),
marked AS (SELECT r.doc_id, r.i, r.whole, l.pos, dead.pos IS NOT NULL AS gone FROM raw r LEFT JOIN lines l ON r.doc_id = l.doc_id AND r.i = l.i LEFT JOIN dead ON dead.doc_id = l.doc_id AND dead.pos = l.pos),
near AS (SELECT *, last_value(CASE WHEN pos IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS before,
 first_value(CASE WHEN pos IS NOT NULL THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM marked),
cut AS (SELECT doc_id, count(pos) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
 string_agg(whole, E'\n' ORDER BY i) FILTER (WHERE NOT (gone OR pos IS NULL AND coalesce(before, false) AND coalesce(after, false))) AS kept FROM near GROUP BY doc_id),
out AS (SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN coalesce(n_removed, 0) = 0 THEN text WHEN n_removed = n_lines THEN '' ELSE kept END AS text FROM documents LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM out
"""
