"""DuckDB SQL that gives the rows of the registered queries, written without regard to scale."""

from __future__ import annotations

from reckon.llm import chat_format, filter_audit, quality, source_audit, url_filter

#: op7: windows of 13 words, the first document of each, and the words that a later one loses.
SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
 first AS (SELECT k, min(doc_id) AS owner FROM win GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN first USING (k), range(13) AS t(j) WHERE owner < doc_id),
 each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
 lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

#: op3: windows of 10 item words (or the whole of a shorter item) in the words of the documents.
CONTAMINATION = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + 9], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM items WHERE len(ws) > 0)),
 sizes AS (SELECT DISTINCT size FROM win),
 own AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM low, sizes)),
 hit AS (SELECT doc_id, item_id, i, size FROM own JOIN win USING (size, k)),
 words AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, range(10) AS t(j) WHERE j < size GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT low.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: op8: shared shingles of all pairs of documents, links, and the least reachable id.
NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
 edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
 least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""

#: op6: digests in base 32 (five hexadecimal digits make four characters) and the first page of each payload.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
 groups AS (SELECT DISTINCT h, g, list_sum([(strpos('0123456789abcdef', substr(h, 5 * g + d + 1, 1)) - 1) * (16 ** (4 - d)) for d in range(5)])::BIGINT AS v FROM p, range(8) AS t(g)),
 digest AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1)
   || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1), '' ORDER BY g) AS d FROM groups GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html) JOIN digest USING (h)
"""

#: op2: windows of 50 bytes (100 hexadecimal digits), the first document of each, and the bytes that a later one loses.
SUFFIX = r"""
WITH b AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
 win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM b)),
 first AS (SELECT hash(k) AS k, min(doc_id) AS owner FROM win GROUP BY ALL),
 hit AS (SELECT doc_id, i FROM win JOIN first ON hash(win.k) = first.k WHERE owner < doc_id),
 runs AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50)::INT AS new FROM hit)) GROUP BY doc_id, g),
 cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS start FROM runs),
 pieces AS (SELECT doc_id, string_agg(substr(h, 2 * start - 1, 2 * (a - start)), '' ORDER BY a) || substr(h, 2 * max(z) + 1) AS kept, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM cuts JOIN b USING (doc_id) GROUP BY doc_id, h)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN pieces USING (doc_id)
"""

#: op5: the base measures, and both distances from histograms summed by language, the nearest one where there is none.
QUALITY = rf"""
WITH d AS (SELECT doc_id, CASE WHEN lower(trim(lang)) NOT IN {quality.NO_LANGUAGE} THEN lang END AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 m AS (SELECT *, len(ws) AS n, length(array_to_string(ws, '')) AS c, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols,
   length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS upper_, length(regexp_replace(t, '\P{{N}}', '', 'g')) AS digit_, length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]', '', 'g')) AS mark_ FROM d),
 lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS times FROM (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
 twice AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win, range(3) AS t(j) WHERE times > 1 GROUP BY doc_id),
 common(b) AS (VALUES {", ".join(f"('{w}')" for w in quality.COMMON)}),
 bins AS (SELECT b FROM common UNION ALL SELECT ''),
 counts AS (SELECT doc_id, CASE WHEN w IN (SELECT b FROM common) THEN w ELSE '' END AS b, count(*) AS v FROM (SELECT doc_id, lower(unnest(ws)) AS w FROM d) GROUP BY ALL),
 hist AS (SELECT 'words' AS kind, m.doc_id, m.lang, bins.b, coalesce(v, 0) AS v FROM m CROSS JOIN bins LEFT JOIN counts ON counts.doc_id = m.doc_id AND counts.b = bins.b
   UNION ALL SELECT 'classes', doc_id, lang, unnest(['lower', 'upper', 'digit', 'mark', 'space']), unnest([c - upper_ - digit_ - mark_, upper_, digit_, mark_, length(t) - c]) FROM m),
 ref AS (SELECT kind, lang AS l, b, sum(v) AS q FROM hist WHERE lang IS NOT NULL GROUP BY ALL),
 pairs AS (SELECT h.kind, h.doc_id, l, v, q, sum(v) OVER w AS vs, sum(q) OVER w AS qs FROM hist h JOIN ref r ON r.kind = h.kind AND r.b = h.b AND (h.lang IS NULL OR r.l = h.lang) WINDOW w AS (PARTITION BY h.kind, h.doc_id, l)),
 terms AS (SELECT kind, doc_id, l, CASE WHEN vs > 0 AND qs > 0 THEN v / vs ELSE 0 END AS p, CASE WHEN vs > 0 AND qs > 0 THEN q / qs ELSE 0 END AS q FROM pairs),
 each AS (SELECT doc_id, l, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS x FROM terms GROUP BY ALL),
 both_ AS (SELECT doc_id, l, max(x) FILTER (kind = 'words') AS words, max(x) FILTER (kind = 'classes') AS classes FROM each GROUP BY ALL),
 size_ AS (SELECT l, sum(q) AS refs FROM ref WHERE kind = 'words' GROUP BY l),
 near AS (SELECT doc_id, words, classes, refs FROM both_ JOIN size_ USING (l) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words, classes) = 1),
 out AS (SELECT m.doc_id, m.n, c, symbols, coalesce(lines.n, 0) AS dup, coalesce(twice.n, 0) AS rep, coalesce(near.classes, 0) AS classes, coalesce(near.words, 0) AS words, greatest(coalesce(refs, 0) - CASE WHEN m.lang IS NULL THEN 0 ELSE m.n END, 0) AS o
   FROM m LEFT JOIN lines USING (doc_id) LEFT JOIN twice USING (doc_id) LEFT JOIN near USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, c::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, n < {quality.LEAST_WORDS} OR 100 * rep > 50 * n AS base_failed,
 NOT (n < {quality.LEAST_WORDS} OR 100 * rep > 50 * n OR (n >= {quality.GUARD_CLASSES} AND classes * o > {quality.FAR_CLASSES} * (o + {quality.DOUBT})) OR (n >= {quality.GUARD_WORDS} AND words * o > {quality.FAR_WORDS} * (o + {quality.DOUBT}))) AS kept
FROM out
"""

#: op10: turns and targets straight from the table; the formatted length from the windows' turns.
CHAT = rf"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
 t AS (SELECT *, (ceil(length(text) / 4.0) + 4)::BIGINT AS n, row_number() OVER w AS place, sum(ceil(length(text) / 4.0) + 4) OVER w AS upto,
   12 + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), '<|n|>')) + 1 + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 11 AS size
   FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 system AS (SELECT conv_id, size, n FROM t WHERE place = 1 AND role = 'system'),
 cells AS (SELECT t.*, greatest({chat_format.BUDGET - chat_format.HISTORY} - coalesce(s.n, 0), 1) AS stride FROM t LEFT JOIN system s USING (conv_id)),
 starts AS (SELECT *, floor((upto - n) / stride) AS cell, min(upto - n) OVER (PARTITION BY conv_id, floor((upto - n) / stride)) AS start FROM cells),
 spans AS (SELECT *, CASE WHEN upto > (cell + 1) * stride AND upto - start > stride THEN upto - n ELSE start END AS win FROM starts),
 ends AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, win) AS e, max(upto) OVER (PARTITION BY conv_id) AS total FROM spans),
 rows_ AS (SELECT conv_id, win, size FROM ends
   UNION ALL SELECT conv_id, e, size FROM ends WHERE e - upto + n <= {chat_format.HISTORY} AND e < total AND NOT (place = 1 AND role = 'system')),
 windows AS (SELECT conv_id, win, sum(size) AS chars, win > 0 AS later FROM rows_ GROUP BY ALL),
 length_ AS (SELECT w.conv_id, sum(chars + CASE WHEN later THEN coalesce(s.size, 0) ELSE 0 END) AS chars FROM windows w LEFT JOIN system s ON s.conv_id = w.conv_id GROUP BY ALL),
 all_ AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM all_ JOIN length_ USING (conv_id)
"""

ORACLE: dict[str, str] = {
    "op2_suffix_array_dedup": SUFFIX,
    "op3_benchmark_decontamination": CONTAMINATION,
    "op5_quality_rules": QUALITY,
    "op6_warc_bundles": WARC,
    "op7_substring_dedup": SUBSTRING,
    "op8_minhash_near_dedup": NEAR,
    "op9_url_filters": url_filter.ORACLE,
    "op10_chat_formatting": CHAT,
    "op11_filter_interaction_audit": filter_audit.ORACLE,
    "op12_source_divergence_audit": source_audit.ORACLE,
}
