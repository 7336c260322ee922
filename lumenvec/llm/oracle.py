"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lumenvec.llm.line_dedup import ALONE, WINDOW
from lumenvec.llm.quality_rules import PHRASE, SENTENCE_ENDS, Rules
from lumenvec.llm.substring import WINDOW as SPAN

R = Rules()
SQL: dict[str, str] = {}

_ENDS = SENTENCE_ENDS.replace("'", "''").replace('\\"', '"')

SQL["op10_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {R.window - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {R.window} + 2)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least({R.window}, coalesce(i - last, {R.window}))) AS n_repeat_words
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
facts AS (SELECT *, length(line) - length(translate(line, '#*$%&|<>', '')) AS sym,
                 len(regexp_extract_all(line, '(?:^|[\t\n\x0B\f\r ])[|»›•>](?:[\t\n\x0B\f\r ]|$)')) AS one,
                 regexp_replace(line, '[^\p{{L}}]+', '', 'g') AS letters
          FROM lines WHERE n > 0),
seps AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\t\n\x0B\f\r ]'), lambda x: x IN ('|', '»', '›', '•', '>'))) AS sep
         FROM facts),
judged AS (SELECT *, sym > n * {R.max_symbols} OR sep > {R.max_separators}
                  OR (length(letters) >= 12 AND letters = upper(letters) AND letters <> lower(letters))
                  OR (n < {R.short_line} AND NOT regexp_matches(line, '[{_ENDS}][\t\n\x0B\f\r ]*$'))
                  OR (n < {R.phrase_line} AND regexp_matches(lower(line), '{PHRASE}')) OR (contains(line, '{{') AND contains(line, '}}')) AS fails
           FROM seps),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
               sum(CASE WHEN fails THEN n ELSE 0 END) AS n_lost FROM judged GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id)),
v AS (SELECT *, n_words < {R.min_words} OR 100 * n_repeat_words > {R.max_repeat_pct} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_lost <= n_words * {R.max_lost} AS kept FROM v
"""

SQL["op3_line_dedup"] = rf"""
WITH lines AS (SELECT doc_id, i AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line
               FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
lined AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos,
                 len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
          FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS ({" UNION ALL ".join(f"""SELECT doc_id, pos, {k} AS k, string_agg(line, chr(10)) OVER w AS g, count(*) OVER w AS n, sum(words) OVER w AS words
        FROM lined WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)""" for k in range(1, WINDOW + 1))}),
later AS (SELECT doc_id, pos, k FROM (SELECT doc_id, pos, k, row_number() OVER (PARTITION BY k, g ORDER BY doc_id, pos) AS nth FROM runs
                                      WHERE n = k AND (k = {WINDOW} OR words >= {ALONE})) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM (SELECT doc_id, pos, unnest(range(0, k)) AS j FROM later)),
marked AS (SELECT lines.doc_id, lines.line_no, lines.line, lined.pos, gone.pos IS NOT NULL AS out
           FROM lines LEFT JOIN lined USING (doc_id, line_no) LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.pos = lined.pos)
SELECT doc_id, count(pos) AS n_lines, CAST(sum(CASE WHEN out THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT out), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op1_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {SPAN - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN} + 2)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, {SPAN}) r(k)),
one AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT one.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY one.i) AS t
         FROM one ANTI JOIN gone ON gone.doc_id = one.doc_id AND gone.i = one.i GROUP BY one.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# Unsigned CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''),
    lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

SQL["op11_conversation_trie"] = f"""
WITH turns AS (SELECT conv_id, turn, md5(length(r) || ':' || r || ':' || t) AS k, strlen(t) AS n
               FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(n ORDER BY turn NULLS FIRST, k) AS ns,
               {_CRC.format("conv_id")} % 9 AS h FROM turns GROUP BY conv_id),
seqs AS (SELECT o.conv_id, list_concat(coalesce(b.ks[1:o.h], []), o.ks[o.h + 1:]) AS ks, list_concat(coalesce(b.ns[1:o.h], []), o.ns[o.h + 1:]) AS ns
         FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
begins AS (SELECT conv_id, d, md5(array_to_string(ks[1:d], ',')) AS p, md5(array_to_string(ks[1:d - 1], ',')) AS up, ns[d] AS n, d = len(ks) AS is_end
           FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM seqs)),
nodes AS (SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(n), 0) AS n,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
          FROM begins GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
below AS (SELECT b.p, count(*) FILTER (k.p IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.n) AS saved_tokens
          FROM nodes v JOIN begins b ON b.conv_id = v.conv_id AND b.d <= v.d LEFT JOIN kids k ON k.p = v.p GROUP BY b.p)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, CASE WHEN v.d > 0 THEN u.conv_id END AS parent_conv_id, v.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below USING (p) LEFT JOIN kids USING (p) LEFT JOIN nodes u ON u.p = v.up AND u.d = v.d - 1
"""

SQL["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM s WHERE same),
r AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      WHERE p.nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""
