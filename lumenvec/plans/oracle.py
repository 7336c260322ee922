"""DuckDB SQL that computes the same results as the registered queries.

The two literal patterns below are the same text the Spark side uses
(``lumenvec.functions.text``), so both engines split identically.
"""

from __future__ import annotations

from lumenvec.functions.text import LETTER_OR_DIGIT, PRETOKEN_PATTERN, WHITE_SPACE

WS = WHITE_SPACE + "+"
EDGE = f"^{WHITE_SPACE}+|{WHITE_SPACE}+\\z"

# v2 words of every document and the 2,000-word fixture vocabulary.
V2_BASE = f"""
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(translate(coalesce(text, ''), 'Σİ', 'σi')), '{WS}'),
                             lambda x: x <> '') AS w
  FROM documents),
wfreq AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(w) AS t FROM words) GROUP BY t),
vocab AS (SELECT token, CAST(2 + row_number() OVER (ORDER BY n DESC, token) AS BIGINT) AS id FROM wfreq
          QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 2000),
specials AS (SELECT * FROM (VALUES ('[CLS]', 1::BIGINT), ('[SEP]', 2::BIGINT)) s(content, id)),
seq AS (SELECT doc_id, list_concat(['[CLS]'], w, ['[SEP]']) AS s FROM words),
long AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS pos, unnest(s) AS token FROM seq),
ids AS (SELECT l.doc_id, l.pos, l.token, CAST(coalesce(v.id, sp.id, 0) AS BIGINT) AS token_id,
               (v.id IS NOT NULL OR sp.id IS NOT NULL) AS in_vocab
        FROM long l LEFT JOIN vocab v ON v.token = l.token LEFT JOIN specials sp ON sp.content = l.token)
"""

# Mean of the fixture vectors per document and dimension, masked by ``m``.
def _pooled(mask: str) -> str:
    return f"""
tv AS (SELECT i.doc_id, d.dim, i.token_id, CAST({mask} AS DOUBLE) AS m,
              CAST(((i.token_id * 31 + d.dim * 17) % 129) - 64 AS DOUBLE) / 64.0 AS h
       FROM ids i CROSS JOIN range(0, 64) d(dim)),
pooled AS (SELECT doc_id, dim, sum(h * m) / greatest(sum(m), 1e-9) AS x FROM tv GROUP BY doc_id, dim)
"""

EMBED_STATIC = f"""
WITH {V2_BASE}, {_pooled('1')},
nrm AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM pooled GROUP BY doc_id)
SELECT p.doc_id, CAST(p.dim AS BIGINT) AS dim,
       round(CASE WHEN nrm = 0 THEN CAST('NaN' AS DOUBLE) ELSE x / nrm END, 6) AS x
FROM pooled p JOIN nrm USING (doc_id)
"""

SQL = {
    "v2_tokens": f"""
WITH {V2_BASE}
SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos, unnest(w) AS token FROM words
""",
    "v2_token_ids": f"""
WITH {V2_BASE}
SELECT doc_id, pos, token, token_id, in_vocab FROM ids
""",
    "embed_static": EMBED_STATIC,
    "masked_pool": f"""
WITH {V2_BASE}, {_pooled('i.in_vocab AND i.token_id > 2')}
SELECT doc_id, CAST(dim AS BIGINT) AS dim, x FROM pooled
""",
}

PT = PRETOKEN_PATTERN
PRE_BASE = f"""
pre AS (
  SELECT doc_id, list_transform(
           regexp_extract_all(regexp_replace(coalesce(text, ''), '{EDGE}', '', 'g'), '{PT}'),
           lambda m: CASE WHEN regexp_matches(m, '{LETTER_OR_DIGIT}') THEN '▁' || m ELSE m END) AS p
  FROM documents),
pfreq AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(p) AS t FROM pre) GROUP BY t),
ptop AS (SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS BIGINT) AS id FROM pfreq
         QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 1000),
singles AS (SELECT unnest(string_split('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')) AS c),
single_pieces AS (SELECT c AS token FROM singles UNION ALL SELECT '▁' || c FROM singles),
extra AS (SELECT token, CAST(1003 + row_number() OVER (ORDER BY token) AS BIGINT) AS id FROM single_pieces
          WHERE token NOT IN (SELECT token FROM ptop)),
pvocab AS (SELECT * FROM ptop UNION ALL SELECT * FROM extra),
pspecials AS (SELECT * FROM (VALUES ('<s>', 0::BIGINT), ('<pad>', 1::BIGINT), ('</s>', 2::BIGINT), ('<unk>', 3::BIGINT)) s(content, id)),
plong AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS pos, unnest(p) AS token FROM pre),
dt AS (SELECT DISTINCT token FROM plong),
maxlen AS (SELECT max(length(token)) AS L FROM pvocab),
st AS (SELECT token, unnest(range(0, length(token))) AS start FROM dt),
cand AS (SELECT token, start, unnest(range(1, least((SELECT L FROM maxlen), length(token) - start) + 1)) AS len FROM st),
best AS (SELECT c.token, c.start, max(CASE WHEN v.token IS NOT NULL THEN c.len ELSE 0 END) AS best
         FROM cand c LEFT JOIN pvocab v ON v.token = substring(c.token, c.start + 1, c.len) GROUP BY c.token, c.start),
seg AS (
  WITH RECURSIVE walk(token, cut, k) AS (
    SELECT token, 0, 0 FROM dt
    UNION ALL
    SELECT w.token, w.cut + greatest(b.best, 1), w.k + 1 FROM walk w JOIN best b ON b.token = w.token AND b.start = w.cut)
  SELECT w.token, CAST(w.k AS BIGINT) AS sub,
         CASE WHEN b.best > 0 THEN substring(w.token, w.cut + 1, b.best) ELSE '<unk>' END AS piece,
         CASE WHEN b.best = 0 THEN substring(w.token, w.cut + 1, 1) END AS src
  FROM walk w JOIN best b ON b.token = w.token AND b.start = w.cut),
pieces AS (
  SELECT l.doc_id, l.pos + 1 AS pos, s.sub, s.piece AS token, s.src FROM plong l JOIN seg s ON s.token = l.token
  UNION ALL SELECT doc_id, 0, 0, '<s>', NULL FROM pre
  UNION ALL SELECT doc_id, len(p) + 1, 0, '</s>', NULL FROM pre),
pids AS (SELECT x.doc_id, x.pos, x.sub, x.token, x.src, CAST(coalesce(v.id, sp.id, (SELECT id FROM pspecials WHERE content = '<unk>'), 0) AS BIGINT) AS token_id,
                (v.id IS NOT NULL OR sp.id IS NOT NULL) AND x.src IS NULL AS in_vocab
         FROM pieces x LEFT JOIN pvocab v ON v.token = x.token LEFT JOIN pspecials sp ON sp.content = x.token)
"""

def _decode(ids: str, rev: str, unk: str, bos: str = "<s>", eos: str = "</s>") -> str:
    return f"""
SELECT doc_id, regexp_replace(replace(replace(replace(
         string_agg(coalesce(r.token, '{unk}'), '' ORDER BY i.pos, i.sub), '▁', ' '), '{bos}', ''), '{eos}', ''),
         '{EDGE}', '', 'g') AS text
FROM {ids} i LEFT JOIN {rev} r ON r.id = i.token_id GROUP BY doc_id
"""


SQL.update({
    "v3_pretokens": f"WITH {PRE_BASE} SELECT doc_id, pos, token FROM plong",
    "v3_segments": f"WITH {PRE_BASE} SELECT token, sub, piece FROM seg",
    "v3_token_ids": f"WITH {PRE_BASE} SELECT doc_id, pos, sub, token, token_id, in_vocab FROM pids",
    "decode_v3": f"""WITH {PRE_BASE},
prev AS (SELECT id, token FROM pvocab UNION ALL SELECT id, content FROM pspecials)
{_decode('pids', 'prev', '<unk>')}""",
    "decode_v2": f"""WITH {V2_BASE},
rev AS (SELECT id, token FROM vocab UNION ALL SELECT id, content FROM specials),
ids2 AS (SELECT *, 0 AS sub FROM ids)
{_decode('ids2', 'rev', '<unk>')}""",
    "vocab_object": f"""WITH {V2_BASE}
SELECT token, id FROM vocab WHERE regexp_matches(token, '^\\p{{L}}+$')""",
    "vocab_array": f"""WITH {V2_BASE}
SELECT token, id - 3 AS id FROM vocab WHERE regexp_matches(token, '^\\p{{L}}+$')""",
    "task_ids": """
WITH r AS (SELECT role, count(*) AS n FROM conversations GROUP BY role),
t AS (SELECT role AS task, CAST(row_number() OVER (ORDER BY n DESC, role) - 1 AS BIGINT) AS task_id FROM r
      QUALIFY row_number() OVER (ORDER BY n DESC, role) <= 2)
SELECT c.conv_id, c.turn, c.role, t.task_id,
       CASE WHEN t.task_id IS NULL THEN 'task type ''' || coalesce(c.role, '') || ''' not found' END AS task_error,
       CAST(coalesce(t.task_id, 0) AS BIGINT) AS task_id_lenient
FROM conversations c LEFT JOIN t ON t.task = c.role""",
})

PRE_POOLED = """
ptv AS (SELECT i.doc_id, d.dim, CAST(((i.token_id * 31 + d.dim * 17) % 129) - 64 AS DOUBLE) / 64.0 + 5.0 / 8.0 AS h
        FROM pids i CROSS JOIN range(0, 64) d(dim)),
ppooled AS (SELECT doc_id, dim, sum(h) / greatest(count(*), 1e-9) AS x FROM ptv GROUP BY doc_id, dim),
pnrm AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM ppooled GROUP BY doc_id)
"""

SQL.update({
    "embed_onnx": EMBED_STATIC,
    "embed_onnx_v3": f"""WITH {PRE_BASE}, {PRE_POOLED}
SELECT p.doc_id, CAST(p.dim AS BIGINT) AS dim,
       round(CASE WHEN nrm = 0 THEN CAST('NaN' AS DOUBLE) ELSE x / nrm END, 6) AS x
FROM ppooled p JOIN pnrm USING (doc_id)""",
    "preview": f"""WITH {V2_BASE}, {_pooled('1')},
nrm AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM pooled GROUP BY doc_id)
SELECT p.doc_id, CAST(p.dim AS BIGINT) AS dim, CAST(64 AS BIGINT) AS shape,
       round(CASE WHEN nrm = 0 THEN CAST('NaN' AS DOUBLE) ELSE x / nrm END, 6) AS x
FROM pooled p JOIN nrm USING (doc_id) WHERE p.dim < 10""",
})


def _v2_embed(p: str, src: str) -> str:
    """CTEs ``{p}emb(id, dim, x)``: normalised static embedding (double) of
    ``src(id, text)``, using the ``vocab``/``specials`` of ``V2_BASE``."""
    return f"""
{p}w AS (SELECT id, list_filter(regexp_split_to_array(lower(translate(coalesce(text, ''), 'Σİ', 'σi')), '{WS}'),
                               lambda x: x <> '') AS w FROM ({src})),
{p}s AS (SELECT id, list_concat(['[CLS]'], w, ['[SEP]']) AS s FROM {p}w),
{p}l AS (SELECT id, unnest(s) AS token FROM {p}s),
{p}i AS (SELECT l.id, CAST(coalesce(v.id, sp.id, 0) AS BIGINT) AS token_id
         FROM {p}l l LEFT JOIN vocab v ON v.token = l.token LEFT JOIN specials sp ON sp.content = l.token),
{p}p AS (SELECT i.id, d.dim, avg(CAST(((i.token_id * 31 + d.dim * 17) % 129) - 64 AS DOUBLE) / 64.0) AS x
         FROM {p}i i CROSS JOIN range(0, 64) d(dim) GROUP BY i.id, d.dim),
{p}n AS (SELECT id, sqrt(sum(x * x)) AS nrm FROM {p}p GROUP BY id),
{p}emb AS (SELECT p.id, p.dim, CASE WHEN nrm = 0 THEN CAST('NaN' AS DOUBLE) ELSE x / nrm END AS x
           FROM {p}p p JOIN {p}n USING (id))
"""


DOC_EMB = _v2_embed("d", "SELECT doc_id AS id, text FROM documents")
PARITY_ROWS = f"""
WITH {V2_BASE}, {DOC_EMB},
pr AS (SELECT id AS doc_id, sum(x * CAST(CAST(x AS FLOAT) AS DOUBLE)) AS ab, sum(x * x) AS aa,
              sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * CAST(CAST(x AS FLOAT) AS DOUBLE)) AS bb,
              max(abs(x - CAST(CAST(x AS FLOAT) AS DOUBLE))) AS mad
       FROM demb GROUP BY id),
st AS (SELECT pr.*, CASE coalesce(d.lang, '') WHEN 'fr' THEN 'right_only' WHEN 'de' THEN 'left_only' ELSE 'both' END AS status
       FROM pr JOIN documents d USING (doc_id)),
rows AS (SELECT doc_id, status,
                CASE WHEN status = 'both' THEN
                  round(CASE WHEN aa * bb = 0 THEN CAST('NaN' AS DOUBLE) ELSE ab / (sqrt(aa) * sqrt(bb)) END, 6) END AS cosine,
                CASE WHEN status = 'both' THEN round(mad, 6) END AS max_abs_diff,
                CASE WHEN status = 'both' THEN mad <= 1e-5 END AS within_tol FROM st)
"""
# Every document on both sides.
PARITY_WHOLE = f"""
WITH {V2_BASE}, {DOC_EMB},
pr AS (SELECT id AS doc_id, sum(x * CAST(CAST(x AS FLOAT) AS DOUBLE)) AS ab, sum(x * x) AS aa,
              sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * CAST(CAST(x AS FLOAT) AS DOUBLE)) AS bb,
              max(abs(x - CAST(CAST(x AS FLOAT) AS DOUBLE))) AS mad
       FROM demb GROUP BY id),
rows AS (SELECT doc_id, 'both' AS status,
                round(CASE WHEN aa * bb = 0 THEN CAST('NaN' AS DOUBLE) ELSE ab / (sqrt(aa) * sqrt(bb)) END, 6) AS cosine,
                round(mad, 6) AS max_abs_diff, mad <= 1e-5 AS within_tol FROM pr)
"""


_NONE_FAILED = ", ".join(f"CAST(0 AS BIGINT) AS n_{x}_failed" for x in ("left", "right", "both"))


def _wide(ids: str, dims: int, add: str) -> str:
    """Head, size and length of static embeddings of many dimensions: the
    fixture vectors depend on id * 31 % 129 alone, so ids are counted by that."""
    return f"""
cls AS (SELECT doc_id, (token_id * 31) % 129 AS r, count(*) AS n FROM {ids} GROUP BY ALL),
tot AS (SELECT doc_id, sum(n) AS n FROM cls GROUP BY doc_id),
wp AS (SELECT doc_id, d.dim, sum(cls.n * CAST((r + d.dim * 17) % 129 - 64 AS DOUBLE) / 64.0) AS s
       FROM cls CROSS JOIN range(0, {dims}) d(dim) GROUP BY doc_id, d.dim),
wm AS (SELECT doc_id, dim, s / tot.n + {add} AS x FROM wp JOIN tot USING (doc_id)),
wn AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm, sum(x * (dim % 97 + 1)) AS ws FROM wm GROUP BY doc_id)
SELECT wm.doc_id, CAST(dim AS BIGINT) AS dim, round(CASE WHEN nrm = 0 THEN CAST('NaN' AS DOUBLE) ELSE x / nrm END, 6) AS x,
       CAST({dims} AS BIGINT) AS n_dims, CASE WHEN nrm = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1.0::DOUBLE END AS norm,
       round(CASE WHEN nrm = 0 THEN CAST('NaN' AS DOUBLE) ELSE ws / nrm END, 6) AS checksum
FROM wm JOIN wn USING (doc_id) WHERE dim < 10"""


def _rates(counts: str, by: str) -> str:
    return f"""
SELECT {by}, n_docs, n_tokens, n_unknown, round(CASE WHEN n_tokens > 0 THEN n_unknown / n_tokens END, 6) AS unknown_rate FROM {counts}"""


def _unknown_words(by: str) -> str:
    return f"""
WITH {V2_BASE},
one AS (SELECT doc_id, t IN (SELECT token FROM vocab) AS known FROM (SELECT doc_id, unnest(w) AS t FROM words)),
cnt AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (NOT known) AS n_unknown FROM one GROUP BY doc_id),
g AS (SELECT {by}, count(*) AS n_docs, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS n_tokens,
             CAST(coalesce(sum(n_unknown), 0) AS BIGINT) AS n_unknown FROM documents LEFT JOIN cnt USING (doc_id) GROUP BY ALL)
{_rates("g", by)}"""


def _unknown_pieces(by: str) -> str:
    return f"""
WITH {PRE_BASE},
g AS (SELECT {by}, count(DISTINCT i.doc_id) AS n_docs, count(*) FILTER (token NOT IN ('<s>', '</s>')) AS n_tokens,
             count(*) FILTER (token NOT IN ('<s>', '</s>') AND NOT in_vocab) AS n_unknown
      FROM pids i JOIN documents d USING (doc_id) GROUP BY ALL)
{_rates("g", by)}"""


SQL.update({
    "topk_benchmark_docs": f"""
WITH {V2_BASE}, {DOC_EMB}, {_v2_embed("b", "SELECT item_id AS id, text FROM benchmark")},
sc AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.x * d.x), 6) AS score
       FROM bemb q JOIN demb d ON q.dim = d.dim GROUP BY q.id, d.id)
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""",
    "topk_embeddings": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score
       FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""",
    "pairs": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS id_a, a.vec_id + 1 AS id_b, round(list_dot_product(a.v, b.v), 6) AS score
FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1""",
    "parity": PARITY_ROWS + " SELECT * FROM rows",
    "parity_summary": PARITY_ROWS + f"""
SELECT {_NONE_FAILED}, CAST(count(*) FILTER (status = 'both') AS BIGINT) AS n_both,
       CAST(count(*) FILTER (status = 'left_only') AS BIGINT) AS n_left_only,
       CAST(count(*) FILTER (status = 'right_only') AS BIGINT) AS n_right_only,
       min(cosine) AS min_cosine, max(max_abs_diff) AS max_abs_diff,
       round(avg(CAST(within_tol AS DOUBLE)), 6) AS share_within_tol FROM rows""",
    "parity_whole": PARITY_WHOLE + " SELECT * FROM rows",
    "parity_summary_whole": PARITY_WHOLE + f"""
SELECT {_NONE_FAILED}, count(*) AS n_both, CAST(0 AS BIGINT) AS n_left_only, CAST(0 AS BIGINT) AS n_right_only,
       min(cosine) AS min_cosine, max(max_abs_diff) AS max_abs_diff,
       round(avg(CAST(within_tol AS DOUBLE)), 6) AS share_within_tol FROM rows""",
    "oov_report": _unknown_words("lang"),
    "oov_report_source": _unknown_words("lang, source"),
    "oov_report_v3": _unknown_pieces("lang"),
    "oov_report_v3_source": _unknown_pieces("source"),
    "oov_ids": _unknown_pieces("source"),
    "oov_top": f"""
WITH {V2_BASE},
c AS (SELECT lang, t AS token, count(*) AS n FROM (SELECT d.lang, unnest(w) AS t FROM words JOIN documents d USING (doc_id))
      WHERE t NOT IN (SELECT token FROM vocab) GROUP BY lang, t)
SELECT lang, CAST(rank AS BIGINT) AS rank, token, n FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 5""",
    "anti_incremental": """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, lang FROM documents)
SELECT text_hash, count(*) AS n_docs, min(doc_id) AS first_doc_id FROM h
WHERE text_hash NOT IN (SELECT text_hash FROM h WHERE lang = 'en') GROUP BY text_hash""",
    "store_latest": f"""
WITH {V2_BASE}, {DOC_EMB},
en AS (SELECT DISTINCT text FROM documents WHERE lang = 'en')
SELECT d.doc_id, CASE WHEN d.text IN (SELECT text FROM en) THEN 'r2' ELSE 'r1' END AS run_id,
       CAST(e.dim AS BIGINT) AS dim, round(e.x, 6) AS x
FROM documents d JOIN demb e ON e.id = d.doc_id""",
    "read_requests": """
WITH c AS (SELECT *, turn = 0 AND conv_id % 5 = 0 AS cut, turn = 0 AND conv_id % 5 <> 0 AND conv_id % 7 = 0 AS num FROM conversations),
one AS (SELECT CASE WHEN cut THEN -1 ELSE conv_id END AS request_id, 0 AS idx,
               CASE WHEN NOT cut AND NOT num AND role = 'user' THEN text END AS text,
               CASE WHEN cut THEN 'invalid JSON' WHEN num THEN 'missing text'
                    WHEN role = 'user' THEN CASE WHEN text IS NULL THEN 'missing text' END
                    ELSE 'Unknown command' END AS error
        FROM c WHERE cut OR num OR role <> 'assistant' OR role IS NULL),
many AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, text,
                CASE WHEN text IS NULL THEN 'missing text' END AS error
         FROM c WHERE NOT cut AND NOT num AND role = 'assistant')
SELECT CAST(request_id AS BIGINT) AS request_id, CAST(idx AS BIGINT) AS idx, text, error FROM one
UNION ALL SELECT CAST(conv_id AS BIGINT), CAST(idx AS BIGINT), text, error FROM many""",
    "stream_embed": f"""
WITH {V2_BASE}, {DOC_EMB},
r AS (SELECT doc_id, text, doc_id // 3 AS request_id, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT CAST(r.request_id AS BIGINT) AS request_id, CAST(r.idx AS BIGINT) AS idx, CAST(e.dim AS BIGINT) AS dim, round(e.x, 6) AS x
FROM r JOIN demb e ON e.id = r.doc_id WHERE r.text IS NOT NULL""",
    "embed_static_768": f"WITH {V2_BASE}, {_wide('ids', 768, '0.0')}",
    "embed_static_1024_task": f"WITH {PRE_BASE}, {_wide('pids', 1024, '5.0 / 8.0')}",
    "v3_token_ids_max": f"""WITH {PRE_BASE},
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token IN ('<s>', '</s>') ORDER BY pos, sub) AS k FROM pids)
SELECT doc_id, pos, sub, token, token_id, in_vocab FROM nth WHERE token IN ('<s>', '</s>') OR k <= 14""",
    "special_tokens": """
WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS k FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT '<' || lang || '>' AS content, CAST(CASE WHEN k % 2 = 0 THEN k + 100 ELSE k END AS BIGINT) AS id FROM l""",
    "topk_with_errors": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label % 3 = 2),
sc AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score
       FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""",
    "oov_top_v3": f"""
WITH {PRE_BASE},
c AS (SELECT d.lang, coalesce(i.src, i.token) AS token, count(*) AS n FROM pids i JOIN documents d ON d.doc_id = i.doc_id
      WHERE NOT i.in_vocab AND i.token NOT IN ('<s>', '</s>') GROUP BY ALL)
SELECT lang, CAST(rank AS BIGINT) AS rank, token, n FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 5""",
    "latency_report": """
WITH r AS (SELECT coalesce(lang, 'none') AS runtime, doc_id AS call_time, doc_id // 16 AS call_seq, n_chars / 65536.0::DOUBLE AS t,
                  CASE WHEN doc_id % 100 = 0 THEN 0.5::DOUBLE END AS setup FROM documents WHERE n_chars IS NOT NULL),
s AS (SELECT runtime, count(*) AS rows, count(DISTINCT call_seq) AS calls, sum(t) AS total, quantile_cont(t, 0.5) AS p50,
             quantile_cont(t, 0.95) AS p95, sum(setup) AS setup_time, arg_min(t, call_time) AS first_call FROM r GROUP BY runtime)
SELECT runtime, rows, calls, first_call, round(CASE WHEN rows > 1 THEN (total - first_call) / (rows - 1) END, 6) AS later_mean,
       round(total / rows, 6) AS mean, p50, round(p95, 6) AS p95, setup_time,
       round(CASE WHEN total > 0 THEN rows / total END, 6) AS rows_per_sec FROM s""",
    "result_split": f"""
WITH {V2_BASE},
n AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (token_id > 1500) AS missing FROM ids GROUP BY doc_id)
SELECT CASE WHEN missing > 0 THEN 'error' ELSE 'good' END AS sink, doc_id,
       CASE WHEN missing = 0 THEN CAST(64 AS BIGINT) END AS dim, n_tokens,
       CASE WHEN missing > 0 THEN missing || ' token ids have no vector' END AS error FROM n""",
    "incremental_runs": """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, lang FROM documents),
en AS (SELECT DISTINCT h FROM h WHERE lang = 'en'),
k AS (SELECT (SELECT count(*) FROM en) AS a, (SELECT count(DISTINCT h) FROM h) AS b,
             (SELECT count(*) FROM h WHERE h IN (SELECT h FROM en)) AS c, (SELECT count(*) FROM h) AS d)
SELECT 1::BIGINT AS run, a AS added, c AS embedded FROM k UNION ALL SELECT 2, b - a, d FROM k UNION ALL SELECT 3, 0, d FROM k""",
    "latency_job": """
SELECT unnest(['words64', 'words768']) AS runtime, (SELECT count(*) FROM documents) AS rows,
       true AS calls_ok, true AS quantiles_ok, true AS sketch_ok, true AS rate_ok""",
    "embed_static_1024_blocks": f"WITH {PRE_BASE}, {_wide('pids', 1024, '5.0 / 8.0')}",
    "store_compact": f"""
WITH {V2_BASE}, {DOC_EMB},
h AS (SELECT sha256(coalesce(text, '')) AS h, lang FROM documents),
k AS (SELECT count(DISTINCT h) AS stored, count(DISTINCT h) FILTER (lang = 'en') AS en FROM h),
s AS (SELECT id AS doc_id, count(*) AS dim, round(sum(x * (dim + 1)), 6) AS checksum FROM demb GROUP BY id),
n AS (SELECT doc_id, count(*) AS n_tokens FROM ids GROUP BY doc_id)
SELECT doc_id, dim, n_tokens, checksum, 2::BIGINT AS runs, stored, en * 2 AS errors FROM s JOIN n USING (doc_id), k""",
    "stream_store": f"""
WITH {V2_BASE}, {DOC_EMB},
s AS (SELECT id AS doc_id, round(sum(x * (dim + 1)), 6) AS checksum FROM demb GROUP BY id),
n AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (token_id > 1500) AS missing FROM ids GROUP BY doc_id),
r AS (SELECT doc_id, doc_id // 3 AS request_id, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) - 1 AS idx FROM documents),
a AS (SELECT * FROM r JOIN s USING (doc_id) JOIN n USING (doc_id) WHERE request_id % 7 <> 0)
SELECT CASE WHEN missing > 0 THEN 'error' ELSE 'result' END AS sink, request_id, idx, CASE WHEN missing = 0 THEN n_tokens END AS n_tokens,
       CASE WHEN missing = 0 THEN checksum END AS checksum, CASE WHEN missing > 0 THEN missing || ' token ids have no vector' END AS error FROM a
UNION ALL SELECT DISTINCT 'error', request_id, 0, NULL, NULL, 'Unknown command' FROM r WHERE request_id % 7 = 0""",
})
SQL["topk_pruned"] = SQL["topk_codes"] = SQL["topk_embeddings"]
SQL["oov_top_summarised"] = SQL["oov_top"]
