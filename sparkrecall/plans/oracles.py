"""DuckDB SQL for every registered query (the correctness oracle). Written
independently of the Spark plans, over the same parquet tables."""

from __future__ import annotations

# White space of Unicode, and what is neither a letter, number or underscore nor white space.
_WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
W = f"[{_WS}]+"
NON_WORD = rf"[^\p{{L}}\p{{N}}_{_WS}]"
STRIDE = 1 << 20


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{W}|{W}$', '', 'g')"


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{W}'), lambda t: t <> '')"


CHUNKS_CTE = f"""
d AS (SELECT doc_id AS pos, {_strip('text')} AS text FROM documents),
u AS (SELECT text, min(pos) AS doc_pos FROM d WHERE length(text) > 0 AND length(text) >= 20 GROUP BY text),
w AS (SELECT doc_pos, text, {_split('text')} AS words FROM u),
c AS (SELECT doc_pos, CASE WHEN len(words) <= 120 THEN [text]
        ELSE list_transform(range(0, CAST(ceil((len(words) - 120) / 90) AS BIGINT) + 1),
                            lambda i: array_to_string(words[i * 90 + 1 : i * 90 + 120], ' ')) END AS chunks
      FROM w),
e AS (SELECT doc_pos, unnest(range(len(chunks))) AS chunk_no, unnest(chunks) AS text FROM c),
cu AS (SELECT text, min(doc_pos * {STRIDE} + chunk_no) AS chunk_id FROM e GROUP BY text),
chunks AS (SELECT chunk_id, chunk_id // {STRIDE} AS doc_pos, CAST(chunk_id % {STRIDE} AS INTEGER) AS chunk_no, text
           FROM cu)"""

BM25_CTE = f"""
toks AS (SELECT chunk_id, {_split('lower(text)')} AS toks FROM chunks),
docs AS (SELECT chunk_id, len(toks) AS dl FROM toks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM toks) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
raw AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw2 AS (SELECT term, df, ln((SELECT n FROM st) - df + 0.5) - ln(df + 0.5) AS raw_idf FROM raw),
terms AS (SELECT term, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw2) ELSE raw_idf END AS idf
          FROM raw2),
post AS (SELECT tf.term, tf.chunk_id,
                idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st))) AS w
         FROM tf JOIN terms USING (term) JOIN docs USING (chunk_id))"""


def _bench_terms() -> str:
    return (f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, "
            f"unnest({_split('lower(text)')}) AS term FROM benchmark) GROUP BY ALL)")


ORACLES: dict[str, str] = {}

ORACLES["corpus_chunks"] = f"WITH {CHUNKS_CTE} SELECT chunk_id, doc_pos, chunk_no, text FROM chunks"

ORACLES["corpus_stats"] = f"""WITH {CHUNKS_CTE}
SELECT (SELECT count(*) FROM u) AS documents_before_chunking, (SELECT count(*) FROM chunks) AS chunk_count"""

ORACLES["bm25_top3"] = f"""WITH {CHUNKS_CTE}, {BM25_CTE}, {_bench_terms()},
sc AS (SELECT query_id, chunk_id, sum(qtf * w) AS score FROM qt JOIN post USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 3"""


def _hash_units(src: str, id_col: str, text_col: str, name: str) -> str:
    """CTEs <name>_u(id, b, u) (unit hashed vector entries) and <name>_n(id, n2)."""
    return f"""
{name}_t AS (SELECT {id_col} AS id, unnest({_split(f'lower({text_col})')}) AS tok FROM {src}),
{name}_v AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS b,
                    sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v
             FROM {name}_t GROUP BY ALL),
{name}_nr AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}_v GROUP BY id),
{name}_u AS (SELECT id, b, v / n AS u FROM {name}_v JOIN {name}_nr USING (id) WHERE n > 0),
{name}_n AS (SELECT {id_col} AS id, coalesce((SELECT sum(u * u) FROM {name}_u x WHERE x.id = s.{id_col}), 0) AS n2
             FROM {src} s)"""


DENSE_CTE = f"""{_hash_units('chunks', 'chunk_id', 'text', 'cv')},
{_hash_units('benchmark', 'item_id', 'text', 'qv')},
dots AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.u * c.u) AS ip FROM qv_u q JOIN cv_u c USING (b) GROUP BY ALL),
dist AS (SELECT qn.id AS query_id, cn.id AS chunk_id,
                greatest(qn.n2 + cn.n2 - 2 * coalesce(d.ip, 0), 0) AS dist
         FROM qv_n qn CROSS JOIN cv_n cn LEFT JOIN dots d ON d.query_id = qn.id AND d.chunk_id = cn.id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), chunk_id) AS rank FROM dist)"""

ORACLES["dense_top6"] = f"""WITH {CHUNKS_CTE}, {DENSE_CTE}
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(dist, 6) AS dist FROM dense WHERE rank <= 6"""

HYBRID_CTE = f"""{CHUNKS_CTE}, {BM25_CTE}, {_bench_terms()}, {DENSE_CTE},
bm AS (SELECT query_id, chunk_id, sum(qtf * w) AS s FROM qt JOIN post USING (term) GROUP BY ALL),
bmn AS (SELECT query_id, chunk_id, CASE WHEN max(s) OVER (PARTITION BY query_id) > 0
                                         THEN s / max(s) OVER (PARTITION BY query_id) ELSE s END AS b FROM bm),
dn AS (SELECT query_id, chunk_id, 1.0 / (1.0 + dist) AS s FROM dense WHERE rank <= 6),
dnn AS (SELECT query_id, chunk_id, s / max(s) OVER (PARTITION BY query_id) AS d FROM dn),
allq AS (SELECT item_id AS query_id FROM benchmark),
scored AS (SELECT q.query_id, c.chunk_id, 0.5 * coalesce(b.b, 0) + 0.5 * coalesce(d.d, 0) AS score
           FROM allq q CROSS JOIN chunks c
           LEFT JOIN bmn b ON b.query_id = q.query_id AND b.chunk_id = c.chunk_id
           LEFT JOIN dnn d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)"""

ORACLES["hybrid_top3"] = f"""WITH {HYBRID_CTE}
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 3"""

EMB_CTE = """
ev AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS vec_id, b.vec_id AS nn_id,
                 list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
          FROM ev a JOIN ev b ON a.vec_id <> b.vec_id)"""

ORACLES["knn_embeddings"] = f"""WITH {EMB_CTE},
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn_id) AS rank FROM pairs)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, nn_id, round(dist, 6) AS dist FROM rk WHERE rank <= 5"""


ROUTING_CTE = """
ev AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
nv AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM ev),
un AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn,
              CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE list_transform(v, lambda x: x * 0) END AS u
       FROM nv),
sims AS MATERIALIZED (SELECT a.rn AS i, b.rn AS j,
                             list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) AS sim
                      FROM un a JOIN un b ON b.rn < a.rn),
edges AS MATERIALIZED (SELECT i, list(j) AS js FROM sims WHERE sim >= {t} GROUP BY i),
walk(rn, stored) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1,
         CASE WHEN len(list_intersect(coalesce(e.js, CAST([] AS BIGINT[])), w.stored)) > 0 THEN w.stored
              ELSE list_append(w.stored, w.rn + 1) END
  FROM walk w LEFT JOIN edges e ON e.i = w.rn + 1
  WHERE w.rn < (SELECT count(*) FROM un)),
fin AS (SELECT stored FROM walk ORDER BY rn DESC LIMIT 1),
st AS (SELECT unnest(stored) AS j, unnest(range(len(stored))) AS memory_id FROM fin),
best AS (SELECT s.i, s.j, s.sim, row_number() OVER (PARTITION BY s.i ORDER BY round(s.sim, 9) DESC, s.j) AS r
         FROM sims s JOIN st ON st.j = s.j)"""

ORACLES["routing_embeddings"] = "WITH RECURSIVE " + ROUTING_CTE.format(t=0.35) + """
SELECT un.vec_id, CASE WHEN b.sim >= 0.35 THEN 'memory' ELSE 'retrieval' END AS source,
       m.memory_id, round(coalesce(b.sim, 0), 6) AS confidence, own.memory_id AS stored_id
FROM un LEFT JOIN best b ON b.i = un.rn AND b.r = 1
        LEFT JOIN st m ON m.j = b.j
        LEFT JOIN st own ON own.j = un.rn"""


def _ntok(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '{NON_WORD}', ' ', 'g'), "
            f"'{W}'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


def _grams(tokcol: str, n: int) -> str:
    return (f"CASE WHEN len({tokcol}) >= {n} THEN list_transform(range(1, len({tokcol}) - {n} + 2), "
            f"lambda i: array_to_string({tokcol}[i : i + {n - 1}], ' ')) ELSE [] END")


def _ngram_counts(name: str, tokcol: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT conv_id, turn, {n} AS n, unnest({_grams(tokcol, n)}) AS gram FROM nt" for n in range(1, 5))
    return f"{name} AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM ({parts}) GROUP BY ALL)"


# Scores of pairs(conv_id, turn, pred, gold).
SCORE_CTE = f"""
nt AS (SELECT conv_id, turn, {_ntok('pred')} AS pt, {_ntok('gold')} AS gt FROM pairs),
nn AS (SELECT conv_id, turn, pt, gt, array_to_string(pt, ' ') AS pn, array_to_string(gt, ' ') AS gn FROM nt),
pc AS (SELECT conv_id, turn, tok, count(*) AS cp FROM (SELECT conv_id, turn, unnest(pt) AS tok FROM nt) GROUP BY ALL),
gc AS (SELECT conv_id, turn, tok, count(*) AS cg FROM (SELECT conv_id, turn, unnest(gt) AS tok FROM nt) GROUP BY ALL),
same AS (SELECT conv_id, turn, sum(least(cp, cg)) AS same FROM pc JOIN gc USING (conv_id, turn, tok) GROUP BY ALL),
{_ngram_counts('hg', 'pt')},
{_ngram_counts('rg', 'gt')},
clip AS (SELECT h.conv_id, h.turn, h.n, sum(least(h.c, coalesce(r.c, 0))) AS m
         FROM hg h LEFT JOIN rg r ON r.conv_id = h.conv_id AND r.turn = h.turn AND r.n = h.n AND r.gram = h.gram
         GROUP BY ALL),
mm AS (SELECT conv_id, turn,
              coalesce(sum(m) FILTER (WHERE n = 1), 0) AS m1, coalesce(sum(m) FILTER (WHERE n = 2), 0) AS m2,
              coalesce(sum(m) FILTER (WHERE n = 3), 0) AS m3, coalesce(sum(m) FILTER (WHERE n = 4), 0) AS m4
       FROM clip GROUP BY ALL),
j AS (SELECT nn.*, coalesce(s.same, 0) AS same, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2,
             coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4, len(pt) AS c, len(gt) AS r
      FROM nn LEFT JOIN same s USING (conv_id, turn) LEFT JOIN mm USING (conv_id, turn)),
scores AS (SELECT conv_id, turn,
       CAST(CASE WHEN pn = gn THEN 1.0 ELSE 0.0 END AS DOUBLE) AS em,
       round(CASE WHEN c = 0 OR r = 0 OR same = 0 THEN 0.0
                  ELSE 2 * (same / c) * (same / r) / (same / c + same / r) END, 6) AS f1,
       round(CASE WHEN c = 0 OR r = 0 OR m1 = 0 THEN 0.0
             ELSE (CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END) * exp((
                 ln(CASE WHEN m1 > 0 THEN m1 ELSE 0.1 END / greatest(1, c))
               + ln(CASE WHEN m2 > 0 THEN m2 ELSE 0.1 END / greatest(1, c - 1))
               + ln(CASE WHEN m3 > 0 THEN m3 ELSE 0.1 END / greatest(1, c - 2))
               + ln(CASE WHEN m4 > 0 THEN m4 ELSE 0.1 END / greatest(1, c - 3))) / 4) END, 6) AS bleu,
       (gn <> '' AND contains(pn, gn)) AS answer_contains_gold
FROM j)"""

ORACLES["answer_scores"] = f"""WITH
pairs AS (SELECT a.conv_id, a.turn, a.text AS pred, b.text AS gold
          FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
          WHERE a.role = 'assistant'),
{SCORE_CTE}
SELECT * FROM scores"""


def _rtok(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


# Longest common subsequence by its table, one row of it per step: the best so far up to
# each gold token is the running maximum of "diagonal + 1 on a match, else the value above".
ROUGE_CTE = f"""
rp AS (SELECT conv_id, turn, {_rtok('pred')} AS p, {_rtok('gold')} AS g FROM pairs),
lcs_walk(conv_id, turn, p, g, i, best) AS (
  SELECT conv_id, turn, p, g, 0, list_transform(range(0, len(g) + 1), lambda j: CAST(0 AS BIGINT)) FROM rp
  UNION ALL
  SELECT conv_id, turn, p, g, i + 1, list_transform(range(1, len(g) + 2), lambda j: list_max(
      list_transform(range(1, j + 1), lambda l: CASE WHEN l > 1 AND g[l - 1] = p[i + 1] THEN best[l - 1] + 1 ELSE best[l] END)))
  FROM lcs_walk WHERE i < len(p)),
lcs AS (SELECT conv_id, turn, len(p) AS np, len(g) AS ng, best[len(g) + 1] AS n FROM lcs_walk WHERE i = len(p)),
rouge AS (SELECT conv_id, turn, round(CASE WHEN np = 0 OR ng = 0 OR n = 0 THEN 0.0
                                           ELSE 2 * (n / np) * (n / ng) / (n / np + n / ng) END, 6) AS rouge_l FROM lcs)"""

ORACLES["rouge_l_scores"] = f"""WITH RECURSIVE
pairs AS (SELECT a.conv_id, a.turn, a.text AS pred, b.text AS gold
          FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
          WHERE a.role = 'assistant'),
{ROUGE_CTE}
SELECT * FROM rouge"""


def _norm(x: str) -> str:
    return f"array_to_string({_ntok(x)}, ' ')"


ORACLES["doc_exact_match"] = f"""WITH n AS (SELECT doc_id, n_chars, {_norm('text')} AS t FROM documents)
SELECT doc_id, CAST(CASE WHEN count(*) OVER (PARTITION BY n_chars, t) > 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS em
FROM n"""

ORACLES["doc_contains_benchmark"] = f"""WITH n AS (SELECT doc_id, {_norm('text')} AS t FROM documents),
g AS (SELECT DISTINCT {_norm('text')} AS g FROM benchmark),
h AS (SELECT DISTINCT doc_id FROM n JOIN g ON g.g <> '' AND contains(n.t, g.g))
SELECT n.doc_id, (h.doc_id IS NOT NULL) AS answer_contains_gold FROM n LEFT JOIN h USING (doc_id)"""


EVENTS_LOG_CTE = """
lg0 AS (SELECT event_id AS seq, user_id AS run_id, ts AS timestamp, event_type AS query,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS confidence, value AS latency FROM events),
lg1 AS (SELECT *, CASE WHEN confidence >= 0.55 THEN 'memory' ELSE 'retrieval' END AS source FROM lg0),
lg AS (SELECT *,
         sum(CASE WHEN source = 'retrieval' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS retrieval_count,
         sum(CASE WHEN source = 'memory' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS memory_count
       FROM lg1)"""

ORACLES["events_log_counters"] = f"""WITH {EVENTS_LOG_CTE}
SELECT seq, run_id, source, CAST(retrieval_count AS BIGINT) AS retrieval_count,
       CAST(memory_count AS BIGINT) AS memory_count, CAST(retrieval_count AS BIGINT) AS memory_size FROM lg"""

ORACLES["events_query_metrics"] = f"""WITH {EVENTS_LOG_CTE},
m AS (SELECT * FROM lg WHERE lower(trim(query)) <> '' AND contains(lower(trim(query)), 'click'))
SELECT '  CLICK ' AS query, count(*) AS matches, round(avg(confidence), 6) AS avg_confidence,
       round(max(confidence), 6) AS max_confidence, round(avg(latency), 6) AS avg_latency,
       round(min(latency), 6) AS min_latency,
       count(*) FILTER (WHERE source = 'memory') AS memory, count(*) FILTER (WHERE source = 'retrieval') AS retrieval,
       count(*) FILTER (WHERE source NOT IN ('memory', 'retrieval')) AS other,
       arg_max(timestamp, seq) AS latest_timestamp, arg_max(source, seq) AS latest_source,
       round(arg_max(confidence, seq), 6) AS latest_confidence, round(arg_max(latency, seq), 6) AS latest_latency,
       CAST(arg_max(retrieval_count, seq) AS BIGINT) AS latest_memory_size,
       CAST(arg_max(retrieval_count, seq) AS BIGINT) AS latest_retrieval_count,
       CAST(arg_max(memory_count, seq) AS BIGINT) AS latest_memory_count
FROM m HAVING count(*) > 0"""

_SUMMARY_SQL = f"""
s AS (SELECT run_id, count(*) AS num_questions, coalesce(avg(confidence), 0) AS avg_confidence,
             coalesce(avg(latency), 0) AS avg_latency_s,
             count(*) FILTER (WHERE source = 'memory') AS memory_path_count,
             count(*) FILTER (WHERE source = 'retrieval') AS retrieval_path_count,
             coalesce(avg(confidence) FILTER (WHERE source = 'memory'), 0) AS memory_path_avg_confidence,
             coalesce(avg(confidence) FILTER (WHERE source = 'retrieval'), 0) AS retrieval_path_avg_confidence,
             CAST(arg_max(retrieval_count, seq) AS BIGINT) AS final_memory_size
      FROM lg GROUP BY run_id),
s2 AS (SELECT *, memory_path_count / num_questions AS memory_path_rate,
              retrieval_path_count / num_questions AS retrieval_path_rate,
              retrieval_path_count / num_questions AS retrieval_call_rate FROM s),
s3 AS (SELECT *, list_filter([CASE WHEN memory_path_rate < 0.1 THEN 'Memory path triggered rarely; corpus diversity or threshold may be limiting early memory reuse.' END,
                              'Answer quality is currently low; retrieval context quality and prompting need improvement.',
                              CASE WHEN avg_latency_s > 20.0 THEN 'Latency is high; consider smaller prompt context or generation limits.' END],
                             lambda x: x IS NOT NULL) AS nl FROM s2)"""

ORACLES["events_run_summary"] = f"""WITH {EVENTS_LOG_CTE}, {_SUMMARY_SQL}
SELECT run_id, num_questions, round(avg_confidence, 6) AS avg_confidence, round(avg_latency_s, 6) AS avg_latency_s,
       memory_path_count, retrieval_path_count, round(memory_path_avg_confidence, 6) AS memory_path_avg_confidence,
       round(retrieval_path_avg_confidence, 6) AS retrieval_path_avg_confidence, final_memory_size,
       round(memory_path_rate, 6) AS memory_path_rate, round(retrieval_path_rate, 6) AS retrieval_path_rate,
       round(retrieval_call_rate, 6) AS retrieval_call_rate,
       CASE WHEN len(nl) > 0 THEN array_to_string(nl, ' | ') ELSE 'Run is stable with balanced routing and measurable answer quality.' END AS notes
FROM s3"""

ORACLES["events_best_run"] = f"""WITH {EVENTS_LOG_CTE}, {_SUMMARY_SQL}
SELECT run_id, round(avg_confidence, 6) AS avg_confidence, printf('%.1f%%', memory_path_rate * 100) AS memory_rate,
       printf('%.3f', avg_latency_s) AS avg_latency
FROM s2 ORDER BY avg_confidence DESC, run_id LIMIT 1"""

ORACLES["stream_routing_embeddings"] = ORACLES["routing_embeddings"]

ORACLES["stream_log_counters_events"] = f"""WITH {EVENTS_LOG_CTE}
SELECT run_id, source, count(*) AS n, round(sum(confidence), 6) AS sum_confidence,
       round(sum(latency), 6) AS sum_latency FROM lg GROUP BY run_id, source"""

ORACLES["retrieval_quality"] = f"""
SELECT h.query_id, count(*) AS returned, count(DISTINCT h.chunk_id) AS "distinct",
       count(*) = 3 AS exact_k, count(*) = count(DISTINCT h.chunk_id) AS no_duplicates,
       coalesce(bool_or(l.quality = 1), false) AS hit_quality
FROM ({ORACLES["hybrid_top3"]}) h
LEFT JOIN labels l ON l.doc_id = h.chunk_id // {STRIDE}
GROUP BY h.query_id"""


# The whole question-answering run: routing among the questions, the hybrid top three of
# the misses, the context of the prompt, its first sentence as the answer, scores.
def _cut(x: str) -> str:
    return (f"CASE WHEN length({_strip(x)}) <= 800 THEN {_strip(x)} "
            f"ELSE regexp_replace({_strip(x)}[1:797], '[{_WS}]+$', '') || '...' END")


QA_CTE = f"""{HYBRID_CTE},
asked AS (SELECT item_id AS seq, text, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark
          WHERE regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]')),
sims AS MATERIALIZED (
  SELECT a.rn AS i, b.rn AS j, coalesce((SELECT sum(x.u * y.u) FROM qv_u x JOIN qv_u y USING (b) WHERE x.id = a.seq AND y.id = b.seq), 0) AS sim
  FROM asked a JOIN asked b ON b.rn < a.rn),
edges AS MATERIALIZED (SELECT i, list(j) AS js FROM sims WHERE sim >= 0.35 GROUP BY i),
route_walk(rn, stored) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1, CASE WHEN len(list_intersect(coalesce(e.js, CAST([] AS BIGINT[])), w.stored)) > 0 THEN w.stored
                        ELSE list_append(w.stored, w.rn + 1) END
  FROM route_walk w LEFT JOIN edges e ON e.i = w.rn + 1 WHERE w.rn < (SELECT count(*) FROM asked)),
fin AS (SELECT stored FROM route_walk ORDER BY rn DESC LIMIT 1),
kept AS (SELECT unnest(stored) AS j, unnest(range(len(stored))) AS memory_id FROM fin),
nearest AS (SELECT s.i, s.j, s.sim, row_number() OVER (PARTITION BY s.i ORDER BY round(s.sim, 9) DESC, s.j) AS r
            FROM sims s JOIN kept ON kept.j = s.j),
routed AS (SELECT a.seq, a.text, a.rn, CASE WHEN n.sim >= 0.35 THEN 'memory' ELSE 'retrieval' END AS source, m.memory_id,
                  coalesce(n.sim, 0) AS confidence, own.memory_id AS stored_id
           FROM asked a LEFT JOIN nearest n ON n.i = a.rn AND n.r = 1 LEFT JOIN kept m ON m.j = n.j LEFT JOIN kept own ON own.j = a.rn),
snippets AS (SELECT r.query_id, max(CASE WHEN r.rank = 1 THEN {_cut('c.text')} END) AS s1,
                    max(CASE WHEN r.rank = 2 THEN {_cut('c.text')} END) AS s2
             FROM rk r JOIN chunks c USING (chunk_id) WHERE r.rank <= 2 GROUP BY r.query_id),
contexts AS (SELECT query_id, {_strip("s1 || CASE WHEN length(s1) + length(s2) <= 1400 THEN chr(10) || chr(10) || s2 ELSE '' END")} AS ctx
             FROM snippets),
generated AS (SELECT query_id, CASE WHEN regexp_matches(ctx, '(?s)^.*?[.!?]{W}') THEN regexp_extract(ctx, '(?s)^(.*?[.!?]){W}', 1)
                                    ELSE ctx END AS answer FROM contexts),
answered AS (SELECT r.*, coalesce(g.answer, served.answer) AS answer
             FROM routed r LEFT JOIN generated g ON g.query_id = r.seq AND r.source = 'retrieval'
             LEFT JOIN (SELECT o.stored_id, x.answer FROM routed o JOIN generated x ON x.query_id = o.seq) served
                    ON r.source = 'memory' AND served.stored_id = r.memory_id),
pairs AS (SELECT seq AS conv_id, 0 AS turn, answer AS pred, text AS gold FROM answered),
{SCORE_CTE}, {ROUGE_CTE},
qa AS (SELECT a.*, s.em, s.f1, s.bleu, g.rouge_l, s.answer_contains_gold,
              CAST(count(*) FILTER (WHERE source = 'retrieval') OVER w AS BIGINT) AS retrieval_count,
              CAST(count(*) FILTER (WHERE source = 'memory') OVER w AS BIGINT) AS memory_count
       FROM answered a JOIN scores s ON s.conv_id = a.seq JOIN rouge g ON g.conv_id = a.seq
       WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

ORACLES["qa_predictions"] = f"""WITH RECURSIVE {QA_CTE}
SELECT CAST(seq AS VARCHAR) AS query_id, source, memory_id, round(confidence, 6) AS confidence, answer AS generated_answer, em, f1, bleu,
       rouge_l, answer_contains_gold, retrieval_count, memory_count, retrieval_count AS memory_size FROM qa"""


def _means(path: str) -> str:
    return ", ".join(f"round(coalesce(avg({m}) FILTER (WHERE source = '{path}'), 0), 4) AS {path}_path_avg_{m}" for m in ("em", "f1", "confidence"))


ORACLES["qa_run_summary"] = f"""WITH RECURSIVE {QA_CTE},
s AS (SELECT count(*) AS num_questions, avg(em) AS e, avg(f1) AS f, avg(rouge_l) AS r, avg(bleu) AS b, avg(confidence) AS c,
             count(*) FILTER (WHERE source = 'memory') AS memory_path_count,
             count(*) FILTER (WHERE source = 'retrieval') AS retrieval_path_count,
             {_means('memory')}, {_means('retrieval')}, max(retrieval_count) AS final_memory_size,
             count(*) FILTER (WHERE NOT answer_contains_gold) AS h FROM qa)
SELECT 'run' AS run_id, num_questions, round(e, 4) AS avg_em, round(f, 4) AS avg_f1, round(r, 4) AS avg_rouge_l, round(b, 4) AS avg_bleu,
       round(c, 4) AS avg_confidence, memory_path_count, retrieval_path_count,
       memory_path_avg_em, memory_path_avg_f1, memory_path_avg_confidence, retrieval_path_avg_em, retrieval_path_avg_f1,
       retrieval_path_avg_confidence, final_memory_size, round(memory_path_count / num_questions, 4) AS memory_path_rate,
       round(retrieval_path_count / num_questions, 4) AS retrieval_path_rate,
       round(retrieval_path_count / num_questions, 4) AS retrieval_call_rate, round(h / num_questions, 4) AS hallucination_rate,
       array_to_string(list_filter([
         CASE WHEN memory_path_count / num_questions < 0.1
              THEN 'Memory path triggered rarely; corpus diversity or threshold may be limiting early memory reuse.' END,
         CASE WHEN f < 0.1 THEN 'Answer quality is currently low; retrieval context quality and prompting need improvement.' END,
         CASE WHEN memory_path_count / num_questions >= 0.1 AND f >= 0.1
              THEN 'Run is stable with balanced routing and measurable answer quality.' END], lambda x: x IS NOT NULL), ' | ') AS notes
FROM s"""
