"""DuckDB SQL for the queries of ``search_queries`` (the approximate search has none)."""

from __future__ import annotations

from .oracles import EVENTS_LOG_CTE, ORACLES as _FIRST, SCORE_CTE, STRIDE, _SUMMARY_SQL, _hash_units, _split, _strip
from .sample_oracles import ORACLES as _SAMPLE

ORACLES: dict[str, str] = {
    "knn_pivot_embeddings": _FIRST["knn_embeddings"],
    "untyped_evidence": _SAMPLE["sample_evidence"],
}

ORACLES["memory_index_search"] = """WITH
ev AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
nv AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM ev),
un AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM nv WHERE n > 0),
sims AS (SELECT a.vec_id, b.vec_id AS nn_id, list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) AS sim FROM un a CROSS JOIN un b),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(2 - 2 * sim, 9), nn_id) AS rank FROM sims)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, nn_id, round(sim, 6) AS similarity FROM rk WHERE rank <= 2"""

# As the routing of all rows, with similarities within a key only and ids numbered by key.
ORACLES["stream_keyed_routing"] = """WITH RECURSIVE
ev AS (SELECT vec_id, label AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
nv AS (SELECT vec_id, k, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM ev),
un AS (SELECT vec_id, k, row_number() OVER (ORDER BY vec_id) AS rn,
              CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE list_transform(v, lambda x: x * 0) END AS u FROM nv),
sims AS MATERIALIZED (SELECT a.rn AS i, b.rn AS j, list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) AS sim
                      FROM un a JOIN un b ON b.k = a.k AND b.rn < a.rn),
edges AS MATERIALIZED (SELECT i, list(j) AS js FROM sims WHERE sim >= 0.35 GROUP BY i),
walk(rn, stored) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1, CASE WHEN len(list_intersect(coalesce(e.js, CAST([] AS BIGINT[])), w.stored)) > 0 THEN w.stored ELSE list_append(w.stored, w.rn + 1) END
  FROM walk w LEFT JOIN edges e ON e.i = w.rn + 1 WHERE w.rn < (SELECT count(*) FROM un)),
fin AS (SELECT unnest(stored) AS j FROM (SELECT stored FROM walk ORDER BY rn DESC LIMIT 1)),
st AS (SELECT j, row_number() OVER (PARTITION BY k ORDER BY j) - 1 AS memory_id FROM fin JOIN un ON un.rn = j),
best AS (SELECT s.i, s.j, s.sim, row_number() OVER (PARTITION BY s.i ORDER BY round(s.sim, 9) DESC, s.j) AS r FROM sims s JOIN st ON st.j = s.j)
SELECT un.vec_id, CAST(un.k AS VARCHAR) AS cache_key, CASE WHEN b.sim >= 0.35 THEN 'memory' ELSE 'retrieval' END AS source,
       m.memory_id, round(coalesce(b.sim, 0), 6) AS confidence, own.memory_id AS stored_id
FROM un LEFT JOIN best b ON b.i = un.rn AND b.r = 1 LEFT JOIN st m ON m.j = b.j LEFT JOIN st own ON own.j = un.rn"""

ORACLES["needle_metrics"] = f"""WITH
lg AS (SELECT conv_id * 1000 + turn AS seq, turn, lower({_strip('text')}) AS q, CASE WHEN role = 'assistant' THEN 'memory' ELSE 'retrieval' END AS source,
              (length(coalesce(text, '')) % 97) / 97.0 AS confidence, length(coalesce(text, '')) / 7.0 AS latency FROM conversations),
nd AS (SELECT DISTINCT unnest({_split('lower(text)')}) AS query FROM benchmark),
m AS (SELECT nd.query, lg.* FROM nd JOIN lg ON lg.q <> '' AND contains(lg.q, nd.query))
SELECT query, count(*) AS matches, round(avg(confidence), 6) AS avg_confidence, round(max(confidence), 6) AS max_confidence,
       round(avg(latency), 6) AS avg_latency, round(min(latency), 6) AS min_latency, count(*) FILTER (WHERE source = 'memory') AS memory,
       count(*) FILTER (WHERE source = 'retrieval') AS retrieval, CAST(0 AS BIGINT) AS other, arg_max(source, seq) AS latest_source,
       round(arg_max(latency, seq), 6) AS latest_latency, arg_max(turn, seq) AS latest_memory_size
FROM m GROUP BY query"""

ORACLES["first_questions"] = f"""WITH
s AS (SELECT doc_id AS pos, {_strip("string_split(coalesce(text, ''), chr(10))[1]")} AS question,
             CASE WHEN doc_id % 2 = 1 THEN 'q' || doc_id WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN source
                  ELSE printf('triviaqa_%05d', doc_id) END AS query_id,
             CASE WHEN doc_id % 5 <> 0 THEN coalesce(lang, '') ELSE '' END AS answer_value,
             [source, ' ', CASE WHEN doc_id % 4 = 0 THEN lang END] AS al FROM documents)
SELECT pos, query_id, question, answer_value, array_to_string(list_filter(al, lambda x: x IS NOT NULL), ' | ') AS aliases, len(al) AS num_aliases
FROM s WHERE question <> '' AND answer_value <> '' ORDER BY pos LIMIT 100"""

ORACLES["smoke_documents"] = """WITH
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS j FROM documents),
u AS (SELECT text, min(doc_id * 4294967296 + j) AS pos FROM l WHERE text <> '' GROUP BY text)
SELECT CAST(pos AS BIGINT) AS pos, text FROM u WHERE (SELECT count(*) FROM u) >= 10
UNION ALL SELECT i AS pos, 'Document ' || i || ': Context about general knowledge' FROM range(20) t(i) WHERE (SELECT count(*) FROM u) < 10"""

ORACLES["long_document_corpus"] = f"""WITH
d AS (SELECT text, min(pos) AS pos FROM (SELECT doc_id AS pos, {_strip('text')} AS text FROM documents) WHERE length(text) >= 30000 GROUP BY text),
q AS (SELECT text, min(pos) AS pos FROM (SELECT item_id AS pos, {_strip('text')} AS text FROM benchmark)
      WHERE length(text) >= 20 AND text NOT IN (SELECT text FROM d) GROUP BY text),
b AS (SELECT 0 AS phase, pos, text FROM d UNION ALL SELECT 1, pos, text FROM q WHERE (SELECT count(*) FROM d) < 20),
u AS (SELECT text, row_number() OVER (ORDER BY phase, pos) - 1 AS doc_pos FROM b),
w AS (SELECT doc_pos, text, {_split('text')} AS words FROM u),
c AS (SELECT doc_pos, CASE WHEN len(words) <= 120 THEN [text]
        ELSE list_transform(range(0, CAST(ceil((len(words) - 120) / 90) AS BIGINT) + 1),
                            lambda i: array_to_string(words[i * 90 + 1 : i * 90 + 120], ' ')) END AS chunks FROM w),
e AS (SELECT doc_pos, unnest(range(len(chunks))) AS chunk_no, unnest(chunks) AS text FROM c),
cu AS (SELECT text, min(doc_pos * {STRIDE} + chunk_no) AS chunk_id FROM e GROUP BY text)
SELECT chunk_id, chunk_id // {STRIDE} AS doc_pos, CAST(chunk_id % {STRIDE} AS INTEGER) AS chunk_no, text FROM cu"""

ORACLES["memory_breakdown"] = f"""WITH
t AS (SELECT conv_id * 1000 + turn AS seq, text FROM conversations),
bl AS (SELECT item_id, item_id * 100000 + unnest(range(len(string_split(text, chr(10))))) AS line_id, unnest(string_split(text, chr(10))) AS text FROM benchmark),
{_hash_units('t', 'seq', 'text', 'tv')},
{_hash_units('benchmark', 'item_id', 'text', 'av')},
{_hash_units('bl', 'line_id', 'text', 'lv')},
r AS (SELECT seq, CASE WHEN seq % 3 <> 0 THEN seq % 211 END AS memory_id FROM t),
ta AS (SELECT r.seq, r.memory_id, sum(x.u * y.u) AS ip FROM r JOIN tv_u x ON x.id = r.seq JOIN av_u y ON y.id = r.memory_id AND y.b = x.b GROUP BY ALL),
tl AS (SELECT r.seq, bl.line_id, sum(x.u * y.u) AS ip FROM r JOIN bl ON bl.item_id = r.memory_id JOIN tv_u x ON x.id = r.seq
       JOIN lv_u y ON y.id = bl.line_id AND y.b = x.b GROUP BY ALL),
sa AS (SELECT r.seq, coalesce(ta.ip, 0) / (sqrt(tn.n2) * sqrt(an.n2) + 1e-8) AS sim_answer
       FROM r JOIN tv_n tn ON tn.id = r.seq JOIN av_n an ON an.id = r.memory_id LEFT JOIN ta USING (seq)),
sd AS (SELECT r.seq, avg(coalesce(tl.ip, 0) / (sqrt(tn.n2) * sqrt(ln.n2) + 1e-8)) AS sim_docs
       FROM r JOIN bl ON bl.item_id = r.memory_id JOIN tv_n tn ON tn.id = r.seq JOIN lv_n ln ON ln.id = bl.line_id
       LEFT JOIN tl ON tl.seq = r.seq AND tl.line_id = bl.line_id GROUP BY r.seq)
SELECT r.seq, round(sa.sim_answer, 4) AS sim_answer, round(sd.sim_docs, 4) AS sim_docs
FROM r LEFT JOIN sa USING (seq) LEFT JOIN sd USING (seq) WHERE r.memory_id IS NOT NULL"""

ORACLES["error_summary"] = f"""WITH
pairs AS (SELECT a.conv_id, a.turn, a.text AS pred, b.text AS gold
          FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
{SCORE_CTE},
v AS (SELECT conv_id % 3 AS run_id, turn / 10.0 AS confidence, conv_id % 2 = 0 AS mem, * FROM scores WHERE conv_id % 7 <> 0),
a AS (SELECT conv_id % 3 AS run_id, count(*) AS total_queries, count(*) FILTER (WHERE conv_id % 7 = 0) AS error_count FROM pairs GROUP BY 1),
s AS (SELECT run_id, count(*) AS num_questions, avg(em) AS avg_em, avg(f1) AS avg_f1, avg(confidence) AS avg_confidence,
             count(*) FILTER (WHERE mem) AS memory_path_count, count(*) FILTER (WHERE NOT mem) AS retrieval_path_count,
             count(*) FILTER (WHERE NOT answer_contains_gold) / count(*) AS hallucination_rate, coalesce(avg(f1) FILTER (WHERE mem), 0) AS mf1
      FROM v GROUP BY run_id)
SELECT a.run_id, 'phase2' AS phase, CAST(10 AS BIGINT) AS smoke_size, total_queries, error_count, coalesce(num_questions, 0) AS num_questions,
       round(coalesce(avg_em, 0), 6) AS avg_em, round(coalesce(avg_f1, 0), 4) AS avg_f1, round(coalesce(avg_confidence, 0), 6) AS avg_confidence,
       coalesce(memory_path_count, 0) AS memory_path_count, coalesce(retrieval_path_count, 0) AS retrieval_path_count,
       round(coalesce(hallucination_rate, 0), 6) AS hallucination_rate, round(coalesce(mf1, 0), 4) AS memory_path_avg_f1
FROM a LEFT JOIN s USING (run_id)"""

ORACLES["run_files"] = f"""WITH {EVENTS_LOG_CTE.replace('user_id AS run_id', 'event_type AS run_id')}, {_SUMMARY_SQL}
SELECT run_id, 'events' AS dataset, num_questions, round(avg_confidence, 6) AS avg_confidence, round(avg_latency_s, 6) AS avg_latency_s,
       round(memory_path_rate, 6) AS memory_path_rate, round(retrieval_path_rate, 6) AS retrieval_path_rate, final_memory_size FROM s2"""
