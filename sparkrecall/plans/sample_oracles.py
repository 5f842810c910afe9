"""DuckDB SQL for the queries of ``sample_queries``."""

from __future__ import annotations

from .oracles import _SUMMARY_SQL, _WS, BM25_CTE, CHUNKS_CTE, EVENTS_LOG_CTE, STRIDE, _norm, _ntok, _split, _strip

ORACLES: dict[str, str] = {}

# A document's texts in the order of the walk: evidence (text, then title of each line),
# search_results (descriptions, titles, then both lists again in field order), context.
_SAMPLES = f"""
s AS (SELECT doc_id AS pos, string_split(coalesce(text, ''), chr(10)) AS ls, source, lang FROM documents),
walked AS (
  SELECT pos, 0 AS field, flatten(list_transform(ls, lambda x: [x, source])) AS ts FROM s
  UNION ALL SELECT pos, 2, list_concat(ls, [source], [source], ls) FROM s
  UNION ALL SELECT pos, 4, [lang] FROM s),
stripped AS (SELECT pos, field, list_filter(list_transform(ts, lambda x: {_strip('x')}), lambda x: x <> '') AS ts FROM walked),
evidence AS (SELECT pos * 4294967296 + field * 268435456 + unnest(range(len(ts))) AS pos, unnest(ts) AS text FROM stripped)"""

ORACLES["sample_evidence"] = f"WITH {_SAMPLES} SELECT CAST(pos AS BIGINT) AS pos, text FROM evidence"

ORACLES["sample_questions"] = f"""WITH
s AS (SELECT doc_id AS pos, {_strip("string_split(coalesce(text, ''), chr(10))[1]")} AS question,
             CASE WHEN doc_id % 2 = 1 THEN 'q' || doc_id WHEN doc_id % 3 = 0 AND source <> '' THEN source
                  ELSE printf('triviaqa_%05d', doc_id) END AS query_id,
             coalesce(CASE WHEN doc_id % 5 <> 0 THEN nullif(lang, '') END, nullif(source, ''), '') AS answer_value,
             [source, ' ', CASE WHEN doc_id % 4 = 0 THEN lang END] AS given FROM documents),
a AS (SELECT *, list_filter(CASE WHEN answer_value <> '' AND NOT coalesce(list_contains(given, answer_value), false)
                                 THEN list_concat([answer_value], given) ELSE given END,
                            lambda x: x IS NOT NULL AND {_strip('x')} <> '') AS al FROM s)
SELECT pos, query_id, question, answer_value, array_to_string(al, ' | ') AS aliases, len(al) AS num_aliases
FROM a WHERE question <> '' AND answer_value <> ''"""

_CORPUS = f"""{_SAMPLES},
firsts AS (SELECT text, min(pos) AS pos FROM evidence WHERE length(text) >= 20 GROUP BY text),
u AS (SELECT text, row_number() OVER (ORDER BY pos) - 1 AS doc_pos FROM firsts)"""

ORACLES["sample_corpus"] = f"""WITH {_CORPUS},
w AS (SELECT doc_pos, text, {_split('text')} AS words FROM u),
c AS (SELECT doc_pos, CASE WHEN len(words) <= 120 THEN [text]
        ELSE list_transform(range(0, CAST(ceil((len(words) - 120) / 90) AS BIGINT) + 1),
                            lambda i: array_to_string(words[i * 90 + 1 : i * 90 + 120], ' ')) END AS chunks FROM w),
e AS (SELECT doc_pos, unnest(range(len(chunks))) AS chunk_no, unnest(chunks) AS text FROM c),
cu AS (SELECT text, min(doc_pos * {STRIDE} + chunk_no) AS chunk_id FROM e GROUP BY text)
SELECT chunk_id, chunk_id // {STRIDE} AS doc_pos, CAST(chunk_id % {STRIDE} AS INTEGER) AS chunk_no, text FROM cu"""

ORACLES["passage_corpus"] = f"WITH {_CORPUS} SELECT doc_pos, text FROM u"

ORACLES["rare_word_top3"] = f"""WITH {CHUNKS_CTE}, {BM25_CTE},
bt AS (SELECT item_id AS query_id, unnest({_split('lower(text)')}) AS term FROM benchmark),
qt AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term DESC) AS r FROM bt)
       WHERE r = 1),
bm AS (SELECT query_id, chunk_id, w AS s FROM qt JOIN post USING (term)),
bn AS (SELECT query_id, chunk_id, CASE WHEN max(s) OVER (PARTITION BY query_id) > 0
                                       THEN s / max(s) OVER (PARTITION BY query_id) ELSE s END AS b FROM bm),
scored AS (SELECT q.item_id AS query_id, c.chunk_id, coalesce(b.b, 0) AS score
           FROM benchmark q CROSS JOIN chunks c LEFT JOIN bn b ON b.query_id = q.item_id AND b.chunk_id = c.chunk_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 3"""

_ALNUM = r"regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')"
ORACLES["turn_guards"] = f"""WITH c AS (SELECT conv_id, turn, {_strip('text')} AS t FROM conversations)
SELECT conv_id, turn, length(t) > 0 AND length({_ALNUM}) >= 3 AND regexp_matches(t, '\\p{{L}}') AS valid,
       length({_ALNUM}) >= 1 AS routable,
       CASE WHEN length(t) <= 40 THEN t ELSE regexp_replace(t[1:37], '[{_WS}]+$', '') || '...' END AS snippet FROM c"""

ORACLES["two_gold_scores"] = f"""WITH
p AS (SELECT a.conv_id, a.turn, a.text AS pred, unnest([b.text, c.text]) AS gold
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
                           JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2
      WHERE a.role = 'assistant'),
n AS (SELECT row_number() OVER () AS i, conv_id, turn, {_ntok('pred')} AS pt, {_ntok('gold')} AS gt, {_norm('pred')} AS pn, {_norm('gold')} AS gn FROM p),
pc AS (SELECT i, tok, count(*) AS c FROM (SELECT i, unnest(pt) AS tok FROM n) GROUP BY ALL),
gc AS (SELECT i, tok, count(*) AS c FROM (SELECT i, unnest(gt) AS tok FROM n) GROUP BY ALL),
same AS (SELECT i, sum(least(pc.c, gc.c)) AS m FROM pc JOIN gc USING (i, tok) GROUP BY i),
f AS (SELECT conv_id, turn, pn = gn AS em, gn <> '' AND contains(pn, gn) AS has,
             CASE WHEN len(pt) = 0 OR len(gt) = 0 OR m IS NULL THEN 0.0
                  ELSE 2 * (m / len(pt)) * (m / len(gt)) / (m / len(pt) + m / len(gt)) END AS f1
      FROM n LEFT JOIN same USING (i))
SELECT conv_id, turn, CAST(CASE WHEN bool_or(em) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS em, round(max(f1), 6) AS f1,
       bool_or(has) AS answer_contains_gold FROM f GROUP BY conv_id, turn"""

ORACLES["log_round_trip"] = f"""WITH {EVENTS_LOG_CTE}
SELECT query, source, count(*) AS n, count(*) FILTER (WHERE source = 'memory') AS n_memory,
       CAST(sum(CASE WHEN source = 'memory' THEN seq END) AS BIGINT) AS sum_memory_id, min(timestamp) AS first_ts,
       round(sum(confidence), 6) AS sum_confidence, round(sum(latency), 6) AS sum_latency, CAST(0 AS BIGINT) AS n_sim_docs
FROM lg GROUP BY query, source"""

ORACLES["run_rollup"] = f"""WITH {EVENTS_LOG_CTE}, {_SUMMARY_SQL}
SELECT CAST(run_id AS VARCHAR) AS run_id, 'events' AS dataset, num_questions, round(avg_confidence, 6) AS avg_confidence,
       round(avg_latency_s, 6) AS avg_latency_s, round(memory_path_rate, 6) AS memory_path_rate, final_memory_size FROM s2"""

ORACLES["report_lines"] = f"""WITH {EVENTS_LOG_CTE}, {_SUMMARY_SQL},
r AS (SELECT CAST(run_id AS VARCHAR) AS run_id, unnest(range(7)) AS line_no,
             unnest(['Dataset', 'Questions', 'Corpus', 'EM/F1', 'ROUGE-L/BLEU', 'Memory/Retrieval', 'Avg latency']) AS label,
             unnest(['events', CAST(num_questions AS VARCHAR), 'None', '0.0000 / 0.0000', '0.0000 / 0.0000',
                     printf('%.1f%%', memory_path_rate * 100) || ' / ' || printf('%.1f%%', retrieval_path_rate * 100),
                     printf('%.3f', avg_latency_s) || 's']) AS value FROM s2)
SELECT run_id, CAST(line_no AS INTEGER) AS line_no, label, value FROM r
UNION ALL SELECT 'all', 0, 'Total runs', CAST(count(*) AS VARCHAR) FROM s2
UNION ALL (SELECT 'all', 1, 'Best run by F1', CAST(run_id AS VARCHAR) FROM s2 ORDER BY avg_confidence DESC, CAST(run_id AS VARCHAR) LIMIT 1)"""
