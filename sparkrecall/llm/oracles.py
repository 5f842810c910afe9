"""DuckDB SQL for the queries that SQL can express."""

from sparkrecall.llm import licenses, quality


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _replaced(value: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for pattern, by in pairs:
        value = f"regexp_replace({value}, '{_sql(pattern)}', '{by.replace('$', chr(92))}', 'g')"
    return value


def _licences() -> str:
    """Texts cut at line ends and at sentence ends; the third cut (at paragraphs) needs
    patterns that look ahead, which DuckDB lacks, and finds nothing more in the tables."""
    known, rules = licenses.sequences()
    sentences = ", ".join(f"('{k}', {i + 1})" for i, k in enumerate(known))
    listed = ", ".join(f"({i}, '{licence}', '{rule}', {n}, '{p}')" for i, (licence, rule, n, p) in enumerate(rules))
    return rf"""
        WITH known(form, id) AS (VALUES {sentences}),
        rules(ord, licence, rule, n_sentences, pattern) AS (VALUES {listed}),
        texts AS (SELECT doc_id, 'line' AS cut, text AS t FROM documents
                  UNION ALL SELECT doc_id, 'end', regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g') FROM documents),
        pieces AS (SELECT doc_id, cut, unnest(ss) AS s, unnest(range(len(ss))) AS n
                   FROM (SELECT doc_id, cut, string_split(regexp_replace(t, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS ss
                         FROM texts)),
        plain AS (SELECT doc_id, cut, n,
                         trim(regexp_replace(regexp_replace(lower(s), '([0-9])\+', '\1 orlater', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s
                  FROM pieces),
        cleaned AS (SELECT *, {_replaced("s", licenses.SLOTS)} AS filled, {_replaced("s", licenses.CLEANING)} AS w FROM plain),
        parted AS (SELECT *, CASE WHEN filled IN (SELECT form FROM known) THEN NULL
                                  WHEN length(s) <= 300 AND (contains(s, 'under ') OR contains(s, 'licen')) AND regexp_matches(w, '{licenses.STATEMENT}')
                                       AND NOT regexp_matches(s, '{licenses.CLAUSE}')
                                  THEN string_split_regex(regexp_extract(w, '{licenses.STATEMENT}', 1), '{licenses.BETWEEN}') END AS names FROM cleaned),
        named AS (SELECT doc_id, cut, n, filled, names IS NOT NULL AS states, unnest(coalesce(names, [s])) AS name,
                         unnest(range(len(coalesce(names, [s])))) AS j FROM parted),
        forms AS (SELECT doc_id, cut, n, j, CASE WHEN states THEN 'licensed under ' || trim({_replaced("name", licenses.WORDS)})
                                                 ELSE filled END AS form FROM named),
        seen AS (SELECT doc_id, cut, ',' || string_agg(id, ',' ORDER BY n, j) || ',' AS ids FROM forms JOIN known USING (form) GROUP BY ALL),
        found AS (SELECT doc_id, licence, min(ord) AS ord
                  FROM seen JOIN rules ON CASE WHEN contains(pattern, '(') THEN regexp_matches(ids, pattern) ELSE contains(ids, pattern) END
                  GROUP BY ALL)
        SELECT doc_id, f.licence, rule, CAST(n_sentences AS BIGINT) AS n_sentences
        FROM found f JOIN rules USING (ord)
        WHERE NOT (f.licence = 'BSD' AND EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.licence LIKE 'BSD-%'))"""


ORACLES = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
        FROM d""",
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        w AS (SELECT doc_id, n, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws
              FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS n FROM l)),
        lines AS (SELECT doc_id, n, ws, array_to_string(ws, ' ') AS line FROM w WHERE len(ws) > 0),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS k FROM lines),
        kinds AS (SELECT line, ws, doc_id AS first_doc, row_number() OVER (ORDER BY doc_id, n) AS pos FROM firsts WHERE k = 1),
        deleted AS (SELECT pos, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v
                    FROM (SELECT pos, ws, unnest(range(1, len(ws) + 1)) AS i FROM kinds WHERE len(ws) >= 5)),
        links AS (
          SELECT a.pos, b.pos AS other FROM deleted a JOIN deleted b ON a.v = b.v AND a.i = b.i AND b.pos < a.pos
          UNION ALL SELECT a.pos, b.pos FROM deleted a JOIN kinds b ON a.v = b.line AND len(b.ws) >= 5
          UNION ALL SELECT b.pos, a.pos FROM deleted a JOIN kinds b ON a.v = b.line AND len(b.ws) >= 5),
        near AS (SELECT DISTINCT pos FROM links WHERE other < pos),
        numbered AS (SELECT f.doc_id, f.n, k.first_doc, r.pos IS NOT NULL AS near,
                            row_number() OVER (PARTITION BY f.doc_id, f.line ORDER BY f.n) AS nth
                     FROM firsts f JOIN kinds k USING (line) LEFT JOIN near r USING (pos)),
        gone AS (SELECT doc_id, list(CAST(n AS INTEGER) ORDER BY n) AS dropped FROM numbered
                 WHERE near OR doc_id > first_doc OR nth > 1 GROUP BY doc_id)
        SELECT doc_id, len(ls) AS n_lines, coalesce(len(dropped), 0) AS n_dropped, coalesce(array_to_string(dropped, ','), '') AS dropped
        FROM l LEFT JOIN gone USING (doc_id)""",
    "op8_license_scan": _licences(),
    "op9_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        base AS (
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
        windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
        repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
                     FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
        lines AS (SELECT doc_id, l, n, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS k
                  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS n
                        FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
        flagged AS (SELECT *, k <= 4 AND regexp_matches(l, '{menu}') AS title,
                           regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g') AS low FROM lines WHERE k > 0),
        runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n)
                           - row_number() OVER (PARTITION BY doc_id, title ORDER BY n) AS run FROM flagged),
        judged AS (
          SELECT doc_id, l, k,
                 10 * len(regexp_extract_all(l, '[|»›•·]')) >= greatest(20, 3 * k)
                 OR 10 * len(regexp_extract_all(l, '[#*$%&|<>]')) >= greatest(30, 3 * k)
                 OR 10 * len(regexp_extract_all(l, '!!')) >= greatest(20, 3 * k)
                 OR (k >= 5 AND 10 * len(regexp_extract_all(l, '[A-ZÀ-ÖØ-Þ]'))
                                > 7 * greatest(10, len(regexp_extract_all(l, '[A-Za-zÀ-ÖØ-öø-ÿ]'))))
                 OR (title AND (count(*) OVER (PARTITION BY doc_id, title, run) >= 3 OR count(*) OVER (PARTITION BY doc_id, l) >= 3))
                 OR (k < 30 AND regexp_matches(low, 'javascript|cookie|lorem ipsum|privacy policy|terms of use|terms of service|'
                     || 'sign in|log in|subscribe|click here|read more|share this')
                     AND (regexp_matches(low, '{call}') OR regexp_matches(low, '{own}'))) AS bad
          FROM runs),
        per_line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines,
                            CAST(coalesce(sum(k) FILTER (bad), 0) AS BIGINT) AS n_lost_words FROM judged GROUP BY doc_id),
        all_of AS (
          SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines,
                 coalesce(n_lost_words, 0) AS n_lost_words
          FROM base LEFT JOIN repeated USING (doc_id) LEFT JOIN per_line USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 30 * n_words AS kept
        FROM all_of""".replace("{menu}", _sql(quality.MENU)).replace("{call}", _sql(quality.CALL)).replace("{own}", _sql(quality.OWN)),
}
