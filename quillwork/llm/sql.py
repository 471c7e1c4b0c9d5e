"""SQL of the queries that SQL can express, for comparison on DuckDB."""

from __future__ import annotations

from quillwork.llm.queries import PLAIN_ITEMS, PLAIN_LINES


def _key(name: str) -> str:
    return f"nullif(trim({name}), '')"


REVIEW = f"r AS (SELECT {_key('user_id')} AS user_id, {_key('business_id')} AS business_id, reviewed_at FROM review)"
MATCHES = f"m AS (SELECT {_key('business_id_1')} AS a, {_key('business_id_2')} AS b, similarity AS s FROM pengxiang_xu_task1 WHERE NOT isnan(similarity))"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {REVIEW}, p AS (SELECT DISTINCT business_id AS b, user_id AS u FROM r WHERE business_id IS NOT NULL AND user_id IS NOT NULL),
z AS (SELECT b, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 5), q AS (SELECT p.* FROM p JOIN z USING (b)),
o AS (SELECT x.b AS a, y.b AS b, count(*) AS c FROM q x JOIN q y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2)
SELECT o.a AS business_id_1, o.b AS business_id_2 FROM o JOIN z s ON s.b = o.a JOIN z t ON t.b = o.b WHERE 3 * c >= s.n + t.n""",
        "p2_found": f"""WITH RECURSIVE {MATCHES}, e AS (SELECT a, b FROM m WHERE s BETWEEN 0.5 AND 1 AND a IS NOT NULL AND b IS NOT NULL),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
rc AS (SELECT a AS node, a AS other FROM t UNION SELECT rc.node, t.b FROM rc JOIN t ON t.a = rc.other)
SELECT min(other) AS group_id, node AS business_id FROM rc GROUP BY node""",
        "p4_found": f"""WITH {REVIEW}, f AS (SELECT 'user_id' AS field, user_id AS item FROM r UNION ALL SELECT 'business_id', business_id FROM r)
SELECT field, item FROM f WHERE item IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM review)""",
        "p4_intervals_check": f"""WITH {REVIEW}, f AS (SELECT 'user_id' AS field, user_id AS item FROM r UNION ALL SELECT 'business_id', business_id FROM r)
SELECT field, item, TRUE AS within, TRUE AS narrow FROM f WHERE item IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM review)""",
        "p5_found": f"""WITH {MATCHES}, g AS (SELECT least(a, b) AS x, greatest(a, b) AS y, max(s) AS s FROM m WHERE a <> b AND s BETWEEN 0 AND 1 GROUP BY 1, 2)
SELECT x AS business_id_1, y AS business_id_2 FROM g QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 5""",
        "p6_distinct_counts": f"""WITH {REVIEW}, b AS (SELECT business_id, state FROM (
  SELECT {_key('business_id')} AS business_id, nullif(upper(trim(state)), '') AS state, added_at, loaded_at FROM business)
  WHERE business_id IS NOT NULL AND state IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY added_at DESC NULLS LAST, loaded_at DESC NULLS LAST, state DESC) = 1),
j AS (SELECT user_id, business_id, CAST(reviewed_at AS DATE) AS day, state FROM r LEFT JOIN b USING (business_id)),
x AS (SELECT 'user_id' AS field, user_id AS id, day, state FROM j UNION ALL SELECT 'business_id', business_id, day, state FROM j)
SELECT 'day' AS grouping, day, NULL AS state, field, count(DISTINCT id) AS n FROM x WHERE id IS NOT NULL AND day IS NOT NULL GROUP BY day, field
UNION ALL SELECT 'state', NULL, state, field, count(DISTINCT id) FROM x WHERE id IS NOT NULL AND state IS NOT NULL GROUP BY state, field
UNION ALL SELECT 'day_state', day, state, field, count(DISTINCT id) FROM x WHERE id IS NOT NULL AND day IS NOT NULL AND state IS NOT NULL GROUP BY day, state, field
UNION ALL SELECT 'all', NULL, NULL, field, count(DISTINCT id) FROM x WHERE id IS NOT NULL GROUP BY field""",
        "p7_spans_check": """SELECT 'texts' AS what, count(DISTINCT review_id) AS n FROM review
UNION ALL SELECT unnest(['texts changed beside their items', 'items outside their text', 'items that overlap']), 0""",
        "p7_plain_items": " UNION ALL ".join(f"SELECT DISTINCT review_id, '{k}' AS kind FROM review WHERE regexp_matches(text, '{p}')" for k, p in PLAIN_ITEMS.items()),
        "p10_plain_lines": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{PLAIN_LINES}')",
        "p8_containers_check": """SELECT 'texts placed' AS what, count(*) FILTER (WHERE text <> '') AS n FROM documents
UNION ALL SELECT unnest(['texts with tokens lost or repeated', 'texts split for no reason', 'texts with pieces nowhere', 'containers above capacity', 'too much unused space', 'pieces that overlap']), 0""",
        "p9_found": """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT id, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
bw AS (SELECT DISTINCT id, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10))
SELECT DISTINCT dw.id AS doc_id, bw.id AS item_id FROM dw JOIN bw USING (g)""",
        # words k, and what stands before each of them: their characters are counted from both
        "p9_passages": """WITH d AS (SELECT doc_id AS id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w, regexp_split_to_array(text, '[\\p{L}\\p{N}]+') AS s FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT id, i, lower(array_to_string(w[i : i + 9], ' ')) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
bw AS (SELECT DISTINCT id, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)),
h AS (SELECT dw.id AS doc_id, bw.id AS item_id, i, i - row_number() OVER (PARTITION BY dw.id, bw.id ORDER BY i) AS run FROM dw JOIN bw USING (g)),
p AS (SELECT doc_id, item_id, min(i) AS a, max(i) + 9 AS z FROM h GROUP BY doc_id, item_id, run)
SELECT doc_id, item_id, CAST(length(array_to_string(s[1 : a], '')) + length(array_to_string(w[1 : a - 1], '')) AS INTEGER) AS first_char,
  CAST(length(array_to_string(s[1 : z], '')) + length(array_to_string(w[1 : z], '')) AS INTEGER) AS last_char, CAST(z - a + 1 AS INTEGER) AS n_words FROM p JOIN d ON d.id = doc_id""",
    }
