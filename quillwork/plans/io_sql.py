"""What comes back from every source and sink, in SQL on the tables themselves."""

from __future__ import annotations

from quillwork.operators.similar import multipliers
from quillwork.plans import core_sql as c


def oracle_sql() -> dict[str, str]:
    core = c.oracle_sql()
    quoted = "'(''' || replace(items, ',', ''', ''') || ''')'"
    report = f"""WITH t AS ({core['itemset_candidates']}),
b AS (SELECT items, size, 0 AS part FROM t UNION ALL SELECT items, size, 1 FROM t WHERE frequent),
z AS (SELECT part, size, row_number() OVER (ORDER BY part, size) AS k, sum(CASE WHEN part = 1 THEN 1 ELSE 0 END) OVER (ORDER BY part, size) AS k1 FROM (SELECT DISTINCT part, size FROM b)),
y AS (SELECT part, size, 2 * k + CASE WHEN part = 1 THEN 1 ELSE 0 END AS line FROM z)
SELECT line, row_number() OVER (PARTITION BY line ORDER BY string_split(items, ',')) AS place, {quoted} AS text FROM b JOIN y USING (part, size)
UNION ALL SELECT 1, 1, 'Candidates:' UNION ALL SELECT min(line) - 1, 1, 'Frequent Itemsets:' FROM y WHERE part = 1
UNION ALL SELECT min(line) - 2, 1, '' FROM y WHERE part = 1 UNION ALL SELECT line - 1, 1, '' FROM y WHERE size > 1"""
    family = multipliers(20)
    other = f"""WITH {c.PAIRS}, {c.INDEX}, nm AS (SELECT count(*) AS n FROM ix),
sg AS (SELECT item, [{', '.join(f'min(({m} * idx + 1) % nm.n)' for m in family)}] AS sig FROM p JOIN ix USING (member), nm GROUP BY item), {c.CLASSES},
bd AS (SELECT item, k AS band, sig[2 * k + 1] AS r1, sig[2 * k + 2] AS r2 FROM sg, range(10) t(k)), rb AS (SELECT bd.* FROM bd JOIN cl USING (item) WHERE item = rep),
ca AS (SELECT DISTINCT x.item AS a, y.item AS b FROM rb x JOIN rb y ON x.band = y.band AND x.r1 = y.r1 AND x.r2 = y.r2 AND x.item < y.item), {c.EXACT}
SELECT a AS business_id_1, b AS business_id_2, round(similarity, 6) AS similarity FROM ex JOIN ca USING (a, b)"""
    return {
        "json_scan": core["review_summary"],
        "business_json_scan": "SELECT state, count(*) AS n, count(DISTINCT business_id) AS n_businesses FROM business GROUP BY 1",
        "csv_scan": "SELECT user_id, count(*) AS n, round(sum(stars), 6) AS stars FROM ratings_train GROUP BY 1",
        "csv_scan_header_by_name": "SELECT business_id, count(*) AS n FROM user_business GROUP BY 1",
        "partition_control": "SELECT count(*) AS n, TRUE AS two_at_most FROM user_business",
        "sampled_rows": "SELECT least(300, count(*)) AS n_drawn, 0 AS n_unknown FROM review",
        "json_document": f"WITH {c.REVIEW} SELECT count(*) FILTER (useful > 0) AS n_review_useful, max(length(text)) AS n_characters, count(DISTINCT user_id) AS n_user FROM r",
        "state_stars_report": f"SELECT 1 + row_number() OVER (ORDER BY stars DESC, state) AS line, state, stars FROM ({core['state_avg_stars']})",
        "timing_report": "SELECT 2.0 AS m1, 0.5 AS m2, count(*) || ' rows' AS explanation FROM business",
        "itemset_report": report,
        "similar_pairs_report": f"SELECT 1 + row_number() OVER (ORDER BY business_id_1, business_id_2) AS line, * FROM ({core['similar_pairs_lsh']})",
        "predictions_report": f"SELECT 1 + row_number() OVER (ORDER BY user_id, business_id) AS line, user_id, business_id, prediction FROM ({core['user_cf']})",
        "betweenness_report": f"SELECT row_number() OVER (ORDER BY betweenness DESC, src, dst) AS line, src, dst, betweenness FROM ({core['edge_betweenness'].replace('round(betweenness, 6)', 'round(betweenness, 9)')})".replace("src, dst, betweenness FROM (", "src, dst, round(betweenness, 6) AS betweenness FROM (", 1),
        "communities_report": f"""SELECT row_number() OVER (ORDER BY n, component) AS line, text FROM (SELECT component, count(*) AS n, string_agg('''' || node || '''', ', ' ORDER BY node) AS text
  FROM ({core['connected_components']}) GROUP BY 1)""",
        "table_lines": "SELECT concat_ws('|', business_id, strftime(added_at, '%Y-%m-%d')) AS text, count(*) AS n FROM business GROUP BY 1",
        "stream_state_average": f"""WITH {c.STATES}, u AS (SELECT review_id, min(nullif(trim(business_id), '')) AS business_id, min(stars) AS stars FROM review WHERE reviewed_at IS NOT NULL GROUP BY 1)
SELECT state, round(avg(stars), 6) AS stars, count(*) AS n FROM u JOIN b USING (business_id) WHERE stars IS NOT NULL GROUP BY 1""",
        "stream_days": """WITH u AS (SELECT review_id, min(reviewed_at) AS seen_at, min(stars) AS stars FROM review WHERE reviewed_at IS NOT NULL GROUP BY 1)
SELECT CAST(seen_at AS DATE) AS day, count(*) AS n, round(avg(stars), 6) AS stars FROM u
GROUP BY 1 HAVING CAST(seen_at AS DATE) + INTERVAL 1 DAY <= (SELECT max(seen_at) FROM u) - INTERVAL 30 DAY""",
        "band_chooser": """SELECT n AS hashes, min(b) AS bands, CAST(n // min(b) AS INTEGER) AS rows
FROM (SELECT unnest([6, 12, 20, 28, 60, 120]) AS n), (SELECT unnest(range(1, 121)) AS b) WHERE n % b = 0 AND pow(1.0 / b, 1.0 * b / n) < 0.5 GROUP BY n""",
        "lsh_pairs_of_other_family": other,
    }
