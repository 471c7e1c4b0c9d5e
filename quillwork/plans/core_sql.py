"""The same results in SQL, for comparison on DuckDB. Kept apart from the queries: nothing here runs on Spark."""

from __future__ import annotations

from quillwork.operators.similar import BANDS, MULTIPLIERS, ODD_MULTIPLIERS
from quillwork.plans.core_queries import EDGE_LEAST, GATE


def _key(name: str) -> str:
    return f"nullif(trim({name}), '')"


REVIEW = f"r AS (SELECT {_key('user_id')} AS user_id, {_key('business_id')} AS business_id, stars, useful, text, review_id, reviewed_at FROM review)"
STATES = f"""b AS (SELECT business_id, state FROM (
  SELECT {_key('business_id')} AS business_id, nullif(upper(trim(state)), '') AS state, added_at, loaded_at FROM business)
  WHERE business_id IS NOT NULL AND state IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY added_at DESC NULLS LAST, loaded_at DESC NULLS LAST, state DESC) = 1)"""
UB = f"ub AS (SELECT * FROM (SELECT {_key('user_id')} AS user_id, {_key('business_id')} AS business_id FROM user_business) WHERE user_id IS NOT NULL AND business_id IS NOT NULL)"
PAIRS = f"{UB}, p AS (SELECT DISTINCT business_id AS item, user_id AS member FROM ub)"
SUPPORT = "(SELECT greatest(3, count(*) // 1000) FROM user_business)"


def _average(tail: str) -> str:
    return f"""WITH {REVIEW}, {STATES}
SELECT state, round(avg(stars), 6) AS stars FROM r JOIN b USING (business_id) WHERE stars IS NOT NULL GROUP BY state ORDER BY 2 DESC, 1 {tail}"""


def _top(key: str) -> str:
    return f"WITH {REVIEW} SELECT {key}, count(*) AS n FROM r WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"


def _top_json(key: str) -> str:
    return f"""(SELECT '[' || string_agg('["' || {key} || '","' || n || '"]', ',' ORDER BY n DESC, {key}) || ']'
  FROM (SELECT {key}, count(*) AS n FROM r WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20))"""


def _baskets(basket: str, item: str, larger: bool = False, support: str = SUPPORT) -> str:
    cut = f"JOIN (SELECT {basket} FROM ub GROUP BY 1 HAVING count(*) > 3) USING ({basket})" if larger else ""
    return f"""{UB}, bi AS (SELECT DISTINCT {basket} AS basket, {item} AS item FROM ub {cut}),
f1 AS (SELECT item, count(*) AS n FROM bi GROUP BY 1 HAVING count(*) >= {support}),
g AS (SELECT basket, item FROM bi WHERE item IN (SELECT item FROM f1)),
f2 AS (SELECT x.item AS i1, y.item AS i2, count(*) AS n FROM g x JOIN g y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= {support}),
f3 AS (SELECT x.item AS i1, y.item AS i2, z.item AS i3, count(*) AS n FROM f2 JOIN g x ON x.item = f2.i1 JOIN g y ON y.basket = x.basket AND y.item = f2.i2
  JOIN g z ON z.basket = x.basket AND z.item > y.item GROUP BY 1, 2, 3 HAVING count(*) >= {support})"""


UP_TO_3 = "SELECT item AS items, 1 AS size, n FROM f1 UNION ALL SELECT i1 || ',' || i2, 2, n FROM f2 UNION ALL SELECT i1 || ',' || i2 || ',' || i3, 3, n FROM f3"

def _longer(most: int) -> str:
    """Itemsets of 4 to ``most`` items, each size from the one before."""
    out = []
    for k in range(4, most + 1):
        own = ", ".join(f"f{k - 1}.i{j}" for j in range(1, k))
        joins = " ".join([f"JOIN g x1 ON x1.item = f{k - 1}.i1", *(f"JOIN g x{j} ON x{j}.basket = x1.basket AND x{j}.item = f{k - 1}.i{j}" for j in range(2, k))])
        out.append(f"f{k} AS (SELECT {own}, z.item AS i{k}, count(*) AS n FROM f{k - 1} {joins} JOIN g z ON z.basket = x1.basket AND z.item > f{k - 1}.i{k - 1} GROUP BY {', '.join(map(str, range(1, k + 1)))} HAVING count(*) >= {SUPPORT})")
    return ", " + ", ".join(out)


MOST = 7  # no itemset of the test data has more items
UP_TO_MOST = " ".join([UP_TO_3, *(f"UNION ALL SELECT {' || chr(44) || '.join(f'i{j}' for j in range(1, k + 1))}, {k}, n FROM f{k}" for k in range(4, MOST + 1))])

INDEX = "ix AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS idx FROM (SELECT DISTINCT member FROM p))"
SIGS = f"""{INDEX}, nm AS (SELECT count(*) AS n FROM ix),
sg AS (SELECT item, [{', '.join(f'min(({m} * idx + 1) % nm.n)' for m in MULTIPLIERS)}] AS sig FROM p JOIN ix USING (member), nm GROUP BY item)"""
CLASSES = """st AS (SELECT item, list_sort(list(member)) AS members, count(*) AS n FROM p GROUP BY item),
cl AS (SELECT item, min(item) OVER (PARTITION BY members) AS rep, n FROM st)"""
BANDED = f"bd AS (SELECT item, k AS band, sig[2 * k + 1] AS r1, sig[2 * k + 2] AS r2 FROM sg, range({BANDS}) t(k))"
CANDIDATES = f"""{SIGS}, {CLASSES}, {BANDED}, rb AS (SELECT bd.* FROM bd JOIN cl USING (item) WHERE item = rep),
ca AS (SELECT DISTINCT x.item AS a, y.item AS b FROM rb x JOIN rb y ON x.band = y.band AND x.r1 = y.r1 AND x.r2 = y.r2 AND x.item < y.item)"""
EXACT = """rp AS (SELECT p.* FROM p JOIN cl USING (item) WHERE item = rep),
ov AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM rp x JOIN rp y ON x.member = y.member AND x.item < y.item GROUP BY 1, 2),
ex AS (SELECT a, b, c / (s.n + t.n - c) AS similarity FROM ov JOIN cl s ON s.item = a JOIN cl t ON t.item = b WHERE c / (s.n + t.n - c) >= 0.5)"""


def _ratings(name: str, source: str) -> str:
    return f"""{name} AS (SELECT user_id, business_id, avg(stars) AS stars FROM (SELECT {_key('user_id')} AS user_id, {_key('business_id')} AS business_id, stars FROM {source})
  WHERE user_id IS NOT NULL AND business_id IS NOT NULL AND stars BETWEEN 1 AND 5 GROUP BY 1, 2)"""


RATINGS = f"{_ratings('tr', 'ratings_train')}, {_ratings('te', 'ratings_test')}"


def _centred(by: str, centre: bool = True) -> str:
    x, y = ("user_id", "business_id") if by == "user" else ("business_id", "user_id")
    return f"c AS (SELECT {x} AS x, {y} AS y, stars AS r, stars - {'avg(stars) OVER (PARTITION BY ' + x + ')' if centre else '0'} AS d FROM tr)"


def _pair_similarity(by: str) -> str:
    return f"""WITH {RATINGS}, {_centred(by)},
s AS (SELECT p.x AS a, q.x AS b, sum(p.d * q.d) AS num, sum(p.d * p.d) AS d1, sum(q.d * q.d) AS d2, count(*) AS n FROM c p JOIN c q ON p.y = q.y AND p.x < q.x GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, round(round(CASE WHEN round(num, 9) = 0 THEN 0.0 ELSE num / sqrt(d1 * d2) END, 9), 6) AS similarity, n FROM s"""


def _cf(by: str, top: int, gate: int, value: str = "round(prediction, 5)", centre: bool = True, near: str = "", only: str = "") -> str:
    x, y = ("user_id", "business_id") if by == "user" else ("business_id", "user_id")
    hit = "mx + coalesce(pr, 0)" if by == "user" else "coalesce(pr, mx)"
    return f"""{RATINGS}, {_centred(by, centre)}{near},
tg AS (SELECT DISTINCT {x} AS x, {y} AS y FROM te WHERE {x} IN (SELECT x FROM c)),
tri AS (SELECT tg.x, tg.y, c.x AS v, c.r AS rv, c.d AS dv FROM tg JOIN c ON c.y = tg.y AND c.x <> tg.x {only}),
sm AS (SELECT w.x, w.v, sum(p.d * q.d) AS num, sum(p.d * p.d) AS d1, sum(q.d * q.d) AS d2, count(*) AS n
  FROM (SELECT DISTINCT x, v FROM tri) w JOIN c p ON p.x = w.x JOIN c q ON q.x = w.v AND q.y = p.y GROUP BY 1, 2),
sc AS (SELECT tri.*, coalesce(num, 0) - coalesce(o.d * dv, 0) AS num, coalesce(d1, 0) - coalesce(o.d * o.d, 0) AS d1, coalesce(d2, 0) - CASE WHEN o.d IS NULL THEN 0 ELSE dv * dv END AS d2, coalesce(n, 0) AS n
  FROM tri LEFT JOIN sm USING (x, v) LEFT JOIN c o ON o.x = tri.x AND o.y = tri.y),
sv AS (SELECT *, round(CASE WHEN round(num, 9) = 0 OR n < {gate} THEN 0.0 ELSE num / sqrt(d1 * d2) END, 9) AS s FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY s DESC, v) AS k FROM sv),
be AS (SELECT x, y, CASE WHEN sum(abs(s)) > 0 THEN sum(s * {'dv' if by == 'user' else 'rv'}) / sum(abs(s)) END AS pr FROM rk WHERE k <= {top} GROUP BY 1, 2),
mx AS (SELECT {x} AS x, avg(stars) AS mx FROM tr GROUP BY 1), my AS (SELECT {y} AS y, avg(stars) AS my FROM tr GROUP BY 1),
pd AS (SELECT te.user_id, te.business_id, te.stars, CASE WHEN mx IS NOT NULL AND my IS NOT NULL THEN {hit} ELSE coalesce(mx, my, 3.0) END AS prediction
  FROM te LEFT JOIN be ON be.x = te.{x} AND be.y = te.{y} LEFT JOIN mx ON mx.x = te.{x} LEFT JOIN my ON my.y = te.{y})""", f"SELECT user_id, business_id, round(stars, 6) AS stars, {value} AS prediction FROM pd"


def _cf_sql(*args, **kw) -> str:
    ctes, tail = _cf(*args, **kw)
    return f"WITH {ctes} {tail}"


def _edges(least: int = EDGE_LEAST) -> str:
    return f"""{PAIRS}, e AS (SELECT x.member AS src, y.member AS dst, count(*) AS n FROM p x JOIN p y ON x.item = y.item AND x.member < y.member GROUP BY 1, 2 HAVING count(*) >= {least}),
ad AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


REACH = "rc AS (SELECT DISTINCT src AS node, src AS other FROM ad UNION SELECT rc.node, ad.dst FROM rc JOIN ad ON ad.src = rc.other)"
# every shortest path between every two nodes; each edge of it carries its share of the pair
PATHS = """wk AS (SELECT DISTINCT src AS root, src AS node, 0 AS d FROM ad UNION SELECT wk.root, ad.dst, wk.d + 1 FROM wk JOIN ad ON ad.src = wk.node WHERE wk.d < 12),
ds AS (SELECT root, node, min(d) AS d FROM wk GROUP BY 1, 2),
sp AS (SELECT root, node, d, CAST([] AS VARCHAR[]) AS steps FROM ds WHERE d = 0
  UNION ALL SELECT sp.root, ad.dst, sp.d + 1, list_append(sp.steps, least(ad.src, ad.dst) || ' ' || greatest(ad.src, ad.dst)) FROM sp JOIN ad ON ad.src = sp.node JOIN ds ON ds.root = sp.root AND ds.node = ad.dst AND ds.d = sp.d + 1),
bw AS (SELECT split_part(x, ' ', 1) AS src, split_part(x, ' ', 2) AS dst, sum(w) / 2 AS betweenness
  FROM (SELECT unnest(steps) AS x, w FROM (SELECT steps, 1.0 / count(*) OVER (PARTITION BY root, node) AS w FROM sp WHERE d > 0)) GROUP BY 1, 2)"""
ORPHANS = f"""{REVIEW}, pb AS (SELECT {_key('business_id')} AS k, added_at, removed_at FROM business),
o AS (SELECT DISTINCT review_id, business_id, reviewed_at FROM r WHERE business_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM pb WHERE k = business_id AND (reviewed_at IS NULL OR (added_at <= reviewed_at AND (removed_at IS NULL OR reviewed_at < removed_at)))))"""


def oracle_sql() -> dict[str, str]:
    rmse_u, rmse_i = _cf("user", 13, 0)[0], _cf("item", 6, GATE)[0]
    near = f""", p AS (SELECT business_id AS item, user_id AS member FROM tr), {SIGS}, {CLASSES}, {BANDED}, rb AS (SELECT bd.* FROM bd JOIN cl USING (item) WHERE item = rep),
ca AS (SELECT DISTINCT x.item AS a, y.item AS b FROM rb x JOIN rb y ON x.band = y.band AND x.r1 = y.r1 AND x.r2 = y.r2 AND x.item < y.item),
{EXACT}, nr AS (SELECT a, b FROM ca JOIN ex USING (a, b) UNION ALL SELECT b, a FROM ca JOIN ex USING (a, b) UNION ALL SELECT rep, rep FROM cl WHERE item = rep)"""
    only = "JOIN cl k1 ON k1.item = tg.x JOIN cl k2 ON k2.item = c.x JOIN nr ON nr.a = k1.rep AND nr.b = k2.rep"
    return {
        "state_avg_stars": _average(""),
        "state_top5": _average("LIMIT 5"),
        "review_summary": f"""WITH {REVIEW} SELECT count(*) FILTER (useful > 0) AS n_useful, count(*) FILTER (stars = 5) AS n_five_star, max(length(text)) AS longest,
count(DISTINCT user_id) AS n_users, {_top_json('user_id')} AS top_users, count(DISTINCT business_id) AS n_businesses, {_top_json('business_id')} AS top_businesses FROM r""",
        "useful_count": "SELECT count(*) AS n FROM review WHERE useful > 0",
        "five_star_count": "SELECT count(*) AS n FROM review WHERE stars = 5",
        "longest_text": "SELECT max(length(text)) AS n FROM review",
        "distinct_users": f"WITH {REVIEW} SELECT count(DISTINCT user_id) AS n FROM r",
        "distinct_businesses": f"WITH {REVIEW} SELECT count(DISTINCT business_id) AS n FROM r",
        "top20_users": _top("user_id"),
        "top20_businesses": _top("business_id"),
        "baskets_by_user": f"WITH {UB} SELECT user_id AS basket, count(*) AS n_rows, count(DISTINCT business_id) AS n_items FROM ub GROUP BY 1",
        "baskets_by_business": f"WITH {UB} SELECT business_id AS basket, count(*) AS n_rows, count(DISTINCT user_id) AS n_items FROM ub GROUP BY 1",
        "basket_size_filter": f"WITH {UB} SELECT user_id AS basket, count(*) AS n_rows, count(DISTINCT business_id) AS n_items FROM ub GROUP BY 1 HAVING count(*) > 3",
        "frequent_singles": f"WITH {_baskets('user_id', 'business_id')} SELECT item, n FROM f1",
        "frequent_pairs": f"WITH {_baskets('user_id', 'business_id')} SELECT i1 || ',' || i2 AS items, 2 AS size, n FROM f2",
        "frequent_triples": f"WITH {_baskets('user_id', 'business_id')} SELECT i1 || ',' || i2 || ',' || i3 AS items, 3 AS size, n FROM f3",
        "frequent_itemsets_of_users": f"WITH {_baskets('business_id', 'user_id')}{_longer(MOST)} {UP_TO_MOST}",
        "itemsets_of_larger_baskets": f"WITH {_baskets('user_id', 'business_id', larger=True)}{_longer(MOST)} {UP_TO_MOST}",
        "frequent_itemsets": f"WITH {_baskets('user_id', 'business_id')}{_longer(MOST)} {UP_TO_MOST}",
        "itemset_levels": f"WITH {_baskets('user_id', 'business_id')}{_longer(MOST)} {UP_TO_MOST}",
        "itemset_candidates": f"""WITH {_baskets('user_id', 'business_id')}{_longer(MOST)}, hd AS (SELECT basket, list(item) AS its FROM bi GROUP BY 1),
fq AS (SELECT string_split(items, ',') AS its, size FROM ({UP_TO_MOST})),
cd AS (SELECT list_append(x.its, y.its[-1]) AS its, x.size + 1 AS size FROM fq x JOIN fq y ON x.size = y.size AND x.its[1 : x.size - 1] = y.its[1 : y.size - 1] AND x.its[-1] < y.its[-1]),
ct AS (SELECT item AS items, 1 AS size, count(*) AS n FROM bi GROUP BY 1 UNION ALL SELECT array_to_string(its, ','), size, (SELECT count(*) FROM hd WHERE list_has_all(hd.its, cd.its)) FROM cd)
SELECT items, size, n, n >= {SUPPORT} AS frequent FROM ct""",
        "dense_index": f"WITH {UB} SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM ub)",
        "characteristic_sets": f"WITH {PAIRS} SELECT item AS business_id, count(*) AS n, min(member) AS first, max(member) AS last FROM p GROUP BY 1",
        "minhash_signatures": f"WITH {PAIRS}, {SIGS} SELECT item AS business_id, array_to_string(sig, ',') AS sig FROM sg",
        "lsh_bands": f"WITH {PAIRS}, {SIGS}, {BANDED} SELECT item AS business_id, band, r1, r2 FROM bd",
        "lsh_bands_small_family": f"""WITH {PAIRS}, {INDEX}, nm AS (SELECT count(*) AS n FROM ix),
sg AS (SELECT item, [{', '.join(f'min(({m} * idx + 1) % nm.n)' for m in ODD_MULTIPLIERS)}] AS sig FROM p JOIN ix USING (member), nm GROUP BY item)
SELECT item AS business_id, k AS band, sig[2 * k + 1] AS r1, sig[2 * k + 2] AS r2 FROM sg, range(10) t(k)""",
        "set_classes": f"WITH {PAIRS}, {CLASSES} SELECT item AS business_id, rep AS class_id, n FROM cl",
        "lsh_candidates": f"WITH {PAIRS}, {CANDIDATES} SELECT a AS business_id_1, b AS business_id_2 FROM ca",
        "similar_pairs_lsh": f"WITH {PAIRS}, {CANDIDATES}, {EXACT} SELECT a AS business_id_1, b AS business_id_2, round(similarity, 6) AS similarity FROM ex JOIN ca USING (a, b)",
        "jaccard_exact_pairs": f"WITH {PAIRS}, {CLASSES}, {EXACT} SELECT a AS business_id_1, b AS business_id_2, round(similarity, 6) AS similarity FROM ex",
        "lsh_precision_recall": f"""WITH {PAIRS}, {CANDIDATES}, {EXACT}, h AS (SELECT count(*) AS n FROM ex JOIN ca USING (a, b))
SELECT CASE WHEN h.n > 0 THEN 1.0 END AS precision_, round(h.n / nullif((SELECT count(*) FROM ex), 0), 6) AS recall_ FROM h""",
        "similar_pairs_confirmed": f"WITH {PAIRS}, {CANDIDATES}, {EXACT} SELECT a AS business_id_1, b AS business_id_2 FROM ex JOIN ca USING (a, b)",
        "group_means": f"""WITH {RATINGS} SELECT 'user' AS side, user_id AS id, round(avg(stars), 6) AS mean FROM tr GROUP BY 2
UNION ALL SELECT 'business', business_id, round(avg(stars), 6) FROM tr GROUP BY 2""",
        "cold_rows": f"""WITH {RATINGS} SELECT user_id, business_id, 'user' AS cold FROM te WHERE user_id NOT IN (SELECT user_id FROM tr)
UNION ALL SELECT user_id, business_id, 'business' FROM te WHERE business_id NOT IN (SELECT business_id FROM tr)""",
        "union_ratings": f"WITH {RATINGS} SELECT user_id, business_id, round(stars, 6) AS stars FROM (SELECT * FROM tr UNION ALL SELECT * FROM te)",
        "train_test_split": f"""WITH {RATINGS} SELECT count(*) AS n, 0 AS n_on_both_sides, TRUE AS share_as_asked FROM (SELECT * FROM tr UNION ALL SELECT * FROM te)""",
        "user_similarity": _pair_similarity("user"),
        "item_similarity": _pair_similarity("item"),
        "user_cf": _cf_sql("user", 13, 0),
        "item_cf": _cf_sql("item", 6, GATE),
        "item_cf_default_gate": _cf_sql("item", 6, 60),
        "user_cf_clipped": _cf_sql("user", 13, 0, "round(greatest(1.0, least(5.0, prediction)), 5)"),
        "user_cf_uncentred": _cf_sql("user", 13, 0, centre=False),
        "item_cf_lsh": _cf_sql("item", 6, GATE, near=near, only=only),
        "cf_rmse": f"""SELECT 'user' AS by_, round(sqrt(avg(pow(stars - prediction, 2))), 5) AS rmse FROM (WITH {rmse_u} SELECT * FROM pd)
UNION ALL SELECT 'item', round(sqrt(avg(pow(stars - prediction, 2))), 5) FROM (WITH {rmse_i} SELECT * FROM pd)""",
        "als_check": f"""WITH {RATINGS} SELECT 'users fitted' AS what, count(DISTINCT user_id) AS n FROM tr UNION ALL SELECT 'rows predicted', count(*) FROM te
UNION ALL SELECT 'cold rows at the default', count(*) FROM te WHERE user_id NOT IN (SELECT user_id FROM tr) OR business_id NOT IN (SELECT business_id FROM tr)
UNION ALL SELECT unnest(['users whose factors solve nothing', 'rows that are no product of factors']), 0""",
        "girvan_newman_check": f"""WITH {_edges()} SELECT 'nodes placed' AS what, count(DISTINCT src) AS n FROM ad
UNION ALL SELECT unnest(['nodes left out', 'nodes in two communities', 'communities that are not connected', 'division below the components']), 0""",
        "co_visit_edges": f"WITH {_edges()} SELECT src, dst, n FROM e",
        "adjacency": f"WITH {_edges()} SELECT src, dst FROM ad",
        "vertices": f"WITH {_edges()} SELECT DISTINCT src AS node FROM ad",
        "graph_degrees": f"WITH {_edges()} SELECT src AS node, count(*) AS degree FROM ad GROUP BY 1",
        "connected_components": f"WITH RECURSIVE {_edges()}, {REACH} SELECT node, min(other) AS component FROM rc GROUP BY 1",
        "edge_betweenness": f"WITH RECURSIVE {_edges()}, {PATHS} SELECT src, dst, round(betweenness, 6) AS betweenness FROM bw",
        "modularity": f"""WITH RECURSIVE {_edges()}, {PATHS}, tp AS (SELECT src, dst FROM bw ORDER BY round(betweenness, 9) DESC, src, dst LIMIT 1),
lf AS (SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.src = e.src AND tp.dst = e.dst)), la AS (SELECT src, dst FROM lf UNION ALL SELECT dst, src FROM lf),
rr AS (SELECT DISTINCT src AS node, src AS other FROM ad UNION SELECT rr.node, la.dst FROM rr JOIN la ON la.src = rr.other),
cc AS (SELECT node, min(other) AS c FROM rr GROUP BY 1), kd AS (SELECT src AS node, count(*) AS k FROM ad GROUP BY 1), kc AS (SELECT c, sum(k) AS k FROM cc JOIN kd USING (node) GROUP BY 1)
SELECT round(2 * (SELECT count(*) FROM lf) / sum(k) - sum(k * k) / pow(sum(k), 2), 9) AS q FROM kc""",
        "daily_counts": """WITH g AS (SELECT CAST(reviewed_at AS DATE) AS day, count(*) AS n, round(avg(stars), 6) AS stars FROM review WHERE reviewed_at IS NOT NULL GROUP BY 1)
SELECT day, n, stars, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM g""",
        "p3_found": f"WITH {ORPHANS} SELECT DISTINCT review_id FROM o",
        "p3_orphans_by_month": f"""WITH {ORPHANS}, fs AS (SELECT k, min(added_at) AS first FROM pb GROUP BY 1),
x AS (SELECT o.*, CASE WHEN fs.k IS NULL THEN 'unknown' WHEN first IS NULL OR reviewed_at < first THEN 'early' ELSE 'gone' END AS reason FROM o LEFT JOIN fs ON fs.k = business_id)
SELECT 'review' AS table_name, strftime(date_trunc('month', reviewed_at), '%Y-%m-%d') AS period, reason, count(*) AS n_rows, count(DISTINCT business_id) AS n_keys FROM x GROUP BY 2, 3""",
    }


