"""Registered itemset queries against brute force, with itemsets larger than their SQL lists."""

import itertools

from quillwork.plans import core_queries

BASKETS = {f"k{i}": "abcde" for i in range(3)} | {"k3": "abcf", "k4": "abf", "k5": "abf", "k6": "fg"}


def brute_force(baskets, support=3):
    counts = {}
    for items in baskets.values():
        for k in range(1, len(items) + 1):
            for c in itertools.combinations(sorted(items), k):
                counts[c] = counts.get(c, 0) + 1
    return {(",".join(c), len(c), n) for c, n in counts.items() if n >= support}


def found(spark, tmp_path, query, rows):
    spark.createDataFrame(rows, "user_id string, business_id string").write.parquet(f"{tmp_path}/user_business.parquet")
    return sorted((r["items"], r["size"], r["n"]) for r in core_queries.queries()[query](spark, str(tmp_path)).collect())


def test_itemsets_of_users_of_every_size(spark, tmp_path):
    want = brute_force(BASKETS)
    assert max(size for _, size, _ in want) == 5
    got = found(spark, tmp_path, "frequent_itemsets_of_users", [(u, b) for b, users in BASKETS.items() for u in users])
    assert got == sorted(want)


def test_itemsets_of_larger_baskets_of_every_size(spark, tmp_path):
    want = brute_force({u: items for u, items in BASKETS.items() if len(items) > 3})
    assert max(size for _, size, _ in want) == 5
    got = found(spark, tmp_path, "itemsets_of_larger_baskets", [(u, b) for u, items in BASKETS.items() for b in items])
    assert got == sorted(want)
