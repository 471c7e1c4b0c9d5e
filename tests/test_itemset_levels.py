import itertools
import random

from quillwork.operators import itemsets


def test_levels_against_brute_force(rows):
    r = random.Random(1)
    baskets = {f"k{i}": {x for x in "abcdefg" if r.random() < 0.5} for i in range(30)}
    df = rows("basket string, item string", [(k, x) for k, items in baskets.items() for x in sorted(items)] * 2)
    got = {tuple(x["items"]): (x["n"], x["size"], x["frequent"]) for x in itemsets.itemset_levels(df, 6).collect()}
    count = lambda c: sum(set(c) <= b for b in baskets.values())
    want, level = {}, [(x,) for x in "abcdefg"]
    while level:
        want |= {c: (count(c), len(c), count(c) >= 6) for c in level}
        good = sorted(c for c in level if count(c) >= 6)
        level = [a + b[-1:] for a, b in itertools.combinations(good, 2) if a[:-1] == b[:-1]]
    assert got == want and max(map(len, want)) > 3
    frequent = {tuple(x["items"]): x["n"] for x in itemsets.frequent_itemsets(df, 6).collect()}
    assert frequent == {c: n for c, (n, _, f) in want.items() if f}


def test_levels_of_nothing(rows):
    assert itemsets.itemset_levels(rows("basket string, item string"), 2).count() == 0
