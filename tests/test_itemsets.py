import itertools
import random

import pytest

from quillwork.operators import itemsets

PAIRS = "user_id string, business_id string"


def baskets(rows, table):
    return itemsets.orient(rows(PAIRS, [(u, b) for u, items in table.items() for b in items]), 1)


def found(df):
    return {tuple(r["items"]): r["n"] for r in df.collect()}


def test_small(rows):
    got = found(itemsets.frequent_itemsets(baskets(rows, {"1": "abc", "2": "ab", "3": "ac", "4": "bc", "5": "abc"}), 3))
    assert got == {("a",): 4, ("b",): 4, ("c",): 4, ("a", "b"): 3, ("a", "c"): 3, ("b", "c"): 3}


def test_repeats_count_once(rows):
    df = rows(PAIRS, [("u1", "a"), ("u1", "a"), ("u2", " a "), (None, "a"), ("u3", "")])
    assert found(itemsets.frequent_itemsets(itemsets.orient(df, 1), 3)) == {}
    assert found(itemsets.frequent_itemsets(itemsets.orient(df, 1), 2)) == {("a",): 2}


def test_exact_threshold_and_brute_force(rows):
    r = random.Random(3)
    table = {str(i): r.sample("abcdefg", r.randint(1, 5)) for i in range(25)}
    want = {}
    for k in range(1, 6):
        for c in itertools.combinations("abcdefg", k):
            n = sum(set(c) <= set(v) for v in table.values())
            if n >= 7:
                want[c] = n
    assert found(itemsets.frequent_itemsets(baskets(rows, table), 7)) == want


def test_basket_filter_is_strict_and_counts_repeats(rows):
    df = rows(PAIRS, [("u", "a"), ("u", "a"), ("u", "b"), ("v", "a"), ("v", "b")])
    left = itemsets.larger_baskets(itemsets.orient(df, 1), 2)
    assert {r.basket for r in left.collect()} == {"u"}


def test_orientation(rows):
    df = rows(PAIRS, [("u", "a")])
    assert itemsets.orient(df, 2).first().basket == "a"
    with pytest.raises(ValueError):
        itemsets.orient(df, 3)
    assert itemsets.frequent_itemsets(itemsets.orient(rows(PAIRS), 1), 1).count() == 0
