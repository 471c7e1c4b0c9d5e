import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillwork.llm import setjoin

S = "k string, t string, n int, id string, side int, level int"


def table(rows, sets):
    return rows(S, [(k, str(t), 1, "x", 5, 9) for k, v in sets.items() for t in v])


def brute(a, b, t, least, same):
    a = {k: v for k, v in a.items() if len(v) >= least}
    b = {k: v for k, v in b.items() if len(v) >= least}
    return {(x, y) for x in a for y in b if (not same or x < y) and len(a[x] & b[y]) >= t * len(a[x] | b[y]) - 1e-9}


def run(df, t, least, right=None):
    return {(r.key_1, r.key_2): r.similarity for r in setjoin.similar_set_pairs(df, "k", "t", t, least, right).collect()}


def family(seed, n=60, universe=40, top=14):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        if out and r.random() < 0.5:
            base = set(r.choice(list(out.values())))
            for _ in range(r.randint(0, 4)):
                base ^= {r.randrange(universe)}
        else:
            base = set(r.sample(range(universe), r.randint(1, top)))
        out[f"s{i:03}"] = (base | ({0} if r.random() < 0.6 else set())) or {1}
    return out


@pytest.mark.parametrize(("t", "least", "seed"), [(0.5, 1, 1), (0.5, 5, 2), (0.8, 1, 3), (0.34, 2, 4), (1.0, 1, 5)])
def test_against_brute_force(rows, t, least, seed):
    sets = family(seed)
    assert set(run(table(rows, sets), t, least)) == brute(sets, sets, t, least, True)


def test_few_tokens_and_large_sets(rows):
    sets = family(6, n=40, universe=8, top=7) | {f"big{i}": set(range(i, 300 + 40 * i)) for i in range(5)}
    assert set(run(table(rows, sets), 0.5, 1)) == brute(sets, sets, 0.5, 1, True)


def test_two_tables(rows):
    a, b = family(7), family(8)
    assert set(run(table(rows, a), 0.5, 2, table(rows, b))) == brute(a, b, 0.5, 2, False)


def test_dirty(rows):
    df = rows(S, [(k, t, None, None, None, None) for k, t in [("a", "1"), (" a", "1 "), ("a", "2"), ("b", "2"), ("b", "1"), (None, "1"), ("", "1"), ("c", None), ("c", ""), ("c", "")]])
    assert run(df, 0.5, 1) == {("a", "b"): 1.0}
    assert run(rows(S), 0.5, 1) == {}
    assert run(df, 0.5, 1, rows(S)) == {}
    with pytest.raises(ValueError):
        setjoin.similar_set_pairs(df, "k", "t", 0.0)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.integers(0, 9), min_size=1), min_size=2, max_size=12), st.sampled_from([0.5, 0.6, 0.75]))
def test_property(rows, found, t):
    sets = {f"k{i:02}": s for i, s in enumerate(found)}
    assert set(run(table(rows, sets), t, 1)) == brute(sets, sets, t, 1, True)
