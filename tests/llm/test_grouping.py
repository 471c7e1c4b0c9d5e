import random

import pytest

from quillwork.llm import grouping

M = "a string, b string, node string, root int"


def groups(rows, pairs, parts=5, **kw):
    df = rows(M, [(x, y, "c", 1) for x, y in pairs]).repartition(parts)
    got = grouping.match_groups(df, "a", "b", **kw).collect()
    assert len(got) == len({r.member for r in got})
    return {r.member: r.group_id for r in got}


def plain(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_random_graph_both_ways(rows, bound):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(90)] + [("hub", f"h{i}") for i in range(40)]
    assert groups(rows, pairs, bound=bound) == plain(pairs)


@pytest.mark.parametrize("bound", [1_000_000, 10])
def test_chain_self_and_nulls(rows, bound):
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("z", "z"), (None, "q"), ("q2", None), ("y", "x"), ("x", "y"), ("x", "y"), ("é", "Z")]
    got = groups(rows, pairs, bound=bound)
    assert got == {**{f"{i:03}": "000" for i in range(61)}, "z": "z", "x": "x", "y": "x", "é": "Z", "Z": "Z"}


def test_empty(rows):
    assert groups(rows, []) == {} and groups(rows, [(None, None)]) == {}


@pytest.mark.parametrize("bound", [1_000_000, 4])
def test_self_match_linked_in_another_partition(rows, bound):
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(30)] + [(f"{i:03}", f"{i:03}") for i in range(31)] + [("z", "z"), ("z", "z")]
    df = rows(M, [(x, y, "c", 1) for x, y in pairs]).repartition(6)
    got = sorted((r.member, r.group_id) for r in grouping.match_groups(df, "a", "b", bound=bound).collect())
    assert got == [(f"{i:03}", "000") for i in range(31)] + [("z", "z")]


def test_a_task_never_holds_more_than_the_bound():
    r, forest, held = random.Random(5), grouping.Forest(10_000), []
    for i in range(60_000):
        forest.add(f"a{r.randrange(10**9)}", f"b{i}", r.randrange(10**9), r.randrange(10**9))
        held.append(len(forest))
        if forest.full:
            forest = grouping.Forest(10_000)
    assert max(held) <= 10_001 and held.count(2) > 10


@pytest.mark.parametrize("shape", ["chain", "star", "random", "two hubs"])
def test_many_levels(rows, shape):
    r, n = random.Random(6), 3000
    pairs = {
        "chain": [(f"{i:05}", f"{i + 1:05}") for i in range(n)], "star": [("m", f"{i:05}") for i in range(n)],
        "random": [(f"{r.randrange(n):05}", f"{r.randrange(n):05}") for _ in range(n)], "two hubs": [(r.choice("xy"), f"{r.randrange(n):05}") for i in range(n)],
    }[shape]
    assert groups(rows, pairs, parts=7, bound=200) == plain(pairs)
