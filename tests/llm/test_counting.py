import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillwork.llm import distinct, heavy, topn


def test_counter_keeps_its_promise():
    r = random.Random(1)
    data = [r.choice("ab") if r.random() < 0.5 else str(r.randrange(500)) for _ in range(5050)] + [None] * 50
    c = heavy.LossyCounter(0.01)
    for i in range(0, len(data), 77):
        c.add(pa.array(data[i : i + 77], pa.string()))
    true = Counter(x for x in data if x)
    assert c.rows == len(data) and len(c.entries) < 400
    for x, n in true.items():
        low, delta = c.entries.get(x, (0, c.bucket))
        assert low <= n <= low + delta and delta <= 0.01 * len(data)


def test_frequent_items(rows):
    r = random.Random(2)
    data = [("hot" if r.random() < 0.34 else r.choice(["x", "y"]) if r.random() < 0.1 else f"r{r.randrange(9000)}", r.choice("pq") if r.random() < 0.9 else None) for _ in range(6000)]
    df = rows("a string, b string, item string", [(*x, "no") for x in data]).repartition(7)
    cols = {"a": F.col("a"), "b": F.col("b")}
    got = {(x.field, x["item"]): x for x in heavy.frequent_items(df, cols, 0.02, 0.002).collect()}
    true = {("a", k): n for k, n in Counter(x for x, _ in data).items()} | {("b", k): n for k, n in Counter(y for _, y in data if y).items()}
    assert {k for k, n in true.items() if n >= 0.02 * 6000} <= set(got)
    for k, x in got.items():
        assert x.n_low <= true[k] <= x.n_high and x.n_high - x.n_low <= 0.002 * 6000 + 1 and x.n_rows == 6000
    exact = {(x.field, x["item"]): x.n for x in heavy.exact_counts(df, cols, heavy.frequent_items(df, cols, 0.02, 0.002)).collect()}
    assert exact == {k: true[k] for k in got}


def test_frequent_items_of_nothing(rows):
    df = rows("a string")
    assert heavy.frequent_items(df, {"a": F.col("a")}, 0.01).count() == 0
    assert heavy.frequent_items(rows("a string", [(None,)] * 5), {"a": F.col("a")}, 0.01).count() == 0


@pytest.mark.parametrize("limit", [None, 10_000, 20])
def test_top_items(rows, limit):
    r = random.Random(3)
    data = [(g, f"i{r.randrange(60):02}", r.choice([0.1, 0.5, 0.5, 0.9])) for g in "aaaaabc" for _ in range(40)]
    data += [("tie", f"t{i:02}", 1.0) for i in range(50)] + [("few", "x", 0.2), (None, "x", 1.0), ("few", None, 1.0), ("few", "y", None), ("few", "z", float("nan"))]
    best = {}
    for g, i, s in data:
        if g and i and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), -1))
    want = set()
    for g in {g for g, _ in best}:
        want |= {(g, i, s) for s, i in sorted(((s, i) for (h, i), s in best.items() if h == g), key=lambda x: (-x[0], x[1]))[:4]}
    df = rows("g string, i string, s double, score string, salt int", [(*x, "q", 0) for x in data])
    assert {tuple(x) for x in topn.top_items(df, "g", "i", "s", 4, heavy=limit).collect()} == want
    assert topn.top_items(df.limit(0), "g", "i", "s", 4, heavy=limit).count() == 0


def test_a_heavy_group_of_equal_scores_by_default(rows):
    data = [("hub", f"i{i:04}", 0.5) for i in range(900)] + [(f"g{i}", "x", 0.1) for i in range(600)]
    df = rows("g string, i string, s double", data).repartition(7)
    out = topn.top_items(df, "g", "i", "s", 5)
    got = {tuple(x) for x in out.collect()}
    assert got == {("hub", f"i{i:04}", 0.5) for i in range(5)} | {(f"g{i}", "x", 0.1) for i in range(600)}
    plan = out._jdf.queryExecution().toString()
    assert "percentile_approx" in plan and "salt" in plan


def test_distinct_counts_and_merging(rows, spark, tmp_path):
    r = random.Random(4)
    data = [(r.choice(["u", "v", "w", None]) or r.choice([None, "z"]), r.choice([1, 2, None]), r.choice(["A", "B", None])) for _ in range(300)]
    df = rows("id string, day int, state string", data)
    sets = {"day": ["day"], "both": ["day", "state"], "all": []}
    want = Counter()
    seen = {("all", None, None, i) for i, _, _ in data if i} | {("day", d, None, i) for i, d, _ in data if i and d} | {("both", d, s, i) for i, d, s in data if i and d and s}
    for g, d, s, _ in seen:
        want[g, d, s] += 1
    a, b = df.filter("day = 1"), df.filter("day = 2 or day is null")
    part = lambda x: distinct.partial(x, "id", F.col("id"), ["day", "state"])
    for p in (part(df), distinct.merge(part(a), part(b), part(a))):
        got = {(x.grouping, x.day, x.state): x.n for x in distinct.counts(p, sets).collect()}
        assert got == dict(want)
    part(a).write.parquet(str(tmp_path / "a"))
    part(b).write.parquet(str(tmp_path / "b"))
    again = distinct.merge(*(spark.read.parquet(str(tmp_path / x)) for x in "ab"))
    assert {(x.grouping, x.day, x.state): x.n for x in distinct.counts(again, sets).collect()} == dict(want)
    assert distinct.counts(part(df.limit(0)), sets).count() == 0
