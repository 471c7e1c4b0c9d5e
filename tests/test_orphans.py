from datetime import datetime

import pytest

from quillwork.operators import orphans

CHILD = "id long, k string, at timestamp, since string, pkey string, keep_id int"
PARENT = "k string, since timestamp, until timestamp, at string, id string"


def day(n):
    return datetime(2024, 1, n)


CHILDREN = [
    (1, "a", day(5)), (2, " a ", day(1)), (3, "a", day(25)), (4, "zz", day(5)), (5, "zz", None), (6, "a", None), (7, None, day(5)), (8, "", day(5)), (9, "b", day(5)), (10, "a", day(20)), (11, "a", day(2)), (11, "a", day(1)), (12, "b", None),
]
PARENTS = [("a", day(2), day(10)), ("a", day(2), day(20)), (" a", day(28), None), ("b", None, None), (None, day(1), None), ("", day(1), None)]
WANT = {(2, "early"), (3, "gone"), (4, "unknown"), (5, "unknown"), (9, "early"), (10, "gone"), (11, "early")}


def run(rows, children, parents, **kw):
    c, p = rows(CHILD, [(*x, "s", "p", 1) for x in children]), rows(PARENT, [(*x, "s", "i") for x in parents])
    return orphans.orphan_references(c, p, "k", "k", "at", "since", "until", keep=("id",), **kw)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_cases(rows, limit):
    got = run(rows, CHILDREN, PARENTS, max_filter_bytes=limit)
    assert {(r.id, r.reason) for r in got.collect()} == WANT and got.count() == len(WANT)


def test_empty(rows):
    assert run(rows, [], PARENTS).count() == 0
    assert {r.reason for r in run(rows, CHILDREN, []).collect()} == {"unknown"} and run(rows, CHILDREN, []).count() == 11


def test_periods(rows):
    got = orphans.orphans_by_period(run(rows, [*CHILDREN, (4, "zz", day(5))], PARENTS), "child").collect()
    assert {(r.table_name, r.period, r.reason, r.n_rows, r.n_keys) for r in got} >= {("child", "2024-01-01", "unknown", 2, 1), ("child", None, "unknown", 1, 1)}


def test_filter_passes_every_key_and_stops_most_others(rows, spark):
    keys = spark.range(3000).selectExpr("cast(id as string) k")
    blocks = orphans.bloom_blocks(3000)
    bits = orphans.bloom_filter(keys, blocks)
    from pyspark.sql import functions as F

    tested = spark.range(6000).selectExpr("cast(id as string) k", "id").withColumn("_block", orphans._block(F.col("k"), blocks)).join(bits, "_block", "left").withColumn("y", orphans.passes(F.col("k")))
    assert tested.filter("id < 3000 and not y").count() == 0
    assert tested.filter("id >= 3000 and y").count() < 150


def test_a_heavy_key_is_verified_in_several_tasks(rows):
    children = [(i, "a" if i % 3 else f"k{i}", day(1 + i % 28)) for i in range(400)]
    want = {(i, "early" if d < day(2) else "gone") if k == "a" else (i, "unknown") for i, k, d in children if k != "a" or not (day(2) <= d < day(20) or d == day(28))}
    for limit in (64 << 20, 0):
        got = run(rows, children, PARENTS, max_filter_bytes=limit).collect()
        assert {(r.id, r.reason) for r in got} == want and len(got) == len(want)
