"""Consolidating pairwise matches into groups: union-find in edge partitions, spanning forests merged level by level.

A level shuffles the edges into partitions of bounded size; each keeps the spanning forest of what it holds and no
more. A node that is nowhere the root of a tree then hangs under one root for good and leaves the graph; its other
roots are linked to that one. What remains are links between roots, so the graph shrinks from level to level, until
one partition holds it and its forest is the global one. Labels are handed back down the levels.

Roots are chosen by a hash that changes with the level, so neither chains nor hubs keep the graph from shrinking.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillwork.functions.durable import release, written
from quillwork.functions.skew import heavy_keys, replicated, salted

BOUND = 1_000_000  # nodes one task holds at a time; about 250 MB of Python memory with keys of 22 characters
MAX_LEVELS = 60


class Forest:
    """Union-find over at most ``bound`` nodes (two more at a time); the root of a tree is its node of smallest
    (hash, key)."""

    def __init__(self, bound: int):
        self.bound, self.codes, self.names, self.rank, self.up = bound, {}, [], [], []

    def __len__(self) -> int:
        return len(self.names)

    def _code(self, name, rank: int) -> int:
        code = self.codes.get(name)
        if code is None:
            code = self.codes[name] = len(self.names)
            self.names.append(name)
            self.rank.append(rank)
            self.up.append(code)
        return code

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a, b, rank_a: int, rank_b: int) -> None:
        x, y = self.root(self._code(a, rank_a)), self.root(self._code(b, rank_b))
        if x != y:
            if (self.rank[x], self.names[x]) < (self.rank[y], self.names[y]):
                self.up[y] = x
            else:
                self.up[x] = y

    @property
    def full(self) -> bool:
        return len(self.names) >= self.bound

    def edges(self) -> tuple[list, list, list, list]:
        """(node, root, rank of each): every node under its root; one that is alone under itself."""
        roots = [self.root(x) for x in range(len(self.names))]
        parents = {r for x, r in enumerate(roots) if x != r}
        keep = [(x, r) for x, r in enumerate(roots) if x != r or x not in parents]
        return tuple(map(list, zip(*((self.names[x], self.names[r], self.rank[x], self.rank[r]) for x, r in keep)))) if keep else ([], [], [], [])


def _forests(edges: DataFrame, level: int, bound: int) -> DataFrame:
    """(node, root, h, hr): the spanning forests of each partition of (a, b), one after the other if it holds more than
    ``bound`` nodes."""
    kind, arrow = edges.schema["a"].dataType.simpleString(), to_arrow_type(edges.schema["a"].dataType)
    ranked = edges.select("a", "b", F.xxhash64(F.lit(level), "a").alias("ha"), F.xxhash64(F.lit(level), "b").alias("hb"))

    def out(forest: Forest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(forest.edges(), (arrow, arrow, pa.int64(), pa.int64()))], names=["node", "root", "h", "hr"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(bound)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                forest.add(*row)
                if forest.full:
                    yield out(forest)
                    forest = Forest(bound)
        if len(forest):
            yield out(forest)

    return ranked.mapInArrow(work, f"node {kind}, root {kind}, h long, hr long")


def _by_root(rows: DataFrame, facts: DataFrame, key: str, how: str) -> DataFrame:
    """Rows with what is known of their root, one row a root; rows of a heavy root are spread over several tasks."""
    heavy = heavy_keys(rows, "root")
    return salted(rows, "root", heavy, [key]).join(replicated(facts, "root", heavy), ["root", "_salt"], how).drop("_salt")


def match_groups(matches: DataFrame, a: str, b: str, bound: int = BOUND) -> DataFrame:
    """(group_id, member): every key of a match with the smallest key of all that it is linked to, directly or not.

    Matches with a null key are dropped; repeats and both directions make no difference; a key matched only to itself
    is a group of one; an empty table gives no rows; other columns are ignored. Each input partition is cut to its
    spanning forests where it lies; no task ever holds more than ``bound`` nodes, at any size.
    """
    spark = matches.sparkSession
    edges = matches.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    forest = written(_forests(edges, 0, bound))
    alone = forest.filter("node = root").select(F.col("node").alias("member"), F.lit(None).cast(forest.schema["root"].dataType).alias("root"))
    settled = []  # of each level, nodes that left the graph, each under one root
    edges = forest.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    for level in range(1, MAX_LEVELS):
        parts = -(-edges.count() // max(1, bound // 2))
        if parts <= 1:  # fewer edges than ``bound`` nodes in one partition: this forest is the global one
            break
        stored = written(_forests(edges.repartition(parts, "a", "b"), level, bound))
        forest = stored.filter("node <> root")
        first = forest.groupBy("node").agg(F.min_by("root", F.struct("hr", "root")).alias("first"))
        roots = forest.select(F.col("root").alias("node"), F.lit(True).alias("is_root")).distinct()
        placed = written(first.join(roots, "node", "left"))
        settled.append(placed.filter("is_root is null").select("node", F.col("first").alias("root")))
        others = forest.join(placed.select("node", "first"), "node").filter("root <> first").select(F.col("root").alias("a"), F.col("first").alias("b"))
        edges = written(others.union(placed.filter("is_root").select("node", "first")).distinct())
        release(stored)
    else:
        raise RuntimeError(f"the graph did not fit one partition after {MAX_LEVELS} levels")
    named = written(_forests(edges.coalesce(1) if settled else edges.repartition(1), MAX_LEVELS, bound).filter("node <> root").select("node", "root"))
    for under in reversed(settled):
        above = named.select(F.col("node").alias("root"), F.col("root").alias("top"))
        named = written(named.union(_by_root(under, above, "node", "left").select("node", F.coalesce("top", "root").alias("root"))))
    roots = named.select(F.col("root").alias("member"), F.lit(None).cast(named.schema["root"].dataType).alias("root")).distinct()
    every = named.select(F.col("node").alias("member"), "root").union(roots).union(alone)
    once = written(every.groupBy("member").agg(F.coalesce(F.max("root"), "member").alias("root")))
    least = once.groupBy("root").agg(F.min("member").alias("group_id"))
    return _by_root(once, least, "member", "inner").select("group_id", "member")
