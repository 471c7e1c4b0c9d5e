"""Distinct counts over huge identifier sets, by hash ranges.

An identifier always falls into the same hash bucket, so buckets share none and their counts add up. A partial result
is a table of distinct (bucket, identifier, group columns) rows: partials of two loads are merged by ``merge``, and
counts of any combination of the group columns follow exactly (error bound 0) from the merged table, bucket by bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.skew import heavy_keys, is_any, n_tasks

BUCKETS = 1024  # at least; on a larger cluster enough that tasks get equal parts
BUCKETS_A_TASK = 16


def _in_buckets(rows: DataFrame) -> DataFrame:
    """The only shuffle of the identifiers: by bucket; repeats vanish within."""
    buckets = max(BUCKETS, BUCKETS_A_TASK * n_tasks(rows.sparkSession))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).repartition("bucket").dropDuplicates()


def partial(df: DataFrame, field: str, identifier: Column, groups: list[str], heavy: list | None = None) -> DataFrame:
    """(field, id, *groups, bucket), distinct. Null identifiers are dropped. Rows of an identifier that holds a large
    part of them are folded before the shuffle; ``heavy`` names those, or they are looked for in a scan of their own."""
    rows = df.select(F.lit(field).alias("field"), identifier.cast("string").alias("id"), *groups).filter("id is not null")
    heavy = heavy_keys(rows, "id") if heavy is None else heavy
    if heavy:
        rows = rows.filter(~is_any(F.col("id"), heavy)).union(rows.filter(is_any(F.col("id"), heavy)).distinct())
    return _in_buckets(rows)


def merge(*partials: DataFrame) -> DataFrame:
    """One partial result of several, wherever they were made or stored."""
    return _in_buckets(reduce(DataFrame.unionByName, [p.drop("bucket") for p in partials]))


def counts(partials: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(grouping, *all group columns, field, n): distinct identifiers of each named combination of group columns.

    A row counts in a combination only if all its columns are known. Identifiers stay in the buckets of the partial
    result; what is shuffled is one count a bucket and group.
    """
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    kinds = {f.name: f.dataType for f in partials.schema}
    views = F.array(*[F.struct(F.lit(name).alias("grouping"), *[(F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in columns]) for name, s in sets.items()])
    known = reduce(lambda a, b: a | b, [(F.col("v.grouping") == name) & reduce(lambda x, y: x & y, [F.col(f"v.{c}").isNotNull() for c in s], F.lit(True)) for name, s in sets.items()])
    rows = partials.select("field", "bucket", "id", F.explode(views).alias("v")).filter(known).select("field", "bucket", "id", "v.*")
    per_bucket = rows.dropDuplicates().groupBy("field", "bucket", "grouping", *columns).agg(F.count(F.lit(1)).alias("c"))
    return per_bucket.groupBy("grouping", *columns, "field").agg(F.sum("c").alias("n"))
