"""Keys that hold so many rows that one task would get too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES = 4  # a key is heavy from this part of a task's fair share on
MOST_TASKS = 4096  # heavy keys are looked for as if there were at most so many tasks
SALTS = 16


def n_tasks(spark: SparkSession) -> int:
    """Tasks that share a shuffle."""
    return max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_rows(spark: SparkSession, n_rows: int) -> int:
    """From so many rows on a key is heavy; no more than PIECES * tasks keys can be."""
    return max(2, -(-n_rows // (PIECES * min(MOST_TASKS, n_tasks(spark)))))


def heavy_keys(df: DataFrame, key: str) -> list:
    """The heavy values of a column, found in one scan by a frequency sketch of bounded size that partial aggregation
    merges; at most PIECES * MOST_TASKS. The sketch misses none; a light key among them does no harm."""
    most = PIECES * min(MOST_TASKS, n_tasks(df.sparkSession))
    row = df.agg(F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {16 * most})").alias("top")).first()
    least = heavy_rows(df.sparkSession, row.n)
    return [x["item"] for x in row.top or [] if x["item"] is not None and x["count"] >= least]


def is_any(key: Column, values: list) -> Column:
    return key.isin(values) if values else F.lit(False)


def salted(df: DataFrame, key: str, heavy: list, spread: list[str], salts: int = SALTS) -> DataFrame:
    """With ``_salt``: 0 for light keys, one of ``salts`` numbers, by the hash of ``spread``, for rows of heavy ones."""
    return df.withColumn("_salt", F.when(is_any(F.col(key), heavy), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))


def replicated(df: DataFrame, key: str, heavy: list, salts: int = SALTS) -> DataFrame:
    """The other side of a join with ``salted``: rows of heavy keys once a salt."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return df.withColumn("_salt", F.explode(F.when(is_any(F.col(key), heavy), every).otherwise(F.array(F.lit(0)))))


def with_facts(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row a key. Rows of heavy keys stay where they lie: the facts of those few keys are
    broadcast, at most PIECES * MOST_TASKS rows; all other rows are joined by shuffling."""
    heavy = heavy_keys(df, key)
    if not heavy:
        return df.join(facts, key, "left")
    here = is_any(F.col(key), heavy)
    light = df.filter(~here | F.col(key).isNull()).join(facts, key, "left")
    return light.unionByName(df.filter(here).join(F.broadcast(facts.filter(here)), key, "left"))
