"""Top N items within every group, groups of any size, one tie rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.durable import written
from quillwork.functions.skew import heavy_rows

SALTS = 64
RANGES = 32


def _top(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "item"))
    return df.withColumn("_k", place).filter(F.col("_k") <= n).drop("_k")


def top_items(df: DataFrame, group: str, item: str, score: str, n: int, heavy: int | None = None) -> DataFrame:
    """(group, item, score): the ``n`` items of each group with the highest score, at equal scores the smaller ones.

    Rows with a null group, item or score, or a score that is NaN, are dropped; a repeated (group, item) counts once,
    with its highest score; a group of fewer items keeps all; an empty table gives no rows; other columns are ignored.

    Groups are counted exactly; one of at least a quarter of a task's fair share of all rows (and of ``heavy`` rows, if
    given) is heavy, so there are at most four times as many heavy groups as tasks and they are broadcast. Light ones take an
    ordinary window. Heavy ones are cut into score ranges: ranges below the one that completes the first ``n`` are
    dropped, what is left is ranked by range and salt, then by group, so no task sorts a whole heavy group, not even
    one of equal scores.
    """
    rows = df.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).cast("double").alias("score")).dropna().filter(~F.isnan("score"))
    best = written(rows.groupBy("group", "item").agg(F.max("score").alias("score")))
    least = max(heavy or 0, heavy_rows(df.sparkSession, best.count()))
    hot = written(best.groupBy("group").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least).select("group"))
    light = _top(best.join(F.broadcast(hot), "group", "left_anti"), ["group"], n)
    heavies = best.join(F.broadcast(hot), "group")
    edges = heavies.groupBy("group").agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10_000).alias("edges"))
    placed = heavies.join(F.broadcast(edges), "group").select("group", "item", "score", F.size(F.filter("edges", lambda e: e < F.col("score"))).alias("range"))
    above = F.sum("c").over(Window.partitionBy("group").orderBy(F.desc("range"))) - F.col("c")  # as many rows as ranges
    kept = placed.groupBy("group", "range").agg(F.count(F.lit(1)).alias("c")).withColumn("above", above).filter(F.col("above") < n).select("group", "range")
    few = placed.join(F.broadcast(kept), ["group", "range"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    first = _top(few, ["group", "range", "salt"], n)
    return light.select("group", "item", "score").union(_top(first, ["group"], n).select("group", "item", "score")).toDF(group, item, score)
