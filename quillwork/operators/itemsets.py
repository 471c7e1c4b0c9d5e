"""Frequent itemsets of market baskets."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.durable import written
from quillwork.functions.keys import keyed


def orient(df: DataFrame, case: int) -> DataFrame:
    """(basket, item) for case 1, baskets of a user's businesses, or 2, of a business's users."""
    if case not in (1, 2):
        raise ValueError(f"case is 1 or 2, not {case!r}")
    basket, item = ("user_id", "business_id") if case == 1 else ("business_id", "user_id")
    return keyed(df, "user_id", "business_id").select(F.col(basket).alias("basket"), F.col(item).alias("item"))


def basket_sizes(baskets: DataFrame) -> DataFrame:
    """Rows and distinct items of each basket, aggregated before the shuffle."""
    pairs = baskets.groupBy("basket", "item").agg(F.count(F.lit(1)).alias("c"))
    return pairs.groupBy("basket").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_items"))


def larger_baskets(baskets: DataFrame, k: int) -> DataFrame:
    """The rows of baskets with more than ``k`` rows, repeated ones counted."""
    big = basket_sizes(baskets).filter(F.col("n_rows") > k).select("basket")
    return baskets.join(big, "basket", "left_semi")


def frequent_singles(baskets: DataFrame, support: int) -> DataFrame:
    """Items in at least ``support`` different baskets."""
    return baskets.distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)


def frequent_itemsets(baskets: DataFrame, support: int) -> DataFrame:
    """(items sorted, n, size) of every itemset contained in at least ``support`` baskets.

    Baskets are cut to frequent items before they are gathered, so a basket holds at most as many items as can be
    frequent at all. Growth over conditional trees counts without listing the pairs of a basket. An empty table gives
    no rows; repeated rows count once.
    """
    pairs = baskets.distinct()
    kept = pairs.join(frequent_singles(baskets, support).select("item"), "item", "left_semi")
    arrays = written(kept.groupBy("basket").agg(F.collect_set("item").alias("items")))
    n = arrays.count()
    empty = baskets.sparkSession.createDataFrame([], "items array<string>, n long, size int")
    if n == 0:
        return empty
    # half a basket below the bound keeps rounding from dropping itemsets exactly at it
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(arrays).freqItemsets
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"), F.size("items").alias("size"))


def next_candidates(frequent: DataFrame) -> DataFrame:
    """(items, a, b) of the next size: every two frequent sets that differ in their last item only, joined on the rest."""
    left = frequent.select(F.col("items").alias("a"))
    right = frequent.select(F.col("items").alias("b"))
    head = lambda c: F.slice(c, 1, F.size(c) - 1)
    pairs = left.join(right, (head("a") == head("b")) & (F.element_at("a", -1) < F.element_at("b", -1)))
    return pairs.select(F.concat("a", F.array(F.element_at("b", -1))).alias("items"), "a", "b").distinct()


def candidate_baskets(candidates: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(items, basket) of each candidate: a basket holds it exactly if it holds both sets the candidate was made of."""
    a = occurrences.select(F.col("items").alias("a"), "basket")
    b = occurrences.select(F.col("items").alias("b"), "basket")
    return candidates.join(a, "a").join(b, ["b", "basket"]).select("items", "basket")


def itemset_levels(baskets: DataFrame, support: int) -> DataFrame:
    """(items, n, size, frequent) of every candidate, size by size: single items, then what ``next_candidates`` makes of
    the frequent sets of the size before, with the number of baskets that hold it (0 where none does).

    The plainer of two ways to the frequent itemsets: it also says what was tried. It keeps which baskets hold a
    frequent set, so it is meant for supports that leave few of them; ``frequent_itemsets`` is not.
    """
    single = baskets.distinct().select(F.array("item").alias("items"), "basket")
    held, size, parts = written(single), 1, []
    candidates = held.select("items").distinct()
    while True:
        counts = held.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
        level = written(candidates.select("items").join(counts, "items", "left").select("items", F.coalesce("n", F.lit(0)).alias("n"), F.lit(size).alias("size")).withColumn("frequent", F.col("n") >= support))
        parts.append(level)
        good = level.filter("frequent").select("items")
        if good.isEmpty():
            return reduce(DataFrame.union, parts)
        candidates = written(next_candidates(good))
        held, size = written(candidate_baskets(candidates, held.join(good, "items", "left_semi"))), size + 1


def itemset_candidates(baskets: DataFrame, support: int) -> DataFrame:
    """Every itemset that is tried, with its size: all items, and the joins of frequent sets."""
    return itemset_levels(baskets, support).select("items", "size")
