"""Descriptive statistics of reviews.

Nulls are never counted as a value; an empty table gives zero counts and null maxima. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.keys import clean_key, clean_state, text_length


def useful_count() -> Column:
    return F.count_if(F.col("useful") > 0)


def five_star_count() -> Column:
    return F.count_if(F.col("stars") == 5.0)


def longest_text() -> Column:
    return F.max(text_length("text"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """One row with the exact number of distinct keys (null for none is not counted)."""
    return df.select(clean_key(key).alias("k")).agg(F.count_distinct("k").alias("n"))


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key; partial counts are built before the shuffle, so a hot key costs one row a task."""
    return df.select(clean_key(key).alias(key)).dropna().groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_keys(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent keys; ties go to the smaller key."""
    return rows_per_key(df, key).orderBy(F.desc("n"), key).limit(n)


def summary(df: DataFrame, n: int = 20) -> DataFrame:
    """All seven statistics as one row. The scalar ones share a single scan of the narrow columns."""
    users, businesses = rows_per_key(df, "user_id"), rows_per_key(df, "business_id")

    def ranked(counts: DataFrame, key: str, name: str) -> DataFrame:
        top = counts.orderBy(F.desc("n"), key).limit(n)
        return top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k")))).alias("a")).select(
            F.to_json(F.transform("a", lambda x: F.array(x.k, (-x.m).cast("string")))).alias(name)
        )

    parts = [
        df.agg(useful_count().alias("n_useful"), five_star_count().alias("n_five_star"), longest_text().alias("longest")),
        users.agg(F.count(F.lit(1)).alias("n_users")),
        ranked(users, "user_id", "top_users"),
        businesses.agg(F.count(F.lit(1)).alias("n_businesses")),
        ranked(businesses, "business_id", "top_businesses"),
    ]
    names = [c for p in parts for c in p.columns]
    # each part is one row with columns of its own; folding them needs no join
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).agg(*[F.max(c).alias(c) for c in names])


def business_states(business: DataFrame) -> DataFrame:
    """One state a business: that of its latest row (by ``added_at``, then ``loaded_at``, then code) with a state.
    ``added_at`` and ``loaded_at`` may be missing from the table."""
    order = [F.col(c) for c in ("added_at", "loaded_at") if c in business.columns]
    rows = business.select(clean_key("business_id").alias("business_id"), clean_state("state").alias("state"), *order).dropna(subset=["business_id", "state"])
    return rows.groupBy("business_id").agg(F.max_by("state", F.struct(*order, "state")).alias("state"))


def state_average(review: DataFrame, business: DataFrame) -> DataFrame:
    """Mean stars of each state over reviews of known businesses, sorted by mean (descending), then state.

    Reviews are first folded to (sum, count) by business: a business with a third of all reviews joins as one row.
    """
    by_business = (
        review.select(clean_key("business_id").alias("business_id"), "stars")
        .dropna()
        .groupBy("business_id")
        .agg(F.sum("stars").alias("s"), F.count("stars").alias("c"))
    )
    return (
        by_business.join(business_states(business), "business_id")
        .groupBy("state")
        .agg((F.sum("s") / F.sum("c")).alias("stars"))
        .orderBy(F.desc("stars"), "state")
    )


def daily_counts(review: DataFrame) -> DataFrame:
    """Reviews and mean stars by day, with the running total; days are few, so one window holds them."""
    days = review.filter("reviewed_at is not null").groupBy(F.to_date("reviewed_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("stars").alias("stars"))
    return days.withColumn("total", F.sum("n").over(Window.orderBy("day")))
