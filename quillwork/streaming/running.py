"""The same statistics over a stream of reviews, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.keys import clean_key
from quillwork.operators.stats import business_states

LATE = "30 days"


def fresh_reviews(reviews: DataFrame, late: str = LATE) -> DataFrame:
    """Reviews delivered twice come out once; those later than the watermark are dropped, as are those without a time. A
    time without zone is one of the session's zone."""
    return reviews.filter("reviewed_at is not null").withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp")).withWatermark("reviewed_at", late).dropDuplicatesWithinWatermark(["review_id"])


def running_state_average(reviews: DataFrame, business: DataFrame, late: str = LATE) -> DataFrame:
    """(state, stars, n) so far, for output in update or complete mode. ``business`` is a table, joined to each batch."""
    rows = fresh_reviews(reviews, late).select(clean_key("business_id").alias("business_id"), "stars").filter("stars is not null")
    return rows.join(business_states(business), "business_id").groupBy("state").agg(F.avg("stars").alias("stars"), F.count(F.lit(1)).alias("n"))


def reviews_by_window(reviews: DataFrame, window: str = "1 day", late: str = LATE) -> DataFrame:
    """(start, n, stars) of each window, final once the watermark has passed it."""
    rows = fresh_reviews(reviews, late)
    return rows.groupBy(F.window("reviewed_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("stars").alias("stars")).select(F.col("w.start").alias("start"), "n", "stars")
