"""Quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse(df: DataFrame, actual: str = "stars", predicted: str = "prediction") -> DataFrame:
    """One row: root of the mean squared error over rows where both are known; null for none."""
    return df.agg(F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2))).alias("rmse"))


def precision_recall(found: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """One row (precision, recall) of distinct found pairs against distinct true ones; null where nothing divides."""
    f, t = found.select(*keys).distinct(), truth.select(*keys).distinct()
    both = f.withColumn("f", F.lit(1)).join(t.withColumn("t", F.lit(1)), list(keys), "full_outer")
    hit, nf, nt = F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()), F.count("f"), F.count("t")
    return both.agg(F.try_divide(hit, nf).alias("precision"), F.try_divide(hit, nt).alias("recall"))


def common_rows(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct rows in both."""
    return found.intersect(truth)
