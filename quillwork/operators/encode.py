"""Dense numbers for keys, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.durable import written

_OFFSET = 33  # monotonically_increasing_id keeps the row of a partition in the lower 33 bits


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Each distinct non-null key with its rank (from 0) in code-point order.

    A range sort spreads the keys; each partition numbers its own rows and adds the size of those before it. The
    broadcast holds one row a partition. The keys are a table as of ``written``, which ``release`` removes.
    """
    rows = written(df.select(key).dropna().distinct().orderBy(key).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _OFFSET)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c")).collect()  # one row a partition
    start, offsets = 0, []
    for r in sorted(sizes):
        offsets.append((r["_p"], start))
        start += r["_c"]
    table = df.sparkSession.createDataFrame(offsets, "_p long, _o long")
    out = (
        rows.withColumn("_p", part)
        .join(F.broadcast(table), "_p")
        .select(key, (F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << _OFFSET) - 1))).alias(name))
    )
    out._written_to = rows._written_to
    return out
