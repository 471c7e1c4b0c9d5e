"""Most frequent values in bounded memory, by lossy counting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.durable import written

ERROR = 0.001
SUMMARY = "field string, item string, n long, delta long, bound long, n_rows long"


class LossyCounter:
    """Counts of one stream. An entry (n, delta) has occurred n to n + delta times; one that isn't held, at most
    ``bucket`` times. At most (1 / error) * log(error * rows) entries are held."""

    def __init__(self, error: float):
        self.width, self.rows, self.bucket, self.entries = math.ceil(1 / error), 0, 0, {}

    def add(self, values: pa.Array) -> None:
        while len(values):
            room = self.width - self.rows % self.width
            part, values = values[:room], values[room:]
            self.rows += len(part)
            for x in pc.value_counts(part.drop_null()).to_pylist():
                n, delta = self.entries.get(x["values"], (0, self.bucket))
                self.entries[x["values"]] = n + x["counts"], delta
            if self.rows % self.width == 0:
                self.bucket += 1
                self.entries = {k: v for k, v in self.entries.items() if v[0] + v[1] > self.bucket}


def summaries(df: DataFrame, columns: dict[str, Column], error: float = ERROR) -> DataFrame:
    """One summary a partition and field, without a shuffle: rows (field, item, n, delta, bound, n_rows); the row with
    a null item carries the partition's bound and number of rows."""
    names = list(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [LossyCounter(error) for _ in names]
        for batch in batches:
            for c, values in zip(counters, batch.columns):
                c.add(values)
        for name, c in zip(names, counters):
            rows = [(None, 0, 0, c.rows)] + [(k, n, d, 0) for k, (n, d) in c.entries.items()]
            item, n, delta, total = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array(item, pa.string()), pa.array(n, pa.int64()), pa.array(delta, pa.int64()), pa.array([c.bucket] * len(rows), pa.int64()), pa.array(total, pa.int64())],
                names=["field", "item", "n", "delta", "bound", "n_rows"],
            )

    return df.select(*[c.cast("string").alias(n) for n, c in columns.items()]).mapInArrow(count, SUMMARY)


def frequent_items(df: DataFrame, columns: dict[str, Column], share: float, error: float = ERROR) -> DataFrame:
    """(field, item, n_low, n_high, n_rows): every value of a column that may occur in at least ``share`` of all rows,
    with the interval its count is guaranteed to lie in, at most ``error`` of all rows wide.

    Nulls are no value but count among the rows. Partition summaries are merged by adding counts and deltas; where a
    partition doesn't hold an item, its bound is added instead. An empty table gives no rows. ``error`` must lie below
    ``share``: no more than 1 / (share - error) items of a column can then come out.
    """
    if not 0 < error < share:
        raise ValueError(f"error {error} must lie between 0 and share {share}")
    parts = written(summaries(df, columns, error))
    totals = parts.filter("item is null").groupBy("field").agg(F.sum("bound").alias("bounds"), F.sum("n_rows").alias("n_rows"))
    merged = parts.filter("item is not null").groupBy("field", "item").agg(F.sum("n").alias("n"), F.sum("delta").alias("delta"), F.sum("bound").alias("bound"))
    high = F.col("n") + F.col("delta") + F.col("bounds") - F.col("bound")
    out = merged.join(F.broadcast(totals), "field")  # one row a field
    return out.select("field", "item", F.col("n").alias("n_low"), high.alias("n_high"), "n_rows").filter(F.col("n_high") >= F.col("n_rows") * share)


def exact_counts(df: DataFrame, columns: dict[str, Column], candidates: DataFrame) -> DataFrame:
    """(field, item, n) of candidates, counted over all rows. There are at most 1 / (share - error) a field, so they
    are broadcast."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("item")) for n, c in columns.items()])).alias("x")
    return df.select(pairs).select("x.*").join(F.broadcast(candidates.select("field", "item")), ["field", "item"]).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
