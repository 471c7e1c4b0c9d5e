"""References to records that do not exist, no longer exist or only exist later.

A Bloom filter of the parent keys proves most orphans without a join; only references that pass it are joined exactly.
The filter is split into blocks of eight 64-bit words: a key belongs to one block and sets one bit in each word, so
building it is one mergeable aggregation, and testing a reference one lookup and eight bit tests on longs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.keys import clean_key
from quillwork.functions.skew import heavy_keys, is_any, replicated, salted

WORDS = 8
BITS_PER_KEY = 12
ROW_BYTES = 128  # of one block in memory, with what a row costs
MAX_FILTER_BYTES = 64 << 20  # a larger filter isn't broadcast but joined by block


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """One bit of each word, all from one hash: six bits of it a word."""
    h = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(_block, _w0 ... _w7) of a one-column table of keys."""
    key = F.col(keys.columns[0])
    rows = keys.select(_block(key, blocks).alias("_block"), *[m.alias(f"_m{i}") for i, m in enumerate(_masks(key))])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(WORDS)])


def passes(key: Column) -> Column:
    """Whether the key may be in the filter whose words lie beside it; a missing block holds no key."""
    hits = [F.col(f"_w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(key))]
    return F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))


def orphan_references(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, at: str, since: str, until: str, keep: tuple[str, ...] = (), max_filter_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """The child rows (``keep``, key, at, reason) whose key has no parent row valid at their time.

    A parent row is valid from ``since`` on and until just before ``until`` (null: for good; a null ``since`` is never
    reached). A child without a time is an orphan only if no parent row has its key at all; a child without a key never
    is. Reasons: unknown (no such parent at all), early (all its rows begin later), gone. Repeated child rows come out
    as often as they occur. Empty parents make every keyed child an orphan, an empty child table gives no rows; any
    other columns of either table are ignored, whatever their names. References to one heavy key are verified in
    several tasks. A filter above ``max_filter_bytes`` meets the references by a join on its blocks.
    """
    c = child.select(clean_key(child_key).alias("key"), F.col(at).alias("at"), *[F.col(k).alias(f"keep_{k}") for k in keep]).filter("key is not null")
    p = parent.select(clean_key(parent_key).alias("pkey"), F.col(since).alias("since"), F.col(until).alias("until")).filter("pkey is not null")
    hot = heavy_keys(c, "key")
    c = salted(c, "key", hot, ["at", *[f"keep_{k}" for k in keep]])
    blocks = bloom_blocks(parent.count())
    bits, numbered = bloom_filter(p.select("pkey"), blocks), c.withColumn("_block", _block(F.col("key"), blocks))
    sure = None
    if blocks * ROW_BYTES <= max_filter_bytes:
        bits = F.broadcast(bits)
    else:  # by block; references to heavy keys would pile up in few blocks, and are few keys to verify
        sure, numbered = numbered.filter(is_any(F.col("key"), hot)), numbered.filter(~is_any(F.col("key"), hot))
    tested = numbered.join(bits, "_block", "left").withColumn("_maybe", passes(F.col("key")))
    definite = tested.filter(~F.col("_maybe")).select(*c.columns)
    maybe = tested.filter("_maybe").select(*c.columns)
    if sure is not None:
        maybe = maybe.unionByName(sure.select(*c.columns))
    own = replicated(p, "pkey", hot).withColumnRenamed("_salt", "_psalt")
    valid = (F.col("key") == F.col("pkey")) & (F.col("_salt") == F.col("_psalt")) & (
        F.col("at").isNull() | ((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    )
    left = maybe.join(own, valid, "left_anti")
    first = own.groupBy("pkey", "_psalt").agg(F.min("since").alias("first"), F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("n").isNull(), "unknown").when(F.col("first").isNull() | (F.col("at") < F.col("first")), "early").otherwise("gone")
    found = left.join(first, (F.col("key") == F.col("pkey")) & (F.col("_salt") == F.col("_psalt")), "left").withColumn("reason", reason)
    out = found.select(*c.columns, "reason").unionByName(definite.withColumn("reason", F.lit("unknown"))).drop("_salt")
    return out.withColumnsRenamed({f"keep_{k}": k for k in keep})


def orphans_by_period(orphans: DataFrame, table: str, period: str = "month") -> DataFrame:
    """Orphans per table, period of their time (null: unknown) and reason, with the number of different keys."""
    month = F.date_format(F.date_trunc(period, F.col("at")), "yyyy-MM-dd")
    per_key = orphans.groupBy(month.alias("period"), "reason", "key").agg(F.count(F.lit(1)).alias("c"))
    return per_key.groupBy(F.lit(table).alias("table_name"), "period", "reason").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
