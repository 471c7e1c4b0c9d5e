"""All pairs of sets with a Jaccard similarity above a threshold, exactly, by pigeonhole partitioning.

The token universe is hashed into segments whose number depends on the length class of the smaller set (classes are
powers of two, two segments for each token of the class's shortest set). Two sets within the threshold differ in at
most H tokens. The larger set gives each of its segments a weight v: 0 (skipped), 1 (the other set must have the same
segment) or 2 (one token more or less is allowed, found by one-deletion signatures on both sides). If the weights sum
to H + 1, one segment must match within its weight, so a join on signatures loses no pair. The cheapest segments are
weighted first, by powers of two of their tokens' frequencies: a token that a third of all sets hold is joined on only
by a set that has too little else. The few sets whose tokens collide so badly that weights 1 and 2 cannot reach H + 1
use the finest partition instead, one token a segment.

Sets stay rows of (set, token): no set is gathered into one row, however large. Candidates are first held against a
128-bit sketch of both sets, which bounds their difference from below, then counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.durable import release, written
from quillwork.functions.keys import clean_key

SKETCH_WORDS = 2


def _class_of(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _sketch(token: Column, word: int) -> Column:
    """The bits a token sets in one 64-bit word of the sketch."""
    h = F.xxhash64(F.lit("sketch"), token)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))
    return F.bit_or(F.when(F.pmod(h, F.lit(SKETCH_WORDS)) == word, bit).otherwise(F.lit(0).cast("long")))


def _most(nr: Column, ns: Column, t: float) -> Column:
    """The largest difference two sets of these sizes may have."""
    return F.floor((nr + ns) * F.lit((1 - t) / (1 + t)) + F.lit(1e-9)).cast("int")


def _rows(df: DataFrame, key: str, token: str, side: int) -> DataFrame:
    return df.select(F.lit(side).alias("side"), clean_key(key).alias("b"), clean_key(token).alias("u")).dropna()


def similar_set_pairs(
    left: DataFrame, key: str, token: str, threshold: float = 0.5, min_size: int = 1, right: DataFrame | None = None, right_key: str | None = None, right_token: str | None = None
) -> DataFrame:
    """(key_1, key_2, similarity) of all pairs of sets with Jaccard similarity of at least ``threshold``.

    A row of ``left`` says that the set ``key`` holds ``token``; repeats count once, rows without either are dropped,
    spaces around both don't matter, other columns are ignored. Sets below ``min_size`` take no part. Without ``right``
    pairs are within ``left``, the smaller key first; with it key_1 is of ``left`` and key_2 of ``right``. Empty tables
    give no rows. The threshold lies above 0 and at most at 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies above 0 and at most at 1")
    t, two = threshold, right is not None
    raw = _rows(left, key, token, 0)
    if two:
        raw = raw.union(_rows(right, right_key or key, right_token or token, 1))
    pairs = written(raw.distinct())
    sizes = written(
        pairs.groupBy("side", "b")
        .agg(F.count(F.lit(1)).cast("int").alias("n"), *[_sketch(F.col("u"), w).alias(f"w{w}") for w in range(SKETCH_WORDS)])
        .filter(F.col("n") >= min_size)
        .withColumn("id", F.monotonically_increasing_id())
    )
    tokens = written(pairs.groupBy("u").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("level")).withColumn("tid", F.monotonically_increasing_id()))
    sets = written(pairs.join(sizes, ["side", "b"]).join(tokens, "u").select("id", "side", "n", "w0", "w1", "tid", "level"))
    release(pairs, tokens)

    own = _class_of(F.col("n"))
    # the larger set looks into every class that a set of at least t times its size may be in
    lowest = F.greatest(F.lit(0), _class_of(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9)))))
    many = F.call_function("shiftleft", F.lit(1), F.col("cls") + 1)  # segments of a class
    token_hash = F.xxhash64("tid")
    groups = written(
        sets.withColumn("own", own)
        .withColumn("cls", F.explode(F.sequence(lowest, own)))
        .withColumn("seg", F.pmod(token_hash, many).cast("int"))
        .groupBy("id", "side", "n", "w0", "w1", "cls", (F.col("cls") == F.col("own")).alias("own"), "seg")
        .agg(F.bit_xor(token_hash).alias("whole"), F.array_sort(F.collect_list(F.struct("level", F.xxhash64("tid").alias("h")))).alias("in_it"))
        .withColumn("l1", F.col("in_it")[0]["level"])
        .withColumn("l2", F.get(F.col("in_it.level"), 1))
        .withColumn("hs", F.col("in_it.h"))
        .drop("in_it")
    )
    # how far up the frequencies a set must go to reach H + 1; a set and class has as many rows as there are levels
    need = _most(F.col("n"), F.least("n", F.call_function("shiftleft", F.lit(1), F.col("cls") + 1) - 1), t) + 1
    steps = groups.select("id", "n", "cls", F.explode(F.filter(F.array("l1", "l2"), lambda x: x.isNotNull())).alias("level"))
    by_level = steps.groupBy("id", "n", "cls", "level").agg(F.count(F.lit(1)).alias("c"))
    so_far = F.sum("c").over(Window.partitionBy("id", "cls").orderBy("level"))
    cut = by_level.withColumn("so_far", so_far).groupBy("id", "cls").agg(F.min(F.when(F.col("so_far") >= need, F.col("level"))).alias("cut"))

    who = ["id", "side", "n", "w0", "w1"]
    sig = lambda body, kind: F.xxhash64("cls", "seg", body, F.lit(kind))
    less = lambda kind: F.transform("hs", lambda h: sig(F.col("whole").bitwiseXOR(h), kind))
    none = F.array().cast("array<bigint>")
    several = F.size("hs") > 1
    indexed = groups.filter("own").select(*who, F.explode(F.concat(F.array(sig(F.col("whole"), 0)), F.when(several, less(1)).otherwise(none))).alias("sig"))
    weighted = groups.join(cut.filter("cut is not null"), ["id", "cls"])
    both = several & (F.col("l2") <= F.col("cut"))
    probes = weighted.filter(F.col("l1") <= F.col("cut")).select(
        *who, F.explode(F.concat(F.array(sig(F.col("whole"), 0)), F.when(both, F.concat(F.array(sig(F.col("whole"), 1)), less(0))).otherwise(none))).alias("sig")
    )
    # the finest partition, for sets that the weights don't cover
    hard = cut.filter("cut is null")
    fine = lambda df: df.select(*who, F.explode(F.transform("hs", lambda h: F.xxhash64("cls", F.lit("token"), h))).alias("sig"))
    hard_probes = fine(groups.join(hard, ["id", "cls"]))
    hard_indexed = fine(groups.filter("own").join(hard.select("cls").distinct(), "cls", "left_semi"))

    def met(r: DataFrame, s: DataFrame) -> DataFrame:
        r = r.select("sig", *[F.col(c).alias(f"r_{c}") for c in who])
        s = s.select("sig", *[F.col(c).alias(f"s_{c}") for c in who])
        apart = F.bit_count(F.col("r_w0").bitwiseXOR(F.col("s_w0"))) + F.bit_count(F.col("r_w1").bitwiseXOR(F.col("s_w1")))
        order = (F.col("s_n") < F.col("r_n")) | ((F.col("s_n") == F.col("r_n")) & (F.col("s_id") < F.col("r_id")))
        fits = (F.col("s_n") >= F.col("r_n") * t - 1e-9) & (apart <= _most(F.col("r_n"), F.col("s_n"), t))
        sides = (F.col("r_side") != F.col("s_side")) if two else F.lit(True)
        return r.join(s, "sig").filter(order & fits & sides).select(F.col("r_id").alias("r"), F.col("s_id").alias("s"), F.col("r_n").alias("rn"), F.col("s_n").alias("sn"))

    candidates = written(met(probes, indexed).union(met(hard_probes, hard_indexed)).distinct())
    release(groups)
    holds = sets.select("id", "tid")
    common = (
        candidates.join(holds.withColumnRenamed("id", "s"), "s")
        .join(holds.withColumnRenamed("id", "r"), ["r", "tid"])
        .groupBy("r", "s", "rn", "sn")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("union", F.col("rn") + F.col("sn") - F.col("c"))
        .filter(F.col("c") >= F.col("union") * t - 1e-9)
    )
    names = sizes.select("id", "side", "b")
    named = common.join(names.select(F.col("id").alias("r"), F.col("side").alias("r_side"), F.col("b").alias("rb")), "r").join(names.select(F.col("id").alias("s"), F.col("b").alias("sb")), "s")
    first = (F.col("r_side") == 0) if two else (F.col("rb") < F.col("sb"))
    return named.select(
        F.when(first, F.col("rb")).otherwise(F.col("sb")).alias("key_1"), F.when(first, F.col("sb")).otherwise(F.col("rb")).alias("key_2"), (F.col("c") / F.col("union")).alias("similarity")
    )
