"""Filling containers of fixed capacity with texts, planned on the histogram of their lengths.

The plan is best fit, longest first, made over counts: all texts of one length are placed as a few runs of containers,
so planning takes as many steps as there are lengths, not texts. Texts then find their slot by their rank within their
length.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.durable import written

CAPACITY = 2048
ROWS_A_SALT = 1_000_000
MAX_RUNS = 500_000  # broadcast bound of the plan; a full histogram of 2,048 lengths takes some 3,500
MAX_WORDS = 500_000  # words whose token count a worker keeps
# fixed values: the pattern by which byte-level tokenizers cut texts into words
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAN = "length int, first_rank long, n_items long, first_container long, each long, base int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter(dict):
    """Tokens of a text. A tokenizer that first cuts texts into words by the byte-level pattern merges only within
    words, so a word is tokenized once and its count kept; any other tokenizer gets whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        cut = parts.get("pre_tokenizer") or {}
        self.by_word = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not parts.get("normalizer")

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return n

    def counts(self, texts: list[str]) -> list[int]:
        if self.by_word:
            return [sum(map(self.__getitem__, WORD.findall(t))) for t in texts]
        out = []
        for i in range(0, len(texts), 64):  # few at a time: encodings are much larger than texts
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(key, n_tokens) of each text; null and empty texts have 0."""
    path, kind = tokenizer or default_tokenizer(), df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.counts([x or "" for x in batch.column(1).to_pylist()]), pa.int32())], names=["key", "n_tokens"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(count, f"key {kind}, n_tokens int").withColumnRenamed("key", key)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for every text: (length, first rank, texts, first container, texts a container, place of the first token).

    Text k of a run goes to container ``first container + k // texts a container``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of containers (first, how many)
    spaces: list[int] = []
    out, opened = [], 0

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, many = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(i)
            else:
                space, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            each = space // length
            full = min(many, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - space))
                put(space - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < many:
                if left:  # fewer texts than a container takes
                    out.append((length, rank, left, first + full, left, capacity - space))
                    put(space - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(space, first + full, many - full)
    return out


def pack(lengths: DataFrame, key: str, capacity: int = CAPACITY, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """(key, piece, n_tokens, container_id, first_token) from (key, n_tokens), keys unique.

    A text of at most ``capacity`` tokens is one piece. A longer one is cut into full pieces, each a container of its
    own, and a rest that is packed like any text. A text without tokens gets container null. Which of several texts of
    one length gets which slot follows their keys, so the result is the same on every run.
    """
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).cast("int")
    pieces = F.when(F.col("n_tokens") == 0, F.array(F.lit(0))).otherwise(F.concat(F.array_repeat(F.lit(capacity), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    cut = lengths.select(key, F.posexplode(pieces).alias("piece", "length"))
    packed = cut.filter("length > 0")
    salts = max(1, -(-lengths.count() // rows_a_salt)) * 8
    salted = packed.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    sizes = written(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("c")))
    histogram = {r.length: r.c for r in sizes.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    runs = plan(histogram, capacity)
    if len(runs) > MAX_RUNS:
        raise ValueError(f"the plan has {len(runs)} runs; {MAX_RUNS} may be broadcast")
    slots = lengths.sparkSession.createDataFrame(runs, PLAN)
    before = F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")
    starts = sizes.select("length", "salt", before.alias("before"))
    ranked = (
        salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy(key, "piece")))
        .join(starts, ["length", "salt"])
        .select(key, "piece", "length", (F.col("before") + F.col("k") - 1).alias("rank"))
    )
    offset = F.col("rank") - F.col("first_rank")
    here = ranked.join(F.broadcast(slots), "length").filter((offset >= 0) & (offset < F.col("n_items")))
    placed = here.select(
        key, "piece", F.col("length").alias("n_tokens"), (F.col("first_container") + F.floor(offset / F.col("each"))).alias("container_id"),
        (F.col("base") + (offset % F.col("each")) * F.col("length")).cast("int").alias("first_token"),
    )
    none = cut.filter("length = 0").select(key, "piece", F.col("length").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("first_token"))
    return placed.union(none)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of all space that is used (null without containers)."""
    once = packed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    return once.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("c").alias("n_pieces"), F.max("t").alias("fullest"),
        F.try_divide(F.sum("t"), F.count(F.lit(1)) * capacity).alias("used"),
    )


def check(packed: DataFrame, lengths: DataFrame, key: str, capacity: int = CAPACITY, least_used: float = 0.99) -> DataFrame:
    """(what, n): what must hold of containers, counted where it is broken; and the texts placed."""
    placed = packed.filter("container_id is not null")
    loads = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    ends = F.col("first_token") + F.col("n_tokens")
    beside = F.lead("first_token").over(Window.partitionBy("container_id").orderBy("first_token"))
    texts = packed.groupBy(key).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.count("container_id").alias("in_containers"))
    both = lengths.join(texts, key, "full_outer")
    counted = [
        both.agg(F.count_if(F.col("in_containers") > 0).alias("texts placed"), F.count_if(~F.col("t").eqNullSafe(F.col("n_tokens"))).alias("texts with tokens lost or repeated"),
                 F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= capacity)).alias("texts split for no reason"), F.count_if((F.col("n_tokens") > 0) & (F.col("in_containers") < F.col("pieces"))).alias("texts with pieces nowhere")),
        loads.agg(F.count_if(F.col("t") > capacity).alias("containers above capacity"), F.coalesce(F.count(F.lit(1)) > F.ceil(F.sum("t") / capacity) / least_used + 1, F.lit(False)).cast("long").alias("too much unused space")),
        placed.withColumn("beside", beside).agg(F.count_if((ends > F.col("beside")) | (ends > capacity)).alias("pieces that overlap")),
    ]
    return reduce(DataFrame.union, [c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"`{n}`").cast("long").alias("n")) for n in c.columns])).alias("x")).select("x.*") for c in counted])
