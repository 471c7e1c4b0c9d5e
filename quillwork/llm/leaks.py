"""Evaluation texts leaking into training texts: an Aho-Corasick automaton over the words of the test items.

Words are maximal runs of letters and digits, compared without case; all between them is ignored. Any ``least``
consecutive words of an item hold a whole block of ``least // 2`` words that begins at a multiple of that many words,
so only these blocks are patterns: the automaton has one node a word of an item, and reads each text once. A block that
is met is extended to both sides along the item; what reaches ``least`` words is a leak, and says which words, and with
them which characters of the original, are leaked.

Items beyond what one automaton may hold are split into several of bounded size, each item whole in one of them; the
texts are read once for each, and the passages are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillwork.functions.durable import written

LEAST = 10
MAX_ITEM_BYTES = 8 << 20  # of item text in one automaton; a worker then holds about 250 MB
GROUPS = 4096
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [w.casefold() for w in WORD.findall(text)]


class Automaton:
    """The blocks of all items, as one automaton over word numbers."""

    def __init__(self, items: list[tuple], least: int):
        self.least, self.block, self.numbers = least, max(1, least // 2), {}
        self.items, self.codes = [], []
        places: dict[tuple, list] = {}
        for item, text in items:
            words = words_of(text or "")
            if len(words) < least:
                continue
            codes = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(0, len(codes) - self.block + 1, self.block):
                places.setdefault(tuple(codes[i : i + self.block]), []).append((len(self.items), i))
            self.items.append(item)
            self.codes.append(codes)
        self.tree = None
        if places:
            self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for block, where in places.items():
                self.tree.add_word(block, where)
            self.tree.make_automaton()

    def scan(self, text: str) -> list[tuple]:
        """(item, first character, character after the last, words) of each longest leaked passage."""
        if self.tree is None:
            return []
        number = self.numbers.get
        codes = tuple(number(w.casefold(), 0) for w in WORD.findall(text))
        if len(codes) < self.least:
            return []
        runs: dict = {}  # of an item and a shift between its words and those of the text: the end of the last run seen
        passages: dict = {}
        for end, where in self.tree.iter(codes):
            start = end - self.block + 1
            for k, i in where:
                if runs.get((k, start - i), -1) >= end:
                    continue
                own, a, b = self.codes[k], start, end
                while a and a - start + i and codes[a - 1] == own[a - 1 - start + i]:
                    a -= 1
                while b + 1 < len(codes) and b + 1 - start + i < len(own) and codes[b + 1] == own[b + 1 - start + i]:
                    b += 1
                runs[k, start - i] = b
                if b - a + 1 >= self.least:
                    passages.setdefault(k, []).append((a, b - self.least + 1))  # first words of leaked windows
        if not passages:
            return []
        spans, out = [m.span() for m in WORD.finditer(text)], []
        for k, windows in passages.items():
            joined: list = []
            for a, z in sorted(windows):
                if joined and a <= joined[-1][1] + 1:
                    joined[-1][1] = max(z, joined[-1][1])
                else:
                    joined.append([a, z])
            out += [(self.items[k], spans[a][0], spans[z + self.least - 1][1], z - a + self.least) for a, z in joined]
        return out


_built: list = []  # the broadcast a worker used last, and its automaton


def _automaton(shared, least: int) -> Automaton:
    if not _built or _built[0] is not shared or _built[1].least != least:
        _built[:] = []
        _built[:] = [shared, Automaton(shared.value, least)]
    return _built[1]


def _shares(own: DataFrame, most: int) -> list[list[int]]:
    """Hash groups of items, put together until they hold ``most`` bytes of text."""
    sizes = own.groupBy("group").agg(F.sum(F.octet_length("text")).alias("b")).collect()  # at most GROUPS rows
    shares, left = [], 0
    for r in sorted(sizes):
        if not shares or left < r.b:
            shares.append([])
            left = most
        shares[-1].append(r.group)
        left -= r.b
    return shares


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(key, item key, first_char, last_char, n_words): each passage of at least ``least`` consecutive words that a
    document shares with an item, characters counted from 0 in the original text, the last one exclusive.

    A passage is a longest run of a document's words each ``least`` of which stand in the item one after the other.
    Null texts, and texts or items of fewer words, match nothing; repeated rows match as often as they occur; whole
    texts are read. Items go to the workers ``max_bytes`` of text at a time, at any number of items.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    arrow, sc = to_arrow_type(items.schema[item_key].dataType), docs.sparkSession.sparkContext
    own = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    own = own.withColumn("group", F.pmod(F.xxhash64("item", "text"), F.lit(GROUPS)).cast("int"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    names = ["doc_id", "item_id", "first_char", "last_char", "n_words"]

    def found(groups: list[int]) -> DataFrame:
        part = own.filter(F.col("group").isin(groups)).select("item", "text").collect()  # bounded by ``max_bytes``, or one group
        shared = sc.broadcast([tuple(r) for r in part])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, least)
            for batch in batches:
                hits = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in automaton.scan(t)]
                columns = list(zip(*hits)) if hits else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, arrow, pa.int32(), pa.int32(), pa.int32()])], names=names)

        return rows.mapInArrow(scan, f"doc_id {kind}, item_id {item_kind}, first_char int, last_char int, n_words int")

    shares = _shares(own, max_bytes) or [[]]
    parts = [found(s) for s in shares]
    if len(parts) > 1:  # each pass is stored, so its broadcast needn't outlive it
        parts = [written(p) for p in parts]
    return reduce(DataFrame.union, parts).withColumnsRenamed({"doc_id": key, "item_id": item_key})
