"""Sinks. Reports are single text files, on any file system Hadoop knows, written in blocks from an iterator, so the
driver never holds a whole result; ``table_csv`` and ``table_lines`` write large results from where they lie."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BLOCK = 10_000  # lines handed over at a time


def write_lines(lines: Iterable[str], path: str) -> None:
    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    rest = iter(lines)
    try:
        while block := list(islice(rest, BLOCK)):
            out.write(bytearray("".join(line + "\n" for line in block).encode("utf-8")))
    finally:
        out.close()


def _number(x: float) -> str:
    return repr(float(x))


def write_json(document: dict, path: str) -> None:
    write_lines([json.dumps(document)], path)


def state_stars(df: DataFrame, path: str) -> None:
    """``state,stars`` and one line a state, in the order of the rows."""

    def lines():
        yield "state,stars"
        for r in df.select("state", "stars").toLocalIterator():
            yield f"{r.state},{_number(r.stars)}"

    write_lines(lines(), path)


def timings(m1: float, m2: float, explanation: str, path: str) -> None:
    write_json({"m1": m1, "m2": m2, "explanation": explanation}, path)


def itemset_lines(df: DataFrame, key: str = "items") -> Iterable[str]:
    """One line a size, itemsets comma-joined, sizes parted by an empty line."""
    size, line = None, []
    text = F.concat(F.lit("('"), F.concat_ws("', '", key), F.lit("')")).alias("t")
    for r in df.orderBy(F.size(key), key).select(F.size(key).alias("n"), text).toLocalIterator():
        if size is not None and r.n != size:
            yield ",".join(line)
            yield ""
            line = []
        size = r.n
        line.append(r.t)
    if line:
        yield ",".join(line)


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    def lines():
        yield "Candidates:"
        yield from itemset_lines(candidates)
        yield ""
        yield "Frequent Itemsets:"
        yield from itemset_lines(frequent)

    write_lines(lines(), path)


def similar_pairs_csv(df: DataFrame, path: str) -> None:
    def lines():
        yield "business_id_1, business_id_2, similarity"
        for r in df.orderBy("business_id_1", "business_id_2").toLocalIterator():
            yield f"{r.business_id_1},{r.business_id_2},{_number(r.similarity)}"

    write_lines(lines(), path)


def predictions_csv(df: DataFrame, path: str) -> None:
    def lines():
        yield "user_id, business_id, prediction"
        for r in df.orderBy("user_id", "business_id").toLocalIterator():
            yield f"{r.user_id},{r.business_id},{_number(r.prediction)}"

    write_lines(lines(), path)


def betweenness_txt(df: DataFrame, path: str) -> None:
    rows = df.orderBy(F.desc("betweenness"), "src", "dst").toLocalIterator()
    write_lines((f"('{r.src}', '{r.dst}'), {_number(r.betweenness)}" for r in rows), path)


def communities_txt(df: DataFrame, path: str) -> None:
    ordered = df.orderBy(F.size("members"), F.element_at("members", 1))
    write_lines((r.t for r in ordered.select(F.concat(F.lit("'"), F.concat_ws("', '", "members"), F.lit("'")).alias("t")).toLocalIterator()), path)


def table_csv(df: DataFrame, path: str) -> None:
    """A distributed CSV table, for results too large for one file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def table_lines(df: DataFrame, line, path: str) -> None:
    """One text line a row, in the order of the rows, as a folder of parts written where the rows lie."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)
