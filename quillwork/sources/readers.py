"""Readers with explicit schemas: nothing is inferred, unused fields never leave the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, useful int, text string"
BUSINESS = "business_id string, state string"
PAIR = "user_id string, business_id string"
RATING = "user_id string, business_id string, stars double"
TRUTH = "business_id_1 string, business_id_2 string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder as a stream of its files, be it one file or a folder of them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    many = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    stream = spark.readStream.schema(table(spark, folder, name).schema)
    return stream.parquet(f"{folder}/{name}.parquet") if many else stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def reviews_json(spark: SparkSession, path: str) -> DataFrame:
    """Review records, one JSON object a line; keys beyond the schema are skipped while parsing."""
    return spark.read.schema(REVIEW).json(path)


def business_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUSINESS).json(path)


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("enforceSchema", True).schema(schema).csv(path)


def pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, PAIR)


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, RATING)


def business_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, BUSINESS)


def truth_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, TRUTH)


def headerless_csv(spark: SparkSession, path: str, first: str, schema: str) -> DataFrame:
    """CSV whose header may be repeated or absent: rows whose first field equals ``first`` are dropped."""
    df = spark.read.schema(schema).csv(path)
    return df.filter(~F.col(df.columns[0]).eqNullSafe(F.lit(first)))


def split_ratings(df: DataFrame, test_share: float = 0.235, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A (train, test) split by the hash of whole rows and the seed: the same on every run and however the rows are
    partitioned, without a sort; equal rows stay together."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1_000_000)) / 1_000_000
    return df.filter(draw >= test_share), df.filter(draw < test_share)


def sample_rows(df: DataFrame, n: int = 3000, seed: int = 7) -> DataFrame:
    """``n`` random rows (a sampling operator: the limit is the feature)."""
    return df.orderBy(F.rand(seed)).limit(n)


def partitioned(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` partitions without a shuffle; AQE normally makes this needless."""
    return df.coalesce(n)
