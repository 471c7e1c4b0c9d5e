"""Column helpers shared by every operator. All stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_key(c: Column | str) -> Column:
    """A key without its surrounding spaces; an empty one is null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def clean_state(c: Column | str) -> Column:
    """A state code in upper case without spaces; an empty one is null."""
    return F.nullif(F.upper(F.trim(col(c))), F.lit(""))


def text_length(c: Column | str) -> Column:
    """Code points of a text; null counts as no text."""
    return F.char_length(col(c))


def smaller(a: Column | str, b: Column | str) -> Column:
    return F.least(col(a), col(b))


def larger(a: Column | str, b: Column | str) -> Column:
    return F.greatest(col(a), col(b))


def clip(c: Column | str, low: float = 1.0, high: float = 5.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """The rows whose keys are all present, with clean keys; other columns are dropped."""
    return df.select(*[clean_key(n).alias(n) for n in names]).dropna()
