"""Token filters over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokenize(lines: DataFrame, column: str) -> DataFrame:
    """One row per part of a line split at single spaces, empty parts included."""
    return lines.select(F.explode(F.split(F.col(column), " ")).alias("token"))


def longer_than(tokens: DataFrame, n: int = 5) -> DataFrame:
    return tokens.where(F.length("token") > n)


def greatest(tokens: DataFrame, n: int = 5) -> DataFrame:
    """The n last tokens in the order of strings, repeats included."""
    return tokens.orderBy(F.desc("token")).limit(n)
