"""Comparing versions: units, multisets of values, exact arithmetic, text similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_diff(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Units (keys ``by`` and text) of two versions side by side: added, removed, changed or unchanged."""
    b = before.select(*by, F.col("text").alias("before_text"), F.lit(True).alias("_b"))
    a = after.select(*by, F.col("text").alias("after_text"), F.lit(True).alias("_a"))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("before_text").eqNullSafe(F.col("after_text")), "unchanged").otherwise("changed")
    return b.join(a, by, "full_outer").withColumn("outcome", state).drop("_a", "_b")


def multiset_diff(before: DataFrame, after: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, removed, added, kept): how many times a value goes, comes and stays."""
    b = before.groupBy(*by, value).agg(F.count("*").alias("nb"))
    a = after.groupBy(*by, value).agg(F.count("*").alias("na"))
    nb, na = F.coalesce("nb", F.lit(0)), F.coalesce("na", F.lit(0))
    both = b.join(a, [*by, value], "full_outer")
    return both.select(*by, value, *(x.cast("long").alias(n) for n, x in (("removed", F.greatest(nb - na, F.lit(0))), ("added", F.greatest(na - nb, F.lit(0))), ("kept", F.least(nb, na)))))


def arithmetic_relations(diff: DataFrame, by: list[str], value: str, least: int = 2, most: int = 36) -> DataFrame:
    """Changes that are a whole multiple, ``least`` to ``most`` times, of a value that stayed.

    For each removed and added value of a pair of versions: |added - removed| = multiple x kept, with a
    positive kept value that is none of the three. The multiples of kept values are listed and met by the
    difference, so kept values are never tried one by one.
    """
    old = diff.where("removed > 0").select(*by, F.col(value).alias("old"))
    new = diff.where("added > 0").select(*by, F.col(value).alias("new"))
    kept = diff.where(f"kept > 0 and {value} > 0").select(*by, F.col(value).alias("base"), F.explode(F.sequence(F.lit(least), F.lit(most))).alias("multiple"))
    steps = kept.withColumn("delta", (F.col("base") * F.col("multiple")).cast("decimal(28,2)"))
    every = old.join(new, by).withColumn("delta", F.abs(F.col("new") - F.col("old")).cast("decimal(28,2)")).where("delta > 0")
    return every.join(steps, [*by, "delta"]).where("base <> old and base <> new and base <> delta")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by matching blocks, 0 to 1; null where either is null."""
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y).ratio(), 6) for x, y in zip(a, b)], dtype="float64")
