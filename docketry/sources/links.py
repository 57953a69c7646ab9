"""Links as data: kinds, signatures, ordered checks, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_format(uri: Column) -> Column:
    """html, packet, pdf, versions or other, by query and path."""
    u = F.lower(uri)
    return F.when(u.contains("html=true"), "html").when(u.contains("packet=true"), "packet").when(u.contains("/previousversions/"), "versions").when(u.rlike(r"\.pdf($|\?)|/viewfile/"), "pdf").otherwise("other")


def signature(uri: Column) -> Column:
    """Path and sorted query keys of a link."""
    keys = F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce(F.try_parse_url(uri, F.lit("QUERY")), F.lit("")), "&"), lambda p: F.split(p, "=")[0])))
    return F.concat(F.coalesce(F.try_parse_url(uri, F.lit("PATH")), F.lit("")), F.lit("?"), F.array_join(keys, "&"))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds; null where none does: the row is accepted."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks))


def stable_sample(df: DataFrame, key: str, n: int, by: str | None = None) -> DataFrame:
    """``n`` rows, or ``n`` of each value of ``by``, by the hash of their key: the same whatever the order."""
    rank = F.sha2(F.col(key).cast("string"), 256)
    if by is None:
        return df.orderBy(rank, key).limit(n)
    w = Window.partitionBy(by).orderBy(rank, key)
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def distinct_first_sample(df: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """``n`` rows by hash of key, one of each value of ``by`` before any second."""
    rank = F.sha2(F.col(key).cast("string"), 256)
    w = Window.partitionBy(by).orderBy(rank, key)
    return df.withColumn("_r", F.row_number().over(w)).orderBy(F.col("_r") > 1, rank, key).limit(n).drop("_r")


def classified(rules: list[tuple[str, str]], default: str, uri: Column) -> Column:
    """The role of the rules (role, regex) that match; raises where rules of different roles do."""
    roles = F.array_distinct(F.array_compact(F.array(*(F.when(uri.rlike(p), F.lit(r)) for r, p in rules))))
    return F.when(F.size(roles) > 1, F.raise_error(F.concat(F.lit("ambiguous role: "), uri))).otherwise(F.coalesce(F.get(roles, F.lit(0)), F.lit(default)))
