"""Queries over amounts recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import units
from docketry.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable money or quantity fact in its common unit."""
    facts = table(spark, sf_dir, "evidence_facts", "fact_id", "fact_type", "raw_text", "unit", "normalized_text").where(F.col("fact_type").isin("money", "quantity"))
    return units.common_amounts(facts, table(spark, sf_dir, "unit_reference")).select("fact_id", "common_unit", "value_key")


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The recorded values of each artifact by dimension, in order of page and place, and the factors of each dimension."""
    facts = table(spark, sf_dir, "evidence_facts", "fact_id", "fact_type", "artifact_id", "locator", "char_start", "numeric_value", "raw_text", "unit", "normalized_text").where(F.col("fact_type").isin("money", "quantity"))
    reference = table(spark, sf_dir, "unit_reference")
    facts = units.dimensions(facts.dropDuplicates(["fact_id"]), reference)
    page = F.coalesce(F.regexp_extract("locator", r"(\d+)\D*$", 1).try_cast("long"), F.lit(0))
    history = facts.select(
        # a fact that names no known unit stays in the history of its type
        F.concat_ws("|", "artifact_id", F.coalesce("dimension", "fact_type")).alias("series"),
        F.concat_ws("|", F.lpad(page.cast("string"), 10, "0"), F.lpad(F.coalesce("char_start", F.lit(0)).cast("string"), 10, "0"), "fact_id").alias("at"),
        F.col("numeric_value").alias("value"),
        "fact_id",
    )
    return history, units.unit_ratios(reference)


def p2_unit_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each artifact's recorded values by dimension, with the unit factor of each level shift."""
    return units.unit_shifts(*_history(spark, sf_dir))


def p2_own_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded value with the unit change of its segment reversed."""
    return units.in_own_units(*_history(spark, sf_dir)).select("fact_id", "series", "segment", "value", "factor", "own_value")
