"""Consolidating pairwise matches into groups by deterministic Borůvka hooking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import cut, release


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.where("u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _hook(edges: DataFrame) -> DataFrame:
    """(x, p): every component points along its smallest outgoing edge, edges being ordered by (u, v).

    That order is total, so the only cycles are two components choosing the same edge; of these the
    smaller becomes the root.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), "u", "v"), F.struct(F.col("v").alias("x"), "u", "v"))).alias("e"))
    best = ends.groupBy("e.x").agg(F.min(F.struct("e.u", "e.v")).alias("e"))
    return best.select("x", F.when(F.col("x") == F.col("e.u"), F.col("e.v")).otherwise(F.col("e.u")).alias("p"))


def _roots(parents: DataFrame) -> DataFrame:
    """Break the two-cycles of the hooking and double pointers until every x points at its root."""
    q = parents.select(F.col("x").alias("p"), F.col("p").alias("pp"))
    tree = parents.join(q, "p").select(
        "x",
        F.when((F.col("pp") == F.col("x")) & (F.col("x") < F.col("p")), F.col("x")).otherwise(F.col("p")).alias("p"),
    )
    tree = cut(tree)
    while True:
        up = tree.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        higher = cut(tree.join(up, "p").select("x", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        release(tree)
        tree = higher
        if tree.where("moved").isEmpty():
            return tree


def connected_groups(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, group_id): one row per distinct id at either end, group_id the smallest id it is linked to.

    Rounds of Borůvka hooking: every component selects its smallest outgoing edge, the trees collapse by
    pointer doubling, edges are relabelled and deduplicated, until no edge joins two components. Each
    round at least halves the components that still have edges, so rounds are logarithmic in the ids,
    whatever the diameter. Only (component, component) rows are shuffled, aggregates combine before the
    shuffle, and every round is written to the shared checkpoint folder.

    Rows with a null end are ignored; an id linked only to itself is a group of its own; repeated and
    reversed edges count once; an empty input gives an empty result. Ids compare by code point.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null").distinct()
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    rest, rounds = cut(_canonical(pairs)), []
    while not rest.isEmpty():
        roots = _roots(_hook(rest))
        rounds.append(roots)
        a = roots.select(F.col("x").alias("u"), F.col("p").alias("pu"))
        b = roots.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        left = cut(_canonical(rest.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))))
        release(rest)
        rest = left
    if not rounds:
        return ids.select("id", F.col("id").alias("group_id"))
    final = _compose(rounds)
    named = cut(ids.join(final.withColumnRenamed("x", "id"), "id", "left").select("id", F.coalesce("p", "id").alias("root")))
    # written, so that the join can split the ids of a group that holds most of them
    least = cut(named.groupBy("root").agg(F.min("id").alias("group_id")))
    return named.join(least, "root").select("id", "group_id")


def _compose(rounds: list[DataFrame]) -> DataFrame:
    """The map of the first round followed through all later ones; later maps are ever smaller."""

    def after(later: DataFrame, earlier: DataFrame) -> DataFrame:
        top = later.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        return earlier.select("x", "p").join(top, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))

    return reduce(after, reversed(rounds)).select("x", "p")


def spelled(column: Column) -> Column:
    """A label without regard to case, spacing and separators."""
    return F.lower(F.regexp_replace(column, r"[^A-Za-z0-9]+", ""))
