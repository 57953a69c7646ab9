from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docketry.llm import components


def groups_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string").withColumn("u", F.lit("clash")).withColumn("p", F.lit(1))
    return {r["id"]: r["group_id"] for r in components.connected_groups(df).collect()}


def test_chain_star_loop_and_nulls(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    star = [("hub", f"s{i}") for i in range(30)]
    edges = [*chain, *star, ("x", "x"), (None, "y"), ("z", None), ("q", "r"), ("r", "q"), ("q", "r")]
    assert run(spark, edges) == groups_of(edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(80):02d}", f"n{rnd.randrange(80):02d}") for _ in range(60)]
    assert run(spark, edges) == groups_of(edges)


def test_no_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "a")]) == {"a": "a"}


def test_labels_without_regard_to_spelling(spark):
    df = spark.createDataFrame([(" Same Record-As",), ("same_record_as",), ("cites",)], "t string")
    assert [r[0] for r in df.select(components.spelled(F.col("t"))).collect()] == ["samerecordas", "samerecordas", "cites"]
