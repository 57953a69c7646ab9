from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import packing


@pytest.mark.parametrize(("cap", "n", "seed"), [(64, 500, 1), (256, 4000, 2), (1024, 3000, 3), (10, 3, 4)])
def test_plan_holds_every_item_once(cap, n, seed):
    rnd = np.random.default_rng(seed)
    h = np.bincount(np.minimum(rnd.geometric(6 / cap, n), cap), minlength=cap + 1)
    plan = packing.plan(h, cap)
    held = np.zeros_like(h)
    for p in plan:
        assert sum(a * k for a, k in p.lengths) <= cap and p.repeats > 0
        for a, k in p.lengths:
            held[a] += k * p.repeats
    assert (held == h).all()
    used, tokens = sum(p.repeats for p in plan), int((np.arange(cap + 1) * h).sum())
    assert n < 100 or used <= 1.03 * np.ceil(tokens / cap)


def test_least_squares_finds_exact_counts():
    patterns = [[(6, 1), (4, 1)], [(5, 2)], [(7, 1), (3, 1)]]
    h = np.zeros(11)
    h[6] = h[4] = 20
    h[5] = 30
    h[7] = h[3] = 8
    assert np.allclose(packing.nonnegative_least_squares(patterns, h), [20, 15, 8], atol=0.01)


def run(spark, sizes, packs):
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens int").withColumn("cap", F.lit(1)).withColumn("pack_name", F.lit("x"))
    return packing.packed(items, spark.createDataFrame(packs, "pack_name string, capacity_tokens int"), "doc_id")


def test_containers(spark):
    rnd = random.Random(3)
    sizes = [rnd.randrange(0, 90) for _ in range(400)] + [50] * 300 + [1000, 100, None]
    packs = [("a", 100), ("b", 32), ("bad", 0), (None, 5)]
    out = run(spark, sizes, packs).toPandas()
    assert set(out["pack_name"]) == {"a", "b"}
    for name, cap in packs[:2]:
        own = out[out["pack_name"] == name]
        assert own.groupby("container_id")["n_tokens"].sum().max() <= cap
        whole = own.groupby("doc_id")["n_tokens"].sum()
        assert whole.to_dict() == {i: s for i, s in enumerate(sizes) if s is not None}
        pieces = own.groupby("doc_id")["piece"].count()
        assert all((pieces[i] == 1) == (s <= cap) for i, s in enumerate(sizes) if s is not None)
        for i, g in own.sort_values("piece").groupby("doc_id"):
            assert g["token_start"].tolist() == [0, *g["n_tokens"].cumsum().tolist()[:-1]]
    fill = {r["pack_name"]: r["fill_share"] for r in packing.fill(run(spark, sizes, packs), spark.createDataFrame(packs, "pack_name string, capacity_tokens int")).collect()}
    assert fill["a"] > 0.97


def test_empty(spark):
    assert run(spark, [], [("a", 10)]).count() == 0
    assert run(spark, [5], []).count() == 0
