from __future__ import annotations

import random

from pyspark.sql import functions as F

from docketry.llm import mixing

TARGETS = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 4), ("n", "big", 0.9, 1), ("n", "gone", 0.05, 3), ("n", "small", 0.05, 8)]


def docs(spark):
    rnd = random.Random(1)
    rows = [("big", rnd.randrange(50, 500)) for _ in range(3000)] + [("mid", rnd.randrange(50, 900)) for _ in range(400)] + [("small", rnd.randrange(20, 300)) for _ in range(60)] + [(None, 9), ("big", 0), ("other", 70)]
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, n_tokens int").withColumn("n", F.lit(1)).withColumn("rate", F.lit(1.0)).drop("n", "rate")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    used = mixing.balanced(docs(spark), targets, "doc_id").cache()
    shares = {(r["mix_name"], r["source"]): r for r in mixing.shares(used, targets).collect()}
    for (mix, source, share, cap) in TARGETS:
        r = shares[mix, source]
        want = 0 if source == "gone" else share / (0.95 if mix == "n" else 1)
        assert abs(r["actual_share"] - want) < 0.005, (mix, source, r["actual_share"])
    assert used.where("copies < 1").count() == 0
    caps = {(m, s): c for m, s, _, c in TARGETS}
    assert all(r["copies"] <= caps[r["mix_name"], r["source"]] for r in used.collect())
    assert used.select("mix_name", "doc_id").distinct().count() == used.count()


def test_budget_is_the_largest_possible():
    got = mixing._budgets({"a": 100, "b": 1000}, [("m", "a", 0.5, 2), ("m", "b", 0.5, 1), ("m", "c", 0.1, 1)])
    assert got == {("m", "a"): 200.0, ("m", "b"): 200.0}


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    assert mixing.balanced(none, targets, "doc_id").count() == 0
    assert mixing.balanced(docs(spark), targets.limit(0), "doc_id").count() == 0
