from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import units

REF = [("usd", "money", "usd", 1.0), ("usd_million", "money", "usd", 1e6), ("acre", "area", "sq_ft", 43560.0), ("usd_thousand", "money", "usd", 1e3)]


def test_common_amounts(spark):
    rows = [
        ("a", "$2.5M", "usd", "x", 9.0), ("b", "12", "$000", None, None), ("c", "7", None, "7.0 acres", 7.0), ("d", "7", None, None, None), ("e", None, "usd", "5 usd", 5.0),
        ("f", "$1 - $2", "usd", None, None), ("a", "$2.5M", "usd", "x", 9.0), ("g", "3 furlongs", None, None, None), ("h", "", "usd", "", None),
    ]
    facts = spark.createDataFrame(rows, "fact_id string, raw_text string, unit string, normalized_text string, numeric_value double").withColumn("factor", F.lit(1)).withColumn("key", F.lit("clash"))
    ref = spark.createDataFrame(REF, "unit_code string, dimension string, common_unit string, factor double")
    got = sorted((r["fact_id"], r["common_unit"], r["value_key"]) for r in units.common_amounts(facts, ref).collect())
    assert got == [("a", "usd", 2500000), ("b", "usd", 12000), ("c", "sq_ft", 304920)]
    assert units.common_amounts(facts.limit(0), ref).count() == 0


def cost(x, cuts, penalty):
    edges = [0, *cuts, len(x)]
    return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + penalty for a, b in itertools.pairwise(edges))


def test_segments_are_optimal():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        x = np.concatenate([rnd.normal(rnd.integers(0, 4), 0.5, rnd.integers(1, 5)) for _ in range(3)])
        ends = units.optimal_segments(np.ones(len(x)), x, x * x, 0.8)
        best = min(cost(x, c, 0.8) for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k))
        assert abs(cost(x, ends[:-1], 0.8) - best) < 1e-9 and ends[-1] == len(x)


@pytest.mark.parametrize("block", [512, 20])
def test_unit_shift_is_found_across_blocks(spark, block):
    rnd = np.random.default_rng(2)
    value = np.exp(rnd.normal(8, 0.05, 1500))
    value[600:1000] /= 1000
    rows = [("s", f"{i:06d}", float(v)) for i, v in enumerate(value)] + [("s", "999999", None), ("t", "000001", 5.0), ("t", "000002", -1.0), (None, "1", 1.0)]
    history = spark.createDataFrame(rows, "series string, at string, value double").withColumn("row", F.lit(7))
    got = sorted((r["series"], r["first_at"], r["last_at"], r["n"], r["factor"]) for r in units.unit_shifts(history, [1000.0, 1e-3, 10.0], block=block).collect())
    assert [(s, a, b, n) for s, a, b, n, _ in got] == [("s", "000000", "000599", 600), ("s", "000600", "000999", 400), ("s", "001000", "001499", 500), ("t", "000001", "000001", 1)]
    assert [round(f, 6) for *_, f in got] == [1, 0.001, 1, 1]
    own = {(r["series"], r["at"]): (r["segment"], r["own_value"]) for r in units.in_own_units(history, [1000.0, 1e-3, 10.0], block=block).collect()}
    assert len(own) == 1501 and [own["s", f"{i:06d}"][0] for i in (0, 599, 600, 999, 1000, 1499)] == [0, 0, 1, 1, 2, 2]
    assert all(6.5 < np.log(v) < 9.5 for (s, _), (_, v) in own.items() if s == "s") and own["t", "000001"] == (0, 5.0)
    assert units.unit_shifts(history.limit(0), [10.0]).count() == 0
    assert units.in_own_units(history.limit(0), [10.0]).count() == 0


def test_p2_unit_shifts_knows_the_factors_of_each_dimension(spark, tmp_path):
    from docketry.plans.quantities import p2_unit_shifts

    rnd = np.random.default_rng(3)
    rows, want = [], {"area": 43560.0, "length": 5280.0, "mass": 2000.0, "volume": 325851.43, "money": 1000.0}
    for d, unit in (("area", "sq ft"), ("length", "ft"), ("mass", "lb"), ("volume", "gal"), ("money", "usd")):
        value = np.exp(rnd.normal(15, 0.02, 60))
        value[40:] /= want[d]
        rows += [(f"{d}{i}", "money" if d == "money" else "quantity", "a", f"page:{i}", 0, float(v), f"{v:.0f}", unit, None) for i, v in enumerate(value)]
    spark.createDataFrame(rows, "fact_id string, fact_type string, artifact_id string, locator string, char_start int, numeric_value double, raw_text string, unit string, normalized_text string").write.parquet(f"{tmp_path}/evidence_facts.parquet")
    ref = [(u, d, c, f) for d, c, u, f in [("area", "sq_ft", "sq_ft", 1.0), ("area", "sq_ft", "acre", 43560.0), ("length", "ft", "ft", 1.0), ("length", "ft", "mile", 5280.0), ("mass", "lb", "lb", 1.0), ("mass", "lb", "short_ton", 2000.0), ("volume", "gal", "gal", 1.0), ("volume", "gal", "acre_ft", 325851.43), ("money", "usd", "usd", 1.0), ("money", "usd", "usd_thousand", 1000.0)]]
    spark.createDataFrame(ref, "unit_code string, dimension string, common_unit string, factor double").write.parquet(f"{tmp_path}/unit_reference.parquet")
    got = {(r["series"], r["segment"]): (r["n"], 1 / r["factor"]) for r in p2_unit_shifts(spark, str(tmp_path)).collect()}
    assert set(got) == {(f"a|{d}", k) for d in want for k in (0, 1)}
    for d, factor in want.items():
        assert got[f"a|{d}", 0] == (40, 1) and got[f"a|{d}", 1][0] == 20 and abs(got[f"a|{d}", 1][1] / factor - 1) < 1e-6
