from __future__ import annotations

import random
from functools import cache
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docketry.llm import chosen_path
from docketry.llm.hashing import TOKEN


@cache
def sets(t, n):
    k = TOKEN.findall(t or "")
    return set(zip(*(k[i:] for i in range(n))))


@cache
def alike(x, y, n):
    s, t = sets(x, n), sets(y, n)
    return len(s & t) / len(s | t) if s | t else 0


def truth(rows, n, threshold):
    known = {(k, g, t) for k, g, t in rows if k and g and t is not None}
    out = set()
    for (a, ga, x), (b, gb, y) in combinations(sorted(known), 2):
        if ga != gb and alike(x, y, n) >= threshold:
            out.add((a, b))
    return out


def corpus(seed, n=220):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        base = [rnd.choice(words) for _ in range(60)] if i % 4 == 0 or not rows else rnd.choice(rows)[2].split()
        for _ in range(rnd.randrange(4)):
            base[rnd.randrange(len(base))] = rnd.choice(words)
        rows.append((f"k{i:04d}", f"g{rnd.randrange(n)}", " ".join(base)))
    return rows


def similar(spark, rows, n=3, threshold=0.6):
    df = spark.createDataFrame(rows, "k string, g string, t string").withColumn("id", F.lit(1)).withColumn("class", F.lit(2)).withColumn("text", F.lit("x"))
    return chosen_path.similar_records(df, "k", "g", "t", n, threshold)


def run(spark, rows, every=False):
    return {(r[0], r[1]) for r in similar(spark, rows).pairs(every).collect()}


def test_against_all_pairs(spark):
    rows = corpus(1)
    want, got = truth(rows, 3, 0.6), run(spark, rows)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_copies_nulls_and_short_texts(spark):
    rows = [("a", "1", "x y z u v w q"), ("b", "2", "x y z u v w q"), ("c", "2", "x y z u v w q"), ("d", "3", "x y"), ("e", "4", "x y"), ("f", "5", ""), ("g", "6", None), (None, "7", "x y z u v w q")]
    got = run(spark, rows + rows)
    assert got == {("a", "b"), ("a", "c")}


def test_large_node_branches_and_streams(spark, monkeypatch):
    rows = [(f"k{i:03d}", f"g{i}", " ".join(f"common{j}" for j in range(40)) + f" tail{i} more{i} last{i}") for i in range(90)]
    assert len(run(spark, rows)) == 90 * 89 // 2


def copies(n):
    text = [f"w{i}" for i in range(30)]
    one, two, three = (" ".join([*text, x]) for x in ("one", "two", "three"))
    return [(f"a{i:04d}", f"g{i}", one) for i in range(n)] + [("b", "g0", two)] + [(f"c{i:04d}", "g0" if i < 5 else f"h{i}", three) for i in range(7)]


@pytest.mark.parametrize("n", [2, 33, 1000])
def test_any_number_of_copies(spark, n):
    rows = copies(n)
    want, found = truth(rows, 3, 0.6), similar(spark, rows)
    assert {(r[0], r[1]) for r in found.pairs(every=True).collect()} == want
    got = {(r[0], r[1]) for r in found.pairs().collect()}
    assert got <= want and (n > chosen_path.SPEAKERS or got == want)
    # no link between texts and no record is lost, and pairs don't grow with the square
    assert {(a[0], b[0]) for a, b in got} == {(a[0], b[0]) for a, b in want}
    assert {x for p in got for x in p} == {x for p in want for x in p}
    assert len(got) <= chosen_path.SPEAKERS * (n + 200)


def test_copies_of_one_group_do_not_hide_others(spark):
    rows = [(f"a{i:03d}", "g0" if i < 50 else f"g{i}", "one two three four five six") for i in range(52)]
    got = run(spark, rows)
    assert {x for p in got for x in p} == {r[0] for r in rows}


def test_classes(spark):
    got = {r["key"]: (r["class_key"], r["copies"], r["links"]) for r in similar(spark, copies(40) * 2).classes().collect()}
    assert len(got) == 48
    assert got["a0039"] == ("a0000", 40, 2) and got["b"] == ("b", 1, 2) and got["c0006"] == ("c0000", 7, 2)


def test_empty(spark):
    assert run(spark, []) == set()
