from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docketry.llm import paragraphs
from docketry.llm.hashing import TOKEN


def sets(t):
    k = TOKEN.findall(t.lower())
    return set(zip(*(k[i:] for i in range(5))))


def brute(rows):
    parts = sorted({(k, g, i, p) for k, g, t in rows if k and g and t is not None for i, p in enumerate(t.split("\n\n")) if len(TOKEN.findall(p.lower())) >= 5})
    root = list(range(len(parts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(parts)), 2):
        a, b = sets(parts[i][3]), sets(parts[j][3])
        if len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    out, groups = {}, {}
    for i, p in enumerate(parts):
        groups.setdefault(top(i), set()).add(p[1])
    for i, (k, *_) in enumerate(parts):
        n, r, m = out.get(k, (0, 0, 0))
        out[k] = (n + 1, r + (len(groups[top(i)]) > 1), m + (top(i) != i))
    return out


def test_against_all_pairs(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    pool = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(25)]
    rows = []
    for i in range(90):
        some = [rnd.choice(pool) if rnd.random() < 0.6 else " ".join(rnd.choice(words) for _ in range(40)) for _ in range(rnd.randrange(1, 5))]
        edited = []
        for p in some:
            w = p.split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "edited"
            edited.append(" ".join(w))
        rows.append((f"k{i:03d}", f"g{i // 2}", "\n\n".join([*edited, "too short"])))
    rows += [("empty", "g", ""), ("null", "g", None), (None, "g", pool[0]), ("nogroup", None, pool[0])] + rows[:5]
    df = spark.createDataFrame(rows, "k string, g string, t string").withColumn("id", F.lit(1)).withColumn("text", F.lit("clash"))
    got = {r["k"]: (r["paragraphs"], r["repeated"], r["removable"]) for r in paragraphs.repeated(df, "k", "g", "t").collect()}
    assert got == brute(rows)
    assert paragraphs.repeated(df.limit(0), "k", "g", "t").count() == 0


def test_bands_are_tuned():
    bands, rows = paragraphs.tuned_bands(0.8, 0.999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)
    with pytest.raises(ValueError):
        paragraphs.tuned_bands(0.1, 0.999, 4)
