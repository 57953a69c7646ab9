from __future__ import annotations

import random

from pyspark.sql import functions as F

from docketry.llm import spans


def text(rnd, n):
    return "".join(rnd.choice("abcdefghij klmnop é") for _ in range(n))


def shared(rows, length):
    where = {}
    for _, g, t in rows:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(g)
    return {k: {i for i in range(len(t or "") - length + 1) if len(where[t[i : i + length]]) > 1} for k, g, t in rows if k is not None}


def corpus():
    rnd = random.Random(5)
    part, hot, edge = text(rnd, 260), text(rnd, 400), text(rnd, 200)
    rows = [("a", "g1", text(rnd, 300) + part), ("b", "g2", part + text(rnd, 50)), ("c", "g2", text(rnd, 10) + part), ("d", "g3", text(rnd, 900))]
    rows += [(f"h{i}", f"gh{i}", text(rnd, 40) + hot + text(rnd, 40)) for i in range(12)]
    rows += [("e", "g4", text(rnd, 17) + edge + text(rnd, 17)), ("f", "g5", text(rnd, 31) + edge), ("n", "g6", edge[1:] + "!"), ("m", "g7", "?" + edge[1:])]
    rows += [("s1", "same", text(rnd, 30)), ("own1", "own", text(rnd, 1) + hot[:150]), ("empty", "g8", ""), ("null", "g9", None)]
    own = text(rnd, 300)
    return rows + [("o1", "o", own), ("o2", "o", own), ("long", "g10", text(rnd, 5000) + part + text(rnd, 3000))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, g string, t string").withColumn("rec", F.lit(0)).withColumn("text", F.lit("clash"))


def test_records_with_a_shared_span(spark):
    rows = corpus()
    want = {k for k, at in shared(rows, 200).items() if at}
    df = frame(spark, rows + rows[:3])
    assert {r[0] for r in spans.SharedSpans(df, "k", "g", "t").records().collect()} == want


def test_coverage(spark):
    rows = corpus()
    got = {r["k"]: r["shared_chars"] for r in spans.SharedSpans(frame(spark, rows), "k", "g", "t").coverage().collect()}
    want = {}
    for k, at in shared(rows, 200).items():
        if at:
            want[k] = len({c for i in at for c in range(i, i + 200)})
    assert got == want


def test_groups(spark):
    got = {r["k"]: r["group_key"] for r in spans.SharedSpans(frame(spark, corpus()), "k", "g", "t").groups().collect()}
    assert got["a"] == got["b"] == got["c"] == got["long"] == "a"
    assert {got[f"h{i}"] for i in range(12)} == {"h0"}
    assert got["e"] == got["f"]


def test_short_link_between_records_with_long_links(spark):
    rnd = random.Random(11)
    one, two, short = text(rnd, 600), text(rnd, 600), text(rnd, 220)
    rows = [("a", "g1", one + text(rnd, 50) + short), ("b", "g2", text(rnd, 40) + one), ("c", "g3", short + text(rnd, 50) + two), ("d", "g4", two + text(rnd, 40))]
    got = {r["k"]: r["group_key"] for r in spans.SharedSpans(frame(spark, rows), "k", "g", "t").groups().collect()}
    assert got == dict.fromkeys("abcd", "a")


def test_pieces_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 2048)
    rnd = random.Random(9)
    part = text(rnd, 230)
    rows = [("x", "1", text(rnd, 3000) + part + text(rnd, 4000)), ("y", "2", text(rnd, 1900) + part + text(rnd, 100)), ("z", "3", text(rnd, 6000))]
    import pyarrow as pa

    def prints(k):
        batch = pa.record_batch({"rec": [0], "grp": [int(rows[k][1])], "text": [rows[k][2]]})
        return {f for b in spans._fingerprints(200, 100)(iter([batch])) for f in b.column("fp").to_pylist()}

    assert prints(0) & prints(1) and not prints(0) & prints(2)


def test_empty(spark):
    assert spans.SharedSpans(frame(spark, []), "k", "g", "t").records().count() == 0
