from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from docketry import __main__ as commands
from docketry.sources import addresses, transport
from docketry.streaming import ledger


def test_addresses(spark):
    from urllib.parse import urljoin

    base = "https://h.example:8080/a/b/page.html?x=1#top"
    hrefs = ["next", "/root", "//other/x", "https://z/y", "?q=2", "c/d.pdf?e=1"]
    got = spark.range(1).select(*(addresses.resolved(F.lit(base), F.lit(h)) for h in hrefs)).first()
    assert list(got) == [urljoin(base, h) for h in hrefs]
    one = spark.range(1).select(addresses.only_value(F.lit("https://h/?a=1&b=&c=1&c=2"), "a"), addresses.only_value(F.lit("https://h/?b="), "b"), addresses.only_value(F.lit("https://h/?c=1&c=2"), "c"), addresses.only_value(F.lit("https://h/"), "a"))
    assert list(one.first()) == ["1", None, None, None]
    links = spark.createDataFrame([("#x",), ("javascript:go()",), (" MAILTO:a@b",), ("",), ("doc.pdf",)], "h string")
    assert [r["h"] for r in links.where(addresses.eligible(F.col("h"))).collect()] == ["doc.pdf"]
    times = spark.createDataFrame([(None,), ("soon",), ("2024-01-01T00:00:00",), ("2024-01-01T00:00:00+02:00",), ("2025-01-01T00:00:00Z",)], "t string")
    assert [r[0] for r in times.select(addresses.time_relation(F.col("t"), F.to_timestamp(F.lit("2024-01-01T00:00:00Z")))).collect()] == ["unknown", "unparseable", "unparseable", "at_or_before_observation", "after_observation"]


def test_visits_retry_only_what_may_pass(spark):
    pdf = "255044462D31"
    rows = [
        ("ok", "s", 1, 503, None, "application/pdf", None, None), ("ok", "s", 2, 200, "application/pdf; v=1", "application/pdf", pdf, "a1"), ("ok", "s", 3, 200, "application/pdf", "application/pdf", pdf, "a2"),
        ("gone", "s", 1, 404, None, None, None, None), ("gone", "s", 2, 200, "text/html", None, "3C", "a3"), ("down", "s", 1, None, None, None, None, None), ("down", "s", 2, 429, None, None, None, None), ("down", "s", 3, 500, None, None, None, None), ("down", "s", 4, 200, "text/html", None, "3C", "a4"),
        ("fake", "s", 1, 200, "application/pdf", None, "3C68", "a5"), ("other", "s", 1, 200, "text/html", "application/pdf", pdf, "a6"),
    ]
    df = spark.createDataFrame(rows, "visit string, source string, attempt int, status int, content_type string, expected string, head string, artifact string")
    got = {r["visit"]: (r["attempts"], r["error"], r["artifact"]) for r in transport.visits(df).collect()}
    assert got == {"ok": (2, None, "a1"), "gone": (1, "HTTP 404", None), "down": (3, "HTTP 500", None), "fake": (1, "missing PDF magic bytes", None), "other": (1, "expected media type application/pdf, received text/html", None)}
    assert transport.visits(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        transport.visits(df, 0)


def test_blobs_are_kept_once_and_checked(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    files = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),), (None,)], "content binary")
    for _ in range(2):
        transport.store_blobs(files, folder)
    kept = spark.read.parquet(folder)
    assert kept.count() == 2 and transport.damaged_blobs(kept).count() == 0
    assert transport.damaged_blobs(kept.withColumn("content", F.lit(b"x"))).count() == 2


def test_ledger_takes_every_visit_once(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    schema = "source string, at timestamp, seq long, artifact string"
    day = lambda n: __import__("datetime").datetime(2024, 1, n)
    one = spark.createDataFrame([("s", day(1), 1, "a"), ("s", day(2), 2, "b"), ("t", day(1), 3, None), ("s", day(1), 1, "a")], schema)
    two = spark.createDataFrame([("s", day(2), 2, "b"), ("s", day(3), 4, None), ("s", day(4), 5, "a"), ("t", day(3), 6, "x")], schema)
    for batch, rows in ((0, one), (1, two), (1, two)):
        ledger.append_batch(rows, batch, folder)
    got = {r["seq"]: (r["state"], r["previous"]) for r in spark.read.parquet(f"{folder}/ledger").collect()}
    assert got == {1: ("new", None), 2: ("changed", "a"), 3: ("unavailable", None), 4: ("unavailable", "b"), 5: ("changed", "b"), 6: ("new", None)}
    assert spark.read.parquet(f"{folder}/ledger").count() == 6


def test_index_by_batches(spark, tmp_path):
    from docketry.operators import search

    docs = [(f"d{i}", f"alpha word{i} {'beta ' * (i % 3)}") for i in range(9)]
    for batch in (0, 1, 1, 2):
        ledger.index_batch(spark.createDataFrame(docs[batch * 3 : batch * 3 + 3], "k string, t string"), batch, str(tmp_path / "i"), "k", "t")
    want = search.search(search.build(spark.createDataFrame(docs, "k string, t string"), "k", "t"), "alpha beta", 5).collect()
    got = search.search(ledger.index_of(spark, str(tmp_path / "i")), "alpha beta", 5).collect()
    assert [(r["id"], round(r["score"], 9)) for r in got] == [(r["id"], round(r["score"], 9)) for r in want]


def test_commands(spark):
    d = "/root/testdata/sf0.001"
    out = io.StringIO()
    assert commands.main(["status", d], spark, out) == 0
    assert {json.loads(x)["name"] for x in out.getvalue().splitlines()} >= {"sources", "evidence_facts"}
    out = io.StringIO()
    assert commands.main(["amounts", d, "--min", "1000", "--max", "1e9", "--limit", "3"], spark, out) == 0 and len(out.getvalue().splitlines()) == 3
    assert commands.main(["amounts", d, "--min", "5", "--max", "1"], spark, out) == 1
    assert commands.main(["dates", d, "--start", "08/18/2026"], spark, out) == 1
    assert commands.main(["search", d, "zzzabsentzzz"], spark, out) == 2
    assert commands.main(["nosuch", d], spark, out) == 2
    assert commands.boundary("20240105") == "2024-01-05" and commands.boundary(None) is None
    from docketry.plans import catalog

    assert set(commands.ALIASES.values()) <= set(catalog.queries())
