"""Bringing quantities recorded in different units and scales to common units.

Two operators. ``common_amounts`` reads the unit that each row states about itself. ``unit_shifts`` needs
no unit at all: it segments each source's history of values and takes a level shift by a known factor for
a change of unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import quantities
from docketry.session import cut


#: Blocks whose segments are searched again together.
FAN = 64


@F.pandas_udf(T.StructType([T.StructField("number", T.DoubleType()), T.StructField("unit", T.StringType())]))
def _read(raw: pd.Series, unit: pd.Series, normalized: pd.Series) -> pd.DataFrame:
    numbers, units = [], []
    for r, u, n in zip(raw, unit, normalized):
        got = quantities.stated_amount(r)
        code = got and (got[1] or (quantities.unit_of(u) if u is not None else quantities.trailing_unit(n)))
        numbers.append(got[0] if code else None)
        units.append(code or None)
    return pd.DataFrame({"number": pd.Series(numbers, dtype="float64"), "unit": pd.Series(units, dtype="object")})


@F.pandas_udf(T.StringType())
def _unit(raw: pd.Series, unit: pd.Series, normalized: pd.Series) -> pd.Series:
    stated = ((quantities.stated_amount(r), u, n) for r, u, n in zip(raw, unit, normalized))
    return pd.Series([(got and got[1]) or quantities.unit_of(u) or quantities.trailing_unit(n) for got, u, n in stated], dtype="object")


def dimensions(facts: DataFrame, units: DataFrame) -> DataFrame:
    """``facts`` with the dimension of the unit that each row names in ``raw_text``, ``unit`` or ``normalized_text``; null if none is known."""
    ref = units.where("unit_code is not null").groupBy(F.col("unit_code").alias("named_unit")).agg(F.min("dimension").alias("dimension"))
    return facts.withColumn("named_unit", _unit("raw_text", "unit", "normalized_text")).join(ref, "named_unit", "left").drop("named_unit")


def unit_ratios(units: DataFrame) -> DataFrame:
    """(dimension, factor): every ratio other than 1 between two factors of a dimension of the reference table."""
    ref = units.where("factor > 0").select("dimension", F.col("factor").cast("double").alias("f")).distinct()
    pairs = ref.join(ref.withColumnRenamed("f", "g"), "dimension").where("f <> g")
    return pairs.select("dimension", (F.col("f") / F.col("g")).alias("factor")).distinct()


def common_amounts(facts: DataFrame, units: DataFrame, key: str = "fact_id") -> DataFrame:
    """(key, common_unit, amount, value_key): every row that states one readable amount, in common units.

    The text states the amount; a unit missing there is taken from ``unit``, and if that is null, from
    ``normalized_text``. ``numeric_value`` is ignored, as it may be stale. Rows with a null or unreadable
    text, a range, a placeholder or an unknown unit give no row; repeated rows give one. ``units`` is the
    reference table (unit_code, common_unit, factor), fixed in size. Empty inputs give an empty result.
    Reading and conversion are row by row; the only shuffle removes copies by key.
    """
    read = facts.select(F.col(key).alias("key"), _read("raw_text", "unit", "normalized_text").alias("r")).where("r.unit is not null")
    ref = units.select(F.col("unit_code").alias("code"), "common_unit", F.col("factor").cast("double").alias("factor")).dropDuplicates(["code"])
    amount = F.col("r.number") * F.col("factor")
    return (
        read.join(ref, F.col("r.unit") == F.col("code"))
        .select("key", "common_unit", amount.alias("amount"), F.floor(amount + 0.5).cast("long").alias("value_key"))
        .distinct()
        .withColumnRenamed("key", key)
    )


def optimal_segments(weight: np.ndarray, total: np.ndarray, square: np.ndarray, penalty: float) -> list[int]:
    """End positions of the segments with least squared error plus ``penalty`` each: exact, by pruned search.

    Point i stands for ``weight[i]`` observations with the given sum and sum of squares.
    """
    n = len(weight)
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weight, total, square))
    best = np.full(n + 1, np.inf)
    best[0], last, open_ = -penalty, np.zeros(n + 1, dtype=int), np.array([0])
    for t in range(1, n + 1):
        dw = w[t] - w[open_]
        cost = q[t] - q[open_] - (s[t] - s[open_]) ** 2 / np.where(dw > 0, dw, 1)
        trial = best[open_] + cost
        k = int(np.argmin(trial))
        best[t], last[t] = trial[k] + penalty, open_[k]
        open_ = np.append(open_[trial <= best[t] + 1e-12], t)
    ends, t = [], n
    while t > 0:
        ends.append(t)
        t = last[t]
    return ends[::-1]


def _noise(x: np.ndarray) -> float:
    """Variance of the noise, from the median step, which a few level shifts don't move."""
    if len(x) < 3:
        return 1.0
    return max(float(np.median(np.abs(np.diff(x)))) / 0.6745 / math.sqrt(2), 1e-3) ** 2


_KEPT = ("first_at", "last_at", "first_row", "last_row", "n", "total", "square", "noise")
_PARTS = "series string, block long, part int, first_at string, last_at string, first_row long, last_row long, n long, total double, square double, noise double"


def _by_block(penalty: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for series, block, points in zip(pdf["series"], pdf["block"], pdf["points"]):
                x = np.array([p["x"] for p in points], dtype=float)
                noise = _noise(x)
                start = 0
                for end in optimal_segments(np.ones(len(x)), x, x * x, penalty * noise * math.log(max(len(x), 2))):
                    part, a, b = x[start:end], points[start], points[end - 1]
                    out.append((series, block, start, a["at"], b["at"], a["row"], b["row"], end - start, float(part.sum()), float((part**2).sum()), noise))
                    start = end
            yield pd.DataFrame(out, columns=["series", "block", "part", *_KEPT])

    return run


def _merge(penalty: float):
    """Segments of neighbouring blocks searched again as weighted points, so a shift at a block's edge is no artefact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for series, block, parts in zip(pdf["series"], pdf["block"], pdf["parts"]):
                w, s, q = (np.array([p[k] for p in parts], dtype=float) for k in ("n", "total", "square"))
                noise = float(np.average([p["noise"] for p in parts], weights=w))
                start = 0
                for end in optimal_segments(w, s, q, penalty * noise * math.log(max(w.sum(), 2))):
                    a, b = parts[start], parts[end - 1]
                    out.append((series, block, start, a["first_at"], b["last_at"], a["first_row"], b["last_row"], int(w[start:end].sum()), float(s[start:end].sum()), float(q[start:end].sum()), noise))
                    start = end
            yield pd.DataFrame(out, columns=["series", "block", "part", *_KEPT])

    return run


def _labelled(parts: DataFrame, factors: list[float] | DataFrame, tolerance: float) -> DataFrame:
    """Segments with the known factor between their level and that of the series' longest segment."""
    mean = F.col("total") / F.col("n")
    level = cut(parts.groupBy("series").agg(F.max_by(mean, F.struct("n", (-F.col("first_row")).alias("f"))).alias("level")))
    number = F.row_number().over(Window.partitionBy("series").orderBy("first_row")) - 1
    rows = parts.join(level, "series").withColumn("mean_log", mean).withColumn("shift", mean - F.col("level")).withColumn("segment", number)
    if isinstance(factors, DataFrame):
        logs = factors.where("factor > 0 and factor <> 1").groupBy("dimension").agg(F.collect_set(F.log("factor")).alias("logs"))
        rows = rows.withColumn("dimension", F.regexp_extract("series", r"([^|]*)$", 1)).join(F.broadcast(logs), "dimension", "left")
    else:
        rows = rows.withColumn("logs", F.array(*(F.lit(x) for x in sorted({math.log(f) for f in factors if f > 0 and f != 1}))).cast("array<double>"))
    near = F.array_min(F.transform("logs", lambda x: F.struct(F.abs(F.col("shift") - x).alias("far"), x.alias("log"))))
    factor = F.when((near["far"] <= tolerance) & (F.abs("shift") > tolerance), F.exp(near["log"])).otherwise(1.0)
    return rows.select("series", "segment", "first_at", "last_at", "first_row", "last_row", "n", "mean_log", factor.alias("factor"))


def _in_rows(history: DataFrame) -> DataFrame:
    """The usable rows of ``history`` with ``row``, their rank within the series from 0.

    Ranked by a range partitioning in the order of the series, numbered where the rows lie and offset by the
    counts of the partitions before, of which there are as many as shuffle partitions: no task sorts a hot series.
    """
    rows = history.where("value > 0 and value < 1.0e300 and series is not null and at is not null").withColumn("x", F.log("value"))
    by = ["series", "at", "x"]
    low = (1 << 33) - 1
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id()))
    task = F.shiftright("_n", 33)
    counts = sorted((r["t"], r["count"]) for r in placed.groupBy(task.alias("t")).count().collect())
    offsets, before = [], 0
    for t, n in counts:
        offsets.append((t, before))
        before += n
    known = history.sparkSession.createDataFrame(offsets, "_t long, _before long")
    numbered = placed.withColumn("_t", task).join(F.broadcast(known), "_t").withColumn("row", F.col("_n").bitwiseAND(F.lit(low)) + F.col("_before")).drop("_n", "_t", "_before")
    first = cut(numbered.groupBy("series").agg(F.min("row").alias("_first")))
    return numbered.join(first, "series").withColumn("row", F.col("row") - F.col("_first")).drop("_first")


def unit_shifts(history: DataFrame, factors: list[float] | DataFrame, penalty: float = 3.0, tolerance: float = 0.12, block: int = 512) -> DataFrame:
    """(series, segment, first_at, last_at, n, mean_log, factor) of each series' history of positive values.

    ``history`` has series, at (string, its order) and value. Penalised changepoint search (least squares on
    log values), exact within a block, runs in every ``block`` successive rows of a series, then again over the segments of ``FAN``
    neighbouring blocks, and so on, so a shift at a block's edge is kept or dropped by the same rule and no
    task gets a whole hot series. For histories of several blocks that is approximate: a shift too short to be
    seen on one side of an edge can be lost, and noise and penalty are the block's. The level with most
    observations is the series' own; a segment whose level differs from it by a known factor was recorded
    in another unit: dividing its values by ``factor`` reverses that (``in_own_units``). ``factor`` is 1
    elsewhere. ``factors`` are those of all series, or a table (dimension, factor) for series that end in ``|dimension``.

    Null, zero, negative and non-finite values are ignored; ties in order fall to the value; a single value
    is one segment; repeated rows are repeated observations; an empty history gives no row.
    """
    return _shifts(cut(_in_rows(history.select("series", "at", "value"))), factors, penalty, tolerance, block).drop("first_row", "last_row")


def _shifts(rows: DataFrame, factors: list[float] | DataFrame, penalty: float, tolerance: float, block: int) -> DataFrame:
    points = rows.select("series", F.floor(F.col("row") / block).cast("long").alias("block"), F.struct("row", "at", "x").alias("p"))
    blocks = points.groupBy("series", "block").agg(F.sort_array(F.collect_list("p")).alias("points"))
    parts = cut(blocks.mapInPandas(_by_block(penalty), _PARTS))
    steps = parts.agg(F.max("block")).first()[0] or 0
    while steps:
        wider = parts.groupBy("series", F.floor(F.col("block") / FAN).cast("long").alias("wide")).agg(F.sort_array(F.collect_list(F.struct("block", "part", *_KEPT))).alias("parts"))
        parts, steps = cut(wider.select("series", F.col("wide").alias("block"), "parts").mapInPandas(_merge(penalty), _PARTS)), steps // FAN
    return _labelled(parts, factors, tolerance)


def in_own_units(history: DataFrame, factors: list[float] | DataFrame, penalty: float = 3.0, tolerance: float = 0.12, block: int = 512) -> DataFrame:
    """The usable rows of ``history`` with ``factor`` and ``own_value``: the unit change of ``unit_shifts`` reversed.

    Rows find their segment by the block that they lie in, so a hot series meets in no task. Other columns of
    ``history`` are kept, but for x, row, segment, factor and own_value.
    """
    taken = ("x", "row", "segment", "factor", "own_value", "first_row", "last_row", "block")
    rows = cut(_in_rows(history.drop(*taken)))
    parts = _shifts(rows.select("series", "at", "x", "row"), factors, penalty, tolerance, block)
    over = F.sequence(F.floor(F.col("first_row") / block), F.floor(F.col("last_row") / block))
    covers = cut(parts.select("series", F.explode(over).alias("block"), "segment", "first_row", "last_row", "factor"))
    found = rows.withColumn("block", F.floor(F.col("row") / block)).join(covers, ["series", "block"]).where("row between first_row and last_row")
    return found.withColumn("own_value", F.col("value") / F.col("factor")).drop("x", "row", "block", "first_row", "last_row")
