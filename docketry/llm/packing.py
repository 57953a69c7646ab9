"""Filling fixed-capacity containers by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import cut


@dataclass
class Pattern:
    """``repeats`` containers, each holding ``lengths`` (length, how many)."""

    lengths: list[tuple[int, int]]
    repeats: int


def combinations(present: np.ndarray, capacity: int, window: int, counts: int = 6) -> list[list[tuple[int, int]]]:
    """Shallow combinations of present lengths whose sum lies in the window below the capacity.

    k items of one length, with k from the most that fit downwards, alone or with items of one other
    length that fill what is left: the longest that fits once, and the longest that fits twice.
    """
    lengths = np.flatnonzero(present)
    out: set[tuple[tuple[int, int], ...]] = set()
    for a in lengths.tolist():
        most = capacity // a
        ks = sorted({most, *range(max(1, most - counts + 1), most + 1), *(max(1, most * j // counts) for j in range(1, counts))}, reverse=True)
        for k in ks:
            left = capacity - k * a
            if left <= window:
                out.add(((a, k),))
            for m in (1, 2):
                i = int(np.searchsorted(lengths, left // m, side="right")) - 1
                for b in lengths[max(0, i - 1) : i + 1].tolist() if i >= 0 else []:
                    if b != a and k * a + m * b >= capacity - window and k * a + m * b <= capacity:
                        out.add(tuple(sorted([(a, k), (b, m)], reverse=True)))
    return [list(p) for p in sorted(out)]


def nonnegative_least_squares(patterns: list[list[tuple[int, int]]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 minimising ``|A x - h|``, A's columns the patterns: accelerated projected gradient, columns and rows scaled."""
    rows = np.concatenate([[n for n, _ in p] for p in patterns]).astype(int)
    mult = np.concatenate([[k for _, k in p] for p in patterns]).astype(float)
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    weight = rows.astype(float)  # a token unplaced counts alike, whatever the item's length
    mult = mult * weight
    goal = histogram * np.arange(len(histogram), dtype=float)
    norm = np.sqrt(np.bincount(cols, mult**2, len(patterns)))
    mult = mult / norm[cols]
    size, v = len(histogram), np.ones(len(patterns)) / np.sqrt(len(patterns))
    forward = lambda x: np.bincount(rows, mult * x[cols], size)
    back = lambda r: np.bincount(cols, mult * r[rows], len(patterns))
    for _ in range(30):
        v = back(forward(v))
        step = float(np.linalg.norm(v))
        v /= step
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(forward(y) - goal) / (1.05 * step), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x / norm


def plan(histogram: np.ndarray, capacity: int, window: int | None = None) -> list[Pattern]:
    """Patterns that hold every item of the histogram (items by length, up to the capacity) exactly once.

    Repeat counts by least squares, rounded down and cut back to what is there; what is left is packed
    greedily, the longest first with the longest that still fit, as many times over as the counts allow.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[Pattern] = []
    if not left.any():
        return out
    patterns = combinations(left > 0, capacity, capacity // 100 if window is None else window)
    if patterns:
        x = nonnegative_least_squares(patterns, left)
        for i in np.argsort(-x, kind="stable"):
            repeats = min(int(x[i] + 1e-6), *(int(left[n]) // k for n, k in patterns[i]))
            if repeats > 0:
                for n, k in patterns[i]:
                    left[n] -= k * repeats
                out.append(Pattern(patterns[i], repeats))
    while left.any():
        room, mine = capacity, {}
        for n in np.flatnonzero(left)[::-1].tolist():
            take = min(room // n, int(left[n]))
            if take:
                mine[n] = take
                room -= take * n
            if not room:
                break
        repeats = min(int(left[n]) // k for n, k in mine.items())
        for n, k in mine.items():
            left[n] -= k * repeats
        out.append(Pattern(sorted(mine.items(), reverse=True), repeats))
    return out


def _places(plans: dict[str, list[Pattern]]) -> list[tuple[str, int, list[int], list[int], list[int]]]:
    """(pack, length, starts, firsts, eachs): where each pattern's share of the items of a length starts, its first container and items in each."""
    used: dict[tuple[str, int], int] = {}
    out: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for pack, patterns in plans.items():
        first = 0
        for p in patterns:
            for n, k in p.lengths:
                at = used.get((pack, n), 0)
                out.setdefault((pack, n), []).append((at, first, k))
                used[pack, n] = at + k * p.repeats
            first += p.repeats
    return [(*key, *map(list, zip(*rows))) for key, rows in out.items()]  # type: ignore[misc]


def _numbered(items: DataFrame, by: list[str]) -> DataFrame:
    """``items`` with ``at``, their rank from 0 in the order ``by``.

    Range partitions in that order are numbered where they lie and offset by the counts of those before, one
    number per partition, so no task sorts more than its share, whatever key is hot.
    """
    placed = cut(items.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id()))
    task = F.shiftright("_n", 33)
    offsets, before = [], 0
    for t, n in sorted((r["t"], r["count"]) for r in placed.groupBy(task.alias("t")).count().collect()):
        offsets.append((t, before))
        before += n
    known = items.sparkSession.createDataFrame(offsets, "_t long, _before long")
    return placed.withColumn("_t", task).join(F.broadcast(known), "_t").withColumn("at", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_n", "_t", "_before")


def packed(items: DataFrame, packs: DataFrame, key: str) -> DataFrame:
    """(pack_name, container_id, key, piece, token_start, n_tokens): every item in containers of every capacity.

    ``items``: key and n_tokens; ``packs``: pack_name, capacity_tokens, a small fixed table. An item longer
    than the capacity is split into full containers and a rest, others never. The histogram of lengths,
    one row per length up to the capacity, is all that reaches the driver; the plan made of it is
    as bounded. Items are numbered by (capacity, length, key) in range partitions and find their container in
    the plan, which is joined as a table. Items of no tokens take one token of room; null sizes and capacities below one are ignored; an
    empty input gives no row; repeated keys are items of their own.
    """
    caps = packs.where("capacity_tokens > 0 and pack_name is not null").select("pack_name", F.col("capacity_tokens").cast("long").alias("cap")).dropDuplicates(["pack_name"])
    small = [(r["pack_name"], r["cap"]) for r in caps.orderBy("pack_name").collect()]
    schema = f"pack_name string, container_id string, {key} {items.schema[key].dataType.simpleString()}, piece int, token_start long, n_tokens int"
    if not small:
        return items.sparkSession.createDataFrame([], schema)
    sized = cut(items.where("n_tokens is not null").select(F.col(key).alias("key"), F.col("n_tokens").cast("long").alias("n")))
    every = sized.crossJoin(F.broadcast(items.sparkSession.createDataFrame(small, "pack_name string, cap long")))
    rest = F.when(F.col("n") == 0, F.lit(0)).when(F.col("n") <= F.col("cap"), F.col("n")).otherwise(F.col("n") % F.col("cap"))
    ends = every.withColumn("whole", F.when(F.col("n") > F.col("cap"), F.floor(F.col("n") / F.col("cap"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", rest)
    full = ends.where("whole > 0").select("pack_name", "cap", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("p"))
    full = full.select(
        "pack_name", F.concat_ws("-", F.lit("w"), F.col("key").cast("string"), F.col("p").cast("string")).alias("container_id"), "key", F.col("p").cast("int").alias("piece"),
        (F.col("p") * F.col("cap")).alias("token_start"), F.col("cap").cast("int").alias("n_tokens"),
    )
    mixed = ends.where("rest > 0 or whole = 0").select(
        "pack_name", F.greatest("rest", F.lit(1)).cast("long").alias("length"), "key",
        F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("cap")).alias("token_start"), F.col("rest").cast("int").alias("n_tokens"),
    )
    counts = mixed.groupBy("pack_name", "length").count().toPandas().sort_values(["pack_name", "length"])
    plans = {}
    for pack, cap in small:
        own = counts[counts["pack_name"] == pack]
        h = np.zeros(cap + 1, dtype=np.int64)
        h[own["length"].to_numpy(dtype=np.int64)] = own["count"].to_numpy()
        plans[pack] = plan(h, cap)
    before = (counts["count"].cumsum() - counts["count"]).tolist()
    first = dict(zip(zip(counts["pack_name"], counts["length"]), before))
    rows = [(pack, n, int(first[pack, n]), s, f, e) for pack, n, s, f, e in _places(plans)]
    places = items.sparkSession.createDataFrame(rows, "pack_name string, length long, before long, starts array<long>, firsts array<long>, eachs array<long>")
    index = F.col("at") - F.col("before")
    p = F.size(F.filter("starts", lambda s: s <= index))
    inside = F.element_at("firsts", p) + F.floor((index - F.element_at("starts", p)) / F.element_at("eachs", p))
    found = _numbered(mixed, ["pack_name", "length", "key"]).join(places, ["pack_name", "length"])
    placed = found.select("pack_name", F.concat(F.lit("m"), inside.cast("string")).alias("container_id"), "key", "piece", "token_start", "n_tokens")
    return full.unionByName(placed).withColumnRenamed("key", key)


def fill(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, tokens, fill_share) of a packing."""
    each = placed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return each.join(packs.select("pack_name", "capacity_tokens"), "pack_name").withColumn("fill_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
