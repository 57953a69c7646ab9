"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import cut

#: Newton steps after which the search is given up with an error. The dual is convex in one variable per source and
#: steps that leave the bracket halve it, so the tilts are at the end of double precision long before.
STEPS = 400
BINS = 4096


def _budgets(sizes: dict[str, int], targets: list[tuple[str, str, float, int]]) -> dict[tuple[str, str], float]:
    """Tokens that each source should give, per mix: the largest total that no source's repeat cap forbids.

    Targets of sources without tokens can't be met; the others keep their proportions.
    """
    out: dict[tuple[str, str], float] = {}
    for mix in sorted({t[0] for t in targets}):
        own = [(s, share, cap) for m, s, share, cap in targets if m == mix and share > 0 and cap > 0 and sizes.get(s, 0) > 0]
        whole = sum(share for _, share, _ in own)
        if not own:
            continue
        total = min(cap * sizes[s] / (share / whole) for s, share, cap in own)
        out |= {(mix, s): total * share / whole for s, share, cap in own}
    return out


def _rate(cap, tilt, x):
    """A document's rate: exponentially tilted by its size, and no more than the repeats allowed."""
    return F.least(cap.cast("double"), F.exp(F.least(tilt * x, F.lit(50.0))))


def balanced(docs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(mix_name, source, key, n_tokens, copies): how often each document is used in each mix, where it is.

    ``docs``: key, source and n_tokens; ``targets``: mix_name, source, target_share and max_repeats, a small
    fixed table. The rates are those nearest, in entropy, to using every document once, among all that give
    each source its budget of tokens: exp(tilt x size), at most max_repeats. Newton iterations on the convex
    dual find the tilts, each step one distributed sum per mix and source over the documents' sizes. Rates
    are rounded to copies by one threshold per source, found in two passes over bounded histograms, so that
    tokens miss the budget by about one document.

    Documents with a null source or without tokens are in no mix; a target without documents is left out
    and the others keep their proportions; repeated keys are documents of their own; ties in rounding fall
    by a hash of the key; empty inputs give no row.
    """
    spark: SparkSession = docs.sparkSession
    known = [(r["mix_name"], r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("mix_name is not null and source is not null and target_share is not null and max_repeats is not null").select("mix_name", "source", "target_share", "max_repeats").distinct().collect()]
    wanted = spark.createDataFrame(sorted({(s,) for _, s, _, _ in known}), "source string")
    rows = cut(docs.where("source is not null and n_tokens > 0").select(F.col(key).alias("key"), "source", F.col("n_tokens").cast("long").alias("n")).join(F.broadcast(wanted), "source"))
    sums = {r["source"]: (int(r["t"]), int(r["t"]) / int(r["c"])) for r in rows.groupBy("source").agg(F.sum("n").alias("t"), F.count("*").alias("c")).collect()}
    budget = _budgets({s: t for s, (t, _) in sums.items()}, known)
    schema = f"mix_name string, source string, {key} {docs.schema[key].dataType.simpleString()}, n_tokens int, copies int"
    if not budget:
        return spark.createDataFrame([], schema)
    caps = {(m, s): c for m, s, _, c in known}
    hist = cut(rows.groupBy("source", "n").count())
    tilt = _newton(spark, hist, sums, budget, caps)

    params = spark.createDataFrame([(m, s, caps[m, s], tilt[m, s] / sums[s][1], budget[m, s]) for m, s in budget], "mix_name string, source string, cap int, tilt double, budget double")
    rate = rows.join(F.broadcast(params), "source").withColumn("rate", _rate(F.col("cap"), F.col("tilt"), F.col("n").cast("double")))
    # a document gets one copy more than the whole part of its rate where ``edge`` is below its source's threshold
    chance = (F.pmod(F.xxhash64("mix_name", "key", "n"), F.lit(1 << 40)) / float(1 << 40)).cast("double")
    parts = rate.withColumn("base", F.floor("rate").cast("int")).withColumn("edge", F.when(F.col("base") < F.col("cap"), (chance - (F.col("rate") - F.col("base")) + 1) / 2))
    whole = {(r["mix_name"], r["source"]): int(r["t"] or 0) for r in parts.groupBy("mix_name", "source").agg(F.sum(F.col("base") * F.col("n")).alias("t")).collect()}
    need = {k: budget[k] - whole.get(k, 0) for k in budget}
    edges = {k: (0.0, 1.0) for k in budget}
    for last in (False, True):
        limits = spark.createDataFrame([(m, s, lo, hi) for (m, s), (lo, hi) in edges.items()], "mix_name string, source string, lo double, hi double")
        within = parts.where("edge is not null").join(F.broadcast(limits), ["mix_name", "source"]).where("edge >= lo and edge < hi")
        bins = within.groupBy("mix_name", "source", F.least(F.floor((F.col("edge") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("t")).collect()
        by: dict[tuple[str, str], dict[int, int]] = {}
        for r in bins:
            by.setdefault((r["mix_name"], r["source"]), {})[r["bin"]] = int(r["t"])
        for k, (lo, hi) in edges.items():
            step, at = (hi - lo) / BINS, 0
            for b in sorted(by.get(k, {})):
                t = by[k][b]
                if need[k] < t:
                    at = b + int(last and 2 * need[k] >= t)  # the document at the edge goes to the nearer side
                    break
                need[k] -= t
                at = b + 1
            edges[k] = (lo + at * step, lo + (at + 1) * step)
    final = spark.createDataFrame([(m, s, lo) for (m, s), (lo, _) in edges.items()], "mix_name string, source string, threshold double")
    copies = (F.col("base") + F.when(F.col("edge") < F.col("threshold"), 1).otherwise(0)).cast("int")
    used = parts.join(F.broadcast(final), ["mix_name", "source"]).select("mix_name", "source", "key", F.col("n").cast("int").alias("n_tokens"), copies.alias("copies"))
    return used.where("copies > 0").withColumnRenamed("key", key)


def _newton(spark: SparkSession, hist: DataFrame, sums: dict, budget: dict, caps: dict) -> dict[tuple[str, str], float]:
    tilt = {k: 0.0 for k in budget}
    low = {k: -math.inf for k in budget}
    high = {k: math.inf for k in budget}
    open_ = set()
    for m, s in budget:
        if budget[m, s] >= caps[m, s] * sums[s][0] * (1 - 1e-9):
            tilt[m, s] = 1e6  # every document as often as it may be
        else:
            open_.add((m, s))
    steps = 0
    while open_:
        steps += 1
        if steps > STEPS:
            raise RuntimeError(f"no tilt found for {sorted(open_)}")
        now = spark.createDataFrame([(m, s, caps[m, s], tilt[m, s], sums[s][1]) for m, s in sorted(open_)], "mix_name string, source string, cap int, tilt double, mean double")
        x = F.col("n") / F.col("mean")
        w = _rate(F.col("cap"), F.col("tilt"), x)
        inner = F.when(w < F.col("cap"), w * x * F.col("n")).otherwise(0.0)
        got = hist.join(F.broadcast(now), "source").groupBy("mix_name", "source").agg(F.sum(w * F.col("n") * F.col("count")).alias("g"), F.sum(inner * F.col("count")).alias("h")).collect()
        for r in got:
            k = (r["mix_name"], r["source"])
            miss = r["g"] - budget[k]
            if miss < 0:
                low[k] = tilt[k]
            else:
                high[k] = tilt[k]
            # met, or the bracket has no number left between its ends
            if abs(miss) <= 1e-6 * budget[k] or high[k] - low[k] <= 1e-14 * abs(tilt[k]):
                open_.discard(k)
                continue
            new = tilt[k] - miss / r["h"] if r["h"] > 0 else math.nan
            if not low[k] < new < high[k]:
                new = (low[k] + high[k]) / 2 if math.isfinite(low[k]) and math.isfinite(high[k]) else tilt[k] + (1.0 if miss < 0 else -1.0) * max(1.0, abs(tilt[k]))
            tilt[k] = new
    return tilt


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, documents, copies, max_repeats) for every target."""
    each = used.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    whole = each.groupBy("mix_name").agg(F.sum("tokens").alias("whole"))
    out = targets.select("mix_name", "source", "target_share", "max_repeats").join(each, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    return out.select("mix_name", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies")), "max_repeats")
