"""Long exact spans shared between records.

All windows of ``length`` characters are compared, through the least hash of each window's runs: equal windows
have an equal one, so no verbatim span is missed, and a window's neighbours mostly share it, so a text
yields few rows. Windows that collide are verified through 128 bits of hash of the whole window, never pair by
pair. Records and groups are 64-bit hashes of their keys: a link is hidden only where the very two groups that
share the passage clash, one in 2^64 links. Near-repeats by paragraph are in ``paragraphs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.components import connected_groups
from docketry.llm.hashing import mix, seeds
from docketry.session import cut

_U = np.uint64
#: Characters hashed at a time; longer texts are taken in pieces that overlap.
PIECE = 1 << 19
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


@lru_cache(maxsize=4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASE[which]
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _U(b))])) for b in (base, inverse))
    return up, down


class _Rolling:
    """Hashes of all runs of a length within a piece of text."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        size = 1 << max(12, int(len(codes)).bit_length())
        self.up, self.down = _powers(which, size)
        with np.errstate(over="ignore"):
            values = mix(codes.astype(_U) + seeds(1, salt=31 + which)[0])
            self.sums = np.concatenate([[_U(0)], np.cumsum(values * self.up[: len(codes)], dtype=_U)])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts] + _U(length))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - 1 - length + 1
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + _U(length))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _pieces(texts: list[str], overlap: int) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (row, offset, text) of about PIECE characters."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(len(text) - overlap, 1), PIECE - overlap):
            part = text[offset : offset + PIECE]
            if size + len(part) > PIECE and group:
                yield group
                group, size = [], 0
            group.append((row, offset, part))
            size += len(part)
    if group:
        yield group


def _fingerprints(length: int, run: int):
    width, context = length - run + 1, length - run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, rec = batch.column("grp").to_numpy(), batch.column("rec").to_numpy()
            for group in _pieces([t if len(t) >= length else "" for t in batch.column("text").to_pylist()], overlap=2 * length):
                group = [g for g in group if len(g[2]) >= length]
                if not group:
                    continue
                sizes = np.array([len(t) for _, _, t in group])
                codes = np.frombuffer("".join(t for _, _, t in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(group)), sizes)
                rolling = _Rolling(codes)
                h = rolling.all(run)
                low = _U((1 << 20) - 1)
                best = _least((h & ~low) | np.arange(len(h), dtype=_U), width)
                inside = np.flatnonzero(np.arange(len(best)) + length <= ends[owner[: len(best)]])
                # a run is the least of a row of neighbouring windows, its own
                at, first, own = np.unique((best[inside] & low).astype(np.int64), return_index=True, return_counts=True)
                mine = owner[at]
                left, right = at - context, at + run + context
                full = (left >= (ends - sizes)[mine]) & (right <= ends[mine])
                ctx = np.zeros(len(at), dtype=_U)
                ctx[full] = rolling.at(left[full], length + context)
                rows = np.array([r for r, _, _ in group])[mine]
                low_window = inside[first] - (ends - sizes)[mine] + np.array([o for _, o, _ in group])[mine]
                yield pa.record_batch({"fp": pa.array(h[at].view(np.int64)), "grp": pa.array(grp[rows]), "rec": pa.array(rec[rows]), "low": pa.array(low_window.astype(np.int32)), "own": pa.array(own.astype(np.int32)), "ctx": pa.array(ctx.view(np.int64), mask=~full)})

    return work


def _windows(length: int):
    """The windows of a text whose least run is one of the given ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, rec, texts, places = (batch.column(c).to_pylist() for c in ("grp", "rec", "text", "places"))
            for g, r, text, where in zip(grp, rec, texts, places):
                n = len(text) - length + 1
                if n < 1:
                    continue
                cover = np.zeros(n + 1, dtype=np.int32)
                w = np.array([(x["low"], x["own"]) for x in where], dtype=np.int64).reshape(-1, 2)
                np.add.at(cover, w[:, 0], 1)
                np.add.at(cover, w.sum(axis=1), -1)
                starts = np.flatnonzero(np.cumsum(cover)[:n])
                for lo in range(0, len(starts), PIECE):
                    part = starts[lo : lo + PIECE]
                    first = part[0]
                    codes = np.frombuffer(text[first : part[-1] + length].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    one, two = (_Rolling(codes, which).at(part - first, length) for which in (0, 1))
                    yield pa.record_batch({"h1": pa.array(one.view(np.int64)), "h2": pa.array(two.view(np.int64)), "grp": pa.array(np.full(len(part), g)), "rec": pa.array(np.full(len(part), r)), "place": pa.array(part)})

    return work


class SharedSpans:
    """Spans of at least ``length`` characters that stand in records of two groups or more.

    ``rows``: ``key`` (the record), ``group``, ``text``. A span repeated only within a group doesn't count.
    Null keys, groups and texts and texts shorter than ``length`` have no spans; repeated rows count once;
    an empty input gives empty results; characters are code points, compared as they stand.
    """

    def __init__(self, rows: DataFrame, key: str, group: str, text: str, length: int = 200, run: int = 100):
        self.key, self.length, self.run = key, length, run
        rows = rows.select(F.col(key).alias("key"), F.col(group).alias("g"), F.col(text).alias("text")).where("key is not null and g is not null and text is not null")
        self.rows = rows.where(F.length("text") >= length).select("key", F.xxhash64("key").alias("rec"), F.xxhash64("g").alias("grp"), "text")
        # hashed twice: writing all runs would cost more disk than hashing costs time
        prints = self.rows.select("rec", "grp", "text").mapInArrow(_fingerprints(length, run), "fp long, grp long, rec long, low int, own int, ctx long")
        self.shared = cut(prints.join(self._several(prints, "fp", first=False), "fp"))

    def _several(self, df: DataFrame, *by: str, first: bool = True) -> DataFrame:
        """Keys that occur in more than one group; ``first``: with the least record that has them.

        Written, so that a join with them can split a hot key: with an aggregate that was just made it can't.
        """
        least = [F.min("rec").alias("first")] if first else []
        return cut(df.groupBy(*by).agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), *least).where("g0 < g1").drop("g0", "g1"))

    def sure(self, first: bool = True) -> DataFrame:
        """(rec, first): records with a run whose surroundings are shared as well; no need to look closer."""
        whole = self.shared.where("ctx is not null").select("fp", "ctx", "grp", "rec")
        return whole.join(self._several(whole, "fp", "ctx", first=first), ["fp", "ctx"]).select("rec", *["first"] * first).distinct()

    def _unsettled(self, sure: DataFrame) -> DataFrame:
        """(fp): runs that a record outside ``sure`` (rec) has."""
        return self.shared.select("fp", "rec").join(sure, "rec", "left_anti").select("fp").distinct()

    def _apart(self, joined: DataFrame) -> DataFrame:
        """(fp): runs whose records ``joined`` (rec, group_id) hasn't brought into one group."""
        at = self.shared.select("fp", "rec").join(joined, "rec", "left").select("fp", F.coalesce("group_id", "rec").alias("at"))
        return at.groupBy("fp").agg(F.min("at").alias("a0"), F.max("at").alias("a1")).where("a0 < a1").select("fp")

    def _places(self, wanted: DataFrame | None) -> DataFrame:
        """(rec, places): the windows to look at; with ``wanted`` (fp), only those of such runs."""
        shared = self.shared.select("fp", "rec", "low", "own")
        if wanted is not None:
            shared = shared.join(wanted, "fp", "left_semi")
        return shared.groupBy("rec").agg(F.collect_set(F.struct("low", "own")).alias("places"))

    def hits(self, wanted: DataFrame | None = None, *detail: str) -> DataFrame:
        """(rec, and of place and first what is asked for): windows that stand in another group too; with ``wanted`` (fp), those of such runs."""
        places = self._places(wanted)
        texts = self.rows.select("rec", "grp", "text").join(places, "rec")
        windows = texts.mapInArrow(_windows(self.length), "h1 long, h2 long, grp long, rec long, place long")
        windows = cut(windows.select("h1", "h2", "grp", "rec", *(c for c in detail if c == "place")))
        return windows.join(self._several(windows, "h1", "h2", first="first" in detail), ["h1", "h2"]).select("rec", *detail)

    def named(self, recs: DataFrame) -> DataFrame:
        return self.rows.select("key", "rec").distinct().join(recs, "rec")

    def records(self) -> DataFrame:
        """(key): records with a shared span."""
        sure = cut(self.sure(first=False))
        found = sure.unionByName(self.hits(self._unsettled(sure))).distinct()
        return self.named(found).select(F.col("key").alias(self.key)).distinct()

    def coverage(self) -> DataFrame:
        """(key, n_chars, shared_chars, spans, shared_share): how much of each record with a shared span is shared."""
        starts = self.hits(None, "place").groupBy("rec").agg(F.array_sort(F.collect_set("place")).alias("s"))
        step = F.zip_with(F.col("s"), F.concat(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.array(F.lit(None).cast("long"))), lambda a, b: F.coalesce(F.least(b - a, F.lit(self.length)), F.lit(self.length)))
        sums = starts.select("rec", step.alias("d"))
        sums = sums.select("rec", F.aggregate("d", F.lit(0).cast("long"), lambda x, d: x + d).alias("shared_chars"), (F.size(F.filter("d", lambda d: d >= self.length))).cast("long").alias("spans"))
        sizes = self.rows.select("key", "rec", F.length("text").cast("long").alias("n_chars")).distinct()
        return sizes.join(sums, "rec").select(F.col("key").alias(self.key), "n_chars", "shared_chars", "spans", (F.col("shared_chars") / F.col("n_chars")).alias("shared_share"))

    def groups(self) -> DataFrame:
        """(key, group_key): records linked through shared spans, directly or not, with the group's least key.

        Links through shared surroundings come first; windows are then looked at of every run whose records
        these leave in different groups, also where each of the records has some other link.
        """
        joined = cut(connected_groups(self.sure(), "rec", "first").withColumnRenamed("id", "rec"))
        links = joined.withColumnRenamed("group_id", "first").unionByName(self.hits(self._apart(joined), "first")).distinct()
        groups = connected_groups(links, "rec", "first")
        named = self.named(groups.withColumnRenamed("id", "rec")).select("key", "group_id").distinct()
        least = cut(named.groupBy("group_id").agg(F.min("key").alias("group_key")))
        return named.join(least, "group_id").select(F.col("key").alias(self.key), "group_key")
