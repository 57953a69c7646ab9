"""Similarity join of token-set documents by chosen paths: near-duplicates with small edits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.hashing import TOKEN, TokenHasher, minima, mix, seeds, shingles
from docketry.session import cut, release

#: Coordinates of a document's sketch, one byte each.
WIDTH = 64
#: Documents of a node that are compared with each other; larger nodes branch.
LEAF = 64
#: Levels after which a node that still is larger is compared in blocks.
DEPTH = 10
#: Records that speak for a class of equal texts, of as many groups as there are.
SPEAKERS = 32

_U = np.uint64
_LEVEL = "node long, id long, sketch binary"
_STEP = "a long, b long, sketch binary"


def _sketches(size: int, trees: int):
    seed = seeds(WIDTH + trees, salt=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHasher()
        for batch in batches:
            values, runs = shingles(batch.column("text").to_pylist(), size, hasher)
            keep = runs > 0
            if not keep.any():
                continue
            least = minima(values, runs[keep], seed)
            sketch = (least[:, :WIDTH] >> _U(20)).astype(np.uint8)
            with np.errstate(over="ignore"):
                nodes = mix(least[:, WIDTH:] + seed[WIDTH:])
            ids = batch.column("id").to_numpy()[keep]
            bytes_ = [row.tobytes() for row in sketch]
            yield pa.record_batch({"node": pa.array(nodes.T.reshape(-1).view(np.int64)), "id": pa.array(np.tile(ids, trees)), "sketch": pa.array(bytes_ * trees, type=pa.binary())})

    return run


def _children(node: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    """Two minwise coordinates, chosen by the node, continue each document's path."""
    with np.errstate(over="ignore"):
        k = node.view(_U)
        first = mix(k + _U(1)) % _U(WIDTH)
        second = (first + _U(1) + mix(k + _U(2)) % _U(WIDTH - 1)) % _U(WIDTH)
        rows = np.arange(len(ids))
        out = [mix(k * _U(0x9E3779B97F4A7C15) + (i << _U(8)) + sketch[rows, i.astype(np.int64)].astype(_U)) for i in (first, second)]
    return pa.record_batch({"a": pa.array(np.concatenate(out).view(np.int64)), "b": pa.array(np.concatenate([ids, ids])), "sketch": pa.array([r.tobytes() for r in sketch] * 2, type=pa.binary())})


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
    return batch.column("node").to_numpy(), batch.column("id").to_numpy(), sketch


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _children(*_columns(batch))


def _near(node: np.ndarray, ids: np.ndarray, sketch: np.ndarray, least: int) -> pa.RecordBatch:
    """Pairs of the same node (rows sorted by node) that agree in at least ``least`` coordinates."""
    found = []
    for lag in range(1, len(ids)):
        at = np.flatnonzero(node[lag:] == node[:-lag])
        if not len(at):
            break
        alike = at[(sketch[at] == sketch[at + lag]).sum(axis=1) >= least]
        found.append((ids[alike], ids[alike + lag]))
    a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, dtype=np.int64)]) for k in (0, 1))
    differ = a != b
    a, b = a[differ], b[differ]
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]), "sketch": pa.nulls(len(both), pa.binary())})


def _step(least: int):
    """Walks through the nodes of a sorted partition: small ones are compared, others branch as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        branching: int | None = None

        def work(node: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, size = np.unique(node, return_counts=True)
            big = np.repeat(size, size) > LEAF
            if branching is not None:
                big |= node == branching
            if big.any():
                yield _children(node[big], ids[big], sketch[big])
            if (~big).any():
                yield _near(node[~big], ids[~big], sketch[~big], least)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch)
            held = new if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, new))  # type: ignore[assignment]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from work(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)  # type: ignore[assignment]
            if len(held[0]) > LEAF:
                yield from work(*held)
                branching, held = int(held[0][-1]), None
        if held is not None and len(held[0]):
            yield from work(*held)

    return run


def _exhaust(nodes: DataFrame, least: int) -> DataFrame:
    """Pairs of the nodes that no path could split, block against block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members").to_pylist():
                ids = np.array([m["id"] for m in members], dtype=np.int64)
                sketch = np.frombuffer(b"".join(m["sketch"] for m in members), dtype=np.uint8).reshape(-1, WIDTH)
                yield _near(np.zeros(len(ids), dtype=np.int64), ids, sketch, least)

    sizes = nodes.groupBy("node").agg(F.ceil(F.count("*") / LEAF).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    spread = nodes.join(sizes, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.groupBy("node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.collect_list(F.struct("id", "sketch")).alias("members"))
    return met.select("members").mapInArrow(compare, _STEP)


def candidates(docs: DataFrame, size: int, threshold: float, trees: int) -> DataFrame:
    """(a, b): pairs of ids of ``docs`` (id long, text) that a chosen path brings together and whose sketches agree.

    In each of ``trees`` independent trees a document goes to the node of its least token run. Nodes of up
    to ``LEAF`` documents are compared exhaustively; larger ones branch by two further minwise coordinates,
    level by level. Nodes with a thousandth of a level's rows or more, of which there are at most a thousand,
    branch where they lie, without a shuffle; all others stream through one task without being held.
    """
    spread = 3.3 * (threshold * (1 - threshold) / WIDTH) ** 0.5
    least = int(np.floor((threshold - spread) * WIDTH))
    level = cut(docs.mapInArrow(_sketches(size, trees), _LEVEL))
    pairs: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        rows = level.count()
        if not rows:
            break
        if depth == DEPTH:
            pairs.append(_exhaust(level, least).select("a", "b"))
            break
        hot = level.groupBy("node").count().where(F.col("count") > max(LEAF, rows // 1000)).select("node")
        hot = cut(hot)
        cool = level.join(F.broadcast(hot), "node", "left_anti").repartition("node").sortWithinPartitions("node")
        steps = cool.select("node", "id", "sketch").mapInArrow(_step(least), _STEP)
        done = cut(steps)
        pairs.append(done.where("sketch is null").select("a", "b"))
        below = level.join(F.broadcast(hot), "node", "left_semi").select("node", "id", "sketch").mapInArrow(_branch, _STEP)
        following = below.unionByName(done.where("sketch is not null")).select(F.col("a").alias("node"), F.col("b").alias("id"), "sketch")
        following = cut(following)
        release(level, hot)
        level = following
    out = pairs[0] if pairs else docs.sparkSession.createDataFrame([], "a long, b long")
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _jaccard(size: int, threshold: float):
    def sets(text: str) -> set:
        t = TOKEN.findall(text)
        return set(zip(*(t[k:] for k in range(size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            out, known, last = [], set(), None
            for i in range(len(a)):
                if last != a[i]:
                    last, known = a[i], sets(x[i])
                other = sets(y[i])
                both = len(known & other)
                union = len(known) + len(other) - both
                if union and both >= threshold * union - 1e-12:
                    out.append((a[i], b[i], both / union))
            yield pa.record_batch({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()), "similarity": pa.array([o[2] for o in out], pa.float64())})

    return run


def similar_texts(docs: DataFrame, size: int = 5, threshold: float = 0.8, trees: int = 9) -> DataFrame:
    """(a, b, similarity): pairs of different texts of ``docs`` (id long, text) with Jaccard similarity of at least
    ``threshold`` over the sets of ``size`` tokens in a row, a token being a run of a-z and 0-9.

    Candidates by chosen paths, then the exact similarity of the texts. No pair is returned wrongly. Where the
    first nodes are leaves, a pair of just the threshold is missed with a chance of about one in a thousand at
    nine trees; the more of the texts is boilerplate, the more nodes branch and the more is missed (measured
    figures: README). Null, empty and too short texts have no pairs; an empty input gives no row.
    """
    texts = docs.select("id", "text").where("text is not null")
    return verified(texts, candidates(texts, size, threshold, trees), size, threshold)


def verified(texts: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b, similarity): those of ``pairs`` (a, b) whose texts (id, text) have the exact similarity."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_jaccard(size, threshold), "a long, b long, similarity double")


@dataclass
class Similar:
    """Classes of equal texts and the pairs of classes that are similar: what any number of copies is stated by.

    ``members``: id (the class), key, grp, n (the class's records) and speaks (the record is one of those that
    speak for its class); ``near``: (a, b, similarity), pairs of different classes.
    """

    members: DataFrame
    near: DataFrame

    def _side(self, name: str, speakers: bool) -> DataFrame:
        rows = self.members.where("speaks") if speakers else self.members
        return rows.select(F.col("id").alias(name), F.col("key").alias(f"k{name}"), F.col("grp").alias(f"g{name}"))

    def pairs(self, every: bool = False) -> DataFrame:
        """(ka, kb): pairs of records of different groups, the smaller key first.

        A record is paired with the speakers of its own class, and speakers with those of similar classes,
        so pairs grow with the records, not with their square, and no link between two texts is lost. Up to
        ``SPEAKERS`` records all speak, so these are all pairs. ``every`` pairs all records, whatever the
        size: the exact expansion.
        """
        across = self.near.join(self._side("a", not every), "a").join(self._side("b", not every), "b")
        within = self._side("a", False).join(self._side("b", not every).withColumnRenamed("b", "a"), "a").where("ka <> kb")
        cols = ["ka", "ga", "kb", "gb"]
        both = across.select(*cols).unionByName(within.select(*cols)).where("ga <> gb")
        return both.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()

    def classes(self) -> DataFrame:
        """(key, class_key, copies, links): of every record its class, named by its least key, with the class's records and similar classes."""
        least = self.members.groupBy("id").agg(F.min("key").alias("class_key"))
        links = self.near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
        named = self.members.select("id", "key", F.col("n").alias("copies")).distinct().join(least, "id").join(links, "id", "left")
        return named.select("key", "class_key", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def similar_records(rows: DataFrame, key: str, group: str, text: str, size: int, threshold: float, trees: int = 9) -> Similar:
    """Records (key, group, text) by classes of equal texts, and the pairs of similar classes; see ``Similar``.

    Equal texts are one class, compared once. The records that speak for it are the first ``SPEAKERS`` by
    (place within their group, key), so every group speaks before any does twice. Rows with a null key,
    group or text, and texts of fewer than ``size`` tokens, which have no runs to share, are
    ignored; repeated rows count once; an empty input gives no row.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(text).alias("text")).where("key is not null and grp is not null and text is not null")
    enough = rf"(?:[a-z0-9]+[^a-z0-9]+){{{size - 1}}}[a-z0-9]"
    rows = rows.where(F.col("text").rlike(enough)).withColumn("class", F.unhex(F.md5("text")))
    members = rows.select("class", "key", "grp").distinct()
    classes = cut(rows.groupBy("class").agg(F.max("text").alias("text")).withColumn("id", F.monotonically_increasing_id()))
    near = cut(similar_texts(classes, size, threshold, trees))
    sizes = members.groupBy("class").agg(F.count("*").alias("n")).join(classes.select("class", "id"), "class")
    known = cut(members.join(sizes, "class").select("id", "key", "grp", "n"))
    # both ranks are cut off before the shuffle, so a hot class is sorted in no single task
    several = known.where("n > 1")
    own = several.withColumn("turn", F.row_number().over(Window.partitionBy("id", "grp").orderBy("key"))).where(F.col("turn") <= SPEAKERS)
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("turn", "key", "grp"))).where(F.col("place") <= SPEAKERS)
    said = first.select("id", "key", "grp", F.lit(True).alias("speaks"))
    marked = several.join(said, ["id", "key", "grp"], "left").withColumn("speaks", F.coalesce("speaks", F.lit(False)))
    return Similar(cut(known.where("n = 1").withColumn("speaks", F.lit(True)).unionByName(marked)), near)
