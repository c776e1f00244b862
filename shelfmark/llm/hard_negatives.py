"""Hard negatives of anchor vectors, by exact integer inner products.

Components become whole numbers, `floor(256 * x)`, so every score is exact and no order of summation
shows. Scores of a tile of anchors against a tile of candidates come from Strassen's recursion: seven
products of quarter tiles instead of eight, odd sides padded with zeros, all sums in 64-bit integers.
Those wrap modulo 2^64 without loss, so sums inside the recursion may pass the limit of 64 bits as
long as the scores themselves do not.

An anchor's best positives are a heap of a few rows, and so are the best negatives of each window
below a positive. Heaps of disjoint candidates merge into the heap of their union. A task streams its
stretch of the candidates past all anchors of a pass and hands on nothing but its heaps; Spark merges
them. Candidates are never shuffled, whatever label a third of them has. A pass takes at most about
`ANCHORS` anchors or `ANCHOR_BYTES` of their components, so what is broadcast does not grow with the
table; more anchors make more passes, each written to the shared folder.

Defined results: rows with a null label or vector, or with a null or non-finite component take no
part; an all-zero or empty vector does, with scores of 0; only vectors of one length are compared. Rows
are told apart by themselves, not by their id: a repeated row is another row, and its copy is a
positive of it. Rows without an id are no anchors; as positives and negatives they come after all
others of their score, with a null id. A positive with a score below 0 has an empty window. An anchor
without positives, or whose windows are empty, has no rows; an empty table gives none. Vectors whose
scores might not fit in 64 bits (a squared length of 2^60 or more after scaling) stop the job with an
error, since no score could be given for them. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.vectors import matrix
from shelfmark.session import scratch_path
from shelfmark.sources.tables import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score

LEAF = 32  # the smallest side that is cut further
ANCHORS = 1 << 13
ANCHOR_BYTES = 32 << 20
BLOCK_NUMBERS = 1 << 19  # components of the candidates in a tile
TILE = 1 << 20  # scores of a tile
MAX_SQUARE = 2.0**60

_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product of two int64 matrices by Strassen's recursion, exact modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return np.einsum("ik,kj->ij", a, b)
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return product(a, b)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = product(a11 + a22, b11 + b22)
    p2 = product(a21 + a22, b11)
    p3 = product(a11, b12 - b22)
    p4 = product(a22, b21 - b11)
    p5 = product(a11 + a12, b22)
    p6 = product(a21 - a11, b11 + b12)
    p7 = product(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best `size` rows of many slots, by falling score, then rising id and row.

    The last bit of a row's number says that it has no id; such rows come last among equals.
    """

    def __init__(self, slots: int, size: int):
        self.size = size
        self.slot, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(slots, _NONE)  # what a row must reach to enter

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids, row = (
            np.concatenate(pair)
            for pair in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, row))
        )
        order = np.lexsort((row, ids, row & 1, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        kept = place < self.size
        full = slot[place == self.size - 1]
        self.slot, order = slot[kept], order[kept]
        self.score, self.id, self.row = score[order], ids[order], row[order]
        self.least[full] = score[order][place[kept] == self.size - 1]


def _leading(scores: np.ndarray, fit: np.ndarray, size: int) -> np.ndarray:
    """Of the fitting scores of each line, those that reach its `size`-th largest."""
    many = np.flatnonzero(fit.sum(axis=1) > 4 * size)
    if len(many):
        some = np.where(fit[many], scores[many], _NONE)
        at = some.shape[1] - size
        fit[many] = some >= np.partition(some, at, axis=1)[:, at, None]
    return fit


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(dim, candidates) with vectors of one length, about `BLOCK_NUMBERS` components at once."""
    held: dict[int, list[pa.Table]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        dims = table.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = table.filter(pa.array(dims == dim))
            held.setdefault(dim, []).append(part)
            size[dim] = size.get(dim, 0) + part.num_rows * max(dim, 1)
            if size[dim] >= BLOCK_NUMBERS:
                yield dim, pa.concat_tables(held.pop(dim))
                size[dim] = 0
    for dim, parts in held.items():
        yield dim, pa.concat_tables(parts)


def _numbers(table: pa.Table, dim: int) -> np.ndarray:
    return matrix(table.column("v")) if dim else np.zeros((table.num_rows, 0), np.int64)


def _slices(n: int, across: int) -> Iterator[slice]:
    step = max(1, TILE // max(1, across))
    return (slice(i, i + step) for i in range(0, n, step))


def _tiles(anchors: pa.Table, dim: int, block: pa.Table, own_label: bool) -> Iterator[tuple]:
    """(anchor places, candidate places, scores) of a block, of equal labels only or of all."""
    at = np.flatnonzero(anchors.column("dim").to_numpy() == dim)
    if not len(at):
        return
    left, right = _numbers(anchors.take(at), dim), _numbers(block, dim).T
    labels, others = anchors.column("label").to_numpy()[at], block.column("label").to_numpy()
    every = np.arange(block.num_rows)
    groups = [(np.arange(len(at)), every)]
    if own_label:
        shared = np.intersect1d(labels, others)
        groups = [(np.flatnonzero(labels == x), np.flatnonzero(others == x)) for x in shared]
    for mine, theirs in groups:
        for part in _slices(len(mine), len(theirs)):
            yield at[mine[part]], theirs, product(left[mine[part]], right[:, theirs])


def _heap_batch(heaps: Heaps, anchor: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    columns = (anchor, place, heaps.score, heaps.id, heaps.row)
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64)) for c in columns], ["anchor", "place", "score", "id", "row"]
    )


_HEAP = "anchor long, place long, score long, id long, row long"


def _positive_heaps(anchors: pa.Table, size: int):
    """A task that gives the best `size` rows of each anchor's label among its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = anchors.column("row").to_numpy()
        heaps = Heaps(len(own), size)
        for dim, block in _blocks(batches):
            ids, rows = block.column("id").to_numpy(), block.column("row").to_numpy()
            for at, there, scores in _tiles(anchors, dim, block, own_label=True):
                fit = (scores >= heaps.least[at, None]) & (own[at, None] != rows[there])
                i, j = np.nonzero(_leading(scores, fit, size))
                heaps.add(at[i], scores[i, j], ids[there[j]], rows[there[j]])
        yield _heap_batch(heaps, own[heaps.slot], np.zeros(len(heaps.slot)))

    return run


def _negative_heaps(anchors: pa.Table, size: int, windows: int):
    """A task that gives the best `size` rows of other labels in each of an anchor's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        heaps = Heaps(len(own) * windows, size)
        low, high = np.full((windows, len(own)), _LAST), np.full((windows, len(own)), _NONE)
        for i, bounds in enumerate(anchors.column("windows").to_pylist()):
            for w, bound in enumerate(bounds):
                low[w, i], high[w, i] = bound["low"], bound["high"]
        for dim, block in _blocks(batches):
            ids, rows = block.column("id").to_numpy(), block.column("row").to_numpy()
            others = block.column("label").to_numpy()
            for at, there, scores in _tiles(anchors, dim, block, own_label=False):
                different = labels[at, None] != others[there]
                for w in range(windows):
                    least = np.maximum(low[w, at], heaps.least[at * windows + w])[:, None]
                    fit = different & (scores >= least) & (scores <= high[w, at, None])
                    i, j = np.nonzero(_leading(scores, fit, size))
                    heaps.add(at[i] * windows + w, scores[i, j], ids[there[j]], rows[there[j]])
        yield _heap_batch(heaps, own[heaps.slot // windows], heaps.slot % windows + 1)

    return run


def _passes(spark, anchors: DataFrame, candidates: DataFrame, task, size: int, name: str) -> DataFrame:
    """Merged heaps of all anchors, a bounded part of which is sent to the workers at once.

    `anchors` is a written table, so every pass reads the same rows.
    """
    n, numbers = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    passes = max(1, -(-n // ANCHORS), -(-8 * numbers // ANCHOR_BYTES))
    best = Window.partitionBy("anchor", "place").orderBy(
        F.desc("score"), F.col("row").bitwiseAND(1), "id", "row"
    )
    path = scratch_path(spark, name)
    for i in range(passes):
        part = anchors.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).toArrow()
        found = candidates.mapInArrow(task(part), _HEAP)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
        ranked.write.parquet(f"{path}/pass={i}")
    return spark.read.schema(_HEAP + ", rank int").parquet(path).drop("pass")


def _id(c: str) -> Column:
    """The id of a row, null where it has none."""
    return F.when(F.col("row").bitwiseAND(1) == 0, F.col(c))


def mine(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    `is_anchor` and `label` are expressions over the columns of `df`.
    """
    spark = df.sparkSession
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(v.isNotNull() & fine & label.isNotNull()).select(
        (F.monotonically_increasing_id() * 2 + F.col(id_column).isNull().cast("long")).alias("row"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("id"),
        label.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"),
        F.size(v).alias("dim"),
        (F.col(id_column).isNotNull() & F.coalesce(is_anchor, F.lit(False))).alias("anchor"),
        F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x * SCALE**2).alias("square"),
    )
    rows = materialize(rows, "negatives-vectors")
    longest = rows.agg(F.max("square")).first()[0] or 0.0
    if not longest < MAX_SQUARE:
        raise ValueError(f"scores of vectors with a squared length of {longest} may not fit in 64 bits")

    candidates = rows.select("row", "id", "label", "v", "dim")
    anchors = rows.where("anchor").select("row", "id", "label", "v", "dim")
    found = _passes(
        spark, anchors, candidates, lambda part: _positive_heaps(part, positives), positives,
        "negatives-positives",
    )
    found = found.select(
        "anchor", F.col("rank").alias("place"), _id("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # 30 * positive <= 100 * negative <= 90 * positive, without a product that could overflow.
    tens, rest = F.expr("positive_score DIV 100"), F.expr("positive_score % 100")
    windows = found.groupBy("anchor").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "place",
                    (tens * LOWEST + F.ceil(rest * LOWEST / 100)).cast("long").alias("low"),
                    (tens * HIGHEST + F.floor(rest * HIGHEST / 100)).cast("long").alias("high"),
                )
            )
        ).alias("windows")
    )
    asked = materialize(
        anchors.join(windows.withColumnRenamed("anchor", "row"), "row"), "negatives-windows"
    )
    hard = _passes(
        spark, asked, candidates, lambda part: _negative_heaps(part, negatives, positives), negatives,
        "negatives-found",
    )
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    hard = hard.select(
        "anchor", F.col("place").cast("int").alias("place"), "rank",
        _id("id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    return (
        hard.join(found, ["anchor", "place"])
        .join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
