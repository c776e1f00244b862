"""Vectors with a cosine of 0.9 or more, found through spherical-cap filters.

A filter is a direction; a vector passes it if their inner product exceeds a threshold, so filters
are caps of the sphere. The directions are random product codes: after a random rotation, a vector
is cut into two parts and each part has a codebook of random directions; every pair of code words is
a filter. That makes the list of all filters a vector exceeds cheap to decode: the two parts are
scored apart, and sorted scores give the pairs above the threshold without trying all. Vectors that
share a filter are compared exactly.

The threshold lets a filter take about `LOAD` vectors, whatever their number, and there are so many
filters that two vectors at the limit share `SHARED` of a code on average; both follow from the
measure of caps. Filters with a code word in common are alike, so `CODES` codes with rotations of
their own stand side by side; together they miss about one pair in a thousand right at the limit,
and fewer above it.

A pair that shares several filters counts in the smallest of them. A filter's task never lists its
pairs: it returns, per vector, how many links it counted and one root per local component. Equal
vectors are one vector with a weight. Neighbouring filters share a task, to which a vector goes
once. A filter with more than `STRIPE` vectors is cut into stripes, and each pair of stripes is a
task of its own.

Defined results: null, zero and non-finite vectors link with nothing; vectors of different length do
not link; rows with an equal id are different vectors; a component's id is the smallest id in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from shelfmark.llm.common import components
from shelfmark.llm.vectors import matrix, usable, vectors
from shelfmark.sources.tables import materialize

COSINE = 0.9
LOAD = 256
SHARED = 8
CODES = 3
STRIPE = 4096
SEED = 8
_FILTERS = StructField("filters", ArrayType(LongType()))
TOGETHER = 32  # neighbouring filters in one group


@dataclass(frozen=True)
class Code:
    """A rotation, two codebooks and the threshold, for vectors of one length."""

    rotation: np.ndarray
    first: np.ndarray
    second: np.ndarray
    threshold: float

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, the filters it exceeds, in order; its best one in any case."""
        turned = unit @ self.rotation
        half = self.first.shape[1]
        ahead, behind = turned[:, :half] @ self.first.T, turned[:, half:] @ self.second.T
        found = []
        for x, y in zip(ahead, behind, strict=True):
            order = np.argsort(-y)
            falling = y[order]
            rows = np.flatnonzero(x >= self.threshold - falling[0])
            many = np.searchsorted(-falling, x[rows] - self.threshold, side="right")
            columns = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            codes = np.repeat(rows, many) * len(y) + order[columns]
            if not len(codes):
                codes = np.array([np.argmax(x) * len(y) + order[0]])
            found.append(np.sort(codes))
        return found


def _cap(d: int, share: float, cosine: float) -> tuple[float, float]:
    """The height of a cap that holds `share` of the sphere in d dimensions, and how probably a
    vector at `cosine` to one in the cap is in it as well."""
    u = np.linspace(-1, 1, 200_001)[1:-1]
    density = (1 - u * u) ** ((d - 3) / 2)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    height = u[np.searchsorted(-above, -share)]
    inside = u[u >= height][:: max(1, int((u >= height).sum() // 2000))]
    weight = (1 - inside * inside) ** ((d - 3) / 2)
    v = np.linspace(-1, 1, 20_001)[1:-1]
    cumulative = np.cumsum((1 - v * v) ** ((d - 4) / 2))
    cumulative /= cumulative[-1]
    need = (height - cosine * inside) / (math.sqrt(1 - cosine**2) * np.sqrt(1 - inside * inside) + 1e-12)
    passes = 1 - np.interp(need, v, cumulative, left=0, right=1)
    return float(height), float((weight * passes).sum() / weight.sum())


def code_for(length: int, n: int, cosine: float = COSINE, number: int = 0) -> Code:
    """One of the codes for `n` vectors of a length; short vectors are read in 16 dimensions."""
    d = max(16, length)
    share = min(0.25, LOAD / max(1, n))
    height, probability = _cap(d, share, cosine)
    words = max(2, math.ceil(math.sqrt(SHARED / probability / share)))
    random = np.random.default_rng([SEED, length, number])
    rotation, _ = np.linalg.qr(random.standard_normal((d, d)))
    half = d // 2
    books = []
    for width in (half, d - half):
        book = random.standard_normal((words, width))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(width / d))
    # Vectors fill the first components; the rest of them are zero.
    return Code(rotation[:length], books[0], books[1], height)


def decode(unit: np.ndarray, codes: list[Code]) -> list[np.ndarray]:
    """For each unit vector its filters in all codes, in order; filters are numbered through."""
    found = []
    for number, code in enumerate(codes):
        ahead = number * len(code.first) * len(code.second)
        found.append([x + ahead for x in code.filters(unit)])
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def units(v: np.ndarray) -> np.ndarray:
    """Unit vectors; by the largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _decoded(classes: DataFrame, n: int, cosine: float) -> DataFrame:
    """The classes with the filters that their vectors exceed."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in codes:
                    codes[dim] = [code_for(dim, n, cosine, i) for i in range(CODES)]
                unit = units(matrix(part.column("v")))
                filters = pa.array([x.tolist() for x in decode(unit, codes[dim])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, filters], [*part.schema.names, "filters"])

    return classes.mapInArrow(decoded, StructType([*classes.schema.fields, _FILTERS]))


def _first_shared(filters: list[np.ndarray], own: int) -> np.ndarray:
    """Whether two vectors share no filter below `own`."""
    below = [f[: np.searchsorted(f, own)] for f in filters]
    values, at = np.unique(np.concatenate(below), return_inverse=True)
    holds = np.zeros((len(filters), len(values)), np.float32)
    holds[np.repeat(np.arange(len(filters)), [len(f) for f in below]), at] = 1
    return holds @ holds.T == 0


def links_of(
    unit: np.ndarray, side: np.ndarray, filters: list[np.ndarray], own: int, cosine: float = COSINE
) -> np.ndarray:
    """The links that one filter counts, as a matrix."""
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if len(some):
        first = _first_shared([filters[i] for i in some], own)
        linked[np.ix_(some, some)] &= first
    return linked


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """The least index of each vector's component."""
    roots = np.arange(len(linked))
    while True:
        least = np.minimum(roots, np.where(linked, roots[None, :], len(linked)).min(axis=1))
        least = least[least]
        if (least == roots).all():
            return roots
        roots = least


_COUNTED = "class long, root long, n long"


def _count(cosine: float, by_filter: bool):
    """Links of one group: of its filters that are not large, or of one pair of stripes."""

    def counted(key, table):
        out = {"class": [], "root": [], "n": []}
        number = table.column("class").to_numpy()
        weight = table.column("weight").to_numpy()
        filters = [np.array(x.as_py(), np.int64) for x in table.column("filters")]
        unit = units(matrix(table.column("v")))
        none = np.zeros(len(number), bool)
        if by_filter:
            # The filters of this group, each with its vectors.
            parts = [x.as_py() for x in table.column("own")]
            flat = np.array([f for p in parts for f in p], np.int64)
            rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(flat, kind="stable")
            cuts = np.flatnonzero(np.diff(flat[order])) + 1
            todo = [(int(flat[at[0]]), rows[at], none) for at in np.split(order, cuts)]
            todo = [x for x in todo if len(x[1]) > 1]
        else:
            side = table.column("side").to_numpy().astype(bool)
            todo = [(key[1].as_py(), np.arange(len(number)), side)]
        for own, at, side in todo:
            linked = links_of(unit[at], side[at] if len(side) else side, [filters[i] for i in at], own, cosine)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                linked = linked[np.ix_(some, some)]
                members = number[at[some]]
                out["class"].append(members)
                out["root"].append(members[_local_roots(linked)])
                out["n"].append(linked @ weight[at[some]])
        columns = {c: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for c, x in out.items()}
        return pa.table({c: pa.array(x) for c, x in columns.items()})

    return counted


def _links(decoded: DataFrame, cosine: float) -> DataFrame:
    """(class, root, n): links counted per class and filter, and one root per local component."""
    passed = decoded.select("class", "dim", F.explode("filters").alias("filter"))
    counts = passed.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(
        counts.where(F.col("n") > STRIPE).select("dim", "filter", F.ceil(F.col("n") / STRIPE).alias("stripes")),
        "vectors-large",
    )
    # A vector goes once to every group of neighbouring filters that it exceeds and that are not large.
    near = (
        passed.join(large, ["dim", "filter"], "left_anti")
        .groupBy("class", F.floor(F.col("filter") / TOGETHER).alias("together"))
        .agg(F.collect_list("filter").alias("own"))
    )
    small = (
        decoded.join(near, "class")
        .groupBy("dim", "together")
        .applyInArrow(_count(cosine, by_filter=True), _COUNTED)
    )
    own = F.pmod(F.xxhash64("class", "filter"), F.col("stripes"))
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1),
        lambda other: F.struct(
            F.least(own, other).alias("i"),
            F.greatest(own, other).alias("j"),
            (own > other).cast("int").alias("side"),
        ),
    )
    striped = (
        passed.join(large, ["dim", "filter"])
        .withColumn("cell", F.explode(cells))
        .select("class", "filter", "cell.i", "cell.j", "cell.side")
    )
    big = (
        decoded.join(striped, "class")
        .groupBy("dim", "filter", "i", "j")
        .applyInArrow(_count(cosine, by_filter=False), _COUNTED)
    )
    return small.unionByName(big)


def dedup(
    df: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector: `vec_id`, `n_links`, `component_id`, `kept`."""
    all_rows = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("v"),
    )
    ids = materialize(
        all_rows.select("id", F.when(usable(F.col("v")), F.xxhash64("v")).alias("class")),
        "vectors-ids",
    )
    classes = (
        vectors(df, id_column, vector_column)
        .groupBy(F.xxhash64("v").alias("class"))
        .agg(F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"), F.first("dim").alias("dim"))
        .withColumn("v", F.col("v").cast(df.schema[vector_column].dataType))
    )
    n = ids.where("class IS NOT NULL").count()
    decoded = materialize(_decoded(classes, n, cosine), "vectors-decoded")
    links = materialize(_links(decoded, cosine), "vectors-links")
    counts = links.groupBy("class").agg(F.sum("n").alias("links"))
    roots = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")), "vectors")
    weights = decoded.select("class", "weight")
    known = (
        weights.join(counts, "class", "left")
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "class",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "class").alias("root"),
        )
    )
    known = materialize(known, "vectors-known")
    joined = ids.join(known, "class", "left")
    least = (
        joined.where("root IS NOT NULL").groupBy(F.col("root").alias("r")).agg(F.min("id").alias("least"))
    )
    return joined.join(least, F.col("root") == F.col("r"), "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("least", "id")).alias("kept"),
    )
