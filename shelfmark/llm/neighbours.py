"""Approximate nearest neighbours by inner product, over stable low-dimensional projections.

The largest inner product becomes the smallest distance by one more component that gives all vectors
the length of the longest. Gaussian projections are 2-stable: the squared distance of two projected
points over their true squared distance follows a chi-square distribution with as many degrees of
freedom as there are projections. A kd-tree holds the projected points of a block of candidates; a
query visits its leaves in the order of their projected distance and verifies the vectors in them
exactly. It stops when a vector as near as its k-th best so far would, with probability
`CONFIDENCE`, have been projected nearer than all leaves still to come.

Candidates are dealt into blocks and queries into chunks; every chunk meets every block in a task of
its own, and what a block answers is at most k rows a query. Blocks and chunks have bounded sizes,
and copies are dealt by row, so no group of them meets in one place.

Defined results: null, zero and non-finite vectors take no part; only vectors of one length are
compared; a query is not its own neighbour, but another row with its id is one; a candidate without an
id comes out with a null id; equal scores are in the order of ids, null last; fewer than k candidates
give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.vectors import matrix, vectors
from shelfmark.sources.tables import materialize

PROJECTIONS = 8
CONFIDENCE = 0.97
LEAF = 256
STEP = 4  # leaves that are verified at once
BLOCK = 1 << 14  # candidates
CHUNK = 1 << 13  # queries
SEED = 6


def chi_square(probability: float, degrees: int) -> float:
    """The quantile, by the cube-root approximation."""
    z, c = NormalDist().inv_cdf(probability), 2 / (9 * degrees)
    return degrees * (1 - c + z * math.sqrt(c)) ** 3


def leaves_of(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree: halves at the median of the widest dimension down to `size`."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        part = points[at]
        widest = np.argmax(part.max(axis=0) - part.min(axis=0))
        half = len(at) // 2
        order = np.argpartition(part[:, widest], half)
        todo += [at[order[:half]], at[order[half:]]]
    return done


class Block:
    """Candidates in leaf order, with the boxes of the leaves."""

    def __init__(self, row: np.ndarray, ids: pa.ChunkedArray, v: np.ndarray, longest: float):
        d = v.shape[1]
        self.stable = np.random.default_rng(SEED).standard_normal((d + 1, PROJECTIONS))
        self.longest = longest
        rest = np.sqrt(np.maximum(longest**2 - (v * v).sum(axis=1), 0))
        points = v @ self.stable[:-1] + rest[:, None] * self.stable[-1]
        leaves = leaves_of(points)
        self.order = order = np.concatenate(leaves)
        self.row, self.v = row[order], v[order]
        self.ids = ids.fill_null(0).to_numpy()[order]
        self.no_id = ids.is_null().to_numpy()[order]
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places among the candidates as given, and scores, of the k best found."""
        length = np.sqrt(query @ query)
        point = (query * (self.longest / length)) @ self.stable[:-1]
        out = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        projected = (out * out).sum(axis=1)
        order = np.argsort(projected, kind="stable")
        bound = chi_square(CONFIDENCE, PROJECTIONS)
        best = np.zeros(0, np.int64)
        scores = np.zeros(0)
        for i in range(0, len(order), STEP):
            if len(best) >= k:
                # True squared distance of the k-th best, with all vectors as long as the longest.
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                distance = 2 * self.longest**2 - 2 * self.longest / length * kth
                if projected[order[i]] >= bound * max(distance, 0):
                    break
            part = np.concatenate(
                [np.arange(self.starts[x], self.ends[x]) for x in order[i : i + STEP]]
            )
            part = part[self.row[part] != own]
            best = np.concatenate([best, part])
            scores = np.concatenate([scores, self.v[part] @ query])
            if len(scores) > 4 * k:
                # All that could still be among the first k, whatever the last digits say.
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= kth - 1e-9 * max(1.0, abs(kth))
                best, scores = best[keep], scores[keep]
        exact = (self.v[best] * query).sum(axis=1)  # one order of summation for all rows
        first = np.lexsort((self.ids[best], self.no_id[best], -exact))[:k]
        return self.order[best[first]], exact[first]


_FOUND = "query_row long, query_id long, vec_id long, score double"
_NOTHING = pa.schema(
    {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
).empty_table()


def nearest(
    df: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k best found for the rows where `is_query` holds."""
    marked = df.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows = vectors(marked.where("__query"), id_column, vector_column).select("row", "id", "v", "dim")
    rows = rows.withColumn("query", F.lit(True)).unionByName(
        vectors(marked.where("NOT __query"), id_column, vector_column).withColumn("query", F.lit(False))
    )
    # Rows of the two parts are told apart by their last bit.
    rows = rows.withColumn("row", F.col("row") * 2 + F.col("query").cast("long"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = materialize(rows.withColumn("length", length), "neighbours-vectors")
    total = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0)), F.max("length")
    ).first()
    n, n_queries, longest = total
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // CHUNK))
    spread = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.where("query").select(
        "row", "id", "v", "dim", spread(chunks).alias("chunk"), every(blocks).alias("block")
    )
    candidates = rows.select(
        "row", "id", "v", "dim", spread(blocks).alias("block"), every(chunks).alias("chunk")
    )

    def searched(left, right):
        if not (left.num_rows and right.num_rows):
            return _NOTHING
        block = Block(
            right.column("row").to_numpy(), right.column("id"), matrix(right.column("v")), longest
        )
        own = left.column("row").to_numpy()
        at, near, scores = [], [], []
        for i, query in enumerate(matrix(left.column("v"))):
            places, exact = block.search(own[i], query, k)
            at.append(np.full(len(places), i))
            near.append(places)
            scores.append(exact)
        at, near = pa.array(np.concatenate(at)), pa.array(np.concatenate(near))
        found = {
            "query_row": left.column("row").take(at),
            "query_id": left.column("id").take(at),
            "vec_id": right.column("id").take(near),
            "score": pa.array(np.concatenate(scores)),
        }
        return pa.table(found, schema=_NOTHING.schema)

    keys = ["chunk", "block", "dim"]
    found = queries.groupBy(keys).cogroup(candidates.groupBy(keys)).applyInArrow(searched, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return (
        found.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
