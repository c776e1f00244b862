"""What several operators share: keys of rows, graph components, text units."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfmark.sources.tables import materialize

# Names that no input column is expected to have.
KEY = "__row_key"
TEXT = "__text"

# White space that separates words, as bytes and inside a Java pattern.
SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = re.compile(rb"[ \t-\r]")


def release_memory() -> None:
    """Give back what earlier tasks of this worker have freed but the allocators still hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


# What a task holds besides its operators: a batch on both sides of Python, the rows that a Parquet
# reader decodes at once, and the row group that a writer fills before it goes to disk.
SMALL = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "parquet.block.size": str(16 << 20),
}


def small_batches(spark: SparkSession) -> SparkSession:
    """Read, hand to Python and write documents a few megabytes at a time."""
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    return spark


def document_key(docs: DataFrame) -> DataFrame:
    """Add `KEY`, a 64-bit hash of `doc_id` and `text`: equal rows are one document."""
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id"), F.col("text")))


def nullable(schema: StructType) -> StructType:
    """The same fields, all of them nullable."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def fold(docs: DataFrame, modulus: int) -> Column:
    """crc32 of the document's id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): connected components of the undirected `edges` (a, b), both long and not null.

    Every round, each node points to the neighbour that comes first in a hashed order, and the
    graph shrinks to the nodes pointed to; hashing makes long sorted chains shrink as well. A hub is
    reduced by partial minima, and joins on it are split at run time. The loop ends when no edge is
    left; each round is written to the shared folder. The root is some node of the component.
    """
    step = materialize(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    hops = []
    while not step.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(hops)), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("best"))
        hop = materialize(
            first.select("node", F.least("best", rank(F.col("node")))["v"].alias("to")),
            f"{name}-hop",
        )
        hops.append(hop)
        left = hop.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = hop.select(F.col("node").alias("b"), F.col("to").alias("y"))
        step = materialize(
            step.join(left, "a")
            .join(right, "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            f"{name}-edges",
        )
    if not hops:
        return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last round back: where the target of a hop was itself moved later, follow it.
    roots = hops[-1].select("node", F.col("to").alias("root"))
    for hop in reversed(hops[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = hop.join(later, "to", "left").select(
            "node", F.coalesce("root", "to").alias("root")
        )
        roots = materialize(roots, f"{name}-roots")
    return roots


def stretches(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """The text in parts of about `size` bytes that end before white space."""
    start = 0
    while start < len(text):
        space = _SPACE.search(text, start + size)
        end = space.start() if space else len(text)
        yield text[start:end]
        start = end


class WordHashes(dict):
    """Word to its 64-bit hash; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of a text's words in order, A-Z in lower case."""
        parts = [np.zeros(0, np.uint64)]
        for stretch in stretches(text or b""):
            words = stretch.lower().split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts) if len(parts) > 2 else parts[-1]


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


_BLANK = np.zeros(256, bool)
_BLANK[list(SPACE)] = True
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64  # bytes of words that are hashed one at a time


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words in order, A-Z in lower case; all words of a stretch at once."""
    parts = [np.zeros(0, np.uint64), *(_hashed(stretch.lower()) for stretch in stretches(text or b""))]
    return np.concatenate(parts) if len(parts) > 2 else parts[-1]


def _hashed(text: bytes) -> np.ndarray:
    blank = np.ones(len(text) + 2, bool)
    blank[1:-1] = _BLANK[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    # The eight bytes from every place on. Sizes count, so what is cut off by zeros is no other word.
    eight = np.ndarray(len(text) + 1, "<u8", buffer=text + bytes(8), strides=(1,))
    found = eight[starts] & _FIRST[np.minimum(sizes, 8)]
    found = mixed_bits(found + sizes.astype(np.uint64) * _ODD)
    longer, at = np.flatnonzero(sizes > 8), 8
    while len(longer) and at < _LONG:
        left = sizes[longer] - at
        more = eight[starts[longer] + at] & _FIRST[np.minimum(left, 8)]
        found[longer] = mixed_bits(found[longer] * _ODD + more)
        longer, at = longer[left > 8], at + 8
    for i in longer:
        found[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return found
