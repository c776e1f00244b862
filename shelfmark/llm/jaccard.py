"""Groups of documents linked by a Jaccard similarity of 0.75 or more of their sets of word 5-grams.

Exact groups by a set-similarity join that uses how sets relate to each other:

* Equal sets are one class; everything below works on classes, so copies cost nothing twice.
* Linked sets are merged. In a few rounds, components are compared to classes with
  which they share smallest hashes; what is found linked is one component, and no pair inside a
  component is ever made again, because for the groups its answer is not needed.
* What is left goes through a prefix index: of two linked sets, the first shingles in one common
  order meet. The order puts shingles that a count sketch of the whole corpus shows to be frequent
  last, ties by hash. Index lists are scanned in blocks; blocks and pairs whose sizes or whose
  positions in the order rule out 0.75 are skipped.

Prefixes travel as arrays, one per segment of the hash range. A list that the sketch shows to be
long is cut into stripes, and each pair of stripes is a list of its own. Candidate pairs that remain
are checked on parity bitmaps, which prove most of the unlinked ones to be so, and then on whole
sets. Sets leave their task only for pairs to verify.

The links found connect every group of linked documents. They are not all links: a pair inside a group
may be linked or not, Jaccard is not transitive, and neither it nor a set's number of links comes out.
Shingles and sets are known by 64-bit hashes.

Defined results: null texts and texts without words have size 0 and are groups of one; fewer than
five words are one shingle; rows with equal `doc_id` and other text are different documents, and a
component's id is the smallest `doc_id` in it (a null `doc_id` only where all are null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    KEY,
    WORD,
    components,
    document_key,
    mixed_bits,
    release_memory,
    word_hashes,
)
from shelfmark.sources.tables import materialize, small_side

WORDS = 5
# The similarity is NUM / DEN.
NUM, DEN = 75, 100

SMALLEST = 8  # smallest hashes kept per class
TRIES = (2, 8, 30)  # centres per list and pairs per two components, by round
COUNTERS = 1 << 18
STRIPE = 20_000  # entries of an index list beyond what the sketch's noise explains
BLOCK = 1024
BUFFER = 1 << 19  # shingles or index entries that a task gathers before it sends them on
FEW = 1_000_000  # rows of two numbers that may be broadcast

_STEPS = mixed_bits(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted set of a document's shingles, from its words' hashes."""
    if not len(words):
        return words
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found += words[k : k + n] * _STEPS[k]
    found = mixed_bits(found)
    found.sort()
    return found[np.append(True, found[1:] != found[:-1])]


def _class_of(found: np.ndarray) -> int:
    """One number for a set."""
    total = mixed_bits(found).sum(dtype=np.uint64) + np.uint64(len(found))
    return int(mixed_bits(np.array([total], np.uint64)).view(np.int64)[0])


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text").cast("binary").alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """(key, doc, n, class, smallest) per document and, with `part`, the counters of a sketch."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            n, number, least, held, size = [], [], [], [], 0
            for text in batch.column("text"):
                found = shingles(word_hashes(text.as_py()))
                held.append((found >> np.uint64(64 - 18)).astype(np.int32))
                size += len(found)
                if size > BUFFER:
                    counters += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
                n.append(len(found))
                number.append(_class_of(found) if len(found) else None)
                least.append(found[:SMALLEST].astype(np.int64))
            if held:
                counters += np.bincount(np.concatenate(held), minlength=COUNTERS)
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("doc"),
                    pa.array(n, pa.int64()),
                    pa.array(number, pa.int64()),
                    pa.array(least, pa.list_(pa.int64())),
                    pa.nulls(size, pa.int32()),
                    pa.nulls(size, pa.binary()),
                ],
                ["key", "doc", "n", "class", "smallest", "part", "counters"],
            )
        parts = counters.astype("<u4").reshape(64, -1)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(64, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))),
                pa.array(range(64), pa.int32()),
                pa.array([p.tobytes() for p in parts], pa.binary()),
            ],
            ["key", "doc", "n", "class", "smallest", "part", "counters"],
        )

    texts = _texts(
        document_key(docs), F.col(KEY).alias("key"), F.col("doc_id").cast("long").alias("doc")
    )
    return texts.mapInArrow(
        described,
        "key long, doc long, n long, class long, smallest array<long>, part int, counters binary",
    )


def _sketch(described: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: `COUNTERS` numbers, whatever the corpus."""

    def added(key, table):
        total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("counters"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([list(total)])})

    parts = described.where("part IS NOT NULL").select("part", "counters")
    rows = parts.groupBy("part").applyInArrow(added, "part int, sums array<long>").collect()
    found = {r["part"]: r["sums"] for r in rows}
    none = [0] * (COUNTERS // 64)
    return np.array([found.get(i, none) for i in range(64)], np.int64).ravel()


def _shared_lists(documents: DataFrame) -> DataFrame:
    """(m, class, n, smallest): the classes that have a smallest hash in common with another."""
    classes = documents.where("class IS NOT NULL").groupBy("class").agg(
        F.first("n").alias("n"), F.first("smallest").alias("smallest")
    )
    lists = classes.select(F.explode("smallest").alias("m"), "class", "n", "smallest")
    more = lists.groupBy("m").count().where(F.col("count") > 1).select("m")
    return lists.join(more, "m")


def _near_pairs(lists: DataFrame, roots: DataFrame, tried: DataFrame, number: int) -> DataFrame:
    """Pairs of components with a few pairs of their classes that share smallest hashes.

    Every list has a few centres, others and more of them in each round; the components in it are
    compared to those. Centres are ranked by class alone, so that the lists of one group share theirs
    and a class meets the same few in all of them. Two components that share much get more pairs, round by round.
    """
    known = lists.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    place = Window.partitionBy("m").orderBy(F.xxhash64(F.lit(number), "class"), "class")
    centres = known.withColumn("place", F.row_number().over(place)).where(F.col("place") <= TRIES[number])
    c = centres.select("m", *(F.col(x).alias(f"c_{x}") for x in ("class", "root", "n", "smallest")))
    shared = F.size(F.array_intersect("smallest", "c_smallest"))
    near = (
        known.join(c, "m")
        .where(F.col("root") != F.col("c_root"))
        .where(_sizes_fit(F.col("n"), F.col("c_n")))
        .where(shared * 5 >= F.least(F.size("smallest"), F.size("c_smallest")) * 3)
        .select(
            F.least("root", "c_root").alias("x"),
            F.greatest("root", "c_root").alias("y"),
            F.least("class", "c_class").alias("a"),
            F.greatest("class", "c_class").alias("b"),
            shared.alias("shared"),
        )
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    best = Window.partitionBy("x", "y").orderBy(F.desc("shared"), F.xxhash64(F.lit(number), "a", "b"), "a", "b")
    ranked = near.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= TRIES[number]).select("a", "b")


def _sizes_fit(n, m):
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def parity(found: np.ndarray) -> bytes:
    """A bitmap of at least four bits a shingle, each bit the parity of the shingles that fall on it.

    Two sets' bitmaps of one size differ in at most as many bits as the sets differ in shingles.
    """
    size = 1 << max(6, int(4 * len(found) - 1).bit_length())
    at = (found & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(bool)).tobytes()


def _halved(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set at a smaller size: places that fall together add up."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(x: bytes, y: bytes, n: int, m: int) -> bool:
    """False only where the bitmaps prove the similarity to be too small."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(_halved(x, size) ^ _halved(y, size)).sum())
    # Linked sets have at least NUM / (NUM + DEN) of n + m in common, and differ in the rest.
    return differ * (NUM + DEN) <= (n + m) * (DEN - NUM)


def _of_classes(
    docs: DataFrame, described: DataFrame, pairs: DataFrame, content, name: str
) -> DataFrame:
    """(class, n, content) of every class in the (a, b) pairs, written: `content` of its set."""
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    # One document of each class that a pair needs.
    one = (
        described.where("class IS NOT NULL")
        .join(needed, "class")
        .groupBy("class")
        .agg(F.min("key").alias("wanted"))
        .select("wanted")
    )
    few = small_side(one, f"{name}-wanted", FEW)
    keyed = document_key(docs.select("doc_id", "text"))
    texts = _texts(keyed.join(few, F.col(KEY) == F.col("wanted"), "left_semi"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        seen = set()
        for batch in batches:
            number, size, found, held = [], [], [], 0
            for text in batch.column("text"):
                members = shingles(word_hashes(text.as_py()))
                # Rows equal in id and text give the same set: once per task is enough.
                if (own := _class_of(members)) in seen:
                    continue
                seen.add(own)
                number.append(own)
                size.append(len(members))
                found.append(content(members))
                held += len(found[-1])
                if held > 8 << 20:
                    yield rows(number, size, found)
                    number, size, found, held = [], [], [], 0
            yield rows(number, size, found)

    def rows(number, size, found):
        kinds = (pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip((number, size, found), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["class", "n", "content"])

    return materialize(texts.mapInArrow(sets, "class long, n long, content binary"), f"{name}-sets")


def _where(pairs: DataFrame, contents: DataFrame, keep) -> DataFrame:
    """The distinct (a, b) pairs for whose contents x and y, of n and m shingles, `keep` holds."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("x", "y", "n", "m"))
            kept = [
                keep(x.as_buffer(), y.as_buffer(), n.as_py(), m.as_py())
                for x, y, n, m in zip(*columns, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = contents.select(F.col("class").alias("a"), "n", F.col("content").alias("x"))
    right = contents.select(
        F.col("class").alias("b"), F.col("n").alias("m"), F.col("content").alias("y")
    )
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(compared, "a long, b long").distinct()


def linked(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether two sets of sorted shingles are similar enough."""
    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (n + m - common)


def _verified(docs: DataFrame, described: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of the (a, b) class pairs whose sets are similar enough.

    Bitmaps rule most of the others out; whole sets are made and moved for what they leave.
    """
    bitmaps = _of_classes(docs, described, pairs, parity, f"{name}-bitmap")
    close = materialize(_where(pairs, bitmaps, may_link), f"{name}-close")
    sets = _of_classes(docs, described, close, np.ndarray.tobytes, name)
    return _where(close, sets, linked)


def _index(docs: DataFrame, roots: DataFrame, sketch: np.ndarray, segments: int) -> DataFrame:
    """(segment, list, class, root, n, at): the prefix of every class, as arrays.

    `list` is the shingle, changed by the pair of stripes where it has any; `root` is stored as its
    difference to the class, which is mostly zero.
    """
    usual = int(np.median(sketch))
    shift = np.uint64(64 - int(math.log2(segments)))

    def entries(found: np.ndarray, number: int, root: int):
        n = len(found)
        often = sketch[(found >> np.uint64(64 - 18)).astype(np.int64)]
        size = n - -(-NUM * n // DEN) + 1
        # `found` is in order already.
        order = np.argsort(often, kind="stable")[:size]
        lists, at, often = found[order], np.arange(size), often[order]
        if often[-1] - usual <= STRIPE:
            return lists, at
        stripes = -(-np.maximum(often - usual, 0) // STRIPE)
        for i in np.flatnonzero(stripes > 1):
            # This entry's stripe meets every stripe, itself included.
            count = int(stripes[i])
            own = int(mixed_bits(np.array([number], np.int64).view(np.uint64))[0] % np.uint64(count))
            other = np.arange(count)
            cell = np.minimum(other, own) * count + np.maximum(other, own)
            lists = np.append(lists, mixed_bits(lists[i] + cell.astype(np.uint64) + np.uint64(1)))
            at = np.append(at, np.full(count, i))
        plain = np.append(stripes <= 1, np.ones(len(lists) - size, bool))
        return lists[plain], at[plain]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        seen, held, size = set(), [], 0
        for batch in batches:
            for text, root in zip(batch.column("text"), batch.column("root").to_pylist(), strict=True):
                found = shingles(word_hashes(text.as_py()))
                if not len(found):
                    continue
                number = _class_of(found)
                if number in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(number)
                root = number if root is None else root
                lists, at = entries(found, number, root)
                held.append((lists, number, root, len(found), at))
                size += len(lists)
                if size >= BUFFER:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def sent(held):
        lists = np.concatenate([x[0] for x in held])
        sizes = [len(x[0]) for x in held]
        order = np.argsort(lists, kind="stable")
        number = np.repeat(np.array([x[1] for x in held], np.int64), sizes)
        columns = [
            lists,
            number,
            np.repeat(np.array([x[2] for x in held], np.int64), sizes) ^ number,
            np.repeat(np.array([x[3] for x in held], np.int64), sizes),
            np.concatenate([x[4] for x in held]).astype(np.int64),
        ]
        columns = [x[order] for x in columns]
        ends = np.searchsorted(columns[0] >> shift, np.arange(segments, dtype=np.uint64), side="right")
        starts = np.append(0, ends[:-1])
        full = np.flatnonzero(ends > starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)),
                *(pa.array([x[starts[i] : ends[i]].tobytes() for i in full], pa.binary()) for x in columns),
            ],
            ["segment", "list", "class", "root", "n", "at"],
        )

    keyed = document_key(docs.select("doc_id", "text"))
    texts = _texts(keyed.join(roots, F.col(KEY) == F.col("of"), "left"), "root")
    return texts.mapInArrow(
        indexed, "segment int, list binary, class binary, root binary, n binary, at binary"
    )


def _list_pairs(number, root, n, at) -> Iterator[np.ndarray]:
    """Pairs of one index list that different components hold and that sizes and positions allow.

    The list is in the order of n. Block against block; a block whose smallest set is too large for
    the other's largest is skipped with all behind it.
    """
    for a in range(0, len(n), BLOCK):
        x = slice(a, a + BLOCK)
        for b in range(a, len(n), BLOCK):
            if n[b] * NUM > n[x][-1] * DEN:
                break
            y = slice(b, b + BLOCK)
            fits = n[y][None, :] * NUM <= n[x][:, None] * DEN
            fits &= root[x][:, None] != root[y][None, :]
            if a == b:
                fits &= np.arange(len(n[x]))[:, None] < np.arange(len(n[y]))[None, :]
            if not fits.any():
                continue
            i, j = np.nonzero(fits)
            i, j = i + a, j + b
            # What can still be common from this shingle on, and what 0.75 asks for.
            still = np.minimum(n[i] - at[i], n[j] - at[j])
            enough = still * (NUM + DEN) >= NUM * (n[i] + n[j])
            yield np.stack([number[i[enough]], number[j[enough]]], axis=1)


def _later_pairs(index: DataFrame) -> DataFrame:
    """Candidate pairs between different components, from the segments of the prefix index."""

    def found(key, table):
        parts = [
            np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)])
            for c, t in (("list", np.uint64), ("class", np.int64), ("root", np.int64), ("n", np.int64), ("at", np.int64))
        ]
        order = np.lexsort((parts[3], parts[0]))
        lists, number, root, n, at = (x[order] for x in parts)
        root = root ^ number
        start = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        end = np.append(start[1:], len(lists))
        mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        pairs = [np.zeros((0, 2), np.int64)]
        for s, e in zip(start[mixed], end[mixed], strict=True):
            pairs += _list_pairs(number[s:e], root[s:e], n[s:e], at[s:e])
        pairs = np.sort(np.concatenate(pairs), axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return index.groupBy("segment").applyInArrow(found, "a long, b long").distinct()


def _class_roots(links: DataFrame, name: str) -> DataFrame:
    return components(links, name).select(F.col("node").alias("class"), "root")


def _early_links(docs: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that smallest hashes find, and the components they make as (class, root).

    What the rounds miss is left to the index.
    """
    lists = materialize(_shared_lists(documents), "jaccard-lists")
    links = lists.where("false").select(F.col("class").alias("a"), F.col("class").alias("b"))
    tried = links
    roots = links.select(F.col("a").alias("class"), F.col("b").alias("root"))
    for number in range(len(TRIES)):
        pairs = materialize(_near_pairs(lists, roots, tried, number), "jaccard-near-pairs")
        tried = tried.unionByName(pairs)
        found = materialize(_verified(docs, documents, pairs, "jaccard-near"), "jaccard-near-links")
        new = found.count()
        if not new:
            break
        links = links.unionByName(found)
        roots = materialize(_class_roots(links, "jaccard-near"), "jaccard-near-roots")
    return links, roots


def groups(docs: DataFrame) -> DataFrame:
    """`key`, `doc`, `n`, `class` and `root` (null: the class is linked with no other) per document."""
    described = materialize(describe(docs), "jaccard-documents")
    size = described.agg(F.sum("n")).first()[0] or 0
    segments = 1 << min(12, max(4, math.ceil(math.log2(max(1, size / (1 << 19))))))
    sketch = _sketch(described)
    documents = described.where("part IS NULL").select("key", "doc", "n", "class", "smallest")
    links, early = _early_links(docs, documents)
    known = documents.join(early, "class").select(F.col("key").alias("of"), "root").distinct()
    index = _index(docs, small_side(known, "jaccard-early", FEW), sketch, segments)
    pairs = materialize(_later_pairs(index), "jaccard-later-pairs")
    later = _verified(docs, documents, pairs, "jaccard-later")
    roots = _class_roots(links.unionByName(later), "jaccard-roots")
    return documents.join(roots, "class", "left").select("key", "doc", "n", "class", "root")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles`, `component_id`."""
    found = materialize(groups(docs), "jaccard-groups")
    # Linked classes share a root, copies a class; a document without words stands alone.
    group = F.coalesce("root", "class")
    least = found.where("class IS NOT NULL").groupBy(group.alias("g")).agg(F.min("doc").alias("least"))
    return found.join(least, group == F.col("g"), "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group in its own columns: the one with the smallest `doc_id`, then key.

    Of rows equal in id and text one stays; documents without words are in no group and all stay.
    """
    found = materialize(groups(docs), "jaccard-groups").where("class IS NOT NULL")
    first = F.struct(F.col("doc").isNull().alias("n"), "doc", "key")
    best = found.groupBy(F.coalesce("root", "class").alias("g")).agg(F.min(first)["key"].alias("best"))
    copies = found.groupBy(F.col("key").alias("best")).agg(F.count(F.lit(1)).alias("rows"))
    best = materialize(best.select("best").join(copies, "best"), "jaccard-best")
    keyed = document_key(docs)
    own = [F.col(f"`{c}`") for c in docs.columns]

    def stays(which: DataFrame) -> DataFrame:
        return keyed.join(which, F.col(KEY) == F.col("best"), "left_semi")

    empty = docs.where(F.coalesce(~F.col("text").rlike(WORD), F.lit(True)))
    return (
        stays(best.where("rows = 1")).select(*own)
        .unionByName(stays(best.where("rows > 1")).dropDuplicates([KEY]).select(*own))
        .unionByName(empty)
    )
