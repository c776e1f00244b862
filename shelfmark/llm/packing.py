"""Documents packed into token sequences of a fixed capacity.

Every document becomes token ids and one end id; only documents longer than the capacity are cut.
How pieces share sequences depends on nothing but their lengths, and there are at most `capacity`
different lengths. So the packing is decided on the histogram of lengths, which is bounded whatever
the size of the corpus: pieces above a third of the capacity go at most two to a sequence and are
matched greedily, the longest first and each with the longest partner that leaves room for it; the
others fill the tightest gap that takes them, in falling order of length, and open sequences only
where no gap is left. The result is a short list of runs: so many pieces of one length, so many to a
sequence, at this offset. Spark numbers the pieces of each length and looks their places up.

A piece's number is a running number in the task that cut it plus what tasks before it cut of that
length, so a length that a third of all pieces share is numbered without ever meeting in one task.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives no sequence. A text is read in stretches that end at white space, which never lies
inside a token of the vocabulary used here, so memory does not follow a text's length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import release_memory, stretches
from shelfmark.sources.tables import materialize

CAPACITY = 4096
END = 1
ENTRY = 16  # bytes of a length and a number
BROADCAST = 256 << 20
WORDS_KEPT = 200_000  # by a task
STRETCH = 2 << 20  # bytes of text that are looked up at once
HELD = 2 << 20  # bytes of ids that are held before they are sent on

_MARKS = tuple(",.;:!?")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How the vocabulary writes bytes: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Word to its ids, as little-endian unsigned 32-bit bytes; texts are put together from there.

    The vocabulary splits at white space, and words further into letters, digits and marks, before
    it merges anything. Words up to U+00FF are keyed in lower case, which the vocabulary is in.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) > WORDS_KEPT:
            self.clear()
        # Up to U+00FF, composition changes nothing and lower case is one letter for one.
        simple = word.isascii() or max(word) < "\u0100"
        if simple and word.islower() and word.isalpha():
            written = word.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.tokenizer.model.tokenize(written)]
            ids = array("I", found).tobytes()
        elif simple and word[-1:] in _MARKS and word[:-1].isalpha():
            ids = self[word[:-1].lower()] + self[word[-1]]
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        distinct = _joined(words.dictionary)
        # Special tokens are told by their case; other letters may change their number.
        if "<|" not in distinct and (distinct.isascii() or max(distinct) < "\u0100"):
            distinct = distinct.lower()
        found = list(map(self.__getitem__, distinct.split("\n"))) if len(words) else []
        sizes = np.array(list(map(len, found)), np.int64) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        bounds = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        shift = starts[at] - (ends - n)
        ids = flat[np.repeat(shift, n) + np.arange(len(shift) and ends[-1])]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _joined(words: pa.Array) -> str:
    """All words, a line feed between them."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, "\n").view(pa.binary())[0].as_py().decode("utf-8", "replace")


def _texts_ids(texts: Iterable[bytes], words: WordIds) -> Iterator[tuple[int, bytes, bool]]:
    """(text, ids of its next stretch, whether that was the last), about `STRETCH` bytes at once."""
    held, size = [], 0
    for i, text in enumerate(texts):
        parts = list(stretches(text)) or [b""]
        for k, part in enumerate(parts):
            held.append((i, part, k == len(parts) - 1))
            size += len(part)
            if size >= STRETCH:
                yield from _stretch_ids(held, words)
                held, size = [], 0
    if held:
        yield from _stretch_ids(held, words)


def _stretch_ids(held, words: WordIds) -> Iterator[tuple[int, bytes, bool]]:
    for (i, _, last), ids in zip(held, words.of([part for _, part, _ in held]), strict=True):
        yield i, ids, last


def pieces_of(
    texts: Iterable[bytes], words: WordIds, capacity: int, end_id: int
) -> Iterator[tuple[int, int, bytes]]:
    """(text, piece, ids): the ids of all texts, cut where the capacity is reached."""
    full, held, piece = capacity * 4, b"", 0
    for i, ids, last in _texts_ids(texts, words):
        held += ids
        if last:
            held += np.array([end_id], "<u4").tobytes()
        while len(held) > full or last and held:
            yield i, piece, held[:full]
            held, piece = held[full:], piece + 1
        if last:
            piece = 0


def cut(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece, with the task that cut it and its running number there by length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        words = WordIds(tokenizer_path)
        task = TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, held, start = [], 0, 0
            texts = (text.as_py() or b"" for text in batch.column("text"))
            for i, piece, ids in pieces_of(texts, words, capacity, end_id):
                n = len(ids) // 4
                start = 0 if piece == 0 else start
                rows.append((i, piece, start, n, zlib.crc32(ids), int(numbers[n]), ids if keep_ids else None))
                numbers[n] += 1
                start += n
                held += len(ids) if keep_ids else 0
                if held > HELD:
                    yield record(batch, rows, task)
                    rows, held = [], 0
            yield record(batch, rows, task)

    def record(batch, rows, task):
        of, piece, start, length, crc, number, ids = zip(*rows, strict=True) if rows else ((),) * 7
        columns = [
            batch.column("doc_id").take(pa.array(of, pa.int64())),
            pa.array(piece, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array([task] * len(rows), pa.int32()),
            pa.array(number, pa.int64()),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
        if keep_ids:
            columns.append(pa.array(ids, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(pieces, schema + (", ids binary" if keep_ids else ""))


@dataclass(frozen=True)
class Run:
    """Pieces `first` to `first + count - 1` of a length: `each` to a sequence, from `sequence` on."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of every length go; see the module's text. Lengths are 1 to `capacity`."""
    runs: list[Run] = []
    used = dict.fromkeys(histogram, 0)  # pieces placed so far
    gaps: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), in order
    opened = 0

    def put(length: int, count: int, each: int, sequence: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, each, sequence, offset))
        used[length] += count

    def fill(length: int, count: int, most: int, waiting: list, done: list) -> int:
        """Put pieces into the tightest of the `waiting` gaps; the rest of each goes to `done`."""
        while count:
            at = bisect_left(waiting, (length,))
            if at == len(waiting):
                break
            room, sequence, n = waiting.pop(at)
            each = min(most, room // length)
            whole = min(n, count // each)
            if whole:
                put(length, whole * each, each, sequence, capacity - room)
                insort(done, (room - each * length, sequence, whole))
                count -= whole * each
            if whole < n:
                rest = count if count < each else 0
                if rest:
                    put(length, rest, rest, sequence + whole, capacity - room)
                    insort(done, (room - rest * length, sequence + whole, 1))
                    count = 0
                if n - whole - bool(rest):
                    insort(waiting, (room, sequence + whole + bool(rest), n - whole - bool(rest)))
        return count

    def open_for(length: int, count: int, most: int, part: list, whole: list) -> None:
        """New sequences with `most` pieces each; one with fewer goes to `part`."""
        nonlocal opened
        n, rest = divmod(count, most)
        if n:
            put(length, n * most, most, opened, 0)
            insort(whole, (capacity - most * length, opened, n))
            opened += n
        if rest:
            put(length, rest, rest, opened, 0)
            insort(part, (capacity - rest * length, opened, 1))
            opened += 1

    falling = sorted((n for n in histogram if histogram[n]), reverse=True)
    single: list[tuple[int, int, int]] = []  # sequences that wait for a second large piece
    for length in (n for n in falling if 3 * n > capacity):
        left = fill(length, histogram[length], 1, single, gaps)
        pair = 2 * length <= capacity
        open_for(length, left, 2 if pair else 1, single, gaps if pair else single)
    for gap in single:
        insort(gaps, gap)
    for length in (n for n in falling if 3 * n <= capacity):
        left = fill(length, histogram[length], capacity, gaps, gaps)
        open_for(length, left, capacity // length, gaps, gaps)
    return runs


def place(ranked: DataFrame, runs: list[Run]) -> DataFrame:
    """The rows with `sequence_id` and `offset` for their `length` and `rank`.

    A length has few runs, and at most `capacity` lists of them go to all executors. The rows stay where
    they are: handed to Python, they would wait on disk with all that the rank was made from.
    """
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in sorted(runs, key=lambda r: (r.length, r.first)):
        by_length.setdefault(r.length, []).append((r.first, r.each, r.sequence, r.offset))
    schema = "length long, runs array<struct<first: long, each: long, sequence: long, offset: long>>"
    listed = ranked.sparkSession.createDataFrame(list(by_length.items()), schema)
    of_rank = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    found = ranked.join(F.broadcast(listed), "length").withColumn("__run", of_rank)
    i = F.col("rank") - F.col("__run.first")
    return found.withColumns({
        "sequence_id": F.col("__run.sequence") + F.expr("(rank - __run.first) div __run.each"),
        "offset": F.col("__run.offset") + i % F.col("__run.each") * F.col("length"),
    })


def _before(counts: DataFrame, capacity: int) -> DataFrame:
    """(task, before): how many pieces of each of its lengths the tasks before it cut.

    A row per task, of at most `capacity` entries, goes to all executors, so that pieces and their ids are
    not shuffled; beyond `BROADCAST` bytes of entries the join is a shuffle.
    """
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    listed = counts.select("task", F.struct("length", before.alias("before")).alias("entry"))
    rows = listed.groupBy("task").agg(F.map_from_entries(F.collect_list("entry")).alias("before"))
    written = materialize(rows, "packing-before")
    return F.broadcast(written) if counts.count() * ENTRY <= BROADCAST else written.hint("shuffle_hash")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset`.

    With `keep_ids` also `ids`, little-endian unsigned 32-bit. `docs` needs `doc_id` and `text`.
    """
    # Ids are most of a piece; they are written for this plan alone.
    options = {"compression": "zstd"} if keep_ids else None
    pieces = materialize(cut(docs, tokenizer_path, capacity, end_id, keep_ids), "packing-pieces", options)
    counts = pieces.groupBy("task", "length").agg((F.max("number") + 1).alias("n"))
    counts = materialize(counts, "packing-counts")
    # At most `capacity` rows.
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    ranked = pieces.join(_before(counts, capacity), "task").withColumn(
        "rank", F.col("number") + F.element_at("before", F.col("length"))
    )
    return place(ranked, plan_runs(histogram, capacity)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
        *(["ids"] if keep_ids else []),
    )
