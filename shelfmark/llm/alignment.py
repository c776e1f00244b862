"""Tokens of two tokenizers over the same bytes, aligned by coalescing their intervals.

Both tokenizers cut the same bytes, a space and the text, so every token is an interval. All intervals
of a stretch, of both kinds, are sorted by their starts and the ends are accumulated to a running
maximum; where a start reaches the maximum of all before it, no token of either kind crosses, and a
group begins. Within a group every token of one kind overlaps the others' bytes, and all pairs are
links. A group's links are counted on its distinct ids, so a run of thousands of equal tokens costs
one pair and not millions.

How many documents hold a pair linked is counted over the whole corpus. A task cuts its documents into
chunks of `CHUNK` bytes of text; a chunk asks for each of its distinct pairs once, with the number of
its documents that hold it. Spark sums these numbers by pair, finds the best pair of every id (an id
has at most as many partners as the other vocabulary has entries), and sends the answers back to the
chunks, where the documents wait with places in the chunk's list of pairs. So what is shuffled are
distinct pairs of chunks, not links, and a pair that every document holds is one row a chunk.

Texts are read in stretches that end before a single space between letters or digits. Neither
tokenizer has a token across such a place (checked for the entries of the second; the first
separates words before it merges anything), so the tokens are those of the whole text.

Defined results: a text that is null, empty, not valid UTF-8, or whose joined tokens are not a space
and the text has no tokens: all numbers are 0 and the digest is the empty text. Strings of special
tokens are plain text. Repeated rows are documents each, also in the counts; an empty table gives no
rows. Extra columns stay, except those named like results, which are replaced; names that begin with
two underscores are taken.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from shelfmark.llm.common import TEXT, nullable, release_memory
from shelfmark.llm.packing import vocabulary
from shelfmark.sources.tables import materialize

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"

STRETCH = 1 << 20  # characters that are tokenized at once
TOKENS = 1 << 18  # that are aligned at once
CHUNK = 8 << 20  # bytes of text whose pairs are asked for together
LINKS = 1 << 20  # links of distinct ids that are expanded at once

_BITS = 32  # of an id inside a pair
_BETWEEN = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """Letter to byte, as byte-level vocabularies write bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Entries:
    """Byte strings that are looked up by number and joined."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array(list(map(len, entries)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes()


# How byte-level vocabularies of this kind separate words: a fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _as_ranks(path: str):
    """The vocabulary of a byte-level file for the quicker library, if the file says no more than that.

    That is: nothing but words separated as in `_WORDS` and merged in the order of their ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, letters = content["model"], _byte_letters()
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    steps = {k: v for k, v in (content["pre_tokenizer"] or {}).items() if k in plain}
    if content["normalizer"] or {**plain, "trim_offsets": steps.get("trim_offsets")} != steps:
        return None
    special = {t["content"] for t in content["added_tokens"] if t["special"]}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    entries = {e: i for e, i in model["vocab"].items() if e not in special}
    order = [entries[m] for m in merged]
    if order != sorted(set(order)) or len(entries) != len(order) + 256 or model.get("ignore_merges"):
        return None
    ranks = {bytes(map(letters.get, e)): i for e, i in entries.items()}
    return tiktoken.Encoding("from file", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """Two tokenizers, and the bytes and written forms of their entries."""

    def __init__(self, first_path: str, second_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first_path)
        self.first.encode_special_tokens = True
        self.quick = _as_ranks(first_path)
        self.second = sentencepiece.SentencePieceProcessor(model_file=second_path)
        letters = _byte_letters()
        self.first_bytes = [b""] * self.first.get_vocab_size()
        for entry, i in self.first.get_vocab().items():
            known = all(c in letters for c in entry)
            self.first_bytes[i] = bytes(map(letters.get, entry)) if known else entry.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.second_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        # Only where no entry crosses from one word into the next may a text be cut.
        self.cuts = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.bytes = [_Entries(self.first_bytes), _Entries(self.second_bytes)]
        # Each entry's number with what may follow it in the written form of groups.
        numbers = [range(len(self.first_bytes)), range(len(self.second_bytes))]
        self.written = _Entries(
            [f"{i}{end}".encode() for ids, ends in zip(numbers, (",|", ",;"), strict=True) for end in ends for i in ids]
        )

    def _stretches(self, text: str) -> Iterator[str]:
        """Parts of the text, without the space between two of them."""
        start = 0
        while self.cuts and len(text) - start > STRETCH:
            space = _BETWEEN.search(text, start + STRETCH)
            if space is None:
                break
            yield text[start : space.start()]
            start = space.end()
        yield text[start:]

    def encode(self, text: bytes | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both kinds by stretch; none if the bytes of either are not space and text."""
        try:
            letters = (text or b"").decode()
        except UnicodeDecodeError:
            return []
        found = []
        for part in self._stretches(letters) if letters else ():
            if self.quick:
                first = self.quick.encode_to_numpy(" " + part, disallowed_special=()).astype(np.int32)
            else:
                first = self.first.encode_batch_fast([" " + part], add_special_tokens=False)[0].ids
            second = self.second.encode(part, num_threads=1)
            found.append((np.array(first, np.int32), np.array(second, np.int32)))
        for kind in (0, 1):
            if b"".join(self.bytes[kind].joined(x[kind]) for x in found) != b" " + (text or b""):
                return []
        return found


@lru_cache(maxsize=2)
def _pair(first_path: str, second_path: str) -> Pair:
    return Pair(first_path, second_path)


def groups_of(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The group of every interval, numbered along the bytes."""
    order = np.lexsort((kinds, starts))
    reached = np.maximum.accumulate(ends[order])
    begins = np.append(False, starts[order][1:] >= reached[:-1])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins)
    return group


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of occurrences of every distinct id of every group."""
    keys, n = np.unique(group << _BITS | ids, return_counts=True)
    return keys >> _BITS, keys & ((1 << _BITS) - 1), n


def _linked(a, b, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair of ids, links) of two lists from `_distinct`, `LINKS` rows at a time or so."""
    (a_group, a_id, a_n), (b_group, b_id, b_n) = a, b
    partners = np.bincount(b_group, minlength=n_groups)
    first = np.cumsum(partners) - partners
    across = partners[a_group]
    done = np.cumsum(across)
    cuts = np.searchsorted(done, np.arange(LINKS, (done[-1] if len(done) else 0) + LINKS, LINKS)) + 1
    for low, high in pairwise(np.unique(np.clip(np.append(0, cuts), 0, len(across)))):
        wide = across[low:high]
        left = np.repeat(np.arange(low, high), wide)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide, wide)
        right = first[a_group[left]] + inner
        yield a_group[left], a_id[left] << _BITS | b_id[right], a_n[left] * b_n[right]


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums."""
    every, number = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    return every[starts], np.add.reduceat(number, starts) if len(starts) else number


class Aligned:
    """What is known of one document; stretches are added in order."""

    def __init__(self, keep_groups: bool):
        self.counts = np.zeros(4, np.int64)  # tokens of both kinds, groups, links
        self.digest = hashlib.sha256()
        self.text = [] if keep_groups else None
        self.pairs, self.links = [], []

    def write(self, part: bytes) -> None:
        part = part[:-1] if not self.counts[2] else b";" + part[:-1]
        self.digest.update(part)
        if self.text is not None:
            self.text.append(part)

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """The document's distinct pairs in order, and their links."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pairs) > 1:
            pairs, links = _summed(self.pairs, self.links)
            self.pairs, self.links = [pairs], [links]
        return self.pairs[0], self.links[0]


def _align(found: list[tuple[Aligned, np.ndarray, np.ndarray]], pair: Pair) -> None:
    """Add a run of stretches to their documents. Stretches are never shared by groups."""
    if not found:
        return
    ids = [np.concatenate([x[kind] for x in found]).astype(np.int64) for kind in (1, 2)]
    counts = [np.array([len(x[kind]) for x in found]) for kind in (1, 2)]
    sizes = [pair.bytes[kind].sizes[ids[kind]] for kind in (0, 1)]
    ends = [np.cumsum(x) for x in sizes]
    kinds = np.repeat([0, 1], [len(x) for x in ids])
    group = groups_of(
        np.concatenate([e - s for e, s in zip(ends, sizes, strict=True)]), np.concatenate(ends), kinds
    )
    n_groups = int(group.max()) + 1
    a_group, b_group = group[: len(ids[0])], group[len(ids[0]) :]
    tokens = [np.bincount(g, minlength=n_groups) for g in (a_group, b_group)]
    last = np.cumsum(counts[0]) - 1  # the last token of a stretch is in its last group
    group_ends = a_group[last] + 1
    n_links = np.append(0, np.cumsum(tokens[0] * tokens[1]))[np.append(0, group_ends)]

    # The written form: ids group by group, the first kind before the second.
    order = np.argsort(group * 2 + kinds, kind="stable")
    place = (group * 2 + kinds)[order]
    ending = np.append(place[1:] != place[:-1], True).astype(np.int64)
    n_first, n_second = len(pair.first_bytes), len(pair.second_bytes)
    base = np.array([[0, n_first], [2 * n_first, 2 * n_first + n_second]])
    entry = np.concatenate(ids)[order] + base[kinds[order], ending]
    written = pair.written.joined(entry)
    token_ends = np.cumsum(counts[0] + counts[1])
    written_ends = np.cumsum(pair.written.sizes[entry])[token_ends - 1]

    document = np.repeat(np.arange(len(found)), np.diff(np.append(0, group_ends)))
    keys, links = [], []
    for at, ids_pair, n in _linked(_distinct(a_group, ids[0]), _distinct(b_group, ids[1]), n_groups):
        # Stretches first, then pairs: the numbers of both are made dense for one sort.
        distinct, dense = np.unique(ids_pair, return_inverse=True)
        key, n = _summed([document[at] << _BITS | dense], [n])
        keys.append(np.stack([key >> _BITS, distinct[key & ((1 << _BITS) - 1)]]))
        links.append(n)
    for part, n in zip(keys, links, strict=True):
        bounds = np.searchsorted(part[0], np.arange(len(found) + 1))
        for i in np.unique(part[0]).tolist():
            found[i][0].pairs.append(part[1, bounds[i] : bounds[i + 1]])
            found[i][0].links.append(n[bounds[i] : bounds[i + 1]])

    start = group_start = 0
    for i, (aligned, first, second) in enumerate(found):
        aligned.write(written[start : written_ends[i]])
        aligned.counts += (
            len(first), len(second), group_ends[i] - group_start, n_links[i + 1] - n_links[i]
        )
        start, group_start = written_ends[i], group_ends[i]


def align_texts(texts: list[bytes | None], pair: Pair, keep_groups: bool = False) -> list[Aligned]:
    """What each text's tokens are to each other."""
    every, held, size = [], [], 0
    for text in texts:
        aligned = Aligned(keep_groups)
        every.append(aligned)
        for first, second in pair.encode(text):
            held.append((aligned, first, second))
            size += len(first) + len(second)
            if size >= TOKENS:
                _align(held, pair)
                held, size = [], 0
    _align(held, pair)
    return every


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_RESULTS = (*_COUNTS, "n_best", "count_sum", "groups_sha256", "groups")
_PARTS = [StructField(c, LongType()) for c in _COUNTS] + [
    StructField("groups_sha256", StringType()),
    StructField("__chunk", LongType()),
    StructField("__at", ArrayType(IntegerType())),
    StructField("__links", ArrayType(LongType())),
    StructField("__asked", ArrayType(LongType())),
    StructField("__holders", ArrayType(LongType())),
]


def _chunk_rows(chunk: int, kept: list[pa.RecordBatch], every: list[Aligned], keep_groups: bool):
    """A row per document, and the pairs of all of them in the row of the first."""
    own = [aligned.linked() for aligned in every]
    asked, holders = np.unique(np.concatenate([p for p, _ in own]), return_counts=True)
    lists = lambda parts, kind: pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum([len(p) for p in parts])), pa.int32()),
        pa.array(np.concatenate(parts), kind),
    )
    first = lambda values: pa.array([values] + [None] * (len(every) - 1), pa.list_(pa.int64()))
    counts = np.array([aligned.counts for aligned in every])
    columns = {c: pa.array(counts[:, i]) for i, c in enumerate(_COUNTS)}
    columns["groups_sha256"] = pa.array([a.digest.hexdigest() if a.counts[0] else "" for a in every])
    columns["__chunk"] = pa.array(np.full(len(every), chunk))
    columns["__at"] = lists([np.searchsorted(asked, p) for p, _ in own], pa.int32())
    columns["__links"] = lists([n for _, n in own], pa.int64())
    columns["__asked"], columns["__holders"] = first(asked), first(holders)
    if keep_groups:
        columns["groups"] = pa.array([b"".join(a.text).decode() for a in every])
    rest = pa.Table.from_batches(kept).combine_chunks()
    table = pa.table({**{c: rest.column(c) for c in rest.column_names}, **columns})
    yield from table.to_batches(max_chunksize=2000)


def align(
    docs: DataFrame, first_path: str | None = None, second_path: str | None = None,
    keep_groups: bool = False,
) -> DataFrame:
    """The documents, without their text, with what their two tokenizations are to each other.

    `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`; with `keep_groups`
    also `groups`, the written form of the alignment.
    """
    first_path, second_path = first_path or vocabulary(FIRST), second_path or vocabulary(SECOND)
    kept = [c for c in docs.columns if c != "text" and c not in _RESULTS]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("binary").alias(TEXT))
    fields = [source.schema[c] for c in kept] + _PARTS
    schema = nullable(StructType(fields + [StructField("groups", StringType())] * keep_groups))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        pair = _pair(first_path, second_path)
        chunk = TaskContext.get().partitionId() << 32
        rows, done, size = [], [], 0
        for batch in batches:
            texts, others = batch.column(TEXT), batch.select(kept)
            low = 0
            for high in _cuts(texts):
                part = texts.slice(low, high - low)
                done += align_texts(part.to_pylist(), pair, keep_groups)
                rows.append(others.slice(low, high - low))
                size += part.nbytes
                low = high
                if size >= CHUNK:
                    yield from _chunk_rows(chunk, rows, done, keep_groups)
                    chunk, rows, done, size = chunk + 1, [], [], 0
        if done:
            yield from _chunk_rows(chunk, rows, done, keep_groups)
        release_memory()

    rows = materialize(source.mapInArrow(aligned, schema), "alignment-documents")
    asked = rows.where("__asked IS NOT NULL").select(
        F.col("__chunk").alias("asking"),
        F.explode(F.arrays_zip(F.col("__asked").alias("pair"), F.col("__holders").alias("n"))).alias("x"),
    )
    asked = asked.select("asking", "x.pair", "x.n")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    of_first = Window.partitionBy(F.shiftright("pair", _BITS))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_first))
    answers = asked.drop("n").join(counts, "pair")

    wanted = [*kept, *_COUNTS, "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups
    kinds = {f.name: f for f in schema.fields} | {
        c: StructField(c, LongType()) for c in ("n_best", "count_sum")
    }

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(bool)
        at, links = (left.column(c).combine_chunks() for c in ("__at", "__links"))
        lengths = np.array([0, *(len(x) for x in at)])
        place, n = at.flatten().to_numpy(), links.flatten().to_numpy()
        bounds = np.cumsum(lengths)
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
        found = {"n_best": total(np.where(best[place], n, 0)), "count_sum": total(count[place] * n)}
        columns = {c: pa.array(found[c].astype(np.int64)) if c in found else left.column(c) for c in wanted}
        return pa.table(columns)

    out = nullable(StructType([kinds[c] for c in wanted]))
    documents = rows.drop("__asked", "__holders").groupBy("__chunk")
    return documents.cogroup(answers.groupBy("asking")).applyInArrow(answered, out)


def _cuts(texts: pa.Array) -> list[int]:
    """Ends of runs of texts of about a quarter of a chunk."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
    stretch = np.cumsum(sizes + 1) // (CHUNK // 4)
    return [*np.flatnonzero(np.diff(stretch)) + 1, len(texts)] if len(texts) else []
