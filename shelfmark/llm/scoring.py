"""Language-model scores from a log-frequency Bloom filter.

Training counts tokens and token pairs over all training texts. A count c is quantised to the level
q = 1 + floor(log_b c), and an n-gram enters the filter once per level up to q; a reader probes level
after level until one is missing and takes the middle of that level's counts. Filters have one-sided
errors, so a count may be read too high, never too low; a pair's count is cut to its history's.

The score interpolates: P(w | v) = L * c(v w) / c(v) + (1 - L) * (c(w) + 1) / (N + V + 1), where
1 - L is the share of training pairs that occurred once, which estimates how often a pair is new.

N-grams are pre-aggregated in tasks and travel as sorted arrays, one per segment of the hash range;
each segment's part of the filter is built where its counts meet, with `BITS` bits a key at every size,
so the rate of counts that are read too high does not depend on the corpus. A filter of up to
`MAX_BYTES` goes to the workers whole. A larger one stays where it is, a row per segment: documents
are dealt into chunks by a hash, the distinct n-grams of a chunk travel to their segments as sorted
arrays, and the levels read there travel back to the chunk. Both ways read the same bits and give the
same scores. Tokens are known by 64-bit hashes.

The base score is exact. The most frequent tokens, at most `HOT`, go to the workers with their
counts; the occurrences of all others are joined to the table of counts, so no hot token is ever
shuffled row by row.

Defined results: null and empty texts are one end token; without training texts every probability
is 1; repeated rows are scored alike and counted each; a null `doc_id` belongs to no held-out fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WordHashes, mixed_bits, release_memory
from shelfmark.sources.tables import materialize

BASE = 1.5  # of the logarithm that quantises counts
BITS = 10  # of the filter per key
PROBES = 4
MAX_BYTES = 256 << 20  # of a filter that workers receive whole
HOT = 1 << 20
TOGETHER = 1 << 17  # tokens that are scored at once
CHUNK = 4 << 20  # bytes of text whose n-grams are sent to the segments together
BUFFER = 1 << 19  # tokens that a task gathers before it sends them on

END = xxhash.xxh3_64_intdigest(b"\n")  # no word is a line feed

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = np.power(BASE, np.arange(120))


def _tokens(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Hashes of a text's words, and one end."""
    return np.append(known.of(text), np.uint64(END))


def _pairs(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed_bits(history * _GOLD + mixed_bits(word))


def _histories(tokens: np.ndarray) -> np.ndarray:
    """Each token's predecessor; the end stands before the first."""
    before = np.empty_like(tokens)
    before[0], before[1:] = END, tokens[:-1]
    return before


def _level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and so on; the greatest q with BASE^(q-1) <= count."""
    return np.searchsorted(_LEVELS, counts, side="right")


def _middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for level 0."""
    low = np.ceil(_LEVELS[np.maximum(levels, 1) - 1])
    high = np.maximum(low, np.ceil(_LEVELS[np.maximum(levels, 1)]) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _positions(keys: np.ndarray, level: np.ndarray | int, bits: np.ndarray):
    """The bits of (key, level) inside its segment, one probe after the other."""
    a = mixed_bits(keys + np.asarray(level, np.uint64) * _GOLD)
    step = mixed_bits(a) | np.uint64(1)
    for _ in range(PROBES):
        yield a % bits
        a = a + step


@dataclass(frozen=True)
class Model:
    """What workers receive: bounded by MAX_BYTES for the filter and HOT tokens."""

    bits: np.ndarray  # uint8, all segments one behind the other; none where it stays in segments
    starts: np.ndarray  # first bit of each segment
    sizes: np.ndarray  # its bits
    hot: np.ndarray  # hashes in order, and their exact counts
    hot_counts: np.ndarray
    tokens: int  # N
    types: int  # V
    seen: float  # L

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts by probing one level after the other."""
        if not len(self.bits):
            return np.zeros(len(keys))
        segment = (keys >> np.uint64(64 - int(math.log2(len(self.sizes))))).astype(np.int64)
        return _middle(_read(self.bits, keys, self.sizes[segment], self.starts[segment]))


def _read(bits: np.ndarray, keys: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The level of every key in the filter part of `size` bits that begins at bit `start`."""
    levels = np.zeros(len(keys), np.int64)
    left, level = np.flatnonzero(size), 0
    while len(left):
        level += 1
        left = left[_holds(bits, keys[left], level, size[left], start[left])]
        levels[left] = level
    return levels


def _holds(bits: np.ndarray, keys: np.ndarray, level: int, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether every probed bit of (key, level) is set."""
    holds = np.ones(len(keys), bool)
    for at in _positions(keys, level, size):
        at = at + start
        byte = bits[(at >> np.uint64(3)).astype(np.int64)]
        holds &= (byte >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return holds


def _by_segment(keys: np.ndarray, segments: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, end) of each segment's run in sorted keys."""
    shift = np.uint64(64 - int(math.log2(segments)))
    ends = np.searchsorted(keys >> shift, np.arange(segments, dtype=np.uint64), side="right")
    start = 0
    for segment, end in enumerate(ends):
        if end > start:
            yield segment, start, end
        start = end


def _segments(docs: DataFrame) -> int:
    """A power of two: about 8 MB of text a segment, and tasks still send arrays, not single keys."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(12, max(4, math.ceil(math.log2(max(1, size / (8 << 20))))))


def _count(train: DataFrame, segments: int) -> DataFrame:
    """(segment, pair, keys, counts): sorted keys and their counts in this part of the corpus."""

    def parts(tokens: list[np.ndarray]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        histories = [_histories(t) for t in tokens]
        words = np.concatenate(tokens)
        for pair, keys in ((False, words), (True, _pairs(np.concatenate(histories), words))):
            keys, counts = np.unique(keys, return_counts=True)
            for segment, start, end in _by_segment(keys, segments):
                yield segment, pair, keys[start:end], counts[start:end].astype(np.uint32)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHashes(), [], 0

        def sent():
            rows = list(parts(held))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.bool_()),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                    pa.array([r[3].tobytes() for r in rows], pa.binary()),
                ],
                ["segment", "pair", "keys", "counts"],
            )

        for batch in batches:
            for text in batch.column("text"):
                held.append(_tokens(text.as_py(), known))
                size += len(held[-1])
                if size >= BUFFER:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()
        # The worker lives on; what it holds would stand beside the filter of the next stages.
        known.clear()
        held.clear()
        release_memory()

    texts = train.select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(counted, "segment int, pair boolean, keys binary, counts binary")


_BUILT = (
    "segment int, bits binary, size long, words array<long>, word_counts array<long>,"
    " tokens long, types long, pairs long, once long"
)


def _build(counts: DataFrame) -> DataFrame:
    """One row per segment: its part of the filter, its exact word counts, its totals."""

    def built(key, table):
        release_memory()

        def gather(pair: bool):
            rows = [i for i, p in enumerate(table.column("pair").to_pylist()) if p == pair]
            keys = [np.frombuffer(table.column("keys")[i].as_py(), np.uint64) for i in rows]
            n = [np.frombuffer(table.column("counts")[i].as_py(), np.uint32) for i in rows]
            if not rows:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return _sum_by(np.concatenate(keys), np.concatenate(n).astype(np.int64))

        words, word_counts = gather(False)
        pairs, pair_counts = gather(True)
        keys = np.concatenate([words, pairs])
        levels = _level(np.concatenate([word_counts, pair_counts]))
        size = BITS * int(levels.sum()) + 7 & ~7
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            inside = keys[levels >= level]
            for at in _positions(inside, level, np.uint64(size)):
                bits[at.astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        row = {
            "segment": key[0].as_py(), "bits": packed, "size": size,
            "words": words.view(np.int64), "word_counts": word_counts,
            "tokens": int(word_counts.sum()), "types": len(words),
            "pairs": int(pair_counts.sum()), "once": int((pair_counts == 1).sum()),
        }
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        kinds += [pa.int64()] * 4
        return pa.table({c: pa.array([v], t) for (c, v), t in zip(row.items(), kinds, strict=True)})

    return counts.groupBy("segment").applyInArrow(built, _BUILT)


@dataclass(frozen=True)
class Trained:
    """A model on its way to the workers, and the exact counts of all tokens as (token, count).

    `parts` has a filter that is too large for the workers: (segment, bits, size), else None.
    """

    shared: Broadcast[Model]
    counts: DataFrame
    tokens: int
    types: int
    segments: int
    parts: DataFrame | None


def train(docs: DataFrame, max_bytes: int = MAX_BYTES, hot: int = HOT) -> Trained:
    """The model of all `docs` (text); its filter goes to the workers up to `max_bytes`."""
    segments = _segments(docs)
    built = materialize(_build(_count(docs, segments)), "lm-segments")
    total = built.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "pairs", "once"))
    ).first()
    both = F.explode(F.arrays_zip("words", "word_counts")).alias("w")
    counts = built.select(both).select(
        F.col("w.words").alias("token"), F.col("w.word_counts").alias("count")
    )
    # The least count whose tokens are few enough, from how many tokens have which binary size.
    by_size = counts.groupBy(F.floor(F.log2("count")).alias("size")).count().collect()
    least, room = 0, hot
    for size, n in sorted(((r[0], r[1]) for r in by_size), reverse=True):
        if n > room:
            least = 1 << (size + 1)
            break
        room -= n
    frequent = counts.where(F.col("count") >= least).toArrow()
    token = frequent.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    # A segment without keys has no bits. The parts come one task's share at a time.
    known = dict(built.select("segment", "size").collect())
    sizes = np.array([known.get(i, 0) for i in range(segments)], np.uint64)
    starts = np.append(0, np.cumsum(sizes)[:-1]).astype(np.uint64)
    whole = int(sizes.sum()) // 8 <= max_bytes
    bits = np.zeros(int(sizes.sum()) // 8 if whole else 0, np.uint8)
    if whole:
        for segment, part in built.select("segment", "bits").toLocalIterator():
            first = int(starts[segment]) // 8
            bits[first : first + len(part)] = np.frombuffer(part, np.uint8)
    model = Model(
        bits=bits,
        starts=starts,
        sizes=sizes,
        hot=token[order],
        hot_counts=frequent.column("count").to_numpy()[order],
        tokens=total["tokens"],
        types=total["types"],
        seen=1 - total["once"] / total["pairs"] if total["pairs"] else 0.0,
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = None if whole else built.select("segment", "bits", "size")
    return Trained(shared, counts, model.tokens, model.types, segments, parts)


def _scores(model: Model, tokens: list[np.ndarray], counts: Callable[[np.ndarray], np.ndarray]):
    """Per text: number of tokens, known hot tokens, their base score, the score; rare tokens.

    `counts` gives the quantised counts of n-grams.
    """
    lengths = np.array([len(t) for t in tokens])
    starts = np.append(0, np.cumsum(lengths)[:-1])
    flat = np.concatenate(tokens)
    before = np.concatenate([_histories(t) for t in tokens])
    words, at = np.unique(flat, return_inverse=True)
    space = model.tokens + model.types + 1

    rank = np.minimum(np.searchsorted(model.hot, words), max(0, len(model.hot) - 1))
    found = model.hot[rank] == words if len(model.hot) else np.zeros(len(words), bool)
    exact = np.where(found, model.hot_counts[rank] if len(model.hot) else 0, 0)
    is_hot = found[at]
    base = np.where(is_hot, np.log10((exact + 1) / space)[at], 0.0)

    rough = counts(words)
    pairs, pair_at = np.unique(_pairs(before, flat), return_inverse=True)
    together = counts(pairs)[pair_at]
    # Every history is a token of the same batch: the end is one of each text.
    history = rough[np.searchsorted(words, before)]
    single = ((rough + 1) / (model.tokens + model.types + 1))[at]
    share = np.minimum(together, history) / np.maximum(history, 1)
    chance = np.where(history > 0, model.seen * share + (1 - model.seen) * np.minimum(single, 1), np.minimum(single, 1))
    return (
        lengths,
        np.add.reduceat(is_hot.astype(np.int64), starts),
        np.add.reduceat(base, starts),
        np.add.reduceat(np.log10(chance), starts),
        np.add.reduceat((~is_hot).astype(np.int64), starts),
        flat[~is_hot],
    )


_NAMES = ["doc_id", "n_tokens", "n_hot", "hot_score", "score", "rare"]
_SCORED = "doc_id long, n_tokens long, n_hot long, hot_score double, score double, rare array<long>"


def _scored_rows(doc_id: pa.Array, scores: tuple) -> list[pa.Array]:
    """The columns of `_SCORED` from what `_scores` gives."""
    lengths, hot, base, total, n_rare, rare = scores
    offsets = pa.array(np.append(0, np.cumsum(n_rare)).astype(np.int32))
    rare = pa.ListArray.from_arrays(offsets, pa.array(rare.view(np.int64)))
    return [doc_id, pa.array(lengths), pa.array(hot), pa.array(base), pa.array(total), rare]


def _score_whole(texts: DataFrame, shared: Broadcast[Model]) -> DataFrame:
    """`_SCORED` for (doc_id, text) where the workers have the whole filter."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        known = WordHashes()
        for batch in batches:
            first, tokens, size = 0, [], 0
            for i, text in enumerate(batch.column("text")):
                tokens.append(_tokens(text.as_py(), known))
                size += len(tokens[-1])
                if size >= TOGETHER or i == batch.num_rows - 1:
                    yield rows(batch.slice(first, len(tokens)), tokens)
                    first, tokens, size = i + 1, [], 0

    def rows(batch: pa.RecordBatch, tokens: list[np.ndarray]) -> pa.RecordBatch:
        model = shared.value
        columns = _scored_rows(batch.column("doc_id"), _scores(model, tokens, model.counts))
        return pa.RecordBatch.from_arrays(columns, _NAMES)

    return texts.mapInArrow(scored, _SCORED)


def _ngrams(tokens: list[np.ndarray]) -> np.ndarray:
    """The distinct tokens and pairs of the texts, sorted."""
    words = np.concatenate(tokens)
    pairs = _pairs(np.concatenate([_histories(t) for t in tokens]), words)
    return np.unique(np.concatenate([words, pairs]))


def _score_parts(texts: DataFrame, trained: Trained) -> DataFrame:
    """`_SCORED` for (doc_id, text) where the filter stays in its segments."""
    shared, segments = trained.shared, trained.segments
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(size / CHUNK))))
    chunks = texts.withColumn("chunk", chunk)

    def tokens_of(table: pa.Table) -> list[np.ndarray]:
        known = WordHashes()
        return [_tokens(text.as_py(), known) for text in table.column("text")]

    def asked(key, table):
        keys = _ngrams(tokens_of(table))
        rows = [(s, keys[a:b].tobytes()) for s, a, b in _by_segment(keys, segments)]
        columns = [
            pa.array([key[0].as_py()] * len(rows), pa.int64()),
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, ["chunk", "segment", "keys"])

    def answered(questions: pa.Table, part: pa.Table) -> pa.Table:
        bits = np.frombuffer(part.column("bits")[0].as_py() if part.num_rows else b"", np.uint8)
        n_bits = np.uint64(8 * len(bits))
        levels = []
        for keys in questions.column("keys"):
            keys = np.frombuffer(keys.as_py(), np.uint64)
            found = _read(bits, keys, np.full(len(keys), n_bits), np.zeros(len(keys), np.uint64))
            levels.append(found.astype(np.uint8).tobytes())
        columns = [
            questions.column("chunk"), questions.column("segment"), pa.array(levels, pa.binary())
        ]
        return pa.Table.from_arrays(columns, ["chunk", "segment", "levels"])

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = tokens_of(table)
        keys = _ngrams(tokens)
        # Segments are runs of the sorted keys, so their answers in order are those of all keys.
        parts = answers.sort_by("segment").column("levels").to_pylist()
        counts = _middle(np.frombuffer(b"".join(parts), np.uint8).astype(np.int64))
        scores = _scores(shared.value, tokens, lambda x: counts[np.searchsorted(keys, x)])
        doc_id = table.column("doc_id").combine_chunks()
        return pa.Table.from_arrays(_scored_rows(doc_id, scores), _NAMES)

    questions = chunks.groupBy("chunk").applyInArrow(asked, "chunk long, segment int, keys binary")
    answers = (
        questions.groupBy("segment")
        .cogroup(trained.parts.groupBy("segment"))
        .applyInArrow(answered, "chunk long, segment int, levels binary")
    )
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, _SCORED)


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """`doc_id`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` for each document."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )
    if trained.parts is None:
        found = _score_whole(texts, trained.shared)
    else:
        found = _score_parts(texts, trained)
    # A row's number is written with it, once.
    first = materialize(found.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    space = F.lit(float(trained.tokens + trained.types + 1))
    # Tokens that training never saw find no count.
    rare = (
        first.select("row", F.explode("rare").alias("token"))
        .join(trained.counts, "token", "left")
        .groupBy("row")
        .agg(
            F.count("count").alias("n_rare"),
            F.sum(F.log10((F.coalesce("count", F.lit(0)) + 1) / space)).alias("rare_score"),
        )
    )
    return first.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
