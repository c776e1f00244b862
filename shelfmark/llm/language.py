"""Language of a text by rank-order profiles of its most frequent character n-grams.

A language's profile is the order of its `PROFILE` most frequent n-grams (one to three letters,
within words, with a mark at word ends) over all its training texts. A document's own order is
compared to each profile by how far every n-gram is out of place; an n-gram that the profile does
not hold counts as `PROFILE` places. The nearest profile wins.

Counting is pre-aggregated per Arrow batch and summed by Spark; a profile is bounded by `PROFILE`
rows per language, so what workers receive does not grow with the corpus.

`keep_known` also asks whether the nearest profile is near enough. A text's score depends on how many
n-grams it has, so every labelled text is compared whole and by its beginnings of `HEADS` bytes, and a
language's floor for texts with 2^c to 2^(c+1) distinct n-grams is `MARGIN` of the score that all but
`LOWEST` of these reach. All labelled rows set the floors, and every document is held to them. Scores are
counted in steps of 1 / `STEPS`, so a floor comes from no more rows than there are steps.

Defined results: a null text, one without a letter, or any text while no language was learned is
`und` with score 0; equal distances go to the language that is first in code-point order; n-grams
of equal count are ordered by their letters. Rows are independent, so repeated rows agree; extra
columns stay, except `lang_pred` and `score`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import release_memory, stretches

PROFILE = 400
UNKNOWN = "und"
# Two workers share an executor with its JVM: together these keep one below 100 MB over its imports.
STRETCH = 1 << 18  # bytes of text whose n-grams are held at once
HELD = 4 << 20  # bytes of text that are counted before the counts are sent on
ROWS = 100  # texts that are compared at once

HEADS = (16, 64, 256, 1024, 4096)
LOWEST = 0.01
MARGIN = 0.7
STEPS = 10_000

_CODE = 21  # bits of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for anything else."""
    table = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: bytes) -> np.ndarray:
    """All n-grams of a text, as integers of three code points; 0 marks a word's end."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    x = np.zeros(len(points) + 2, np.uint64)
    x[1:-1] = _letters()[points]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    x = x[keep]
    two, one = np.uint64(2 * _CODE), np.uint64(_CODE)
    pairs = x[:-1] << one | x[1:]
    triples = (x[:-2] << two | x[1:-1] << one | x[2:])[x[1:-1] != 0]
    # Lengths never meet: pairs carry the top bit, triples a letter above the lowest place.
    return np.concatenate([x[x != 0], pairs | np.uint64(1 << 63), triples])


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and their counts; memory follows `STRETCH`, not the texts."""
    values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size = [], 0

    def merged():
        new, n = np.unique(np.concatenate(held), return_counts=True)
        if not len(values):
            return new, n
        both, at = np.unique(np.concatenate([values, new]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

    for text in texts:
        for part in stretches(text, STRETCH):
            held.append(grams(part))
            size += len(held[-1])
            if size >= 3 * STRETCH:
                values, counts = merged()
                held, size = [], 0
    if held:
        values, counts = merged()
    return values, counts


def _ordered(text: bytes, most: int) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first."""
    values, counts = gram_counts([text])
    return values[np.argsort(-counts, kind="stable")[:most]]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    def rows(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            values, counts = gram_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    texts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", F.col("text").cast("binary").alias("text")
    )
    found = texts.mapInArrow(counted, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its n-grams, most frequent first; at most `profile` rows per language."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = count_grams(docs).withColumn("place", place).where(F.col("place") <= profile)
    found: dict[str, list] = {}
    for lang, gram in rows.orderBy("lang", "place").select("lang", "gram").collect():
        found.setdefault(lang, []).append(gram)
    return {lang: np.array(x, np.int64).view(np.uint64) for lang, x in sorted(found.items())}


def _nearest(texts: list[bytes | None], profiles: dict[str, np.ndarray], size: int):
    """Language and score of every text."""
    return _compared(texts, profiles, size)[:2]


def _compared(texts: list[bytes | None], profiles: dict[str, np.ndarray], size: int):
    """Language, score and number of n-grams of every text."""
    own = [_ordered(t, size) if t else np.zeros(0, np.uint64) for t in texts]
    lengths = np.array([len(x) for x in own])
    languages = list(profiles)
    names = np.full(len(texts), UNKNOWN, object)
    scores = np.zeros(len(texts))
    if not languages or not lengths.any():
        return names, scores, lengths
    flat = np.concatenate(own)
    places = np.concatenate([np.arange(n) for n in lengths])
    full = np.flatnonzero(lengths)
    starts = np.append(0, np.cumsum(lengths)[:-1])[full]
    away = np.empty((len(languages), len(full)))
    for i, lang in enumerate(languages):
        order = np.argsort(profiles[lang])
        known = profiles[lang][order]
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        out = np.where(known[at] == flat, np.abs(order[at] - places), size)
        away[i] = np.add.reduceat(np.minimum(out, size), starts)
    best = away.argmin(axis=0)
    names[full] = np.array(languages, object)[best]
    scores[full] = 1 - away[best, np.arange(len(full))] / (lengths[full] * size)
    return names, scores, lengths


def language_of(text: Column, profiles: dict[str, np.ndarray], size: int = PROFILE) -> Column:
    """A struct of `lang_pred` and `score` for a string column."""

    @F.pandas_udf("lang_pred string, score double")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_memory()
        for part in parts:
            found = [
                _nearest(list(part.iloc[i : i + ROWS]), profiles, size)
                for i in range(0, len(part), ROWS)
            ]
            names, scores = zip(*found, strict=True) if found else ([[]], [[]])
            yield pd.DataFrame(
                {"lang_pred": np.concatenate(names), "score": np.concatenate(scores)}
            )

    # Not to be evaluated again by every filter that looks at the result.
    return nearest.asNondeterministic()(text.cast("binary"))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """The documents with `lang_pred` and `score`."""
    found = docs.withColumn("__found", language_of(F.col("text"), profiles, size))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*kept, "__found.lang_pred", "__found.score")


def _class(n_grams: np.ndarray) -> np.ndarray:
    """The power of two in a number of n-grams."""
    return np.frexp(np.maximum(n_grams, 1))[1] - 1


def score_floors(
    docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE
) -> dict[str, np.ndarray]:
    """Language to the least score of its texts, by `_class`; see the module's text."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, len(texts), ROWS):
                whole = [t.as_py() for t in texts[i : i + ROWS]]
                parts = [t[:n] for t in whole for n in (*(n for n in HEADS if n < len(t)), len(t)) if t]
                names, scores, n_grams = _compared(parts, profiles, size)
                steps = np.rint(scores * STEPS).astype(np.int32)
                columns = [pa.array(names, pa.string()), pa.array(_class(n_grams), pa.int32()), pa.array(steps)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "class", "step"])

    parts = labelled.select(F.col("text").cast("binary").alias("text"))
    found = parts.mapInArrow(compared, "lang string, class int, step int").where(F.col("lang") != UNKNOWN)
    # Counted by tasks before anything is exchanged: a class has at most `STEPS` + 1 rows here.
    counts = found.groupBy("lang", "class", "step").agg(F.count(F.lit(1)).alias("n"))
    low = F.percentile("step", F.lit(LOWEST), F.col("n")) / STEPS
    rows = counts.groupBy("lang", "class").agg(low.alias("low")).collect()
    floors = {}
    for lang in profiles:
        low = {r["class"]: MARGIN * r["low"] for r in rows if r["lang"] == lang}
        # Where no labelled text has so many n-grams, the lowest floor of the language.
        other = min(low.values(), default=0.0)
        floors[lang] = np.array([low.get(c, other) for c in range(int(_class(np.array(size))) + 1)])
    return floors


def keep_known(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """The documents whose language is one of those in `lang`, learned from these documents.

    Texts without a letter go, and so do texts that have no n-gram of their nearest language or
    score below its floor: other languages and noise. Where no row has a language, there is nothing
    to tell languages by, and all texts with a letter stay.
    """
    profiles = learn(docs, size)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    floors = score_floors(docs, profiles, size)

    def near(texts: list[bytes | None]) -> np.ndarray:
        names, scores, n_grams = _compared(texts, profiles, size)
        least = [floors[x][c] if x in floors else 1.0 for x, c in zip(names, _class(n_grams), strict=True)]
        return (names != UNKNOWN) & (scores > 0) & (scores >= np.array(least))

    @F.pandas_udf("boolean")
    def known(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_memory()
        for part in parts:
            found = [near(list(part.iloc[i : i + ROWS])) for i in range(0, len(part), ROWS)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0, bool))

    marked = docs.withColumn("__known", known.asNondeterministic()(F.col("text").cast("binary")))
    return marked.where("__known").drop("__known")
