"""Repeated lines, dropped everywhere but in one document.

Lines are reduced to 128-bit hashes and range-partitioned by (hash, document); a secondary sort puts
the greatest document of a hash first. Each task streams its rows and never holds more than the
first few documents of one hash, so a line that a third of all documents hold is cut into as many
ranges as its rows need. Only the first and the last hash of a range can reach into a neighbour;
their counts (two rows a range) are added up and decide the rows that were left open. What comes
out is a compressed bitmap per document, never text.

Defined results: a null or empty text is one empty line; a null `doc_id` is one document, below all
others; rows equal in `doc_id` and text are one document and get the same bitmap; rows with the same
`doc_id` and other text count as the same document but have bitmaps of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, SPACE, TEXT, document_key, nullable, release_memory
from shelfmark.sources.tables import materialize

MIN_LENGTH = 40  # code points of a key
MIN_DOCUMENTS = 5

BITMAP = "__bitmap"

_LINE = "hi long, lo long, doc long, key long, at int"
_OUT = "kind int, hi long, lo long, doc long, key long, at int, n long"
_DROP, _OPEN, _RUN = 0, 1, 2


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: stripped of ASCII white space, A-Z in lower case."""
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]


def lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per line whose key is long enough: its hash, document and position."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            doc, key = batch.column("doc"), batch.column("key")
            row, at, digest = [], [], []
            for i, text in enumerate(batch.column("text")):
                for j, line in enumerate(line_keys(text.as_py() or b"")):
                    if len(line) >= min_length and len(line.decode("utf-8", "replace")) >= min_length:
                        row.append(i)
                        at.append(j)
                        digest.append(xxhash.xxh3_128_digest(line))
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both[:, 0]),
                    pa.array(both[:, 1]),
                    doc.take(pa.array(row, pa.int64())),
                    key.take(pa.array(row, pa.int64())),
                    pa.array(at, pa.int32()),
                ],
                ["hi", "lo", "doc", "key", "at"],
            )

    columns = document_key(docs).select(
        F.col("doc_id").cast("long").alias("doc"),
        F.col(KEY).alias("key"),
        F.col("text").cast("binary").alias("text"),
    )
    return columns.mapInArrow(hashed, _LINE)


def _stream(min_documents: int):
    """Decide the rows of one sorted range; see the module's text for the edges."""

    def run_of(batches):
        """(hash, doc, key, at) columns, batch by batch, as numpy; null documents as their own."""
        for batch in batches:
            doc = batch.column("doc")
            yield (
                batch.column("hi").to_numpy(),
                batch.column("lo").to_numpy(),
                doc.fill_null(0).to_numpy(),
                doc.is_null().to_numpy(zero_copy_only=False),
                batch.column("key").to_numpy(),
                batch.column("at").to_numpy(),
            )

    def rows(kind, part, n=None):
        hi, lo, doc, null, key, at = part
        size = len(hi)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, kind, np.int32)),
                pa.array(hi),
                pa.array(lo),
                pa.array(doc, mask=null),
                pa.array(key),
                pa.array(at),
                pa.array(np.zeros(size, np.int64) if n is None else n),
            ],
            ["kind", "hi", "lo", "doc", "key", "at", "n"],
        )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        state = None  # the run that is being read
        first = True

        def record(run):
            hash_, doc, null = run["hash"], run["head"][0], run["head"][1]
            return rows(
                _RUN,
                tuple(
                    np.array([x], t)
                    for x, t in zip(
                        (*hash_, doc, null, 0, 0),
                        (np.int64, np.int64, np.int64, bool, np.int64, np.int32),
                        strict=True,
                    )
                ),
                np.array([run["n"]], np.int64),
            )

        def finish(run, edge):
            """Rows still held when a run ends; few, or the run was decided before."""
            held = [tuple(np.concatenate(x) for x in zip(*run["held"], strict=True))] if run["held"] else []
            if run["open"] or edge:
                yield from (rows(_OPEN, x) for x in held)
                yield record(run)

        for hi, lo, doc, null, key, at in run_of(batches):
            size = len(hi)
            if not size:
                continue
            new_run = np.ones(size, bool)
            new_run[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
            starts = np.flatnonzero(new_run)
            ends = np.append(starts[1:], size)
            documents = np.add.reduceat(new_doc, starts)
            last = len(starts) - 1
            # Runs inside this batch with too few documents need no further look.
            look = documents >= min_documents
            look[[0, last]] = True
            for r in np.flatnonzero(look):
                a, b = starts[r], ends[r]
                part = tuple(x[a:b] for x in (hi, lo, doc, null, key, at))
                hash_ = (hi[a], lo[a])
                fresh = state is None or state["hash"] != hash_
                if fresh and state is not None:
                    yield from finish(state, edge=False)
                if fresh:
                    state = {
                        "hash": hash_, "head": (doc[a], null[a]), "last": (doc[a], null[a]),
                        "n": int(documents[r]), "held": [], "open": first,
                    }
                    first = False
                else:
                    same = state["last"] == (doc[a], null[a])
                    state["n"] += int(documents[r]) - int(same)
                state["last"] = (doc[b - 1], null[b - 1])
                if state["open"]:
                    yield rows(_OPEN, part)
                    continue
                keep = (part[2] == state["head"][0]) & (part[3] == state["head"][1])
                state["held"].append(tuple(x[~keep] for x in part))
                if state["n"] >= min_documents:
                    for x in state["held"]:
                        yield rows(_DROP, x)
                    state["held"] = []
        if state is not None:
            yield from finish(state, edge=True)

    return decide


def drop_positions(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(doc, key, at) of every line to drop."""
    ranges = (
        lines(docs, min_length)
        .repartitionByRange("hi", "lo", F.desc_nulls_last("doc"))
        .sortWithinPartitions("hi", "lo", F.desc_nulls_last("doc"), "key", "at")
    )
    decided = materialize(ranges.mapInArrow(_stream(min_documents), _OUT), "line-decisions")
    # At most two rows per range: the hashes that begin or end one.
    edges = (
        decided.where(F.col("kind") == _RUN)
        .groupBy("hi", "lo")
        .agg(F.sum("n").alias("total"), F.max("doc").alias("keeper"))
        .where(F.col("total") >= min_documents)
    )
    late = (
        decided.where(F.col("kind") == _OPEN)
        .join(F.broadcast(edges), ["hi", "lo"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
    )
    return (
        decided.where(F.col("kind") == _DROP)
        .select("doc", "key", "at")
        .unionByName(late.select("doc", "key", "at"))
    )


def pack(dropped: list[int]) -> bytes:
    """A keep bitmap up to the last dropped line, compressed; all lines behind it stay."""
    bits = np.ones((max(dropped) // 8 + 1) * 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """One boolean a line: whether it stays."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """`doc`, `key`, `bitmap` for the documents that lose lines; `document_key` gives the key."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            maps = pa.array([pack(x) for x in batch.column("ats").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("key"), maps], ["doc", "key", "bitmap"]
            )

    positions = drop_positions(docs, min_length, min_documents)
    grouped = positions.groupBy("doc", "key").agg(F.collect_set("at").alias("ats"))
    return grouped.mapInArrow(packed, "doc long, key long, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents, `bitmap` joined to each (null: every line stays)."""
    keyed = document_key(docs)
    on = keyed["doc_id"].cast("long").eqNullSafe(bitmaps["doc"]) & (keyed[KEY] == bitmaps["key"])
    return keyed.join(bitmaps, on, "left").select(
        *(keyed[c] for c in docs.columns), bitmaps["bitmap"].alias(BITMAP)
    )


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Number of lines, lines dropped, and the rest joined by line feeds."""
    parts = text.split(b"\n")
    if bitmap is None:
        return len(parts), 0, text
    keep = unpack(bitmap, len(parts))
    return len(parts), int((~keep).sum()), b"\n".join(x for x, k in zip(parts, keep, strict=True) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with the dropped lines gone from `text`, and `n_lines`, `n_dropped` added.

    A null text stays null.
    """

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            found = [
                kept_text(text.as_py() or b"", bitmap.as_py())
                for text, bitmap in zip(batch.column(TEXT), batch.column(BITMAP), strict=True)
            ]
            n_lines, n_dropped, texts = zip(*found, strict=True) if found else ((), (), ())
            texts = pa.array(texts, pa.binary(), mask=batch.column(TEXT).is_null().to_numpy(False))
            rest = [c for c in batch.schema.names if c not in (TEXT, BITMAP)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in rest),
                    texts,
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64()),
                ],
                [*rest, TEXT, "n_lines", "n_dropped"],
            )

    taken = {"text", "n_lines", "n_dropped", TEXT, BITMAP}
    rest = [c for c in docs.columns if c not in taken]
    joined = with_bitmaps(docs, bitmaps).select(
        *rest, F.col("text").cast("binary").alias(TEXT), BITMAP
    )
    schema = nullable(docs.select(*rest).schema).add(TEXT, "binary").add("n_lines", "long")
    done = joined.mapInArrow(rebuilt, schema.add("n_dropped", "long"))
    return done.select(*rest, F.col(TEXT).cast("string").alias("text"), "n_lines", "n_dropped")


def drop_repeated_lines(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """Documents without repeated lines: all columns, `text` rebuilt, `n_lines`, `n_dropped`."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_length, min_documents))


def clean(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """The documents in their own columns, without repeated lines; `n_chars` follows the text."""
    kept = drop_repeated_lines(docs, min_length, min_documents)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.length("text").cast(kind))
    return kept.select(*docs.columns)
