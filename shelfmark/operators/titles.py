"""Books laid out for the explorer, and an index of the three-letter runs of their titles.

`laid_out` sorts the books by publisher and price and numbers them, so the statistics of Parquet
pages rule out most of them for a publisher, a price range or a range of numbers. `title_postings`
has a row per three-letter run ("gram") and chunk of 64 books: which of the 64 titles hold it, as the
bits of one whole number. A search ands the numbers of its grams, turns the chunks that are left into
a bounded list of ranges of book numbers, which reach the scan, and compares the titles read there as a
plain scan would. So the index only decides what is read, never what is found.

A posting's size does not depend on how many books hold the gram: a gram that a third of all titles
hold has one row per chunk, spread over tasks by (gram, chunk). Whole numbers are ored before the
shuffle. Only one block number per `blocks` of books at most comes to the driver.

Defined results: a null title is never found; a text of fewer than three letters has no gram and is
searched for by a scan, an empty text is in every title that is not null. Books and postings carry the
stamp of the layout they were made from; where the stamps differ, a search scans too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.analytics import PUBLISHER

GRAM = 3
CHUNK = 64  # books per posting: the bits of a whole number
PAGE = 1024  # books per Parquet page, which a range reads or skips as a whole
GRAMS = 8  # of a search: more than Parquet compares one by one would become a range of grams
BLOCKS = 1 << 16  # block numbers that a search may bring to the driver
RANGES = 256  # ranges in the filter that reaches the scan

ROW = "book_row"
LAYOUT = "layout"

# Writer options for `laid_out` rows: pages small enough to be skipped one by one.
PAGES = {"parquet.page.row.count.limit": str(PAGE)}


def laid_out(books: DataFrame) -> DataFrame:
    """`books` sorted by publisher and price, with a number `book_row` and the layout's stamp.

    Numbers rise along the files and have gaps between them. Write the result with `PAGES` before it
    is used: the numbers are those of the write.
    """
    order = [PUBLISHER, "price", "product_id"]
    return (
        books.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({ROW: F.monotonically_increasing_id(), LAYOUT: F.lit(uuid.uuid4().hex)})
    )


def _grams(title: Column) -> Column:
    """The runs of three letters; none for shorter titles and null ones."""
    last = F.length(title) - (GRAM - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), last))
    return F.transform(places, lambda i: F.substring(title, i, F.lit(GRAM)))


def title_postings(laid: DataFrame) -> DataFrame:
    """(gram, chunk, mask, layout) of written `laid_out` rows, each file sorted by gram and chunk.

    One shuffle, of the ored numbers; in every file a search skips the pages of other grams.
    """
    held = laid.select(
        F.explode(_grams(F.lower("name"))).alias("gram"),
        F.expr(f"{ROW} DIV {CHUNK}").alias("chunk"),
        F.expr(f"shiftleft(1L, int({ROW} % {CHUNK}))").alias("bit"),
    )
    stamp = laid.select(LAYOUT).first()
    masks = held.groupBy("gram", "chunk").agg(F.bit_or("bit").alias("mask"))
    return masks.sortWithinPartitions("gram", "chunk").withColumn(
        LAYOUT, F.lit(stamp[0] if stamp else None).cast("string")
    )


def search_grams(text: str) -> list[str]:
    """At most `GRAMS` of the distinct runs of the text, evenly spaced."""
    text = text.lower()
    found = list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))
    if len(found) <= GRAMS:
        return found
    return [found[i * (len(found) - 1) // (GRAMS - 1)] for i in range(GRAMS)]


def merged_ranges(blocks: list[int], width: int, most: int) -> list[tuple[int, int]]:
    """First and last number of runs of sorted blocks; the smallest gaps are closed down to `most` runs."""
    gaps = [(b - a, i) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False)) if b - a > 1]
    cuts = sorted(i for _, i in sorted(gaps, reverse=True)[: most - 1])
    starts = [blocks[0], *(blocks[i + 1] for i in cuts)]
    ends = [*(blocks[i] for i in cuts), blocks[-1]]
    return [(a * width, (b + 1) * width - 1) for a, b in zip(starts, ends, strict=True)]


def candidate_ranges(laid: DataFrame, postings: DataFrame, text: str) -> list[tuple[int, int]] | None:
    """Ranges of book numbers outside which no title holds the text; None where the index cannot say."""
    grams = search_grams(text)
    if not grams:
        return None
    stamp = laid.select(LAYOUT).first()
    other = postings.select(LAYOUT).first()
    if stamp is None or other is None or stamp[0] != other[0]:
        return None
    chunks = (
        postings.where(F.col("gram").isin(grams))
        .groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("grams"), F.bit_and("mask").alias("mask"))
        .where((F.col("grams") == len(grams)) & (F.col("mask") != 0))
    )
    # Blocks get wider with the number of books, so their number is bounded by files and `BLOCKS`.
    books, width = laid.count(), PAGE
    while books > width * BLOCKS:
        width *= 2
    block = F.expr(f"chunk DIV {width // CHUNK}").alias("block")
    blocks = sorted(r["block"] for r in chunks.select(block).distinct().collect())
    return merged_ranges(blocks, width, RANGES) if blocks else []


def _either(conditions: list[Column]) -> Column:
    """Any of the conditions, as a balanced tree."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _either(conditions[:half]) | _either(conditions[half:])


def with_title(laid: DataFrame, postings: DataFrame, text: str) -> DataFrame:
    """The books whose lower-cased title holds the lower-cased text, in their own columns.

    Same rows as the title filter of `explore_books`, whose other filters may follow: they reach the
    same scan.
    """
    holds = F.contains(F.lower("name"), F.lit(text.lower()))
    found = laid.where(holds)
    ranges = candidate_ranges(laid, postings, text)
    if ranges is not None:
        within = [F.col(ROW).between(a, b) for a, b in ranges]
        found = found.where(_either(within) if within else F.lit(False))
    return found.drop(ROW, LAYOUT)
