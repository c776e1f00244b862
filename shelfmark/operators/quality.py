"""Data-quality rules. Each returns the violating rows; no rows means the rule holds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import models
from shelfmark.sources.tables import small_side

# A million 8-byte digests.
MAX_BROADCAST_DIGESTS = 1_000_000


# --- conditions on one row -------------------------------------------------------------------


def is_missing(col: str) -> Column:
    return F.col(col).isNull()


def is_not_accepted(col: str, values: Sequence) -> Column:
    return ~F.col(col).isin(list(values))


def is_missing_when(col: str, when_col: str, when_value) -> Column:
    return (F.col(when_col) == F.lit(when_value)) & F.col(col).isNull()


def is_blank(col: str) -> Column:
    return F.trim(F.col(col)) == ""


def negative_price() -> Column:
    return F.col("price") < 0


def discount_out_of_range() -> Column:
    return (F.col("discount_pct") < 0) | (F.col("discount_pct") > 100)


def flag_contradicts_count() -> Column:
    none = F.col("review_count").isNull() | (F.col("review_count") == 0)
    return (F.col("has_reviews") & none) | (~F.col("has_reviews") & (F.col("review_count") > 0))


def list_price_below_price() -> Column:
    return F.col("list_price") < F.col("price")


def rating_out_of_range() -> Column:
    rating = F.col("rating_average")
    return (F.col("review_count") > 0) & ((rating < 1.0) | (rating > 5.0))


# --- rules as violating rows -----------------------------------------------------------------


def dq_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(is_missing(col))


def dq_unique(df: DataFrame, *cols: str, wide: bool = False) -> DataFrame:
    """Values (or combinations) that occur more than once, with their number of rows.

    For `wide` values (whole texts) a first pass shuffles digests only, and just the rows whose
    digest repeats are grouped by the value itself. The result is the same.
    """
    keyed = df.dropna(subset=list(cols))
    counted = (_with_repeated_digest(keyed, cols) if wide else keyed).groupBy(*cols)
    return counted.agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1)


def _with_repeated_digest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose digest occurs more than once: all repeated values and a few chance hits."""
    digest = F.xxhash64(*cols).alias("__digest")
    counted = df.select(digest).groupBy("__digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.where("n > 1").select("__digest")
    side = small_side(repeated, "digests", MAX_BROADCAST_DIGESTS)
    return df.select("*", digest).join(side, "__digest", "left_semi")


def dq_accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(is_not_accepted(col, values))


def dq_relationships(child: DataFrame, col: str, parent: DataFrame, pcol: str) -> DataFrame:
    """Child rows whose non-null value the parent lacks."""
    known = parent.select(F.col(pcol).alias("__parent"))
    return child.where(F.col(col).isNotNull()).join(
        known, F.col(col) == F.col("__parent"), "left_anti"
    )


def dq_not_null_when(df: DataFrame, col: str, when_col: str, when_value) -> DataFrame:
    return df.where(is_missing_when(col, when_col, when_value)).select(col, when_col)


def dq_not_empty_string(df: DataFrame, col: str) -> DataFrame:
    return df.where(is_blank(col))


def dq_price_positive(books: DataFrame) -> DataFrame:
    """Negative prices; zero passes."""
    return books.where(negative_price()).select("product_id", "name", "price")


def dq_discount_range(books: DataFrame) -> DataFrame:
    columns = ["product_id", "name", "price", "list_price", "discount_pct"]
    return books.where(discount_out_of_range()).select(*columns)


def dq_has_reviews_consistent(books: DataFrame) -> DataFrame:
    columns = ["product_id", "name", "review_count", "has_reviews"]
    return books.where(flag_contradicts_count()).select(*columns)


def dq_list_price_gte_price(books: DataFrame) -> DataFrame:
    columns = ["product_id", "name", "price", "list_price", "discount_pct"]
    return books.where(list_price_below_price()).select(*columns)


def dq_rating_range(books: DataFrame) -> DataFrame:
    columns = ["product_id", "name", "rating_average", "review_count"]
    return books.where(rating_out_of_range()).select(*columns)


def dq_review_count(books: DataFrame, reviews: DataFrame) -> DataFrame:
    return models.books_vs_actual_counts(books, reviews)


def dq_review_orphans(reviews: DataFrame, books: DataFrame) -> DataFrame:
    columns = ["review_id", "product_id", "reviewer_name"]
    return models.orphan_reviews(reviews, books).select(*columns)


# --- report ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Suite:
    """The rules of one table: conditions on rows, unique keys, and rules that read other tables.

    `columns` are what the rules read. `across` holds functions from the tables to lines (table,
    rule, violations), one for all rules that can share a pass.
    """

    table: str
    columns: Sequence[str]
    rows: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    unique: Sequence[str] = ()
    across: Sequence[Callable[[Mapping[str, DataFrame]], DataFrame]] = ()


def _reviews_against_books(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Reviews without a book, with and without counting null products, and books with more reviews
    than they report: from one count per product, joined once.
    """
    per_product = tables["reviews"].groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    books = tables["books"].select("product_id", "review_count", F.lit(True).alias("known"))
    both = per_product.join(books, "product_id", "left")
    lost = F.when(F.col("known").isNull(), F.col("n"))
    counted = both.agg(
        F.coalesce(F.sum(F.when(F.col("product_id").isNotNull(), lost)), F.lit(0)).alias("named"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("every"),
        F.count_if(F.col("known") & (F.col("n") > F.col("review_count"))).alias("over"),
    )
    lines = [
        ("reviews", "relationships(product_id)", "named"),
        ("reviews", "reviews_have_valid_product", "every"),
        ("books", "review_count_matches_actual", "over"),
    ]
    return _lines(counted, lines)


def _not_null(*cols: str) -> dict[str, Callable[[], Column]]:
    return {f"not_null({c})": (lambda c=c: is_missing(c)) for c in cols}


# The ratings that are accepted, and which rule is attached to which column.
RATINGS = [1, 2, 3, 4, 5]

SUITES = [
    Suite(
        "stg_listing",
        columns=["product_id", "name", "price", "rating_average"],
        rows=_not_null("product_id", "name", "price", "rating_average"),
        unique=["product_id"],
    ),
    Suite(
        "stg_detail",
        columns=["product_id", "name", "price"],
        rows=_not_null("product_id", "name", "price"),
        unique=["product_id"],
    ),
    Suite(
        "stg_reviews",
        columns=["review_id", "product_id", "rating"],
        rows={
            **_not_null("review_id", "product_id", "rating"),
            "accepted_values(rating)": lambda: is_not_accepted("rating", RATINGS),
        },
        unique=["review_id"],
    ),
    Suite(
        "books",
        columns=[
            *["product_id", "name", "price", "list_price", "discount_pct"],
            *["rating_average", "review_count", "has_reviews"],
        ],
        rows={
            **_not_null(
                "product_id", "price", "rating_average", "discount_pct", "has_reviews", "name"
            ),
            "not_null_when(rating_average, has_reviews)": lambda: is_missing_when(
                "rating_average", "has_reviews", "true"
            ),
            "accepted_values(has_reviews)": lambda: is_not_accepted("has_reviews", [True, False]),
            "not_empty_string(name)": lambda: is_blank("name"),
            "price_positive": negative_price,
            "discount_range": discount_out_of_range,
            "has_reviews_consistent": flag_contradicts_count,
            "list_price_gte_price": list_price_below_price,
            "rating_range": rating_out_of_range,
        },
        unique=["product_id"],
    ),
    Suite(
        "reviews",
        columns=["review_id", "product_id", "rating", "title", "reviewer_name"],
        rows={
            **_not_null("review_id", "product_id", "rating"),
            "accepted_values(rating)": lambda: is_not_accepted("rating", RATINGS),
            "not_empty_string(reviewer_name)": lambda: is_blank("reviewer_name"),
            "not_empty_string(title)": lambda: is_blank("title"),
        },
        unique=["review_id"],
        across=[_reviews_against_books],
    ),
]


def columns_read(table: str) -> list[str]:
    """The columns of a table that its rules read."""
    return [c for suite in SUITES if suite.table == table for c in suite.columns]


def _row_rules(table: str, df: DataFrame, rules: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """All row conditions of a table in one scan, then one line per rule."""
    counted = df.agg(*(F.count_if(condition()).alias(f"r{i}") for i, condition in enumerate(rules.values())))
    return _lines(counted, [(table, rule, f"r{i}") for i, rule in enumerate(rules)])


def _lines(counted: DataFrame, lines: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row of counts as lines (table, rule, name of the count)."""
    line = "named_struct('table', '{}', 'rule', '{}', 'violations', {})"
    return counted.selectExpr(f"inline_outer(array({', '.join(line.format(*x) for x in lines)}))")


def _unique_rules(tables: Mapping[str, DataFrame], suites: Sequence[Suite]) -> DataFrame | None:
    """The unique rules of all tables as one aggregation over (rule, value).

    Values go with the number of their rule, so one shuffle takes all of them, counted per task
    before it; the rules themselves stand beside as a line each, for those without a violation.
    """
    rules = [(suite.table, col) for suite in suites for col in suite.unique]
    if not rules:
        return None
    tagged = [
        tables[table].where(f"`{col}` IS NOT NULL").selectExpr(f"{i} AS at", f"cast(`{col}` AS string) AS value")
        for i, (table, col) in enumerate(rules)
    ]
    values = reduce(DataFrame.unionByName, tagged).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = [F.expr(f"count_if(at = {i} AND n > 1) AS u{i}") for i in range(len(rules))]
    return _lines(values.agg(*counts), [(table, f"unique({col})", f"u{i}") for i, (table, col) in enumerate(rules)])


def dq_report(tables: Mapping[str, DataFrame], suites: Sequence[Suite] = SUITES) -> DataFrame:
    """One line per rule: table, rule, violations, passed. Tables that are not given are left out.

    A table is read once for all conditions on its rows, and once, keys only, for its unique rules,
    which share one shuffle with those of the other tables. Facts feed many rules, so pass written
    (or persisted) tables.
    """
    known = [suite for suite in suites if suite.table in tables]
    if not known:
        raise ValueError("no known table to check")
    parts = [_row_rules(suite.table, tables[suite.table], suite.rows) for suite in known if suite.rows]
    unique = _unique_rules(tables, known)
    parts += [unique] if unique is not None else []
    parts += [rule(tables) for suite in known for rule in suite.across]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)
