"""The catalogue questions: overview, explorer, reviews, price intelligence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import exact_avg, round_half_up
from shelfmark.operators.median import MAX_BROADCAST_GROUPS, group_medians
from shelfmark.sources.tables import small_side

PUBLISHER = "spec_publisher_vn"

# Upper bounds of the discount tiers, in percent.
TIER_BOUNDS = [10, 20, 30, 50]

# What an underpriced book is judged by.
MEASURES = ["price", "rating_average", "review_count"]

# Places of shares and correlations.
DIGITS = 6


def price_bucket(width: float) -> Column:
    """Lower bound of the fixed-width bucket a price falls into."""
    return F.floor(F.col("price") / F.lit(float(width))) * F.lit(float(width))


def discount_tier(col: Column) -> Column:
    """'none' up to 0, then (0,10], (10,20], (20,30], (30,50] and above; null stays null."""
    tier = F.when(col <= 0, F.lit("none"))
    lower = 0
    for bound in TIER_BOUNDS:
        tier = tier.when(col <= bound, F.lit(f"{lower}-{bound}"))
        lower = bound
    return tier.when(col > lower, F.lit(f"over {lower}"))


# --- overview --------------------------------------------------------------------------------


def kpi_cards(books: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: books, reviews, average price, average rating, share of books with reviews."""
    per_books = books.agg(
        F.count(F.lit(1)).alias("books"),
        exact_avg(F.col("price")).alias("avg_price"),
        exact_avg(F.col("rating_average")).alias("avg_rating"),
        exact_avg(F.col("has_reviews").cast("double")).alias("share_with_reviews"),
    )
    per_reviews = reviews.agg(F.count(F.lit(1)).alias("reviews"))
    both = per_books.unionByName(per_reviews, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def price_distribution(books: DataFrame, width: float) -> DataFrame:
    priced = books.where(F.col("price").isNotNull())
    return priced.groupBy(price_bucket(width).alias("price_from")).agg(
        F.count(F.lit(1)).alias("books")
    )


def rating_breakdown(books: DataFrame) -> DataFrame:
    rated = books.where(F.col("rating_average").isNotNull())
    return rated.groupBy(F.floor("rating_average").alias("rating")).agg(
        F.count(F.lit(1)).alias("books")
    )


def top_publishers(books: DataFrame, n: int = 10) -> DataFrame:
    named = books.where(F.col(PUBLISHER).isNotNull())
    return (
        named.groupBy(PUBLISHER)
        .agg(F.count(F.lit(1)).alias("books"), exact_avg(F.col("price")).alias("avg_price"))
        .orderBy(F.desc("books"), PUBLISHER)
        .limit(n)
    )


def discount_vs_rating(books: DataFrame) -> DataFrame:
    """The points of the scatter plot: discounted percentage against rating per book."""
    known = F.col("discount_pct").isNotNull() & F.col("rating_average").isNotNull()
    return books.where(known).select("product_id", "discount_pct", "rating_average")


def correlation(books: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the number of complete pairs and their correlation."""
    pairs = books.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), round_half_up(F.corr(x, y), DIGITS).alias("corr")
    )


# --- explorer --------------------------------------------------------------------------------


def explore_books(
    books: DataFrame,
    publishers: Sequence[str] | None = None,
    price: tuple[float, float] | None = None,
    rating: tuple[float, float] | None = None,
    tiers: Sequence[str] | None = None,
    title: str | None = None,
    sort: str | None = None,
    ascending: bool = True,
) -> DataFrame:
    """Books by publisher, price range, rating range, discount tier and title text, sorted.

    Ranges include both ends. Ties of the sort column follow the product id.
    """
    found = books
    if publishers is not None:
        found = found.where(F.col(PUBLISHER).isin(list(publishers)))
    if price is not None:
        found = found.where(F.col("price").between(*price))
    if rating is not None:
        found = found.where(F.col("rating_average").between(*rating))
    if tiers is not None:
        found = found.where(discount_tier(F.col("discount_pct")).isin(list(tiers)))
    if title is not None:
        found = found.where(F.contains(F.lower("name"), F.lit(title.lower())))
    if sort is None:
        return found
    first = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    return found.orderBy(first, "product_id")


# --- reviews ---------------------------------------------------------------------------------


def reviews_by_star(reviews: DataFrame) -> DataFrame:
    """Count and share of every rating from 1 to 5."""
    rated = reviews.where(F.col("rating").between(1, 5))
    stars = rated.groupBy("rating").agg(F.count(F.lit(1)).alias("reviews"))
    # Five rows at most reach this window.
    share = F.col("reviews") / F.sum("reviews").over(Window.partitionBy())
    return stars.withColumn("share", round_half_up(share, DIGITS))


def verified_split(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("reviewer_purchased").agg(
        F.count(F.lit(1)).alias("reviews"),
        exact_avg(F.col("rating")).alias("avg_rating"),
        exact_avg(F.col("thank_count")).alias("avg_thanks"),
    )


def most_helpful(reviews: DataFrame, n: int = 10) -> DataFrame:
    columns = ["review_id", "product_id", "product_name", "rating", "title", "thank_count"]
    return (
        reviews.select(*columns)
        .orderBy(F.col("thank_count").desc_nulls_last(), "review_id")
        .limit(n)
    )


# --- price intelligence ----------------------------------------------------------------------


def discount_tiers(books: DataFrame) -> DataFrame:
    known = books.where(F.col("discount_pct").isNotNull())
    return known.groupBy(discount_tier(F.col("discount_pct")).alias("tier")).agg(
        F.count(F.lit(1)).alias("books"),
        exact_avg(F.col("rating_average")).alias("avg_rating"),
        exact_avg(F.col("quantity_sold")).alias("avg_quantity_sold"),
    )


def discount_by_publisher(books: DataFrame) -> DataFrame:
    named = books.where(F.col(PUBLISHER).isNotNull())
    return named.groupBy(PUBLISHER).agg(exact_avg(F.col("discount_pct")).alias("avg_discount_pct"))


def _by_price(books: DataFrame, width: float, measures: Mapping[str, str]) -> DataFrame:
    priced = books.where(F.col("price").isNotNull())
    return priced.groupBy(price_bucket(width).alias("price_from")).agg(
        F.count(F.lit(1)).alias("books"),
        *(exact_avg(F.col(col)).alias(alias) for alias, col in measures.items()),
    )


def price_vs_rating(books: DataFrame, width: float) -> DataFrame:
    return _by_price(books, width, {"avg_rating": "rating_average"})


def price_vs_sales(books: DataFrame, width: float) -> DataFrame:
    return _by_price(books, width, {"avg_quantity_sold": "quantity_sold"})


def underpriced_books(books: DataFrame) -> DataFrame:
    """Books cheaper than their publisher's median, with rating and review count above theirs.

    Reads `books` three times, so pass a written table.
    """
    wanted = books.select("product_id", "name", PUBLISHER, *MEASURES)
    medians = group_medians(wanted, PUBLISHER, MEASURES)
    medians = small_side(medians, "medians", MAX_BROADCAST_GROUPS)
    return (
        wanted.join(medians, PUBLISHER)
        .where(F.col("price") < F.col("median_price"))
        .where(F.col("rating_average") > F.col("median_rating_average"))
        .where(F.col("review_count") > F.col("median_review_count"))
        .select(*wanted.columns)
    )
