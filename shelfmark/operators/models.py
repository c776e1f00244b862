"""Staging projections and fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.functions.specs import KNOWN_SPECS, SPEC_PREFIX

# The column lists below are the public shape of the tables.
STG_LISTING = [
    "product_id", "sku", "name", "url_key", "url_path", "type", "seller_id", "seller_product_id",
    "price", "list_price", "original_price", "discount", "discount_rate", "rating_average",
    "review_count", "order_count", "favourite_count", "quantity_sold", "brand_name", "book_cover",
    "has_ebook", "bundle_deal", "shippable", "is_visible", "is_flower", "is_gift_card",
    "availability", "inventory", "salable_type", "stock_item", "primary_category_path",
    "productset_id", "productset_group_name", "thumbnail_url", "thumbnail_width",
    "thumbnail_height", "url_review", "extracted_at",
]

STG_DETAIL = [
    *"product_id sku name url_key short_description description images categories".split(),
    *"price list_price discount_rate rating_average review_count inventory_status".split(),
    *(SPEC_PREFIX + key for key in KNOWN_SPECS),
    "extracted_at",
]

STG_REVIEWS = [
    "review_id", "product_id", "rating", "title", "content", "thank_count", "reviewer_name",
    "reviewer_purchased", "created_at", "extracted_at",
]

FCT_BOOKS = [
    "product_id", "sku", "name", "url_key", "url_path", "type", "seller_id", "seller_product_id",
    "price", "list_price", "original_price", "discount", "discount_rate", "discount_pct",
    "rating_average", "review_count", "order_count", "favourite_count", "quantity_sold",
    "has_reviews", "brand_name", "book_cover", "has_ebook", "bundle_deal", "shippable",
    "is_visible", "primary_category_path", "productset_id", "productset_group_name", "availability",
    "inventory", "salable_type", "thumbnail_url", "url_review", "short_description",
    "spec_publisher_vn", "spec_publication_date", "spec_book_cover", "spec_number_of_page",
    "spec_language_book", "spec_book_version", "spec_isbn13", "spec_brand", "spec_origin",
    "spec_dich_gia", "spec_edition", "spec_dimensions", "inventory_status", "categories",
    "extracted_at",
]

BOOKS_NARROW = [
    "product_id", "name", "primary_category_path", "brand_name", "price", "discount_pct",
    "rating_average", "spec_publisher_vn", "spec_language_book", "spec_isbn13",
]

FCT_REVIEWS = [
    "review_id", "product_id", "rating", "title", "content", "thank_count", "reviewer_name",
    "reviewer_purchased", "created_at", "product_name", "primary_category_path", "brand_name",
    "price", "discount_pct", "rating_average", "spec_publisher_vn", "spec_language_book",
    "spec_isbn13", "extracted_at",
]

SNAPSHOT_SOURCE = [
    "product_id", "name", "price", "original_price", "discount_rate", "brand_name", "extracted_at",
]


def stg_listing(listing: DataFrame) -> DataFrame:
    keyed = listing.where(F.col("id").isNotNull())
    return keyed.withColumnRenamed("id", "product_id").select(*STG_LISTING)


def stg_detail(detail: DataFrame) -> DataFrame:
    return detail.where(F.col("product_id").isNotNull()).select(*STG_DETAIL)


def stg_reviews(reviews: DataFrame) -> DataFrame:
    keyed = reviews.where(F.col("review_id").isNotNull() & F.col("product_id").isNotNull())
    return keyed.select(*STG_REVIEWS)


def fct_books(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Staged listing with the book columns of the staged detail, plus two computed columns.

    Both sides hold one row per product and are already partitioned by it after cleaning, so
    the join itself adds no shuffle.
    """
    return join_books(listing, detail, FCT_BOOKS)


def listed_books(listing: DataFrame) -> DataFrame:
    """The columns of the book table that the listing alone gives: no detail is read."""
    detail_only = {c for c in STG_DETAIL if c not in STG_LISTING}
    return join_books(listing, None, [c for c in FCT_BOOKS if c not in detail_only])


def join_books(
    listing: DataFrame, detail: DataFrame | None, columns: Sequence[str]
) -> DataFrame:
    """The wanted columns of the book table; the sides need to hold no more than these take.

    A detail record adds columns, never books, so without wanted columns of its own it is not read.
    """
    wanted = [c for c in FCT_BOOKS if c in set(columns)]
    from_detail = [c for c in wanted if c in STG_DETAIL and c not in STG_LISTING]
    books = listing.withColumns(
        {
            "discount_pct": S.discount_pct(F.col("price"), F.col("list_price")),
            "has_reviews": S.has_reviews(F.col("review_count")),
        }
    )
    if from_detail:
        books = books.join(detail.select("product_id", *from_detail), "product_id", "left")
    return books.select(*wanted)


def books_narrow(books: DataFrame) -> DataFrame:
    return books.select(*BOOKS_NARROW)


def fct_reviews(reviews: DataFrame, books: DataFrame) -> DataFrame:
    """Staged reviews with the context of their book, null where the book is unknown.

    A product may hold most of the reviews. With `books` a written table, both sides are shuffled
    straight into the join, and a skewed partition of reviews is split at run time. Books go to
    every executor only when measured small.
    """
    return join_reviews(reviews, books, FCT_REVIEWS)


def join_reviews(reviews: DataFrame, books: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wanted columns of the review table."""
    wanted = [c for c in FCT_REVIEWS if c in set(columns)]
    context = books_narrow(books).withColumnRenamed("name", "product_name")
    return reviews.join(context, "product_id", "left").select(*wanted)


def snapshot_source(books: DataFrame) -> DataFrame:
    return books.select(*SNAPSHOT_SOURCE)


def orphan_reviews(reviews: DataFrame, books: DataFrame) -> DataFrame:
    """Reviews whose product is not among the books; a null product has no book either.

    Pass `books` as a written table, as for `fct_reviews`.
    """
    return reviews.join(books.select("product_id"), "product_id", "left_anti")


def books_vs_actual_counts(books: DataFrame, reviews: DataFrame) -> DataFrame:
    """Books with more collected reviews than they report. Reviews are counted before the join."""
    actual = reviews.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("crawled_review_count")
    )
    return (
        books.select("product_id", "name", F.col("review_count").alias("reported_review_count"))
        .join(actual, "product_id")
        .where(F.col("crawled_review_count") > F.col("reported_review_count"))
    )
