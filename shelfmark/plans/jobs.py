"""The daily run: bronze to silver, silver to gold, price snapshot, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import run_timestamp
from shelfmark.operators import analytics, clean, history, models, payload, quality, rows, titles
from shelfmark.session import prepare, scratch, size_shuffles
from shelfmark.sources import bronze, snapshots, tables

ENTITIES = ["listing", "detail", "reviews"]

SILVER = {entity: f"silver.{entity}" for entity in ENTITIES}
BOOKS = "marts.fct_books"
REVIEWS = "marts.fct_reviews"
EXPLORER = "marts.explorer_books"
POSTINGS = "marts.title_postings"
PRICES = "marts.fct_prices_history"
SNAPSHOT = "snapshots.book_prices"
AUDIT = "audit.rows"
LOSSES = "audit.losses"
LANDED = "audit.landed"

# What the price snapshot watches.
SNAPSHOT_KEY = "product_id"
SNAPSHOT_CHECK = ["price", "discount_rate"]


def land(
    spark: SparkSession,
    landed: dict[str, DataFrame],
    bronze_path: str,
    run: str,
    location: str | None = None,
) -> DataFrame:
    """Landed responses of one run to bronze; returns responses and unreadable ones by entity.

    `landed` maps entities to responses in a column `payload`; reviews also have the `product_id`
    that was asked for. Entities may be left out. Responses are counted while they are written. With
    `location` the counts of all runs are kept in the table `audit.landed`; a repeated run replaces
    the counts of the entities it lands.
    """
    if not landed:
        raise ValueError("nothing landed")
    prepare(spark)
    read = {
        "listing": payload.listing_from_payload,
        "detail": payload.detail_from_payload,
        "reviews": payload.reviews_from_payload,
    }
    counts = []
    for entity, responses in landed.items():
        seen = Observation(f"landed_{entity}")
        found = read[entity](payload.observe_pages(responses, seen), run)
        bronze.bronze_append(bronze.nested_to_json(found), f"{bronze_path}/{entity}", run)
        counts.append((entity, seen.get["pages"], seen.get["unreadable"]))
    counted = spark.createDataFrame(counts, "entity string, pages bigint, unreadable bigint")
    if location is not None:
        kept = counted.select("entity", F.lit(run).alias("run"), "pages", "unreadable")
        if spark.catalog.tableExists(LANDED):
            again = (F.col("run") == run) & F.col("entity").isin(list(landed))
            kept = spark.table(LANDED).where(~again).unionByName(kept)
        tables.write_table(kept.coalesce(1), LANDED, location)
    return counted


def work_list(spark: SparkSession, bronze_path: str) -> DataFrame | None:
    """The products of the newest listing run, to be asked for next; None before the first."""
    newest = bronze.latest_run_file(spark, f"{bronze_path}/listing")
    return None if newest is None else rows.distinct_work_list(newest)


def bronze_to_silver(spark: SparkSession, bronze_path: str, location: str) -> DataFrame:
    """Merge and clean all runs of `<bronze_path>/<entity>`; returns the audit of rows."""
    prepare(spark)
    size_shuffles(spark, bronze.input_bytes(spark, bronze_path))
    with scratch(spark):
        raw = {e: bronze.bronze_union(spark, f"{bronze_path}/{e}") for e in ENTITIES}
        return silver_from_raw(raw, location)


def silver_from_raw(raw: dict[str, DataFrame], location: str) -> DataFrame:
    """Replace the three silver tables from raw rows; returns the audit of rows, a table itself.

    Raw rows are counted while they are read for the silver tables, and values that could not be read
    while these are written, not in a pass of their own. The latter are the table `audit.losses`.
    """
    spark = next(iter(raw.values())).sparkSession
    seen = {e: Observation(f"raw_{e}") for e in ENTITIES}
    counted = {e: raw[e].observe(seen[e], F.count(F.lit(1)).alias("rows")) for e in ENTITIES}
    lost = {e: Observation(f"lost_{e}") for e in ENTITIES}
    cleaned = {
        "listing": clean.clean_listing(counted["listing"], lost=lost["listing"]),
        "detail": clean.clean_detail(counted["detail"], spec_keys=None, lost=lost["detail"]),
        "reviews": clean.clean_reviews(counted["reviews"], lost=lost["reviews"]),
    }
    for entity, df in cleaned.items():
        tables.write_table(df, SILVER[entity], location)
    kept = {e: spark.table(SILVER[e]).count() for e in ENTITIES}
    audit = [(e, seen[e].get["rows"], kept[e], seen[e].get["rows"] - kept[e]) for e in ENTITIES]
    schema = "entity string, rows_in bigint, rows_out bigint, dropped bigint"
    tables.write_table(spark.createDataFrame(audit, schema), AUDIT, location)
    unread = [(e, column, rows) for e in ENTITIES for column, rows in lost[e].get.items()]
    schema = "entity string, column string, rows_lost bigint"
    tables.write_table(spark.createDataFrame(unread, schema), LOSSES, location)
    return spark.table(AUDIT)


def publish_staging(spark: SparkSession) -> None:
    """The staging models, as views of this session over the silver tables."""
    tables.publish_views(
        {
            "stg_listing": models.stg_listing(spark.table(SILVER["listing"])),
            "stg_detail": models.stg_detail(spark.table(SILVER["detail"])),
            "stg_reviews": models.stg_reviews(spark.table(SILVER["reviews"])),
        }
    )


def silver_to_gold(spark: SparkSession, location: str) -> None:
    """Staging views and the two fact tables; the second reads the first as a table."""
    prepare(spark)
    publish_staging(spark)
    books = models.fct_books(spark.table("stg_listing"), spark.table("stg_detail"))
    tables.write_table(books, BOOKS, location)
    reviews = models.fct_reviews(spark.table("stg_reviews"), spark.table(BOOKS))
    tables.write_table(reviews, REVIEWS, location)
    tables.write_table(titles.laid_out(spark.table(BOOKS)), EXPLORER, location, options=titles.PAGES)
    tables.write_table(titles.title_postings(spark.table(EXPLORER)), POSTINGS, location)


def explore(spark: SparkSession, title: str | None = None, **filters) -> DataFrame:
    """`explore_books` over the stored books: their layout and the index of titles decide what is read."""
    laid = spark.table(EXPLORER)
    if title is None:
        return analytics.explore_books(laid.drop(titles.ROW, titles.LAYOUT), **filters)
    found = titles.with_title(laid, spark.table(POSTINGS), title)
    return analytics.explore_books(found, **filters)


def snapshot_prices(spark: SparkSession, location: str, run: str) -> DataFrame:
    """Record the prices of the book table as of `run`, and rebuild the price history."""
    prepare(spark)
    source = models.snapshot_source(spark.table(BOOKS))
    recorded = snapshots.snapshot(
        SNAPSHOT, source, f"{location}/snapshots/book_prices", run, SNAPSHOT_KEY, SNAPSHOT_CHECK
    )
    shown = history.price_history(recorded, run_timestamp(F.lit(run)))
    tables.write_table(shown, PRICES, location)
    return spark.table(PRICES)


def check(spark: SparkSession) -> DataFrame:
    """The report of all rules over staging and facts."""
    prepare(spark)
    publish_staging(spark)
    return quality.dq_report(
        {
            "stg_listing": spark.table("stg_listing"),
            "stg_detail": spark.table("stg_detail"),
            "stg_reviews": spark.table("stg_reviews"),
            "books": spark.table(BOOKS),
            "reviews": spark.table(REVIEWS),
        }
    )


def run_all(spark: SparkSession, bronze_path: str, location: str, run: str) -> DataFrame:
    """One daily run; returns the report of the checks."""
    bronze_to_silver(spark, bronze_path, location)
    silver_to_gold(spark, location)
    snapshot_prices(spark, location, run)
    return check(spark)
