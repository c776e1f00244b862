"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.operators import analytics as A
from shelfmark.operators import clean, history, losses, models, payload, quality, rows, titles
from shelfmark.plans import jobs
from shelfmark.session import prepare, scratch_path
from shelfmark.sources import bronze, tables
from shelfmark.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters of the reports; the SQL uses the same values.
PRICE_WIDTH = 5000.0
NOW = "2024-03-01 00:00:00"
HISTORY_CHECK = ["price", "discount_rate"]


def query(function: Query) -> Query:
    """Register a query under its function's name, with the session settings it needs."""

    @wraps(function)
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    QUERIES[function.__name__] = prepared
    return prepared


def _now():
    return F.lit(NOW).cast("timestamp")


def _plain_time(df: DataFrame, *cols: str) -> DataFrame:
    """UTC timestamps as wall-clock time, as the SQL side has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


# --- the pipeline on the fixtures ------------------------------------------------------------


def _listing_raw(spark, sf_dir):
    return fx.listing_raw(fx.table(spark, sf_dir, "lineitem"))


def _detail_raw(spark, sf_dir):
    return fx.detail_raw(fx.table(spark, sf_dir, "part"))


def _reviews_raw(spark, sf_dir):
    return fx.reviews_raw(fx.table(spark, sf_dir, "events"))


def _stg_listing(spark, sf_dir):
    return models.stg_listing(clean.clean_listing(_listing_raw(spark, sf_dir), fx.LISTING_TIES))


def _stg_detail(spark, sf_dir):
    raw = _detail_raw(spark, sf_dir)
    return models.stg_detail(clean.clean_detail(raw, ties=fx.DETAIL_TIES))


def _stg_reviews(spark, sf_dir):
    return models.stg_reviews(clean.clean_reviews(_reviews_raw(spark, sf_dir), fx.REVIEW_TIES))


def _books(spark, sf_dir):
    return models.fct_books(_stg_listing(spark, sf_dir), _stg_detail(spark, sf_dir))


def _listed_books(spark, sf_dir):
    """Books for questions that ask for nothing from the detail records."""
    return models.listed_books(_stg_listing(spark, sf_dir))


def _books_table(spark, sf_dir, *columns):
    """Some columns of the books as a written table.

    Filters on parsed columns (publisher, quantity) would otherwise sink below the join and parse
    every text again.
    """
    return tables.materialize(_books(spark, sf_dir).select("product_id", *columns), "books")


def _facts(spark, sf_dir):
    """Books as a written table, as marts are, and the reviews joined to it."""
    books = tables.materialize(models.books_narrow(_books(spark, sf_dir)), "books")
    return books, models.fct_reviews(_stg_reviews(spark, sf_dir), books)


# --- sources and sinks -----------------------------------------------------------------------


@query
def bronze_union(spark, sf_dir):
    """Three runs that disagree: ids as double, a missing and an additional column."""
    raw = _listing_raw(spark, sf_dir).select(
        "id", "seller_id", "seller_product_id", "price", "list_price", "type", "book_cover"
    )
    path = scratch_path(spark, "bronze")
    narrow = raw.where(F.col("book_cover") == "a").drop("list_price")
    drifted = raw.where(F.col("book_cover") == "n").withColumn("id", F.col("id").cast("double"))
    rest = ~F.coalesce(F.col("book_cover").isin("a", "n"), F.lit(False))
    wider = raw.where(rest).withColumn("note", F.col("type"))
    for run, part in {"1": narrow, "2": drifted, "3": wider}.items():
        bronze.bronze_append(part, path, f"2024010{run}_000000")
    return bronze.bronze_union(spark, path)


def _bronze_by_flag(spark, sf_dir):
    """Three runs: the return flags A and N, then all others."""
    lines = fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"
    )
    path = scratch_path(spark, "bronze")
    flag = F.col("l_returnflag")
    rest = ~F.coalesce(flag.isin("A", "N"), F.lit(False))
    for run, chosen in enumerate((flag == "A", flag == "N", rest), start=1):
        bronze.bronze_append(lines.where(chosen), path, f"2024010{run}_000000")
    return path


@query
def latest_run_file(spark, sf_dir):
    return bronze.latest_run_file(spark, _bronze_by_flag(spark, sf_dir))


@query
def bronze_append(spark, sf_dir):
    return bronze.bronze_union(spark, _bronze_by_flag(spark, sf_dir), keep_run=True)


@query
def stamp_run(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.stamp_run(lines, fx.RUN)


@query
def checkpoint_overlap(spark, sf_dir):
    """A checkpoint repeats most rows of the final file; the latest rows are the same."""
    raw = _listing_raw(spark, sf_dir)
    path = scratch_path(spark, "bronze")
    bronze.bronze_append(raw.where(F.col("book_cover") != "n"), path, "20240101_000000_ckpt100")
    bronze.bronze_append(raw, path, "20240101_000100")
    merged = bronze.bronze_union(spark, path)
    latest = rows.latest_per_key(merged, ["id"], ties=fx.LISTING_TIES)
    return latest.select("id", "seller_product_id", "price", "extracted_at")


@query
def nested_to_json(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    nested = events.select(
        "event_id",
        "value",
        F.struct(F.col("user_id").alias("user"), kind.alias("kind")).alias("pair"),
        F.array("event_id", "user_id").alias("ids"),
        F.create_map(F.col("event_type"), F.col("user_id")).alias("by_kind"),
    )
    return bronze.nested_to_json(nested)


def _scratch_database(spark):
    """(database, location) that nothing else uses."""
    location = scratch_path(spark, "tables")
    return location.rsplit("/", 1)[1].replace("-", "_"), location


@query
def silver_write(spark, sf_dir):
    database, location = _scratch_database(spark)
    silver = {
        "silver_listing": clean.clean_listing(_listing_raw(spark, sf_dir), fx.LISTING_TIES),
        "silver_detail": clean.clean_detail(_detail_raw(spark, sf_dir), None, fx.DETAIL_TIES),
        "silver_reviews": clean.clean_reviews(_reviews_raw(spark, sf_dir), fx.REVIEW_TIES),
    }
    named = {f"{database}.{name}": df for name, df in silver.items()}
    counts = tables.write_tables(spark, named, location)
    return counts.withColumn("table", F.substring_index("table", ".", -1))


@query
def mart_write(spark, sf_dir):
    """Staging as views, marts as tables; the second mart reads the first as a table."""
    database, location = _scratch_database(spark)
    staged = {
        "stg_listing": _stg_listing(spark, sf_dir),
        "stg_detail": _stg_detail(spark, sf_dir),
        "stg_reviews": _stg_reviews(spark, sf_dir),
    }
    tables.publish_views(staged)
    books = models.fct_books(spark.table("stg_listing"), spark.table("stg_detail"))
    tables.write_table(books, f"{database}.fct_books", location)
    reviews = models.fct_reviews(
        spark.table("stg_reviews"), spark.table(f"{database}.fct_books")
    )
    tables.write_table(reviews, f"{database}.fct_reviews", location)
    return spark.table(f"{database}.fct_reviews").select(
        "review_id", "product_id", "product_name", "price", "spec_publisher_vn"
    )


@query
def row_audit(spark, sf_dir):
    return rows.row_audit(
        {
            "listing": (_listing_raw(spark, sf_dir), ["id"], []),
            "detail": (_detail_raw(spark, sf_dir), ["product_id"], []),
            "reviews": (
                _reviews_raw(spark, sf_dir),
                ["review_id"],
                ["review_id", "product_id"],
            ),
        }
    )


@query
def conversion_losses(spark, sf_dir):
    """Values of the kept rows that no conversion could read, per entity and column."""
    listing, detail = _listing_raw(spark, sf_dir), _detail_raw(spark, sf_dir)
    detail = rows.drop_null_keys(detail, ["product_id"])
    reviews = rows.drop_null_keys(_reviews_raw(spark, sf_dir), ["product_id", "review_id"])
    latest = rows.latest_per_key
    listing = latest(listing, ["id"], ties=fx.LISTING_TIES)
    detail = latest(detail, ["product_id"], ties=fx.DETAIL_TIES)
    reviews = latest(reviews, ["review_id"], ties=fx.REVIEW_TIES)
    found = [
        ("listing", losses.conversion_losses(listing, clean.listing_conversions(listing))),
        ("detail", losses.conversion_losses(detail, clean.detail_conversions(detail))),
        ("reviews", losses.conversion_losses(reviews, clean.review_conversions(reviews))),
    ]
    parts = [df.select(F.lit(entity).alias("entity"), "column", "rows_lost") for entity, df in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- payloads --------------------------------------------------------------------------------


def _listing_payload(spark, sf_dir):
    return fx.listing_payload(fx.table(spark, sf_dir, "lineitem"))


def _details(spark, sf_dir):
    pages = fx.detail_payload(fx.table(spark, sf_dir, "part"))
    return payload.detail_from_payload(pages, fx.RUN)


@query
def listing_from_payload(spark, sf_dir):
    items = payload.listing_from_payload(_listing_payload(spark, sf_dir), fx.RUN)
    return items.select(
        "id",
        "sku",
        "name",
        "seller_id",
        "price",
        S.extract_quantity(F.col("quantity_sold")).alias("quantity_sold"),
        "review_count",
        "has_ebook",
        "brand_name",
        F.get_json_object("record", "$.badges[0]").alias("badge"),
        "extracted_at",
    )


@query
def page_audit(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return payload.page_audit(fx.reviews_payload(events, faults=True))


@query
def detail_from_payload(spark, sf_dir):
    return _details(spark, sf_dir).select(
        "product_id",
        "name",
        "description",
        "short_description",
        "price",
        "list_price",
        "review_count",
        F.get_json_object("specifications", "$[0].attributes[0].value").alias("first_spec"),
        "sku",
        "extracted_at",
    )


@query
def images_project(spark, sf_dir):
    return _details(spark, sf_dir).select("product_id", "images")


@query
def spec_to_text(spark, sf_dir):
    """The text reads back as specifications."""
    details = _details(spark, sf_dir)
    return clean.flatten_specs(details, "product_id", "specifications")


@query
def categories_to_text(spark, sf_dir):
    return _details(spark, sf_dir).select(
        "product_id",
        (F.col("categories") == "{}").alias("without"),
        F.get_json_object("categories", "$.id").cast("bigint").alias("category_id"),
        F.get_json_object("categories", "$.name").alias("category"),
    )


@query
def reviews_from_payload(spark, sf_dir):
    pages = fx.reviews_payload(fx.table(spark, sf_dir, "events"))
    return payload.reviews_from_payload(pages, fx.RUN)


@query
def review_total_reached(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return payload.review_total_reached(fx.reviews_payload(events, faults=True))


@query
def distinct_work_list(spark, sf_dir):
    """The products of the newest of two landed runs."""
    path = scratch_path(spark, "bronze")
    lines = fx.table(spark, sf_dir, "lineitem")
    jobs.land(spark, {"listing": fx.listing_payload(lines)}, path, "20240101_000000")
    newer = fx.listing_payload(lines.where(F.col("l_returnflag") == "N"))
    jobs.land(spark, {"listing": newer}, path, "20240102_000000")
    return jobs.work_list(spark, path)


# --- cleaning --------------------------------------------------------------------------------


@query
def latest_per_key(spark, sf_dir):
    raw = _listing_raw(spark, sf_dir)
    return rows.latest_per_key(raw, ["id"], ties=fx.LISTING_TIES).select(
        "id", "seller_product_id", "seller_id", "price", "quantity_sold", "extracted_at"
    )


@query
def latest_per_key_detail(spark, sf_dir):
    """Null counts as one product here, as it does before staging drops it."""
    raw = _detail_raw(spark, sf_dir)
    latest = rows.latest_per_key(raw, ["product_id"], ties=fx.DETAIL_TIES)
    return latest.select("product_id", "sku", "price", "extracted_at")


@query
def latest_per_key_reviews(spark, sf_dir):
    raw = _reviews_raw(spark, sf_dir)
    latest = rows.latest_per_key(raw, ["review_id"], ties=fx.REVIEW_TIES)
    return latest.select("review_id", "product_id", "thank_count", "extracted_at")


@query
def clean_listing(spark, sf_dir):
    cleaned = clean.clean_listing(_listing_raw(spark, sf_dir), fx.LISTING_TIES)
    return cleaned.select("id", "name", "price", "list_price", "quantity_sold", "extracted_at")


@query
def clean_detail(spark, sf_dir):
    cleaned = clean.clean_detail(_detail_raw(spark, sf_dir), ties=fx.DETAIL_TIES)
    return cleaned.where(F.col("product_id").isNotNull()).select(
        "product_id", "price", "list_price", "rating_average", "review_count", "spec_publisher_vn"
    )


@query
def clean_reviews(spark, sf_dir):
    cleaned = clean.clean_reviews(_reviews_raw(spark, sf_dir), fx.REVIEW_TIES)
    return _plain_time(cleaned, "created_at")


@query
def drop_null_keys(spark, sf_dir):
    kept = rows.drop_null_keys(_reviews_raw(spark, sf_dir), ["product_id", "review_id"])
    return kept.select("review_id", "product_id", "extracted_at")


@query
def extract_quantity(spark, sf_dir):
    return _listing_raw(spark, sf_dir).select(
        "id", "seller_product_id", S.extract_quantity(F.col("quantity_sold")).alias("quantity_sold")
    )


@query
def zero_to_null(spark, sf_dir):
    return _listing_raw(spark, sf_dir).select(
        "id", "seller_product_id", S.zero_to_null(F.col("list_price")).alias("list_price")
    )


@query
def drop_if_present(spark, sf_dir):
    raw = _listing_raw(spark, sf_dir).select("id", "sku", "price", *clean.LISTING_DROPPED)
    return rows.drop_if_present(raw, [*clean.LISTING_DROPPED, "never_there"])


@query
def flatten_specs(spark, sf_dir):
    return clean.flatten_specs(_detail_raw(spark, sf_dir), "sku", "specifications")


@query
def pivot_specs(spark, sf_dir):
    details = _detail_raw(spark, sf_dir).select("sku", "extracted_at", "specifications")
    return clean.pivot_specs(details, "specifications")


@query
def pivot_specs_discovered(spark, sf_dir):
    """Columns follow the keys that occur; keys beyond the widest table go into a map."""
    details = _detail_raw(spark, sf_dir).select("sku", "extracted_at", "specifications")
    return clean.pivot_all_specs(details, "specifications")


@query
def to_number(spark, sf_dir):
    return _detail_raw(spark, sf_dir).select(
        "sku",
        "extracted_at",
        S.to_number(F.col("price")).alias("price"),
        S.to_number(F.col("rating_average")).alias("rating_average"),
    )


@query
def to_int_nullable(spark, sf_dir):
    return _reviews_raw(spark, sf_dir).select(
        "review_id",
        "extracted_at",
        S.to_int_nullable(S.to_number(F.col("rating"))).alias("rating"),
    )


@query
def parse_created_at(spark, sf_dir):
    parsed = _reviews_raw(spark, sf_dir).select(
        "review_id", "extracted_at", S.parse_created_at(F.col("created_at")).alias("created_at")
    )
    return _plain_time(parsed, "created_at")


@query
def missing_normalise(spark, sf_dir):
    """Per specification: products that have it, and products whose missing value is null."""
    details = clean.pivot_specs(_detail_raw(spark, sf_dir), "specifications")
    return details.agg(
        F.count(F.lit(1)).alias("details"),
        F.count("spec_publisher_vn").alias("with_publisher"),
        F.count("spec_isbn13").alias("with_isbn13"),
        F.count_if(F.col("spec_isbn13").isNull()).alias("without_isbn13"),
        F.count("spec_edition").alias("with_edition"),
    )


# --- staging and facts -----------------------------------------------------------------------


@query
def stg_listing(spark, sf_dir):
    return _stg_listing(spark, sf_dir)


@query
def stg_detail(spark, sf_dir):
    return _stg_detail(spark, sf_dir)


@query
def stg_reviews(spark, sf_dir):
    return _plain_time(_stg_reviews(spark, sf_dir), "created_at")


@query
def fct_books(spark, sf_dir):
    return _books(spark, sf_dir)


@query
def books_narrow(spark, sf_dir):
    return models.books_narrow(_books(spark, sf_dir))


@query
def snapshot_source(spark, sf_dir):
    return models.snapshot_source(_books(spark, sf_dir))


@query
def fct_reviews(spark, sf_dir):
    return _plain_time(_facts(spark, sf_dir)[1], "created_at")


@query
def discount_pct(spark, sf_dir):
    raw = _listing_raw(spark, sf_dir)
    pct = S.discount_pct(F.col("price"), F.col("list_price"))
    return raw.select("id", "seller_product_id", pct.alias("discount_pct"))


@query
def has_reviews(spark, sf_dir):
    raw = _listing_raw(spark, sf_dir)
    flag = S.has_reviews(F.col("review_count"))
    return raw.select("id", "seller_product_id", "review_count", flag.alias("has_reviews"))


@query
def orphan_reviews(spark, sf_dir):
    known = tables.materialize(_books(spark, sf_dir).select("product_id"), "books")
    orphans = models.orphan_reviews(_stg_reviews(spark, sf_dir), known)
    return orphans.select("review_id", "product_id", "title", "thank_count")


@query
def books_vs_actual_counts(spark, sf_dir):
    return models.books_vs_actual_counts(_books(spark, sf_dir), _stg_reviews(spark, sf_dir))


# --- history ---------------------------------------------------------------------------------


def _price_runs(spark, sf_dir):
    return fx.price_runs(fx.table(spark, sf_dir, "events"))


def _backfill(runs):
    return history.scd2_backfill(runs, "product_id", HISTORY_CHECK, ties=["seen_at"])


def _history_columns(df):
    return _plain_time(df.drop("seen_at"), "valid_from", "valid_to")


@query
def scd2_backfill(spark, sf_dir):
    return _history_columns(_backfill(_price_runs(spark, sf_dir)))


@query
def scd2_merge(spark, sf_dir):
    """The last run merged into the history of all runs before it."""
    runs = _price_runs(spark, sf_dir)
    last = runs.agg(F.max("extracted_at")).first()[0]
    # The earlier history does not know the last run; what it left open is still open.
    before = tables.materialize(_backfill(runs.where(F.col("extracted_at") < last)), "history")
    source = rows.latest_per_key(
        runs.where(F.col("extracted_at") == last), ["product_id"], order="seen_at", ties=[]
    )
    now = S.run_timestamp(F.lit(last))
    merged = history.scd2_merge(before, source, "product_id", HISTORY_CHECK, now)
    return _history_columns(merged)


@query
def price_history(spark, sf_dir):
    shown = history.price_history(_backfill(_price_runs(spark, sf_dir)), _now())
    return _plain_time(shown, "valid_from", "valid_to")


# --- analytics -------------------------------------------------------------------------------


@query
def kpi_cards(spark, sf_dir):
    return A.kpi_cards(_listed_books(spark, sf_dir), _stg_reviews(spark, sf_dir))


@query
def price_distribution(spark, sf_dir):
    return A.price_distribution(_listed_books(spark, sf_dir), PRICE_WIDTH)


@query
def rating_breakdown(spark, sf_dir):
    return A.rating_breakdown(_listed_books(spark, sf_dir))


@query
def top_publishers(spark, sf_dir):
    return A.top_publishers(_books_table(spark, sf_dir, A.PUBLISHER, "price"))


@query
def discount_vs_rating(spark, sf_dir):
    return A.discount_vs_rating(_listed_books(spark, sf_dir))


@query
def discount_rating_corr(spark, sf_dir):
    return A.correlation(_listed_books(spark, sf_dir), "discount_pct", "rating_average")


@query
def explore_books(spark, sf_dir):
    shown = ["name", "price", "rating_average", A.PUBLISHER]
    found = A.explore_books(
        _books_table(spark, sf_dir, *shown, "discount_pct"),
        publishers=["Brand#1", "Brand#2", "Brand#3 Press", "Brand#4"],
        price=(1000.0, 90000.0),
        rating=(1.0, 5.0),
        tiers=["none", "0-10"],
        title="BOOK 1",
        sort="price",
        ascending=False,
    )
    return found.select("product_id", *shown)


@query
def search_titles(spark, sf_dir):
    shown = ["name", "price", "rating_average", A.PUBLISHER]
    books = _books_table(spark, sf_dir, *shown, "discount_pct")
    laid = tables.materialize(titles.laid_out(books), "books-laid-out", titles.PAGES)
    postings = tables.materialize(titles.title_postings(laid), "title-postings")
    found = titles.with_title(laid, postings, "BOOK 11")
    found = A.explore_books(found, price=(1000.0, 90000.0), sort="price", ascending=False)
    return found.select("product_id", *shown)


@query
def reviews_by_star(spark, sf_dir):
    return A.reviews_by_star(_stg_reviews(spark, sf_dir))


@query
def verified_split(spark, sf_dir):
    return A.verified_split(_stg_reviews(spark, sf_dir))


@query
def most_helpful(spark, sf_dir):
    return A.most_helpful(_facts(spark, sf_dir)[1])


@query
def discount_tiers(spark, sf_dir):
    return A.discount_tiers(_listed_books(spark, sf_dir))


@query
def discount_by_publisher(spark, sf_dir):
    return A.discount_by_publisher(_books_table(spark, sf_dir, A.PUBLISHER, "discount_pct"))


@query
def price_vs_rating(spark, sf_dir):
    return A.price_vs_rating(_listed_books(spark, sf_dir), PRICE_WIDTH)


@query
def price_rating_corr(spark, sf_dir):
    return A.correlation(_listed_books(spark, sf_dir), "price", "rating_average")


@query
def price_vs_sales(spark, sf_dir):
    return A.price_vs_sales(_listed_books(spark, sf_dir), PRICE_WIDTH)


@query
def price_sales_corr(spark, sf_dir):
    measures = ["price", "quantity_sold"]
    return A.correlation(_books_table(spark, sf_dir, *measures), *measures)


@query
def underpriced_books(spark, sf_dir):
    return A.underpriced_books(_books_table(spark, sf_dir, "name", A.PUBLISHER, *A.MEASURES))


# --- data quality ----------------------------------------------------------------------------


@query
def dq_not_null(spark, sf_dir):
    return quality.dq_not_null(_listed_books(spark, sf_dir), "price").select("product_id", "name", "price")


@query
def dq_unique(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    return quality.dq_unique(lines, "l_orderkey", "l_linenumber")


@query
def dq_unique_text(spark, sf_dir):
    return quality.dq_unique(fx.table(spark, sf_dir, "documents"), "text", wide=True)


@query
def dq_accepted_values(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    accepted = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    return quality.dq_accepted_values(orders, "o_orderpriority", accepted)


@query
def dq_relationships(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return quality.dq_relationships(
        lines, "l_partkey", _detail_raw(spark, sf_dir), "product_id"
    )


@query
def dq_not_null_when(spark, sf_dir):
    return quality.dq_not_null_when(
        _listed_books(spark, sf_dir), "rating_average", "has_reviews", "true"
    )


@query
def dq_not_empty_string(spark, sf_dir):
    reviews = _stg_reviews(spark, sf_dir)
    return quality.dq_not_empty_string(reviews, "reviewer_name").select(
        "review_id", "reviewer_name"
    )


@query
def dq_price_positive(spark, sf_dir):
    return quality.dq_price_positive(_listed_books(spark, sf_dir))


@query
def dq_discount_range(spark, sf_dir):
    return quality.dq_discount_range(_listed_books(spark, sf_dir))


@query
def dq_has_reviews_consistent(spark, sf_dir):
    """The flag of the mart is right by construction, so it is checked against later counts."""
    later = F.when(F.col("order_count") < 3, F.col("review_count")).otherwise(
        F.col("favourite_count")
    )
    books = _listed_books(spark, sf_dir).withColumn("review_count", later)
    return quality.dq_has_reviews_consistent(books)


@query
def dq_list_price_gte_price(spark, sf_dir):
    return quality.dq_list_price_gte_price(_listed_books(spark, sf_dir))


@query
def dq_rating_range(spark, sf_dir):
    return quality.dq_rating_range(_listed_books(spark, sf_dir))


@query
def dq_review_count(spark, sf_dir):
    _, reviews = _facts(spark, sf_dir)
    return quality.dq_review_count(_listed_books(spark, sf_dir), reviews)


@query
def dq_review_orphans(spark, sf_dir):
    books, reviews = _facts(spark, sf_dir)
    return quality.dq_review_orphans(reviews, books)


@query
def dq_report(spark, sf_dir):
    """Every table feeds several rules, so the columns that rules read are written once."""
    of_books = [*quality.columns_read("books"), *models.BOOKS_NARROW]
    of_reviews = quality.columns_read("reviews")

    def staged(name, df, wanted):
        wanted = {*quality.columns_read(name), *wanted}
        return df.select(*(c for c in df.columns if c in wanted))

    written = tables.materialize_all(
        {
            "stg_listing": staged("stg_listing", _stg_listing(spark, sf_dir), of_books),
            "stg_detail": staged("stg_detail", _stg_detail(spark, sf_dir), of_books),
            "stg_reviews": staged("stg_reviews", _stg_reviews(spark, sf_dir), of_reviews),
        }
    )
    listing, detail, reviews = written.values()
    books = tables.materialize(models.join_books(listing, detail, of_books), "books")
    facts = models.join_reviews(reviews, books, of_reviews)
    return quality.dq_report(
        {
            "stg_listing": listing,
            "stg_detail": detail,
            "stg_reviews": reviews,
            "books": books,
            "reviews": tables.materialize(facts, "reviews"),
        }
    )
