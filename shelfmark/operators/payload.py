"""Landed response text (one row per response) to bronze rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scalars import to_int_nullable, to_number
from shelfmark.operators.rows import stamp_run

# Fields of a listing item. A string field takes nested values as JSON text.
LISTING_ITEM = """
    id bigint, sku string, name string, url_key string, url_path string, type string,
    seller_id bigint, seller_product_id bigint,
    price double, list_price double, original_price double, discount double, discount_rate double,
    rating_average double, review_count bigint, order_count bigint, favourite_count bigint,
    quantity_sold string, brand_name string, book_cover string,
    has_ebook boolean, bundle_deal boolean, shippable boolean, is_visible boolean,
    is_flower boolean, is_gift_card boolean,
    availability bigint, inventory string, salable_type string, stock_item string,
    primary_category_path string, productset_id bigint, productset_group_name string,
    thumbnail_url string, thumbnail_width bigint, thumbnail_height bigint, url_review string,
    author_name string, short_description string, inventory_status string
"""

# Fields read from a product response.
DETAIL_FIELDS = """
    id bigint, name string, description string, short_description string,
    price double, list_price double, discount_rate double, rating_average double,
    review_count bigint, inventory_status string,
    specifications string, images array<struct<base_url string>>, categories string,
    url_key string, sku string
"""

DETAIL_SCALARS = [
    "name", "description", "short_description", "price", "list_price", "discount_rate",
    "rating_average", "review_count", "inventory_status",
]

# Fields read from a review response.
REVIEW_ITEM = """
    id bigint, rating string, title string, content string, thank_count bigint,
    created_at string, created_by struct<name string, purchased boolean>
"""


def _read_type(dtype: T.DataType) -> T.DataType:
    """Numbers are read as the text they came in; a number sent as text or as 4.0 is one as well."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _read_type(f.dataType)) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_read_type(dtype.elementType))
    return T.StringType() if isinstance(dtype, (T.LongType, T.DoubleType)) else dtype


def _as_read(ddl: str) -> str:
    return _read_type(T.StructType.fromDDL(ddl)).simpleString()


def whole_number(text: Column) -> Column:
    """Text as bigint: digits to the last one, also `4.0`; anything else is null."""
    digits = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))
    return F.coalesce(digits, to_int_nullable(to_number(text)))


def _converted(ddl: str, of: str) -> list[Column]:
    """The fields of a record that was read by `_as_read`, in the types of `ddl`."""
    found = []
    for field in T.StructType.fromDDL(ddl):
        value = F.col(f"{of}.`{field.name}`")
        if isinstance(field.dataType, T.LongType):
            value = whole_number(value)
        elif isinstance(field.dataType, T.DoubleType):
            value = to_number(value)
        found.append(value.alias(field.name))
    return found


def _page(item: str) -> str:
    return f"data array<{item}>, paging struct<total string>"


def _unreadable(text: Column) -> Column:
    """Whether a response is no JSON object; a missing one is unreadable as well."""
    return F.coalesce(F.try_parse_json(text).isNull() | ~text.rlike(r"^\s*\{"), F.lit(True))


def _page_counts(col: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("pages"), F.count_if(_unreadable(F.col(col))).alias("unreadable")]


def page_audit(df: DataFrame, col: str = "payload") -> DataFrame:
    """How many responses there are, and how many of them cannot be read."""
    return df.agg(*_page_counts(col))


def observe_pages(df: DataFrame, seen: Observation, col: str = "payload") -> DataFrame:
    """The responses as they are; `seen` receives the counts of `page_audit` while they are written on."""
    return df.observe(seen, *_page_counts(col))


def _items(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per element of `page.data`.

    The outer form is filtered afterwards: for the plain form Spark infers a filter on the list
    and parses the page a second and third time to evaluate it.
    """
    items = pages.select(*keep, F.explode_outer("page.data").alias("item"))
    return items.where(F.col("item").isNotNull())


def listing_from_payload(
    df: DataFrame, run: str, item: str = LISTING_ITEM, col: str = "payload"
) -> DataFrame:
    """One row per item of every listing page.

    The fields of `item` become columns; `record` is the item as it came, so bronze, the only copy,
    also keeps the fields that nobody has asked for yet. Unreadable pages have no rows; `page_audit`
    counts them.
    """
    pages = df.select(F.from_json(col, _page("string")).alias("page"))
    records = _items(pages).withColumnRenamed("item", "record")
    read = records.withColumn("item", F.from_json("record", _as_read(item)))
    return stamp_run(read.select(*_converted(item, "item"), "record"), run)


def images_project(images: Column) -> Column:
    """JSON text of the image addresses; a missing list is `[]`, a missing address `null`."""
    urls = F.transform(images, lambda image: image["base_url"])
    return F.coalesce(F.to_json(urls, {"ignoreNullFields": "false"}), F.lit("[]"))


def spec_to_text(specifications: Column) -> Column:
    return F.coalesce(specifications, F.lit("[]"))


def categories_to_text(categories: Column) -> Column:
    return F.coalesce(categories, F.lit("{}"))


def detail_from_payload(df: DataFrame, run: str, col: str = "payload") -> DataFrame:
    """Sixteen columns of every product response.

    An unreadable response gives a row without product id, which staging drops.
    """
    read = df.select(F.from_json(col, _as_read(DETAIL_FIELDS)).alias("r"))
    products = read.select(F.struct(*_converted(DETAIL_FIELDS, "r")).alias("d"))
    named = products.select(
        F.col("d.id").alias("product_id"),
        *(f"d.{c}" for c in DETAIL_SCALARS),
        spec_to_text(F.col("d.specifications")).alias("specifications"),
        images_project(F.col("d.images")).alias("images"),
        categories_to_text(F.col("d.categories")).alias("categories"),
        "d.url_key",
        "d.sku",
    )
    return stamp_run(named, run)


def reviews_from_payload(
    df: DataFrame, run: str, product: str = "product_id", col: str = "payload"
) -> DataFrame:
    """One row per review of every review page, with the product the page was asked for."""
    pages = df.select(product, F.from_json(col, _page(_as_read(REVIEW_ITEM))).alias("page"))
    items = _items(pages.withColumnRenamed(product, "product_id"), "product_id")
    items = items.withColumn("item", F.struct(*_converted(REVIEW_ITEM, "item")))
    named = items.select(
        F.col("item.id").alias("review_id"),
        "product_id",
        "item.rating",
        "item.title",
        "item.content",
        "item.thank_count",
        "item.created_at",
        F.col("item.created_by.name").alias("reviewer_name"),
        F.col("item.created_by.purchased").alias("reviewer_purchased"),
    )
    return stamp_run(named, run)


def review_total_reached(
    df: DataFrame, product: str = "product_id", col: str = "payload"
) -> DataFrame:
    """Per product: reviews collected, the total its pages report, pages that say neither, and
    whether the total is reached.

    A page that cannot be read, or whose total is there but is no number, is `unreadable`; a product
    with such a page is never complete. A page without a total reports 0. Counts inside the page, so
    no review row is ever built or shuffled.
    """
    pages = df.select(
        product,
        F.from_json(col, _page("string")).alias("page"),
        _unreadable(F.col(col)).alias("broken"),
    )
    said = F.col("page.paging.total")
    total = whole_number(said)
    of_page = F.when(~F.col("broken"), F.greatest(F.coalesce(F.size("page.data"), F.lit(0)), F.lit(0)))
    counted = pages.groupBy(F.col(product).alias("product_id")).agg(
        F.coalesce(F.sum(of_page), F.lit(0)).alias("collected"),
        F.coalesce(F.max(F.when(~F.col("broken"), total)), F.lit(0)).alias("reported"),
        F.count_if(F.col("broken") | (said.isNotNull() & total.isNull())).alias("unreadable"),
    )
    done = (F.col("unreadable") == 0) & (F.col("collected") >= F.col("reported"))
    return counted.withColumn("complete", done)
