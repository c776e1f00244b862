"""The given star-schema tables in the shapes the pipeline reads.

Every view keeps all rows of its table. Faults (nulls, blanks, unknown products, bad text, bad
JSON) are planted by rules on the columns, so that every branch of the operators sees rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import RUN_STAMP
from shelfmark.sources.tables import file_bytes

# Latest-per-key needs a total order; these make one on the fixtures.
LISTING_TIES = ["seller_product_id", "seller_id", "original_price"]
DETAIL_TIES = ["sku"]
REVIEW_TIES = ["thank_count"]

RUN = "20240301_000000"


# Below so many bytes of file for each core, a table cannot have a row group for every core.
ROW_GROUP_BYTES = 16 * 1024 * 1024

# A row group is never cut by the reader; tables with larger ones are dealt out.
TASK_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One with fewer row groups than cores, as small files have, is dealt out to them.

    So is one with row groups of more than `TASK_ROWS` rows, to tasks of at most about so many. Anything else is
    read as its row groups lie, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if file_bytes(df) < cores * ROW_GROUP_BYTES:
        return df.hint("rebalance")
    # Without columns, a scan takes its rows from the footers.
    tasks = df.groupBy(F.spark_partition_id()).count()
    most, rows = tasks.agg(F.max("count"), F.sum("count")).first()
    return df.repartition(-(-rows // TASK_ROWS)) if (most or 0) > TASK_ROWS else df


def _columns(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{sql} AS {name}" for name, sql in expressions.items()))


_UNITS = "cast(l_quantity AS bigint)"
_PAID = "l_extendedprice * (1 - l_discount)"

_LISTING = {
    "id": "l_partkey",
    "sku": "concat('SKU-', l_partkey)",
    "name": "CASE WHEN l_linenumber = 7 THEN '  ' ELSE concat('Book ', l_partkey) END",
    "url_key": "concat('book-', l_partkey)",
    "url_path": "concat('book-', l_partkey, '.html')",
    "type": "l_linestatus",
    "seller_id": "l_suppkey",
    "seller_product_id": "l_orderkey * 10 + l_linenumber",
    "price": f"CASE WHEN {_UNITS} = 1 THEN -({_PAID}) WHEN {_UNITS} <> 2 THEN {_PAID} END",
    "list_price": """CASE WHEN l_discount = 0 THEN 0.0D
        WHEN l_tax = 0.08D THEN l_extendedprice * 0.9D ELSE l_extendedprice END""",
    "original_price": "l_extendedprice",
    "discount": "l_extendedprice * l_discount",
    "discount_rate": "l_discount",
    "rating_average": """CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'O')
        THEN l_linenumber * 0.8D END""",
    "review_count": f"""CASE WHEN l_linenumber = 5 THEN NULL WHEN l_returnflag = 'N' THEN 0L
        ELSE {_UNITS} * 2 END""",
    "order_count": "cast(l_linenumber AS bigint)",
    "favourite_count": "l_suppkey",
    "quantity_sold": f"""CASE l_orderkey % 6 WHEN 0 THEN cast({_UNITS} AS string)
        WHEN 1 THEN concat({_UNITS}, '.7')
        WHEN 2 THEN to_json(named_struct('text', 'sold', 'value', {_UNITS}))
        WHEN 3 THEN concat('"', {_UNITS}, '"')
        WHEN 4 THEN 'n/a' END""",
    "brand_name": "concat('Brand ', l_suppkey)",
    "book_cover": "lower(l_returnflag)",
    "has_ebook": "l_linestatus = 'O'",
    "bundle_deal": "l_returnflag = 'R'",
    "shippable": "l_tax > 0.02D",
    "is_visible": "l_linenumber < 7",
    "is_flower": "false",
    "is_gift_card": "false",
    "availability": "1L",
    "inventory": "'stock'",
    "salable_type": "l_linestatus",
    "stock_item": "concat('item ', l_linenumber)",
    "primary_category_path": "concat('1/2/', l_suppkey)",
    "productset_id": "l_suppkey",
    "productset_group_name": "concat('set ', l_returnflag)",
    "thumbnail_url": "concat('thumb/', l_partkey)",
    "thumbnail_width": "280L",
    "thumbnail_height": "280L",
    "url_review": "concat('review/', l_partkey)",
    "author_name": "concat('Author ', l_suppkey)",
    "short_description": "'short'",
    "inventory_status": "'available'",
    "extracted_at": f"date_format(l_shipdate, '{RUN_STAMP}')",
}


def listing_raw(lineitem: DataFrame) -> DataFrame:
    """Every order line is one extraction of its part as a product."""
    return _columns(lineitem, _LISTING)


def _group(name: str, *attributes: tuple[str, str, str]) -> str:
    listed = ", ".join(
        f"named_struct('code', {code}, 'name', {label}, 'value', {value})"
        for code, label, value in attributes
    )
    return f"to_json(named_struct('name', '{name}', 'attributes', array({listed})))"


_GENERAL = _group(
    "General",
    ("'publisher_vn'", "'Publisher'", "p_brand"),
    ("''", "'Number Of Page'", "cast(p_size AS string)"),
    ("'Book Cover'", "'Cover'", "p_type"),
)
_MORE = _group("More", ("'publisher_vn'", "'Publisher'", "concat(p_brand, ' Press')"))
_IDS = _group("Ids", ("'isbn13'", "'ISBN'", "concat('978', p_partkey)"))

# A second publisher overrides the first when p_size is a multiple of 7. When it is a multiple of
# 11, a group that is no object stands before the last group.
_SPECIFICATIONS = f"""concat('[', {_GENERAL}, ',',
    CASE WHEN p_size % 7 = 0 THEN {_MORE} ELSE '{{"name":"More","attributes":[]}}' END, ',',
    CASE WHEN p_size % 11 = 0 THEN '5,' ELSE '' END, {_IDS}, ']')"""

_DETAIL = {
    "product_id": "CASE WHEN p_size <= 40 THEN p_partkey END",
    "name": "p_name",
    "description": "concat('About ', p_name)",
    "short_description": "p_type",
    "price": """CASE WHEN p_size % 13 = 0 THEN 'n/a'
        ELSE cast(p_retailprice + e.more AS string) END""",
    "list_price": """CASE WHEN p_size % 5 = 0 THEN '0'
        ELSE cast(p_retailprice * 1.25D AS string) END""",
    "discount_rate": "20.0D",
    "rating_average": """CASE WHEN p_size = 3 THEN 'unknown'
        ELSE concat(p_size % 5 + 1, '.5') END""",
    "review_count": """CASE WHEN p_size % 4 = 0 THEN concat(p_size, '.5')
        ELSE cast(p_size AS string) END""",
    "inventory_status": "CASE WHEN p_size % 2 = 0 THEN 'available' ELSE 'out_of_stock' END",
    "specifications": _SPECIFICATIONS,
    "images": "to_json(array(concat('img/', p_partkey)))",
    "categories": "to_json(named_struct('id', p_size, 'name', p_type))",
    "url_key": "concat('book-', p_partkey)",
    "sku": "concat('SKU-', p_partkey)",
    "extracted_at": "e.stamp",
}


def detail_raw(part: DataFrame) -> DataFrame:
    """Every part in two extractions; parts over size 40 came back without an id."""
    runs = """explode(array(named_struct('stamp', '20240101_000000', 'more', 1.0D),
        named_struct('stamp', '20240201_000000', 'more', 0.0D))) AS e"""
    return _columns(part.selectExpr("*", runs), _DETAIL)


_K = "cast(get_json_object(props, '$.k') AS bigint)"
_STARS = """CASE event_type WHEN 'purchase' THEN '5' WHEN 'view' THEN '4' WHEN 'click' THEN '3'
    WHEN 'signup' THEN '2.5' ELSE 'x' END"""
_EPOCH = "unix_timestamp(cast(ts AS timestamp))"

_REVIEWS = {
    "review_id": "event_id",
    "product_id": f"""CASE WHEN {_K} <> 0
        THEN CASE WHEN event_type = 'error' THEN -1 - user_id ELSE user_id END END""",
    "rating": _STARS,
    "title": "CASE WHEN event_type = 'signup' THEN '  ' ELSE event_type END",
    "content": "props",
    "thank_count": f"{_K} + again",
    "created_at": f"""CASE event_id % 3 WHEN 0 THEN cast({_EPOCH} AS string)
        WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE 'n/a' END""",
    "reviewer_name": f"CASE WHEN {_K} % 10 = 3 THEN ' ' ELSE concat('user ', user_id) END",
    "reviewer_purchased": "event_type = 'purchase'",
    "extracted_at": f"""date_format(
        cast(ts AS timestamp) + make_dt_interval(again), '{RUN_STAMP}')""",
}


def reviews_raw(events: DataFrame) -> DataFrame:
    """Every event is a review, extracted at once and again a day later with one more thank.

    Errors review unknown products; events with k = 0 came back without a product.
    """
    return _columns(events.selectExpr("*", "explode(array(0, 1)) AS again"), _REVIEWS)


_PRICE_RUNS = {
    "product_id": "user_id",
    "name": "concat('Book ', user_id, ' of ', event_id)",
    "price": """CASE event_type WHEN 'click' THEN 10.0D WHEN 'purchase' THEN 30.0D
        WHEN 'signup' THEN 40.0D WHEN 'view' THEN 50.0D END""",
    "original_price": "value",
    "discount_rate": f"{_K} % 2 * 10.0D",
    "brand_name": "concat('Brand ', user_id)",
    "seen_at": "ts",
    "extracted_at": f"date_format(date_trunc('day', cast(ts AS timestamp)), '{RUN_STAMP}')",
}


def price_runs(events: DataFrame) -> DataFrame:
    """Daily runs of a catalogue: the event type sets the price of product `user_id`, `k` its rate.

    Users without an event on a day are absent from that run. `seen_at` orders rows of one run.
    """
    return _columns(events, _PRICE_RUNS)


def _offer(product: str, sku: str, seller: str, price: str) -> str:
    return f"""named_struct('id', {product}, 'sku', concat('{sku}', {product}),
        'name', concat('Book ', {product}), 'seller_id', {seller}, 'price', {price},
        'review_count', cast(l_linenumber AS double), 'quantity_sold', CASE WHEN l_returnflag <> 'N'
            THEN named_struct('text', 'sold', 'value', {_UNITS}) END,
        'has_ebook', l_linestatus = 'O', 'badges', array('badge'))"""


def listing_payload(lineitem: DataFrame) -> DataFrame:
    """One listing page per order line: the part, and the part as its supplier offers it.

    The supplier's numbers come as text, review counts as `4.0`; `badges` is a field that nobody
    reads yet.
    """
    line = _offer("l_partkey", "SKU-", "l_suppkey", "l_extendedprice")
    own = _offer(
        "cast(l_suppkey AS string)", "OWN-", "cast(NULL AS bigint)", "cast(l_tax AS string)"
    )
    page = f"named_struct('data', array({line}, {own}))"
    return lineitem.selectExpr(f"to_json({page}) AS payload")


def detail_payload(part: DataFrame) -> DataFrame:
    """One product response per part; odd sizes lack categories, multiples of 3 lack images."""
    images = """array(
        named_struct('base_url', concat('img/', p_partkey), 'position', p_size),
        named_struct('base_url', cast(NULL AS string), 'position', p_size))"""
    specifications = """array(named_struct('name', 'General',
        'attributes', array(named_struct('code', 'brand', 'value', p_brand))))"""
    response = f"""named_struct('id', p_partkey, 'name', p_name,
        'description', concat('About ', p_name), 'price', p_retailprice,
        'review_count', p_size, 'specifications', {specifications},
        'images', CASE WHEN p_size % 3 <> 0 THEN {images} END,
        'categories', CASE WHEN p_size % 2 = 0
            THEN named_struct('id', p_size, 'name', p_type) END,
        'sku', concat('SKU-', p_partkey))"""
    return part.selectExpr(f"to_json({response}) AS payload")


def reviews_payload(events: DataFrame, faults: bool = False) -> DataFrame:
    """One review page per event: its author's review, and one whose author is unknown.

    Pages of viewers report as many reviews as the event's k. With `faults`, every fifth error is
    cut off, clicks report their total as text, and signups report none that is a number.
    """
    author = """named_struct('name', concat('user ', user_id),
        'purchased', event_type = 'purchase')"""

    def review(shift: int, by: str) -> str:
        return f"""named_struct('id', event_id * 2 + {shift}, 'rating', {_STARS},
            'title', event_type, 'thank_count', {_K} + {shift}, 'created_at', {_EPOCH},
            'created_by', {by})"""

    nobody = f"CASE WHEN false THEN {author} END"
    total = f"CASE WHEN event_type = 'view' THEN {_K} ELSE 2L END"
    if faults:
        total = f"""CASE event_type WHEN 'signup' THEN 'n/a' ELSE cast({total} AS string) END"""
    page = f"""named_struct('data', array({review(0, author)}, {review(1, nobody)}),
        'paging', named_struct('total', {total}))"""
    text = f"to_json({page})"
    if faults:
        cut = "event_type = 'error' AND event_id % 5 = 0"
        text = f"CASE WHEN {cut} THEN left({text}, 40) ELSE {text} END"
    return events.selectExpr("user_id AS product_id", f"{text} AS payload")
