"""For every registered query the SQL it must equal, over the base tables.

The SQL computes what the planted values must become straight from the base columns; it never
reads the JSON or the text that the queries parse.
"""

from __future__ import annotations

from shelfmark.functions.specs import KNOWN_SPECS

ORACLE_SQL: dict[str, str] = {}

# Every order line as a product extraction, with quantity and list price already clean.
_LISTING_ALL = """
listing_all AS (
  SELECT l_partkey AS product_id,
         'SKU-' || l_partkey AS sku,
         CASE WHEN l_linenumber = 7 THEN '  ' ELSE 'Book ' || l_partkey END AS name,
         'book-' || l_partkey AS url_key,
         'book-' || l_partkey || '.html' AS url_path,
         l_linestatus AS type,
         l_suppkey AS seller_id,
         l_orderkey * 10 + l_linenumber AS seller_product_id,
         CASE WHEN l_quantity = 1 THEN -(l_extendedprice * (1 - l_discount))
              WHEN l_quantity <> 2 THEN l_extendedprice * (1 - l_discount) END AS price,
         CASE WHEN l_discount = 0 THEN NULL
              WHEN l_tax = 0.08 THEN l_extendedprice * 0.9e0
              ELSE l_extendedprice END AS list_price,
         l_extendedprice AS original_price,
         l_extendedprice * l_discount AS discount,
         l_discount AS discount_rate,
         CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'O')
              THEN l_linenumber * 0.8e0 END AS rating_average,
         CASE WHEN l_linenumber = 5 THEN NULL
              WHEN l_returnflag = 'N' THEN 0
              ELSE CAST(l_quantity AS BIGINT) * 2 END AS review_count,
         CAST(l_linenumber AS BIGINT) AS order_count,
         l_suppkey AS favourite_count,
         CASE WHEN l_orderkey % 6 < 4 THEN CAST(l_quantity AS BIGINT) END AS quantity_sold,
         'Brand ' || l_suppkey AS brand_name,
         lower(l_returnflag) AS book_cover,
         l_linestatus = 'O' AS has_ebook,
         l_returnflag = 'R' AS bundle_deal,
         l_tax > 0.02 AS shippable,
         l_linenumber < 7 AS is_visible,
         FALSE AS is_flower,
         FALSE AS is_gift_card,
         CAST(1 AS BIGINT) AS availability,
         'stock' AS inventory,
         l_linestatus AS salable_type,
         'item ' || l_linenumber AS stock_item,
         '1/2/' || l_suppkey AS primary_category_path,
         l_suppkey AS productset_id,
         'set ' || l_returnflag AS productset_group_name,
         'thumb/' || l_partkey AS thumbnail_url,
         CAST(280 AS BIGINT) AS thumbnail_width,
         CAST(280 AS BIGINT) AS thumbnail_height,
         'review/' || l_partkey AS url_review,
         strftime(l_shipdate, '%Y%m%d_%H%M%S') AS extracted_at
  FROM lineitem)"""

_LISTING = (
    _LISTING_ALL
    + """,
listing AS (
  SELECT * FROM listing_all
  QUALIFY row_number() OVER (
    PARTITION BY product_id
    ORDER BY extracted_at DESC, seller_product_id DESC, seller_id DESC, original_price DESC) = 1)"""
)

_PUBLISHER = "CASE WHEN p_size % 7 = 0 THEN p_brand || ' Press' ELSE p_brand END"
_ISBN = "CASE WHEN p_size % 11 <> 0 THEN '978' || p_partkey END"
_SPEC_VALUES = {
    "publisher_vn": _PUBLISHER,
    "number_of_page": "CAST(p_size AS VARCHAR)",
    "book_cover": "p_type",
    "isbn13": _ISBN,
}


def _spec_columns(keys: list[str]) -> str:
    return ", ".join(
        f"{_SPEC_VALUES.get(k, 'CAST(NULL AS VARCHAR)')} AS spec_{k}" for k in keys
    )


# Every part as its latest detail.
_DETAIL_ALL = f"""
detail_all AS (
  SELECT CASE WHEN p_size <= 40 THEN p_partkey END AS product_id,
         'SKU-' || p_partkey AS sku,
         p_name AS name,
         'book-' || p_partkey AS url_key,
         p_type AS short_description,
         'About ' || p_name AS description,
         '["img/' || p_partkey || '"]' AS images,
         '{{"id":' || p_size || ',"name":"' || p_type || '"}}' AS categories,
         CASE WHEN p_size % 13 <> 0 THEN p_retailprice END AS price,
         CASE WHEN p_size % 5 <> 0 THEN p_retailprice * 1.25e0 END AS list_price,
         20.0e0 AS discount_rate,
         CASE WHEN p_size <> 3 THEN p_size % 5 + 1.5e0 END AS rating_average,
         CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS BIGINT) END AS review_count,
         CASE WHEN p_size % 2 = 0 THEN 'available' ELSE 'out_of_stock' END AS inventory_status,
         {_spec_columns(KNOWN_SPECS)},
         '20240201_000000' AS extracted_at
  FROM part)"""

_DETAIL = _DETAIL_ALL + """,
detail AS (SELECT * FROM detail_all WHERE product_id IS NOT NULL)"""

_FROM_DETAIL = """short_description spec_publisher_vn spec_publication_date spec_book_cover
    spec_number_of_page spec_language_book spec_book_version spec_isbn13 spec_brand spec_origin
    spec_dich_gia spec_edition spec_dimensions inventory_status categories""".split()

_BOOKS = f"""{_LISTING},{_DETAIL},
books AS (
  SELECT l.* EXCLUDE (is_flower, is_gift_card, stock_item, thumbnail_width, thumbnail_height),
         CASE WHEN l.list_price > 0
              THEN round((l.list_price - l.price) * 100e0 / l.list_price * 100e0, 0) / 100e0
              ELSE 0e0 END AS discount_pct,
         l.review_count IS NOT NULL AND l.review_count > 0 AS has_reviews,
         {", ".join("d." + c for c in _FROM_DETAIL)}
  FROM listing l LEFT JOIN detail d ON l.product_id = d.product_id)"""

_K = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"

# Every event as a review, twice: as extracted first (again = 0) and a day later (again = 1).
_REVIEWS_ALL = f"""
reviews_all AS (
  SELECT event_id AS review_id,
         CASE WHEN {_K} = 0 THEN NULL WHEN event_type = 'error' THEN -1 - user_id
              ELSE user_id END AS product_id,
         CASE event_type WHEN 'purchase' THEN 5 WHEN 'view' THEN 4 WHEN 'click' THEN 3 END
           ::BIGINT AS rating,
         CASE WHEN event_type = 'signup' THEN '  ' ELSE event_type END AS title,
         props AS content,
         {_K} + again AS thank_count,
         CASE WHEN {_K} % 10 = 3 THEN ' ' ELSE 'user ' || user_id END AS reviewer_name,
         event_type = 'purchase' AS reviewer_purchased,
         CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS created_at,
         strftime(ts + to_days(CAST(again AS INTEGER)), '%Y%m%d_%H%M%S') AS extracted_at,
         again
  FROM events, range(2) AS runs(again))"""

_REVIEWS = _REVIEWS_ALL + """,
stg_reviews AS (
  SELECT * EXCLUDE (again) FROM reviews_all WHERE again = 1 AND product_id IS NOT NULL)"""

_FACTS = f"""{_BOOKS},{_REVIEWS},
reviews AS (
  SELECT r.*, b.name AS product_name, b.primary_category_path, b.brand_name, b.price,
         b.discount_pct, b.rating_average, b.spec_publisher_vn, b.spec_language_book,
         b.spec_isbn13
  FROM stg_reviews r LEFT JOIN books b ON r.product_id = b.product_id)"""


def _add(name: str, sql: str, ctes: str = "") -> None:
    ORACLE_SQL[name] = f"WITH {ctes}\n{sql.strip()}" if ctes else sql.strip()


def _avg(expression: str) -> str:
    """Average to six places, half up, from a whole-number sum of the values times 10^8."""
    total = f"sum(CAST(round(({expression}) * 1e8) AS HUGEINT))"
    n = f"count({expression})"
    return f"sign({total}) * ((2 * abs({total}) + 100 * {n}) // (200 * {n})) / 1e6"


# --- sources and sinks -----------------------------------------------------------------------

_add(
    "bronze_union",
    """
SELECT product_id AS id, seller_id, seller_product_id, price,
       CASE WHEN book_cover = 'a' THEN NULL
            ELSE CASE WHEN discount_rate = 0 THEN 0e0 ELSE list_price END END AS list_price,
       type, book_cover, CASE WHEN book_cover = 'r' THEN type END AS note
FROM listing_all""",
    _LISTING_ALL,
)
_add(
    "latest_run_file",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag
FROM lineitem WHERE l_returnflag = 'R'""",
)
_add(
    "bronze_append",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag,
       CASE l_returnflag WHEN 'A' THEN '20240101_000000' WHEN 'N' THEN '20240102_000000'
            ELSE '20240103_000000' END AS run
FROM lineitem""",
)
_add(
    "stamp_run",
    """
SELECT l_orderkey, l_linenumber, l_partkey, '20240301_000000' AS extracted_at FROM lineitem""",
)
_add(
    "checkpoint_overlap",
    "SELECT product_id AS id, seller_product_id, price, extracted_at FROM listing",
    _LISTING,
)
_add(
    "nested_to_json",
    """
SELECT event_id, value,
       '{"user":' || user_id || ',"kind":'
         || CASE WHEN event_type = 'error' THEN 'null' ELSE '"' || event_type || '"' END
         || '}' AS pair,
       '[' || event_id || ',' || user_id || ']' AS ids,
       '{"' || event_type || '":' || user_id || '}' AS by_kind
FROM events""",
)
_add(
    "silver_write",
    f"""
SELECT 'silver_listing' AS "table", count(*) AS "rows" FROM listing
UNION ALL
SELECT 'silver_detail', count(*) + count(DISTINCT CASE WHEN p_size > 40 THEN 1 END)
         - count(CASE WHEN p_size > 40 THEN 1 END) FROM part
UNION ALL
SELECT 'silver_reviews', count(*) FROM stg_reviews""",
    f"{_LISTING},{_REVIEWS}",
)
_add(
    "mart_write",
    "SELECT review_id, product_id, product_name, price, spec_publisher_vn FROM reviews",
    _FACTS,
)
_add(
    "row_audit",
    f"""
SELECT entity, rows_in, rows_out, rows_in - rows_out AS dropped FROM (
  SELECT 'listing' AS entity, count(*) AS rows_in, count(DISTINCT l_partkey) AS rows_out
  FROM lineitem
  UNION ALL
  SELECT 'detail', 2 * count(*),
         count(DISTINCT CASE WHEN p_size <= 40 THEN p_partkey ELSE -1 END) FROM part
  UNION ALL
  SELECT 'reviews', 2 * count(*), count(CASE WHEN {_K} <> 0 THEN 1 END) FROM events)""",
)

# --- payloads --------------------------------------------------------------------------------

_add(
    "listing_from_payload",
    """
SELECT CASE own WHEN 0 THEN l_partkey ELSE l_suppkey END AS id,
       CASE own WHEN 0 THEN 'SKU-' || l_partkey ELSE 'OWN-' || l_suppkey END AS sku,
       'Book ' || CASE own WHEN 0 THEN l_partkey ELSE l_suppkey END AS name,
       CASE own WHEN 0 THEN l_suppkey END AS seller_id,
       CASE own WHEN 0 THEN l_extendedprice ELSE l_tax END AS price,
       CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) END AS quantity_sold,
       CAST(l_linenumber AS BIGINT) AS review_count,
       l_linestatus = 'O' AS has_ebook,
       CAST(NULL AS VARCHAR) AS brand_name, 'badge' AS badge,
       '20240301_000000' AS extracted_at
FROM lineitem, range(2) AS offers(own)""",
)
_add(
    "detail_from_payload",
    """
SELECT p_partkey AS product_id, p_name AS name, 'About ' || p_name AS description,
       CAST(NULL AS VARCHAR) AS short_description, p_retailprice AS price,
       CAST(NULL AS DOUBLE) AS list_price, CAST(p_size AS BIGINT) AS review_count,
       p_brand AS first_spec, 'SKU-' || p_partkey AS sku, '20240301_000000' AS extracted_at
FROM part""",
)
_add(
    "images_project",
    """
SELECT p_partkey AS product_id,
       CASE WHEN p_size % 3 <> 0 THEN '["img/' || p_partkey || '",null]' ELSE '[]' END AS images
FROM part""",
)
_add(
    "spec_to_text",
    """
SELECT p_partkey AS product_id, 0 AS gi, 0 AS ai, 'spec_brand' AS k, p_brand AS v FROM part""",
)
_add(
    "categories_to_text",
    """
SELECT p_partkey AS product_id, p_size % 2 <> 0 AS "without",
       CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS category_id,
       CASE WHEN p_size % 2 = 0 THEN p_type END AS category
FROM part""",
)
_add(
    "reviews_from_payload",
    f"""
SELECT event_id * 2 + shift AS review_id, user_id AS product_id,
       CASE event_type WHEN 'purchase' THEN '5' WHEN 'view' THEN '4' WHEN 'click' THEN '3'
            WHEN 'signup' THEN '2.5' ELSE 'x' END AS rating,
       event_type AS title, CAST(NULL AS VARCHAR) AS content,
       {_K} + shift AS thank_count,
       CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS created_at,
       CASE shift WHEN 0 THEN 'user ' || user_id END AS reviewer_name,
       CASE shift WHEN 0 THEN event_type = 'purchase' END AS reviewer_purchased,
       '20240301_000000' AS extracted_at
FROM events, range(2) AS pair(shift)""",
)
_add(
    "review_total_reached",
    f"""
SELECT *, unreadable = 0 AND collected >= reported AS complete
FROM (SELECT user_id AS product_id, 2 * count(CASE WHEN NOT cut THEN 1 END) AS collected,
             coalesce(max(CASE WHEN NOT cut AND event_type <> 'signup' THEN
                 CASE WHEN event_type = 'view' THEN {_K} ELSE 2 END END), 0) AS reported,
             count(CASE WHEN cut OR event_type = 'signup' THEN 1 END) AS unreadable
      FROM (SELECT *, event_type = 'error' AND event_id % 5 = 0 AS cut FROM events)
      GROUP BY user_id)""",
)
_add(
    "page_audit",
    """
SELECT count(*) AS pages,
       count(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 END) AS unreadable
FROM events""",
)
_add(
    "distinct_work_list",
    """
SELECT l_partkey AS product_id FROM lineitem WHERE l_returnflag = 'N'
UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N'""",
)

# --- cleaning --------------------------------------------------------------------------------

_add(
    "latest_per_key",
    """
SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seller_product_id,
       l_suppkey AS seller_id,
       CASE WHEN l_quantity = 1 THEN -(l_extendedprice * (1 - l_discount))
            WHEN l_quantity <> 2 THEN l_extendedprice * (1 - l_discount) END AS price,
       CASE l_orderkey % 6
            WHEN 0 THEN units WHEN 1 THEN units || '.7'
            WHEN 2 THEN '{"text":"sold","value":' || units || '}'
            WHEN 3 THEN '"' || units || '"' WHEN 4 THEN 'n/a' END AS quantity_sold,
       strftime(l_shipdate, '%Y%m%d_%H%M%S') AS extracted_at
FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS units FROM lineitem)
QUALIFY row_number() OVER (
  PARTITION BY l_partkey
  ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_suppkey DESC,
           l_extendedprice DESC) = 1""",
)
_add(
    "latest_per_key_detail",
    """
SELECT CASE WHEN p_size <= 40 THEN p_partkey END AS product_id, 'SKU-' || p_partkey AS sku,
       CASE WHEN p_size % 13 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS price,
       '20240201_000000' AS extracted_at
FROM part
QUALIFY row_number() OVER (
  PARTITION BY CASE WHEN p_size <= 40 THEN p_partkey END ORDER BY 'SKU-' || p_partkey DESC) = 1""",
)
_add(
    "latest_per_key_reviews",
    "SELECT review_id, product_id, thank_count, extracted_at FROM reviews_all WHERE again = 1",
    _REVIEWS_ALL,
)
_add(
    "clean_listing",
    """
SELECT product_id AS id, name, price, list_price, quantity_sold, extracted_at FROM listing""",
    _LISTING,
)
_add(
    "clean_detail",
    """
SELECT product_id, price, list_price, rating_average, review_count, spec_publisher_vn
FROM detail""",
    _DETAIL,
)
_add("clean_reviews", "SELECT * FROM stg_reviews", _REVIEWS)
_add(
    "conversion_losses",
    """
SELECT 'listing' AS entity, 'quantity_sold' AS "column",
       count(*) FILTER (seller_product_id // 10 % 6 = 4) AS rows_lost FROM listing
UNION ALL SELECT 'detail', 'price', count(*) FILTER (p_size % 13 = 0) FROM part WHERE p_size <= 40
UNION ALL SELECT 'detail', 'list_price', 0
UNION ALL SELECT 'detail', 'rating_average', count(*) FILTER (p_size = 3) FROM part WHERE p_size <= 40
UNION ALL SELECT 'detail', 'review_count', count(*) FILTER (p_size % 4 = 0) FROM part WHERE p_size <= 40
UNION ALL SELECT 'reviews', 'rating', count(*) FILTER (rating IS NULL) FROM stg_reviews
UNION ALL SELECT 'reviews', 'created_at', count(*) FILTER (created_at IS NULL) FROM stg_reviews""",
    _LISTING + "," + _REVIEWS,
)
_add(
    "drop_null_keys",
    """
SELECT review_id, product_id, extracted_at FROM reviews_all WHERE product_id IS NOT NULL""",
    _REVIEWS_ALL,
)
_add(
    "extract_quantity",
    "SELECT product_id AS id, seller_product_id, quantity_sold FROM listing_all",
    _LISTING_ALL,
)
_add(
    "zero_to_null",
    "SELECT product_id AS id, seller_product_id, list_price FROM listing_all",
    _LISTING_ALL,
)
_add("drop_if_present", "SELECT product_id AS id, sku, price FROM listing_all", _LISTING_ALL)
_add(
    "flatten_specs",
    f"""
SELECT 'SKU-' || p_partkey AS sku, gi, ai, k, v
FROM (
  SELECT p_partkey, 0 AS gi, 0 AS ai, 'spec_publisher_vn' AS k, p_brand AS v FROM part
  UNION ALL SELECT p_partkey, 0, 1, 'spec_number_of_page', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 0, 2, 'spec_book_cover', p_type FROM part
  UNION ALL SELECT p_partkey, 1, 0, 'spec_publisher_vn', p_brand || ' Press' FROM part
            WHERE p_size % 7 = 0
  UNION ALL SELECT p_partkey, 2, 0, 'spec_isbn13', '978' || p_partkey FROM part
            WHERE p_size % 11 <> 0), range(2)""",
)
_EXTRACTIONS = "(VALUES ('20240101_000000', 1e0), ('20240201_000000', 0e0)) AS runs(stamp, more)"
_add(
    "pivot_specs",
    f"""
SELECT 'SKU-' || p_partkey AS sku, stamp AS extracted_at, {_spec_columns(KNOWN_SPECS)}
FROM part, {_EXTRACTIONS}""",
)
_add(
    "pivot_specs_discovered",
    f"""
SELECT 'SKU-' || p_partkey AS sku, stamp AS extracted_at, {_spec_columns(list(_SPEC_VALUES))}
FROM part, {_EXTRACTIONS}""",
)
_add(
    "to_number",
    f"""
SELECT 'SKU-' || p_partkey AS sku, stamp AS extracted_at,
       CASE WHEN p_size % 13 <> 0 THEN p_retailprice + more END AS price,
       CASE WHEN p_size <> 3 THEN p_size % 5 + 1.5e0 END AS rating_average
FROM part, {_EXTRACTIONS}""",
)
_add(
    "to_int_nullable",
    "SELECT review_id, extracted_at, rating FROM reviews_all",
    _REVIEWS_ALL,
)
_add(
    "parse_created_at",
    "SELECT review_id, extracted_at, created_at FROM reviews_all",
    _REVIEWS_ALL,
)
_add(
    "missing_normalise",
    """
SELECT 2 * count(*) AS details, 2 * count(*) AS with_publisher,
       2 * count(CASE WHEN p_size % 11 <> 0 THEN 1 END) AS with_isbn13,
       2 * count(CASE WHEN p_size % 11 = 0 THEN 1 END) AS without_isbn13,
       CAST(0 AS BIGINT) AS with_edition
FROM part""",
)

# --- staging and facts -----------------------------------------------------------------------

_add("stg_listing", "SELECT * FROM listing", _LISTING)
_add("stg_detail", "SELECT * FROM detail", _DETAIL)
_add("stg_reviews", "SELECT * FROM stg_reviews", _REVIEWS)
_add("fct_books", "SELECT * FROM books", _BOOKS)
_add(
    "books_narrow",
    """
SELECT product_id, name, primary_category_path, brand_name, price, discount_pct, rating_average,
       spec_publisher_vn, spec_language_book, spec_isbn13 FROM books""",
    _BOOKS,
)
_add(
    "snapshot_source",
    """
SELECT product_id, name, price, original_price, discount_rate, brand_name, extracted_at
FROM books""",
    _BOOKS,
)
_add("fct_reviews", "SELECT * FROM reviews", _FACTS)
_add(
    "discount_pct",
    """
SELECT product_id AS id, seller_product_id,
       CASE WHEN list_price > 0
            THEN round((list_price - price) * 100e0 / list_price * 100e0, 0) / 100e0
            ELSE 0e0 END AS discount_pct
FROM listing_all""",
    _LISTING_ALL,
)
_add(
    "has_reviews",
    """
SELECT product_id AS id, seller_product_id, review_count,
       review_count IS NOT NULL AND review_count > 0 AS has_reviews
FROM listing_all""",
    _LISTING_ALL,
)
_add(
    "orphan_reviews",
    """
SELECT review_id, product_id, title, thank_count FROM stg_reviews
WHERE product_id NOT IN (SELECT l_partkey FROM lineitem)""",
    _REVIEWS,
)
_OVERCOUNT = """
SELECT b.product_id, b.name, b.review_count AS reported_review_count, a.crawled_review_count
FROM books b
JOIN (SELECT product_id, count(*) AS crawled_review_count FROM stg_reviews GROUP BY product_id) a
  ON b.product_id = a.product_id
WHERE a.crawled_review_count > b.review_count"""
_add("books_vs_actual_counts", _OVERCOUNT, f"{_BOOKS},{_REVIEWS}")

# --- history ---------------------------------------------------------------------------------

_HISTORY = f"""
states AS (
  SELECT user_id AS product_id, 'Book ' || user_id || ' of ' || event_id AS name,
         CASE event_type WHEN 'click' THEN 10e0 WHEN 'purchase' THEN 30e0
              WHEN 'signup' THEN 40e0 WHEN 'view' THEN 50e0 END AS price,
         value AS original_price, {_K} % 2 * 10e0 AS discount_rate,
         'Brand ' || user_id AS brand_name,
         strftime(ts, '%Y%m%d') || '_000000' AS extracted_at
  FROM events
  QUALIFY row_number() OVER (
    PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC) = 1),
runs AS (
  SELECT extracted_at, row_number() OVER (ORDER BY extracted_at) AS nr,
         lead(extracted_at) OVER (ORDER BY extracted_at) AS following
  FROM (SELECT DISTINCT extracted_at FROM states)),
marked AS (
  SELECT s.*, r.nr, r.following,
         CASE WHEN lag(nr) OVER by_run = nr - 1
               AND lag(price) OVER by_run IS NOT DISTINCT FROM price
               AND lag(discount_rate) OVER by_run IS NOT DISTINCT FROM discount_rate
              THEN 0 ELSE 1 END AS starts
  FROM states s JOIN runs r USING (extracted_at)
  WINDOW by_run AS (PARTITION BY product_id ORDER BY nr)),
islands AS (
  SELECT *, sum(starts) OVER (
    PARTITION BY product_id ORDER BY nr ROWS UNBOUNDED PRECEDING) AS island
  FROM marked),
history AS (
  SELECT product_id, first(name ORDER BY nr) AS name, first(price ORDER BY nr) AS price,
         first(original_price ORDER BY nr) AS original_price,
         first(discount_rate ORDER BY nr) AS discount_rate,
         first(brand_name ORDER BY nr) AS brand_name,
         min(extracted_at) AS extracted_at,
         strptime(min(extracted_at), '%Y%m%d_%H%M%S') AS valid_from,
         strptime(first(following ORDER BY nr DESC), '%Y%m%d_%H%M%S') AS valid_to
  FROM islands GROUP BY product_id, island)"""
_add("scd2_backfill", "SELECT * FROM history", _HISTORY)
_add("scd2_merge", "SELECT * FROM history", _HISTORY)
_add(
    "price_history",
    """
SELECT product_id, name, brand_name, price, discount_rate, valid_from,
       coalesce(valid_to, TIMESTAMP '2024-03-01 00:00:00') AS valid_to,
       valid_to IS NULL AS is_current,
       date_diff('day', valid_from, coalesce(valid_to, TIMESTAMP '2024-03-01 00:00:00'))
         AS days_at_price
FROM history""",
    _HISTORY,
)

# --- analytics -------------------------------------------------------------------------------

_TIER = """CASE WHEN discount_pct <= 0 THEN 'none' WHEN discount_pct <= 10 THEN '0-10'
     WHEN discount_pct <= 20 THEN '10-20' WHEN discount_pct <= 30 THEN '20-30'
     WHEN discount_pct <= 50 THEN '30-50' WHEN discount_pct > 50 THEN 'over 50' END"""
_BUCKET = "floor(price / 5000e0) * 5000e0"

_add(
    "kpi_cards",
    f"""
SELECT count(*) AS books, {_avg("price")} AS avg_price, {_avg("rating_average")} AS avg_rating,
       {_avg("CAST(has_reviews AS DOUBLE)")} AS share_with_reviews,
       (SELECT count(*) FROM stg_reviews) AS reviews
FROM books""",
    f"{_BOOKS},{_REVIEWS}",
)
_add(
    "price_distribution",
    f"""
SELECT {_BUCKET} AS price_from, count(*) AS books FROM books WHERE price IS NOT NULL GROUP BY 1""",
    _BOOKS,
)
_add(
    "rating_breakdown",
    """
SELECT CAST(floor(rating_average) AS BIGINT) AS rating, count(*) AS books
FROM books WHERE rating_average IS NOT NULL GROUP BY 1""",
    _BOOKS,
)
_add(
    "top_publishers",
    f"""
SELECT spec_publisher_vn, count(*) AS books, {_avg("price")} AS avg_price
FROM books WHERE spec_publisher_vn IS NOT NULL
GROUP BY 1 ORDER BY books DESC, spec_publisher_vn LIMIT 10""",
    _BOOKS,
)
_add(
    "discount_vs_rating",
    """
SELECT product_id, discount_pct, rating_average FROM books
WHERE discount_pct IS NOT NULL AND rating_average IS NOT NULL""",
    _BOOKS,
)


def _corr(x: str, y: str) -> str:
    return f"""
SELECT count(*) AS pairs, round(corr({x}, {y}) * 1e6, 0) / 1e6 AS corr FROM books
WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


_add("discount_rating_corr", _corr("discount_pct", "rating_average"), _BOOKS)
_add(
    "explore_books",
    f"""
SELECT product_id, name, price, rating_average, spec_publisher_vn FROM books
WHERE spec_publisher_vn IN ('Brand#1', 'Brand#2', 'Brand#3 Press', 'Brand#4')
  AND price BETWEEN 1000 AND 90000 AND rating_average BETWEEN 1 AND 5
  AND {_TIER} IN ('none', '0-10') AND contains(lower(name), 'book 1')
ORDER BY price DESC, product_id""",
    _BOOKS,
)
_add(
    "search_titles",
    """
SELECT product_id, name, price, rating_average, spec_publisher_vn FROM books
WHERE contains(lower(name), 'book 11') AND price BETWEEN 1000 AND 90000
ORDER BY price DESC, product_id""",
    _BOOKS,
)
_add(
    "reviews_by_star",
    """
SELECT rating, count(*) AS reviews,
       round(count(*) / sum(count(*)) OVER () * 1e6, 0) / 1e6 AS share
FROM stg_reviews WHERE rating BETWEEN 1 AND 5 GROUP BY rating""",
    _REVIEWS,
)
_add(
    "verified_split",
    f"""
SELECT reviewer_purchased, count(*) AS reviews, {_avg("rating")} AS avg_rating,
       {_avg("thank_count")} AS avg_thanks
FROM stg_reviews GROUP BY 1""",
    _REVIEWS,
)
_add(
    "most_helpful",
    """
SELECT review_id, product_id, product_name, rating, title, thank_count FROM reviews
ORDER BY thank_count DESC NULLS LAST, review_id LIMIT 10""",
    _FACTS,
)
_add(
    "discount_tiers",
    f"""
SELECT {_TIER} AS tier, count(*) AS books, {_avg("rating_average")} AS avg_rating,
       {_avg("quantity_sold")} AS avg_quantity_sold
FROM books WHERE discount_pct IS NOT NULL GROUP BY 1""",
    _BOOKS,
)
_add(
    "discount_by_publisher",
    f"""
SELECT spec_publisher_vn, {_avg("discount_pct")} AS avg_discount_pct
FROM books WHERE spec_publisher_vn IS NOT NULL GROUP BY 1""",
    _BOOKS,
)
_add(
    "price_vs_rating",
    f"""
SELECT {_BUCKET} AS price_from, count(*) AS books, {_avg("rating_average")} AS avg_rating
FROM books WHERE price IS NOT NULL GROUP BY 1""",
    _BOOKS,
)
_add("price_rating_corr", _corr("price", "rating_average"), _BOOKS)
_add(
    "price_vs_sales",
    f"""
SELECT {_BUCKET} AS price_from, count(*) AS books, {_avg("quantity_sold")} AS avg_quantity_sold
FROM books WHERE price IS NOT NULL GROUP BY 1""",
    _BOOKS,
)
_add("price_sales_corr", _corr("price", "quantity_sold"), _BOOKS)
_add(
    "underpriced_books",
    """
SELECT b.product_id, b.name, b.spec_publisher_vn, b.price, b.rating_average, b.review_count
FROM books b JOIN (
  SELECT spec_publisher_vn, median(price) AS mid_price, median(rating_average) AS mid_rating,
         median(review_count) AS mid_reviews
  FROM books WHERE spec_publisher_vn IS NOT NULL GROUP BY 1) m USING (spec_publisher_vn)
WHERE b.price < m.mid_price AND b.rating_average > m.mid_rating
  AND b.review_count > m.mid_reviews""",
    _BOOKS,
)

# --- data quality ----------------------------------------------------------------------------

_add("dq_not_null", "SELECT product_id, name, price FROM books WHERE price IS NULL", _BOOKS)
_add(
    "dq_unique",
    """
SELECT l_orderkey, l_linenumber, count(*) AS n_records FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
)
_add(
    "dq_unique_text",
    "SELECT text, count(*) AS n_records FROM documents GROUP BY 1 HAVING count(*) > 1",
)
_add(
    "dq_accepted_values",
    """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""",
)
_add(
    "dq_relationships",
    """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""",
)
_add(
    "dq_not_null_when",
    "SELECT rating_average, has_reviews FROM books WHERE has_reviews AND rating_average IS NULL",
    _BOOKS,
)
_add(
    "dq_not_empty_string",
    "SELECT review_id, reviewer_name FROM stg_reviews WHERE reviewer_name = ' '",
    _REVIEWS,
)
_add("dq_price_positive", "SELECT product_id, name, price FROM books WHERE price < 0", _BOOKS)
_add(
    "dq_discount_range",
    """
SELECT product_id, name, price, list_price, discount_pct FROM books
WHERE NOT discount_pct BETWEEN 0 AND 100""",
    _BOOKS,
)
_add(
    "dq_has_reviews_consistent",
    """
SELECT * FROM (
  SELECT product_id, name, has_reviews,
         CASE WHEN order_count < 3 THEN review_count ELSE favourite_count END AS review_count
  FROM books)
WHERE has_reviews <> (coalesce(review_count, 0) <> 0)""",
    _BOOKS,
)
_add(
    "dq_list_price_gte_price",
    """
SELECT product_id, name, price, list_price, discount_pct FROM books WHERE price > list_price""",
    _BOOKS,
)
_add(
    "dq_rating_range",
    """
SELECT product_id, name, rating_average, review_count FROM books
WHERE review_count > 0 AND NOT rating_average BETWEEN 1 AND 5""",
    _BOOKS,
)
_add("dq_review_count", _OVERCOUNT, f"{_BOOKS},{_REVIEWS}")
_add(
    "dq_review_orphans",
    """
SELECT review_id, product_id, reviewer_name FROM stg_reviews
WHERE product_id NOT IN (SELECT product_id FROM books)""",
    f"{_BOOKS},{_REVIEWS}",
)


def _report() -> str:
    def count(table: str, rule: str, condition: str) -> str:
        return (
            f"SELECT '{table}' AS \"table\", '{rule}' AS rule, "
            f"(SELECT count(*) FROM {source[table]} WHERE {condition}) AS violations"
        )

    source = {
        "stg_listing": "listing",
        "stg_detail": "detail",
        "stg_reviews": "stg_reviews",
        "books": "books",
        "reviews": "reviews",
    }
    not_null = {
        "stg_listing": ["product_id", "name", "price", "rating_average"],
        "stg_detail": ["product_id", "name", "price"],
        "stg_reviews": ["review_id", "product_id", "rating"],
        "books": ["product_id", "price", "rating_average", "discount_pct", "has_reviews", "name"],
        "reviews": ["review_id", "product_id", "rating"],
    }
    lines = [count(t, f"not_null({c})", f"{c} IS NULL") for t, cs in not_null.items() for c in cs]
    for table, cs in not_null.items():
        lines.append(
            f"SELECT '{table}', 'unique({cs[0]})', (SELECT count(*) FROM (SELECT {cs[0]} "
            f"FROM {source[table]} GROUP BY 1 HAVING count(*) > 1))"
        )
    rated = "rating NOT IN (1, 2, 3, 4, 5)"
    lines += [
        count("stg_reviews", "accepted_values(rating)", rated),
        count("reviews", "accepted_values(rating)", rated),
        count("reviews", "not_empty_string(reviewer_name)", "trim(reviewer_name) = ''"),
        count("reviews", "not_empty_string(title)", "trim(title) = ''"),
        count("books", "accepted_values(has_reviews)", "has_reviews NOT IN (TRUE, FALSE)"),
        count(
            "books",
            "not_null_when(rating_average, has_reviews)",
            "has_reviews AND rating_average IS NULL",
        ),
        count("books", "not_empty_string(name)", "trim(name) = ''"),
        count("books", "price_positive", "price < 0"),
        count("books", "discount_range", "NOT discount_pct BETWEEN 0 AND 100"),
        count("books", "has_reviews_consistent", "has_reviews <> (coalesce(review_count, 0) > 0)"),
        count("books", "list_price_gte_price", "list_price < price"),
        count(
            "books", "rating_range", "review_count > 0 AND NOT rating_average BETWEEN 1 AND 5"
        ),
        "SELECT 'books', 'review_count_matches_actual', "
        f"(SELECT count(*) FROM ({_OVERCOUNT}))",
    ]
    orphans = "product_id NOT IN (SELECT product_id FROM books)"
    lines += [
        count("reviews", "relationships(product_id)", orphans),
        count("reviews", "reviews_have_valid_product", orphans),
    ]
    union = "\nUNION ALL ".join(lines)
    return f"SELECT *, violations = 0 AS passed FROM ({union})"


_add("dq_report", _report(), _FACTS)
