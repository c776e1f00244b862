"""Bronze rows to clean rows, one function per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.functions.specs import KNOWN_SPECS, SPEC_PREFIX, spec_items
from shelfmark.operators.losses import converted
from shelfmark.operators.rows import drop_if_present, drop_null_keys, latest_per_key
from shelfmark.sources.tables import materialize

# Listing columns that the detail record holds in better shape.
LISTING_DROPPED = ["author_name", "short_description", "inventory_status"]

# So many keys become columns, the most frequent first; the values of all others go into a map.
MAX_SPEC_KEYS = 2000
MORE_SPECS = "specs_more"


def _typed(df: DataFrame, name: str) -> tuple[Column, object]:
    return F.col(name), df.schema[name].dataType


def listing_conversions(df: DataFrame) -> dict[str, Column]:
    """What a listing's columns are read as, where a value may fail to be read."""
    return {"quantity_sold": S.extract_quantity(*_typed(df, "quantity_sold"))}


def detail_conversions(df: DataFrame) -> dict[str, Column]:
    return {
        "rating_average": S.to_number(*_typed(df, "rating_average")),
        "review_count": S.to_int_nullable(S.to_number(*_typed(df, "review_count"))),
        "price": S.to_number(*_typed(df, "price")),
        "list_price": S.to_number(*_typed(df, "list_price")),
    }


def review_conversions(df: DataFrame) -> dict[str, Column]:
    return {
        "rating": S.to_int_nullable(S.to_number(*_typed(df, "rating"))),
        "created_at": S.parse_created_at(*_typed(df, "created_at")),
    }


def clean_listing(
    df: DataFrame, ties: Sequence[str] | None = None, lost: Observation | None = None
) -> DataFrame:
    """Latest row per id; quantity as integer; list price 0 as null.

    Here and below, `lost` counts the values of kept rows that could not be read, by column.
    """
    latest = drop_if_present(latest_per_key(df, ["id"], ties=ties), LISTING_DROPPED)
    read = converted(latest, listing_conversions(df), lost)
    if "list_price" not in df.columns:
        return read
    return read.withColumn("list_price", S.zero_to_null(*_typed(df, "list_price")))


def clean_detail(
    df: DataFrame,
    spec_keys: Sequence[str] | None = KNOWN_SPECS,
    ties: Sequence[str] | None = None,
    lost: Observation | None = None,
) -> DataFrame:
    """Latest row per product; tolerant numbers; one `spec_` column per specification key.

    With `spec_keys=None` the columns are the known keys and every other key of the latest rows.
    """
    latest = latest_per_key(df, ["product_id"], ties=ties)
    if spec_keys is None:
        # The latest rows are read twice, for their keys and for their values.
        latest = materialize(latest, "latest_detail")
        pivoted = pivot_all_specs(latest, "specifications", KNOWN_SPECS)
    else:
        pivoted = pivot_specs(latest, "specifications", spec_keys)
    read = converted(pivoted, detail_conversions(df), lost)
    return read.withColumn("list_price", S.zero_to_null(F.col("list_price")))


def clean_reviews(
    df: DataFrame, ties: Sequence[str] | None = None, lost: Observation | None = None
) -> DataFrame:
    """Rows with both ids, latest per review; rating as integer; creation time in UTC."""
    keyed = drop_null_keys(df, ["product_id", "review_id"])
    return converted(latest_per_key(keyed, ["review_id"], ties=ties), review_conversions(df), lost)


def flatten_specs(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """One row per attribute: (id, group position, attribute position, key, value)."""
    # The outer form, since for the plain one Spark reads the text again for an inferred filter.
    items = df.select(id_col, F.explode_outer(spec_items(F.col(col))).alias("item"))
    return items.where(F.col("item").isNotNull()).select(id_col, "item.gi", "item.ai", "item.k", "item.v")


def _quoted(text: str) -> str:
    """A SQL string literal; keys come from the data."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pivot_specs(
    df: DataFrame,
    col: str,
    spec_keys: Sequence[str] = KNOWN_SPECS,
    more: str | None = None,
) -> DataFrame:
    """Replace the specification text by one column per key, null where the key is absent.

    `more` names a map column for the keys that have no column of their own. Works inside the row:
    no explode, no grouping and no join back, hence no shuffle.
    """
    names = [k if k.startswith(SPEC_PREFIX) else SPEC_PREFIX + k for k in spec_keys]
    items, keys, values = "__items", "__keys", "__values"
    # Read backwards: the first match is the last attribute of that key.
    listed = df.withColumn(items, spec_items(F.col(col))).withColumns(
        {keys: F.reverse(F.col(items)["k"]), values: F.reverse(F.col(items)["v"])}
    )

    last = {
        name: F.expr(f"get({values}, cast(array_position({keys}, {_quoted(name)}) AS int) - 1)")
        for name in names
    }
    if more is not None:
        named = F.array(*(F.lit(name) for name in names))
        others = F.array_except(keys, named)
        last[more] = F.map_from_arrays(
            others, F.transform(others, lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1))
        )
    return listed.withColumns(last).drop(items, keys, values, col)


def pivot_all_specs(
    df: DataFrame, col: str, known: Sequence[str] = (), limit: int = MAX_SPEC_KEYS
) -> DataFrame:
    """`pivot_specs` by the `known` keys and the keys that occur; no value is lost.

    Where more than `limit` keys occur, the most frequent become columns and the values of all others
    go into the map `MORE_SPECS`. Reads `df` twice, for its keys and for its values.
    """
    first = [SPEC_PREFIX + key for key in known]
    found = discover_spec_keys(df, col, limit + 1)
    more = MORE_SPECS if len(found) > limit else None
    if more is not None:
        found = discover_spec_keys(df, col, limit)
    return pivot_specs(df, col, first + [key for key in found if key not in first], more)


def discover_spec_keys(df: DataFrame, col: str, limit: int = MAX_SPEC_KEYS) -> list[str]:
    """The `limit` most frequent keys, sorted: for tables whose columns follow the data.

    Keys are counted per task before the shuffle; no more than the width of a table comes back.
    """
    keys = df.select(F.explode_outer(spec_items(F.col(col))["k"]).alias("k"))
    counts = keys.where(F.col("k").isNotNull()).groupBy("k").count()
    return sorted(row["k"] for row in counts.orderBy(F.desc("count"), "k").limit(limit).collect())
