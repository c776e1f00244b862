"""Specification text (groups of attributes) to key/value pairs, inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.json import END, bind, is_whole, parse_whole

# The specification columns the models name, in their order.
KNOWN_SPECS = [
    "publisher_vn",
    "publication_date",
    "dimensions",
    "book_cover",
    "number_of_page",
    "manufacturer",
    "language_book",
    "book_version",
    "isbn13",
    "brand",
    "origin",
    "brand_country",
    "dich_gia",
    "edition",
    "material",
    "seller_delivery_method",
    "is_warranty_applied",
    "bookcare_service",
    "warranty_form",
    "warranty_time_period",
    "organization_name",
    "organization_address",
    "service_highlight_2",
    "service_highlight_3",
]

SPEC_PREFIX = "spec_"

# The usual shape. Text that does not fit is read element by element instead.
_USUAL = """groups array<struct<attributes array<struct<code string, name string, value string>>>>,
    mark string"""
_STRICT = {"allowSingleQuotes": "false"}

# JSON texts of a code that counts as not given, and how a typed read shows them.
_EMPTY_CODE = ["null", '""', "0", "0.0", "false", "[]", "{}"]
_EMPTY_LOOK = ["", "null", "0", "0.0", "false", "[]", "{}"]

_ITEMS = "array<struct<ok:boolean,gi:int,ai:int,k:string,v:string>>"


def _key(label: Column) -> Column:
    return F.replace(F.lower(F.concat(F.lit(SPEC_PREFIX), label)), F.lit(" "), F.lit("_"))


def _item(ok: bool | Column, gi: Column, ai: Column, key: Column, value: Column) -> Column:
    return F.struct(
        (F.lit(ok) if isinstance(ok, bool) else ok).alias("ok"),
        gi.cast("int").alias("gi"),
        ai.cast("int").alias("ai"),
        key.alias("k"),
        value.alias("v"),
    )


def _usual_items(text: Column) -> Column:
    """Items of well-formed text; null when any element is unusual in shape or code."""

    def plain(attr: Column) -> Column:
        code = F.coalesce(attr["code"], F.lit(""))
        by_name = (code == "") & attr["name"].isNotNull()
        return attr.isNotNull() & (by_name | ~code.isin(_EMPTY_LOOK))

    def whole(group: Column) -> Column:
        listed = group["attributes"]
        return group.isNotNull() & listed.isNotNull() & F.forall(listed, plain)

    def items(group: Column, gi: Column) -> Column:
        def item(attr: Column, ai: Column) -> Column:
            code = attr["code"]
            label = F.when(code != "", code).otherwise(attr["name"])
            return _item(True, gi, ai, _key(label), attr["value"])

        return F.transform(group["attributes"], item)

    def flat(typed: Column) -> Column:
        groups = typed["groups"]
        usual = (typed["mark"] == END) & F.forall(groups, whole)
        return F.when(F.coalesce(usual, F.lit(False)), F.flatten(F.transform(groups, items)))

    marked = F.concat(F.lit('{"groups":'), text, F.lit(f',"mark":"{END}"}}'))
    return bind(F.from_json(marked, _USUAL, _STRICT), flat)


def _json(variant: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(variant, path, "variant"))


def _is_object(variant: Column) -> Column:
    return F.coalesce(F.startswith(F.to_json(variant), F.lit("{")), F.lit(False))


def _exact_items(text: Column) -> Column:
    """Items of any text, one at a time, up to the first malformed group or attribute."""
    nothing = F.lit(None).cast("string")

    def label(attr: Column) -> Column:
        code = _json(attr, "$.code")
        name = F.try_variant_get(attr, "$.name", "string")
        null_name = F.is_variant_null(F.try_variant_get(attr, "$.name", "variant"))
        given = code.isNotNull() & ~code.isin(_EMPTY_CODE)
        return F.when(given, F.try_variant_get(attr, "$.code", "string")).otherwise(
            F.coalesce(name, F.when(null_name, F.lit("none")), F.lit("unknown"))
        )

    def items(group: Column, gi: Column) -> Column:
        def item(attr: Column, ai: Column) -> Column:
            value = F.try_variant_get(attr, "$.value", "string")
            return _item(_is_object(attr), gi, ai, _key(label(attr)), value)

        bad = F.array(_item(False, gi, F.lit(-1), nothing, nothing))
        listed = F.try_variant_get(group, "$.attributes", "array<variant>")
        raw = _json(group, "$.attributes")
        # Absent, empty text and an empty object hold no attribute, which is no fault.
        empty = raw.isNull() | raw.isin('""', "{}")
        found = F.when(listed.isNotNull(), F.transform(listed, item))
        found = found.when(empty, F.slice(bad, 1, 0)).otherwise(bad)
        return F.when(_is_object(group), found).otherwise(bad)

    def until_bad(found: Column) -> Column:
        first_bad = F.array_position(F.transform(found, lambda i: i["ok"]), False).cast("int")
        return F.when(first_bad > 0, F.slice(found, F.lit(1), first_bad - 1)).otherwise(found)

    def found(parsed: Column) -> Column:
        groups = F.try_variant_get(parsed, "$[0]", "array<variant>")
        return F.when(is_whole(parsed), F.flatten(F.transform(groups, items)))

    return bind(bind(parse_whole(text), found), until_bad)


def spec_items(text: Column) -> Column:
    """array<struct<ok, gi, ai, k, v>> in document order, up to the first malformed element.

    `gi` and `ai` are the positions of the group and of the attribute in it. Text that is no
    JSON array gives an empty array. Reading stops at the first group that is no object, whose
    `attributes` is no list, or at the first attribute that is no object; pairs before it stay.
    """
    return F.coalesce(_usual_items(text), _exact_items(text), F.array().cast(_ITEMS))
