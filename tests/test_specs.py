import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.specs import KNOWN_SPECS
from shelfmark.operators import clean


def attribute(**fields):
    return fields


def group(*attributes):
    return {"name": "g", "attributes": list(attributes)}


A = attribute(code="a", name="A", value="1")
B = attribute(code="b", name="B", value="2")

# text -> [(group, attribute, key, value)]
CASES = {
    "null": (None, []),
    "empty": ("", []),
    "no json": ("oops", []),
    "empty list": ("[]", []),
    "object": (json.dumps(group(A)), []),
    "number": ("5", []),
    "single quotes": ("[{'attributes':[{'code':'a','value':'1'}]}]", []),
    "usual": (json.dumps([group(A, B)]), [(0, 0, "spec_a", "1"), (0, 1, "spec_b", "2")]),
    "white space": ("  " + json.dumps([group(A)]), [(0, 0, "spec_a", "1")]),
    "two groups": (
        json.dumps([group(A), group(B)]),
        [(0, 0, "spec_a", "1"), (1, 0, "spec_b", "2")],
    ),
    "repeated key": (
        json.dumps([group(A, attribute(code="a", value="3")), group(attribute(code="A", value=4))]),
        [(0, 0, "spec_a", "1"), (0, 1, "spec_a", "3"), (1, 0, "spec_a", "4")],
    ),
    "blanks and case": (
        json.dumps([group(attribute(code="Bìa Sách X", value="v"))]),
        [(0, 0, "spec_bìa_sách_x", "v")],
    ),
    "empty code": (
        json.dumps([group(attribute(code="", name="Number Of Page", value="9"))]),
        [(0, 0, "spec_number_of_page", "9")],
    ),
    "null code": (
        json.dumps([group(attribute(code=None, name="N", value="9"))]),
        [(0, 0, "spec_n", "9")],
    ),
    "no code, no name": (json.dumps([group({"value": "9"})]), [(0, 0, "spec_unknown", "9")]),
    "null name": (json.dumps([group({"name": None, "value": "9"})]), [(0, 0, "spec_none", "9")]),
    "code zero": (
        json.dumps([group(attribute(code=0, name="Zero", value="9"))]),
        [(0, 0, "spec_zero", "9")],
    ),
    "code text zero": (
        json.dumps([group(attribute(code="0", name="Zero", value="9"))]),
        [(0, 0, "spec_0", "9")],
    ),
    "code number": (json.dumps([group(attribute(code=7, value="9"))]), [(0, 0, "spec_7", "9")]),
    "null value": (json.dumps([group(attribute(code="a", value=None))]), [(0, 0, "spec_a", None)]),
    "no value": (json.dumps([group(attribute(code="a"))]), [(0, 0, "spec_a", None)]),
    "nested value": ('[{"attributes":[{"code":"a","value":{"z":1}}]}]', [(0, 0, "spec_a", '{"z":1}')]),
    "no attributes": (json.dumps([{"name": "g"}, group(B)]), [(1, 0, "spec_b", "2")]),
    "empty attributes": (json.dumps([group(), group(B)]), [(1, 0, "spec_b", "2")]),
    "empty object as attributes": (
        json.dumps([{"attributes": {}}, group(B)]),
        [(1, 0, "spec_b", "2")],
    ),
    "null attributes stop": (
        json.dumps([group(A), {"attributes": None}, group(B)]),
        [(0, 0, "spec_a", "1")],
    ),
    "text attributes stop": (
        json.dumps([group(A), {"attributes": "abc"}, group(B)]),
        [(0, 0, "spec_a", "1")],
    ),
    "number group stops": (json.dumps([group(A), 5, group(B)]), [(0, 0, "spec_a", "1")]),
    "null group stops": (json.dumps([group(A), None, group(B)]), [(0, 0, "spec_a", "1")]),
    "number attribute stops": (
        json.dumps([group(A, 7, B), group(B)]),
        [(0, 0, "spec_a", "1")],
    ),
    "null attribute stops": (json.dumps([group(A, None, B)]), [(0, 0, "spec_a", "1")]),
    "text behind": (json.dumps([group(A)]) + " junk", []),
    "bracket behind": (json.dumps([group(A)]) + "]", []),
    "list behind": (json.dumps([group(A)]) + ",[]", []),
    "text behind an unusual list": (json.dumps([group(A), 5]) + " junk", []),
    "line feeds around": ("\n" + json.dumps([group(A)]) + "\n", [(0, 0, "spec_a", "1")]),
    "repeated field": (
        '[{"attributes":[{"code":"a","code":"b","value":"1"},{"code":0,"code":"c"}]}]',
        [(0, 0, "spec_b", "1"), (0, 1, "spec_c", None)],
    ),
    "repeated field, unusual": (
        '[{"attributes":[{"code":"a","code":"b","value":"1"}]},7]',
        [(0, 0, "spec_b", "1")],
    ),
    "cut off": (json.dumps([group(A, B)])[:-5], []),
}


@pytest.fixture(scope="module")
def specs(spark):
    rows = [(name, text) for name, (text, _) in CASES.items()]
    return spark.createDataFrame(rows, "id string, specs string").cache()


@pytest.fixture(scope="module")
def flattened(specs):
    found = {name: [] for name in CASES}
    for row in clean.flatten_specs(specs, "id", "specs").orderBy("gi", "ai").collect():
        found[row["id"]].append((row["gi"], row["ai"], row["k"], row["v"]))
    return found


@pytest.mark.parametrize("name", CASES)
def test_flatten(flattened, name):
    assert flattened[name] == CASES[name][1]


def test_pivot_takes_the_last_of_a_key(specs):
    keys = sorted({item[2] for _, items in CASES.values() for item in items})
    pivoted = clean.pivot_specs(specs, "specs", keys)
    for row in pivoted.collect():
        last = {k: v for _, _, k, v in CASES[row["id"]][1]}
        assert {k: row[k] for k in keys} == {k: last.get(k) for k in keys}, row["id"]


def test_pivot_gives_every_known_column_without_shuffle(specs):
    pivoted = clean.pivot_specs(specs.select("id", "specs"), "specs")
    assert pivoted.columns == ["id", *(f"spec_{k}" for k in KNOWN_SPECS)]
    assert "Exchange" not in pivoted._jdf.queryExecution().executedPlan().toString()


def test_discovered_keys(spark):
    odd = "it's \\ odd"
    text = json.dumps([group(A, attribute(code=odd, value="x"))])
    df = spark.createDataFrame([("1", text), ("2", None)], "id string, specs string")
    keys = clean.discover_spec_keys(df, "specs")
    assert keys == ["spec_a", "spec_it's_\\_odd"]
    row = clean.pivot_specs(df.where(F.col("id") == "1"), "specs", keys).first()
    assert row["spec_it's_\\_odd"] == "x"
    assert clean.discover_spec_keys(df, "specs", limit=1) == ["spec_a"]
    more = clean.pivot_specs(df, "specs", ["spec_a"], more="more").orderBy("id").collect()
    assert more[0]["more"] == {"spec_it's_\\_odd": "x"} and not more[1]["more"]


def test_discovery_in_clean_detail(spark):
    old, new = json.dumps([group(A)]), json.dumps([group(B)])
    df = spark.createDataFrame(
        [(1, old, "x", "4", "5", "0", "20240101_000000"), (1, new, "4.5", "7.5", "6", "9", "20240102_000000")],
        "product_id bigint, specifications string, rating_average string, review_count string, "
        "price string, list_price string, extracted_at string",
    )
    row = clean.clean_detail(df, spec_keys=None).first().asDict()
    # A key that only an older extraction had gives no column.
    assert row["spec_b"] == "2" and "spec_a" not in row and "spec_origin" in row
    assert (row["rating_average"], row["review_count"], row["price"], row["list_price"]) == (
        4.5,
        None,
        6.0,
        9.0,
    )


def test_no_key_is_lost(spark):
    """2,500 keys: 2,000 columns and a map, and every value is found again."""
    import json

    n = 2500
    rows = [
        (i, json.dumps([{"name": "g", "attributes": [{"code": f"k{j}", "name": f"k{j}", "value": f"v{i}-{j}"} for j in range(i, n, 5)]}]))
        for i in range(5)
    ]
    df = spark.createDataFrame(rows, "id int, specs string")
    found = clean.pivot_all_specs(df, "specs")
    assert len(found.columns) == 1 + clean.MAX_SPEC_KEYS + 1
    values = {}
    for row in found.collect():
        cells = row.asDict()
        cells |= cells.pop(clean.MORE_SPECS) or {}
        values |= {k: v for k, v in cells.items() if k != "id" and v is not None}
    assert len(values) == n and {int(v.split("-")[1]) for v in values.values()} == set(range(n))
