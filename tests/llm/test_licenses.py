import re

import pytest

from shelfmark.llm import licenses
from conftest import SMALL


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def base(text):
    w = words(text)
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def compare(df):
    rows = licenses.report(df.select("doc_id", "text")).collect()
    texts = df.select("doc_id", "text").collect()
    wanted = sorted(((i, *base(t)) for i, t in texts), key=str)
    found = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=str)
    assert found == wanted
    for r in rows:
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1
        assert (r["score"] == 1) or not r["base_labels"]
    return {r["doc_id"]: r for r in rows}


def test_whole_table(spark):
    rows = compare(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert any(r["n_base"] for r in rows.values())


def test_odd_rows(odd, none):
    compare(odd)
    assert licenses.report(none).collect() == []


def test_places(spark):
    mit = "x Under,the\nMIT-License under the mit license"
    notice = licenses.NOTICES[0][0]
    gpl = "foo. Licensed under the GNU General Public License, version 3."
    texts = [
        mit,
        "cc by nc by nc cc by nc cc BY-NC",
        "Apache License, Version 2.0 and apache license version 2",
        f"é {notice.upper()} end",
        notice.replace("copy", "copies").replace("deal", "work"),
        notice.replace("granted", "given"),
        gpl,
        "the license of the public is general and version 3",
        " ".join(["cc by nc"] * 500),
        "kelvin K under the mİt license underé the mit license",
        "under the mit",
    ]
    rows = compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    label = [rows[i]["labels"] for i in range(len(texts))]
    assert label[:5] == ["mit", "cc-by-nc", "apache-2", "mit", "mit"]
    assert label[5:8] == ["", "gpl-3", ""] and label[9:] == ["", ""]
    assert rows[8]["n_base"] == 500 and rows[8]["last_word"] == 1497
    assert 0.7 <= rows[4]["score"] < 1 and rows[3]["score"] == pytest.approx(1)


def test_no_python_in_the_plan(spark):
    df = licenses.report(spark.read.parquet(f"{SMALL}/documents.parquet"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", text)


@pytest.mark.parametrize("n", [1, 4])
def test_a_notice_that_every_row_holds(spark, n):
    """The words of such a notice are in all documents; it is found all the same."""
    notice = licenses.NOTICES[0][0]
    df = spark.createDataFrame([(i, f"file {i} {notice} end") for i in range(n)], "doc_id long, text string")
    rows = compare(df)
    assert [r["labels"] for r in rows.values()] == ["mit"] * n
    assert all(r["score"] == pytest.approx(1) for r in rows.values())
