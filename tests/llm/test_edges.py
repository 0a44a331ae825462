"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import exact_dedup, html_extract, mixing, ngram_join, piece_codec, pii, quality, secret_scan, shard, toxicity

LEVELS = {"language": "lang", "origin": "source"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, sig string, h string, rank int, keep_id long, row long, epoch int, kind string"
LONG = "alpha beta 12 gamma@x.org " * 4000 + "x" * 50_000
TEXTS = [None, "", "  \n", "a b", "one two three four five six", LONG, LONG, "one two three four five six"]

OPERATORS = {
    "exact": exact_dedup.exact_duplicates,
    "deduplicate": exact_dedup.deduplicate,
    "near": ngram_join.near_duplicates,
    "one_of_each": ngram_join.one_of_each,
    "pii": pii.find,
    "secrets": secret_scan.scan,
    "pieces": piece_codec.encode,
    "quality": quality.judge,
    "keep_good": quality.keep_good,
    "mix": lambda d: mixing.mix(d, LEVELS, {}, 1.0),
    "choose": lambda d: mixing.choose(d, LEVELS, {}, 1.0),
    "shard": lambda d: shard.assign(d, 4),
}
FILTERS = {"deduplicate", "one_of_each", "keep_good", "mix"}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 1 else "en", None, None, 7, "s", "h", 1, 5, 9, 3, "k") for i, t in enumerate(TEXTS)]
    rows += [(None, "null id text here with words", None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[4], rows[4], (2, "other text of the same id as two", "en", "s", 1, 1, "", "", 1, 1, 1, 1, "")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    out = OPERATORS[name](odd)
    rows = out.collect()
    if name in FILTERS:
        assert out.columns == odd.columns
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd.collect()}
    elif name != "choose":
        assert len(rows) == odd.count()
    if name in ("deduplicate", "one_of_each"):
        assert sorted(r["doc_id"] for r in rows if r["text"] and r["text"].startswith("one two")) == [4]
        assert [r["doc_id"] for r in rows if r["text"] == LONG] == [5]
        assert None in [r["doc_id"] for r in rows]
        assert "other text of the same id as two" in [r["text"] for r in rows]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


def test_toxicity_edges(spark, odd):
    labels = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], labels)
    scores = toxicity.score(odd, none).collect()
    assert len(scores) == odd.count() and {round(r["score"], 6) for r in scores} == {0.1}
    some = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (None, 1, 1), (5, 1, None), (3, 1, 0)], labels)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, some).collect())
    assert toxicity.score(spark.createDataFrame([], DOCS), none).collect() == []


def test_page_edges(spark):
    kind = "page_id long, url string, html string, id long, text string, host string, row long"
    rows = [(1, None, None, 1, "t", "h", 1), (2, "", "", 1, "t", "h", 1), (2, "", "", 1, "t", "h", 1),
            (None, "not a url", "<p>x", 1, "t", "h", 1), (5, "http://A.b/", "<div>" * 5000 + "deep", 1, "t", "h", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r["text"] for r in got) == ["", "", "", "deep", "x"]
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, 1, 4]
    assert html_extract.extract(spark.createDataFrame([], kind)).collect() == []


def test_defined_results(odd):
    near = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(odd).collect()}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4), (7, 2, 4), (6, near and max(n for _, n, _ in near), 5)} <= near
    same = exact_dedup.exact_duplicates(odd).where("doc_id = 4").collect()
    assert [r["group_size"] for r in same] == [4] * 3 and sum(r["kept"] for r in same) == 1
    first = exact_dedup.exact_duplicates(odd).where(F.col("doc_id") <= 1).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in first} == {(0, 0, 2), (1, 0, 2)}
