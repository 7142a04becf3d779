"""Normalising and tokenising, as columns and in the kernel."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import kernel

NORMAL = [
    ("'Here's@#An ##example!", "heres  an   example"),
    ("München Gödel Gießen Bären", "muenchen goedel giessen baeren"),
    ("root_type hubspot", "root type hubspot"),
    ("123movies123free", "123 movies 123 free"),
    ("peer2peer", "peer2peer"),
    ("peer22peer", "peer 22 peer"),
    ("ersatzteile24 laptop", "ersatzteile 24  laptop"),
    ("neumeyer str. 22-24nürnberg", "neumeyer str   22   24 nuernberg"),
    ("\t x  ", "x"),
    ("", ""),
]


def test_normalize(spark):
    rows = spark.createDataFrame(NORMAL, "q string, e string").select(text.normalize(F.col("q")).alias("n"), "e", "q").collect()
    assert all(r.n == r.e for r in rows)
    assert all(kernel.normalize(q) == e for q, e in NORMAL)


@pytest.mark.parametrize(
    ("query", "words", "synonyms"),
    [
        ("@xel en e x", ["xelenex"], {}),
        ("sim karte defekt t mobile iphone", ["sim", "karte", "defekt", "mobile", "iphone"], {2: "defektt"}),
        ("caddy14 d ersatzteile", ["caddy", "14", "ersatzteile"], {1: "14d"}),
        ("r sim 7 free mobile iphone 5", ["r", "sim", "7", "free", "mobile", "iphone", "5"], {}),
        ("@x s e l e n a x", ["xselenax"], {}),
        ("", [], {}),
    ],
)
def test_tokenize(query, words, synonyms):
    assert kernel.tokenize(query, kernel.SEARCH, {}) == (words, synonyms)
    assert kernel.tokenize(query, kernel.INDEX, {})[1] == {}


def test_dictionary_synonyms():
    words, synonyms = kernel.tokenize("large millions widget", kernel.SEARCH, {"millions": "million", "large": "widget"})
    assert words == ["large", "millions", "widget"]
    assert synonyms == {1: "million"}  # widget is in the query already


@given(st.lists(st.sampled_from(["a", "b", "ab", "é", "b a"]), min_size=3, max_size=3))
@settings(max_examples=60, deadline=None)
def test_bag(parts):
    a, b, c = parts
    expect = f"{c} {a} {b}" if a == b < c else " ".join(sorted(parts, key=str.encode))
    assert kernel.bag(*parts) == expect


def test_match_sets(spark):
    row = [(["several", "million"], ["2", "millions"], [("million", "millions")]), (["several", "million"], ["several", "million", "or", "millions"], [("million", "millions")])]
    df = spark.createDataFrame(row, "q array<string>, c array<string>, s array<struct<word:string,synonym:string>>")
    sets = text.match_sets(F.col("q"), F.col("c"), F.col("s"))
    got = [tuple(map(set, r)) for r in df.select(*(c.alias(n) for n, c in sets.items())).collect()]
    assert got == [({"million"}, {"several"}, {"2"}), ({"several", "million"}, set(), {"or", "millions"})]
