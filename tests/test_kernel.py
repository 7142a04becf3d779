"""Units of stopwords, must-have words and n-grams."""

import pytest

from kindred.operators import kernel

STOP = set("aber the 4 1 7 and has by welche sind im if is it to into all of in not a was who on many as".split())


def look(rel=None, stop=STOP, places=(), dictionary=None):
    rel = rel or {}
    return kernel.Lookup(lambda w: rel.get(w, 1000 if w in stop else 4000 + len(w)), stop.__contains__, set(places).__contains__, dictionary or {})


def units(query, mode=kernel.INDEX, rel=None):
    words, synonyms = kernel.tokenize(query, mode, {})
    if len(words) < 2:
        return words
    l = look(rel, stop=STOP - {"many"})
    return [u.text for u in kernel.Grouping(words, kernel.weigh(words, synonyms, l), synonyms, mode).units]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("watch the magicians season 4 free 123", ["watch", "magicians the", "4 season", "free", "123"]),
        ("ormlite callintransaction and h2", ["ormlite", "and callintransaction", "h2"]),
        ("laravel has many order by", ["laravel", "has many", "by order"]),
        ("order by has many laravel", ["by order", "has many", "laravel"]),
        ("the paws of destiny amazon prime", ["paws the", "destiny of", "amazon", "prime"]),
        ("the clash influences", ["clash the", "influences"]),
        ("if the word is numeric it has to go into bigram", ["if the word", "is numeric", "has it", "go to", "bigram into"]),
        ("remove all of the spaces in JavaScript file", ["all remove", "of spaces the", "in javascript", "file"]),
        ("allocating memory is not a big deal", ["allocating", "is memory", "big not", "deal"]),
        ("who was the first to invent bicycle", ["the was who", "first", "invent to", "bicycle"]),
        ("youngest person to walk on the moon", ["youngest", "person", "to walk", "moon on the"]),
        ("changing mac os menu bar", ["changing", "mac", "os", "menu", "bar"]),
        ("@xsel e n a x", ["xselenax"]),
        ("@x s e l e n a x", ["xselenax"]),
        ("watch the magicians season 4 episode 1 free 123", ["watch", "magicians the", "4 season", "1 episode", "free", "123"]),
        ("watch the magicians season 4 episode 1 123movies", ["watch", "magicians the", "4 season", "1 episode", "123", "movies"]),
        ("welche 30 unternehmen sind im dax", ["30 welche", "unternehmen", "dax im sind"]),
        ("if the word is 7 it has to go into bigram", ["if the word", "7 is", "has it", "go to", "bigram into"]),
        ("aber keine", ["aber keine"]),
        ("hengstenberg evangelische", ["hengstenberg", "evangelische"]),
        ("emacs bind buffer mode key", ["emacs", "bind", "buffer", "mode", "key"]),
        ("disneyland paris ticket download", ["disneyland", "paris", "ticket", "download"]),
        ("friends s01 e01 stream", ["friends", "s01", "e01", "stream"]),
        ("caddy14 d ersatzteile", ["caddy", "14", "ersatzteile"]),
        ("youngest person on the moon", ["youngest", "person", "moon on the"]),
        ("bdv e670", ["bdv", "e670"]),
    ],
)
def test_units(query, expected):
    rel = {"season": 4100, "moon": 5000, "dax": 5000, "unternehmen": 4500}
    assert units(query, rel=rel) == expected
    assert units(query, kernel.SEARCH, rel) == expected


def test_units_of_fused_letters():
    """In search mode the letter is a synonym's; the unit is the same in index mode."""
    assert units("sim karte defekt t mobile iphone") == ["sim", "karte", "defekt", "mobile", "iphone"]


@pytest.mark.parametrize(
    ("query", "rel", "stop", "places", "must", "expected"),
    [  # relevances that fit the known results
        (
            "list of literature genres txt",
            {"list": 4150, "of": 4950, "literature": 5450, "genres": 4850, "txt": 8200},
            {"of", "txt"},
            ["list"],
            [0, 2],
            {"list literature of": [0, 1, 2], "literature of": [1, 2], "genres list": [0, 3], "genres txt": [3, 4], "genres txt list": [0, 3, 4], "genres literature": [2, 3], "list literature": [0, 2], "genres txt literature of": [1, 2, 3, 4], "genres list literature": [0, 2, 3], "genres of": [1, 3], "genres": [3]},
        ),
        (
            "friends s01 e01 stream",
            {"friends": 6350, "s01": 6750, "e01": 7950, "stream": 4300},
            set(),
            ["friends"],
            [0, 2, 3],
            {"s01 stream": [1, 3], "friends s01": [0, 1], "e01 s01": [1, 2], "friends stream": [0, 3], "e01 friends": [0, 2], "e01 stream": [2, 3], "e01 friends s01": [0, 1, 2], "s01": [1]},
        ),
        (
            "emacs bind buffer mode key",
            {"emacs": 7000, "bind": 8650, "buffer": 5800, "mode": 5400, "key": 4300},
            set(),
            ["buffer", "emacs"],
            [0, 1],
            {"emacs key": [0, 4], "buffer emacs": [0, 2], "bind emacs": [0, 1], "bind buffer": [1, 2], "emacs mode": [0, 3], "buffer mode": [2, 3], "buffer key": [2, 4], "key mode": [3, 4], "bind buffer emacs": [0, 1, 2], "bind mode": [1, 3], "bind key": [1, 4], "emacs": [0]},
        ),
    ],
)
def test_golden_parses(query, rel, stop, places, must, expected):
    p = kernel.parse(query, kernel.INDEX, look(rel, stop, places))
    assert {t: sorted(ids) for t, (_, ids) in p.ngrams.items()} == expected
    assert sorted(p.must) == must


def test_what_size():
    p = kernel.parse("what size kenzan", kernel.INDEX, look({"what": 600, "size": 1500, "kenzan": 9000}, {"what"}))
    assert set(p.ngrams) == {"kenzan size what", "kenzan size", "kenzan"}
    assert p.must == [2]


def test_four_content_words():
    rel = {"disneyland": 5200, "paris": 3000, "ticket": 2900, "download": 2500}
    p = kernel.parse("disneyland paris ticket download", kernel.INDEX, look(rel, set(), ["paris"]))
    got = {t: ids for t, (_, ids) in p.ngrams.items()}
    assert got == {"disneyland paris": [0, 1], "paris ticket": [1, 2], "download ticket": [2, 3], "disneyland download": [0, 3], "disneyland": [0], "disneyland paris ticket": [0, 1, 2], "disneyland ticket": [0, 2], "download paris": [1, 3]}
    assert set(p.must) == {0, 1}


def test_small_cases():
    assert kernel.parse(None, kernel.INDEX, look()).ngrams == {}
    one = kernel.parse("word", kernel.SEARCH, look())
    assert one.ngrams == {"word": (1.0, [0])} and one.must == [0]
    assert kernel.parse("word word", kernel.INDEX, look()).words == ["word", "word"]


def test_index_and_search_agree_without_synonyms():
    for q in ("sim karte iphone mobile", "list of literature genres txt"):
        a, b = (set(kernel.parse(q, m, look()).ngrams) for m in (kernel.INDEX, kernel.SEARCH))
        assert a <= b
