"""Hashing, the capped index, sources, search and distances."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from kindred.functions import hashing
from kindred.operators import distances, index, parsing, search
from kindred.sources import config, lines, tables
from kindred.streaming import append


@pytest.fixture(scope="module")
def dims(spark):
    terms = spark.createDataFrame([("red", 3000), ("blue", 2000), ("bolt", 5000), ("nut", 1000), ("large", 2500)], "word string, rel bigint")
    return parsing.Dimensions(terms, spark.createDataFrame([("the",)], "word string"))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(0, "red bolt"), (1, "blue bolt"), (2, "large nut"), (3, "the red large bolt"), (4, "")], "query_id bigint, query string")


def test_hashes(spark):
    assert hashing.jump(1000011111111, 32) == 7
    assert hashing.jump(1000011111111, 1) == 0
    with pytest.raises(ValueError):
        hashing.jump(1, 0)
    with pytest.raises(ValueError):
        hashing.split_id(F.lit(1), 6)
    df = spark.range(0, 400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    x, y = hashing.unpair(hashing.pair(F.col("x"), F.col("y")))
    assert df.where((x != F.col("x")) | (y != F.col("y"))).count() == 0


def test_cap(spark):
    rows = [("a", k, s) for k, s in enumerate([1, 2, 3, 5, 10, 4, 10])]
    got = index.cap(spark.createDataFrame(rows, "ngram string, query_id bigint, score smallint"), 3).collect()
    assert {(r.query_id, r.score) for r in got} == {(4, 10), (6, 10), (3, 5)}


def test_merge(spark):
    one = spark.createDataFrame([("a", 2), ("b", 1)], "ngram string, len bigint")
    got = index.merge_dictionaries([one, one]).collect()
    assert {r.key for r in got} == {f"{n}\0\0{k}" for n in "ab" for k in (0, 1)}


def test_lines(spark, tmp_path):
    for name, text in (("b.gz", "x:y:z:broken\n"), ("a.gz", 'red bolt\nqe:blue bolt\r\n7:url:large nut\n"q:a\\"b"\trest\n')):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    got = lines.read_lines(spark, str(tmp_path)).orderBy("query_id").collect()
    assert [(r.query_id, r.type, r["query"], r.parse_error) for r in got] == [(0, "qe", "red bolt", False), (1, "qe", "blue bolt", False), (2, "url", "large nut", False), (3, "q", 'a"b', False), (4, None, None, True)]
    assert lines.read_corpus(spark, str(tmp_path)).count() == 5


def test_side_tables(spark, tmp_path):
    (tmp_path / "stop").write_text("the\nof\n\n")
    (tmp_path / "none").write_text("\n")
    (tmp_path / "syn").write_text("a b\na c\n")
    assert tables.read_stopwords(spark, str(tmp_path / "stop")).count() == 2
    with pytest.raises(ValueError):
        tables.read_stopwords(spark, str(tmp_path / "none"))
    assert [tuple(r) for r in tables.read_synonyms(spark, str(tmp_path / "syn")).collect()] == [("a", "c")]
    import numpy as np

    (tmp_path / "words").write_text('"a"\n"b"\n')
    np.arange(6, dtype="<f4").tofile(tmp_path / "vecs")
    got = {r.word: r.vec for r in tables.read_vectors(spark, str(tmp_path / "words"), str(tmp_path / "vecs"), 3).collect()}
    assert got == {"a": [0.0, 1.0, 2.0], "b": [3.0, 4.0, 5.0]}


def test_config(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"terms_relevance_file": "t", "stopwords_file": "s", "use_word_vectors": False, "toponyms_file": "p", "synonyms_file": "y", "i2q_file": "i"}))
    assert config.SearchConfig.from_json(str(path)).bucket_size == 2500
    path.write_text("{}")
    with pytest.raises(ValueError):
        config.SearchConfig.from_json(str(path))


def test_word_tables_and_joins_agree(spark, corpus, dims):
    a = parsing.parse(corpus, dims).orderBy("query_id").collect()
    b = parsing.parse(corpus, dims, broadcast_rows=0).orderBy("query_id").collect()
    assert a == b


def test_joined_words_travel_without_the_queries(spark, corpus, dims, monkeypatch):
    """With large tables only the words of blocks are joined; the queries go to their blocks once."""
    monkeypatch.setattr(parsing, "BLOCK_ROWS", 2)
    places = spark.createDataFrame([("large",)], "word string")
    synonyms = spark.createDataFrame([("red", "crimson"), ("nut", "bolt")], "word string, synonym string")
    more = parsing.Dimensions(dims.terms, dims.stopwords, places, synonyms)
    rows = corpus.unionByName(spark.createDataFrame([(5, None), (6, "red bolt")], corpus.schema))
    for mode in ("index", "search"):
        a = parsing.parse(rows, more, mode).orderBy("query_id")
        b = parsing.parse(rows, more, mode, broadcast_rows=0)
        assert a.collect() == b.orderBy("query_id").collect()
        assert "hashpartitioning(query" not in b._jdf.queryExecution().executedPlan().toString()
    some = parsing.parse(rows, more, columns=("must_have", "n_ngrams"), broadcast_rows=0)
    assert some.columns == ["query_id", "query", "must_have", "n_ngrams"]
    assert {(r.query_id, r.n_ngrams) for r in some.collect()} == {(r.query_id, len(r.ngrams)) for r in parsing.parse(rows, more).collect()}


def test_search(spark, corpus, dims, tmp_path):
    built = index.SearchIndex(index.build(corpus, dims), dims, corpus)
    built.write(str(tmp_path / "index"))
    loaded = index.SearchIndex.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "bolt red"), (2, ""), (3, None), (4, "unknown thing")], "qid bigint, query string")
    for i in (built, loaded):
        got = [tuple(r) for r in search.search(asked, i, 10).orderBy("qid", "rank").collect()]
        assert got[0][:2] == (1, 0) and got[0][2] == pytest.approx(0)
        assert {g[0] for g in got} == {1}
        assert [g[2] for g in got] == sorted(g[2] for g in got)
    assert search.search(asked, built, 0).count() == 0
    found = json.loads(search.search_json(asked, built, 1).first().results)
    assert found[0][0] == 0 and found[0][2] == "red bolt" and found[0][1]["cosine"] is None
    part = index.SearchIndex.load(spark, str(tmp_path / "index"), (0, 1))
    assert part.postings.count() <= built.postings.count()


def test_lists_that_are_asked_for(spark, corpus, dims):
    """An index of some lists, with texts looked up, gives what the whole one gives; nothing else is capped."""
    whole = index.SearchIndex(index.build(corpus, dims), dims, corpus)
    asked = spark.createDataFrame([(1, "bolt red"), (2, "large bolt nut")], "qid bigint, query string")
    grams = search.parsed_queries(asked, whole).select(F.explode("ngrams.ngram").alias("ngram")).distinct()
    some = index.build(corpus, dims, only=grams)
    assert {r.ngram for r in some.collect()} < {r.ngram for r in whole.postings.collect()}
    seen = []
    texts = lambda ids: corpus.where(F.col("query_id").isin(seen.extend(r[0] for r in ids.collect()) or seen))
    got = search.search(asked, index.SearchIndex(some, dims, texts=texts), 10, hold=lambda df: df.localCheckpoint())
    assert sorted(got.collect()) == sorted(search.search(asked, whole, 10).collect()) and seen


def test_distance_to_itself_is_zero(spark, dims):
    vec = spark.createDataFrame([(w, [float(k), 1.0]) for k, w in enumerate(["red", "bolt", "blue"])], "word string, vec array<float>")
    rows = [(0, "red bolt", 0, "red bolt"), (0, "red bolt", 1, "blue bolt"), (0, "red bolt", 2, "zzz yyy"), (1, "", 3, "red"), (2, "red", 4, None)]
    got = {r.cand_id: r for r in distances.distances(spark.createDataFrame(rows, "qid bigint, query string, cand_id bigint, candidate string"), dims, vec).collect()}
    assert got[0].keyword == pytest.approx(0) and got[0].cosine == 0.0
    assert 0 < got[1].keyword < 1 and got[1].cosine is not None
    assert got[2].keyword == 1 and got[2].cosine is None
    assert 3 not in got and got[4].keyword == 1


def test_stream_equals_batch(spark, corpus, dims, tmp_path):
    for k in (0, 1):
        corpus.where(F.col("query_id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append.append_postings(stream, dims, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = append.compact(spark, str(tmp_path / "out"))
    assert set(got.collect()) == set(index.build(corpus, dims).collect())
