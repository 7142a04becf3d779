"""The queries that show every operator at work, by name."""

from __future__ import annotations

import json
import struct
import tempfile
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import hashing, text, vectors
from kindred.operators import distances as D
from kindred.operators import index as I
from kindred.operators import kernel
from kindred.operators import parsing as P
from kindred.operators import search as S
from kindred.plans import tables as T
from kindred.sources import lines
from kindred.sources import tables as files
from kindred.sources.config import SearchConfig
from kindred.streaming import append

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), " ")


@query
def normalize_text(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", text.normalize(F.coalesce("text", F.lit(""))).alias("normal"))


@query
def tokenize_filter(spark, sf):
    words = text.words(text.normalize(F.coalesce("text", F.lit(""))))
    return T.read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n_words"))


def _lines(spark, sf) -> DataFrame:
    """Raw lines of all kinds, made of the names of ``part``."""
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    made = [name, F.concat(F.lit("qe:"), name), F.concat(key, F.lit(":url:"), name), F.concat(F.lit('"q:'), name, F.lit('"\trest')), F.concat(F.lit("a:b:c:"), name), F.concat(F.lit('"'), name)]
    line = made[0]
    for k, c in enumerate(made[1:], 1):
        line = F.when(F.col("p_partkey") % len(made) == k, c).otherwise(line)
    return T.read(spark, sf, "part").select("p_partkey", line.alias("line"))


@query
def parse_line(spark, sf):
    parsed = lines.parse_line(F.col("line"))
    return _lines(spark, sf).select("p_partkey", *(c.alias(n) for n, c in parsed.items()), lines.query_kind(parsed["type"]).alias("kind"))


@query
def query_type_prefix_filter(spark, sf):
    rows = _lines(spark, sf).select("p_partkey", *(c.alias(n) for n, c in lines.parse_line(F.col("line")).items()))
    return lines.with_prefixes(rows, ["q", "qe"]).select("p_partkey", "type", "query")


@query
def global_ordinal(spark, sf):
    rows = T.read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"))
    return lines.with_ordinal(rows, "o_orderkey")


@query
def term_df_idf(spark, sf):
    n = T.read(spark, sf, "documents").agg(F.count("*").alias("n"))
    return T.doc_frequency(spark, sf).crossJoin(F.broadcast(n)).select("word", "df", r6(F.log2(F.col("n") / F.col("df"))).alias("idf"))  # a table of one row


@query
def term_relevance(spark, sf):
    return T.doc_terms(spark, sf)


@query
def stop_flag(spark, sf):
    stop = T.doc_stopwords(spark, sf).withColumn("stop", F.lit(True))
    return T.item_words(spark, sf).select("word").distinct().join(stop, "word", "left").select("word", F.coalesce("stop", F.lit(False)).alias("stop"))


@query
def stopword_semi(spark, sf):
    return T.item_words(spark, sf).select("item_id", "word").distinct().join(T.doc_stopwords(spark, sf), "word", "left_semi").select("item_id", "word")


@query
def stopword_anti(spark, sf):
    return T.item_words(spark, sf).select("item_id", "word").distinct().join(T.doc_stopwords(spark, sf), "word", "left_anti").select("item_id", "word")


def _item_relevance(spark, sf) -> DataFrame:
    return T.item_words(spark, sf).join(T.doc_terms(spark, sf), "word", "left").select("item_id", "pos", "word", P.relevance().alias("rel"))


@query
def relevance_lookup_default(spark, sf):
    return _item_relevance(spark, sf).select("word", "rel").distinct()


@query
def word_weights(spark, sf):
    stop = T.doc_stopwords(spark, sf).withColumn("stop", F.lit(True))
    rows = _item_relevance(spark, sf).join(stop, "word", "left").withColumn("stop", F.coalesce("stop", F.lit(False)) | (F.octet_length("word") == 1))
    first = F.row_number().over(Window.partitionBy("item_id", "word").orderBy("pos")) == 1
    weight = F.when(F.col("stop"), F.col("rel") * 0.5).when(first, F.col("rel") * 1.0).otherwise(0.0)
    return rows.withColumn("weight", weight).groupBy("item_id").agg(F.sum("weight").alias("norm"), F.count("*").alias("n_words"))


@query
def argmin_argmax_word(spark, sf):
    place = F.struct(F.col("rel"), -F.col("pos"))
    low = F.struct(F.col("rel"), F.col("pos"))
    number = text.has_digit(F.col("word"))
    return _item_relevance(spark, sf).groupBy("item_id").agg(F.max_by("word", place).alias("most"), F.min_by("word", low).alias("least"), F.max_by(F.when(number, F.col("word")), F.when(number, place)).alias("number"))


@query
def bow2_pairs(spark, sf):
    rows = T.item_words(spark, sf)
    by = Window.partitionBy("item_id").orderBy("pos")
    out = None
    for step in (1, 2, 3):
        part = rows.select(text.bag2(F.col("word"), F.lead("word", step).over(by)).alias("pair"), F.lead("word", step).over(by).alias("next"), F.lit(1 - (step - 1) / 100).alias("part")).where("next is not null")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("pair").agg(F.count("*").alias("n"), r6(F.sum("part")).alias("weight"))


@query
def bow3_top(spark, sf):
    by = Window.partitionBy("item_id").orderBy(F.desc("rel"), "pos")
    top = _item_relevance(spark, sf).withColumn("k", F.row_number().over(by)).where("k <= 3")
    got = top.groupBy("item_id").agg(*(F.max(F.when(F.col("k") == k, F.col("word"))).alias(f"w{k}") for k in (1, 2, 3)))
    return got.where("w3 is not null").select("item_id", text.bag3(F.col("w1"), F.col("w2"), F.col("w3")).alias("ngram"))


@query
def ngram_rel_quantized(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", hashing.quantize(F.col("p_retailprice") / 700).cast("long").alias("score"))


def _doc_postings(spark, sf) -> DataFrame:
    counted = T.doc_words(spark, sf).groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("word").alias("ngram"), F.col("doc_id").alias("query_id"), F.least(F.col("n"), F.lit(255)).cast("long").alias("score"))


def _capped_doc_postings(spark, sf) -> DataFrame:
    """The capped lists of ``_doc_postings``. Where a document is one row, its words are counted where
    it is read, and of a block of documents only the best postings of each word travel on."""
    if T.docs_are_rows(spark, sf):
        counted = I.counted_words(T.normal_texts(spark, sf), T.DOC_CAP)
        return I.cap(counted.select("ngram", "query_id", F.col("score").cast("long").alias("score")), T.DOC_CAP)
    return I.cap(_doc_postings(spark, sf), T.DOC_CAP)


@query
def inverted_index_capped(spark, sf):
    return _capped_doc_postings(spark, sf)


@query
def posting_lengths(spark, sf):
    return I.dictionary(_capped_doc_postings(spark, sf))


@query
def dictionary_union(spark, sf):
    items = T.item_words(spark, sf).select(F.col("word").alias("ngram"), "item_id").distinct()
    merged = I.merge_dictionaries([I.dictionary(_doc_postings(spark, sf)), I.dictionary(items)])
    ngram, shard = I.merged_key(F.col("key"))
    return merged.select(ngram.alias("ngram"), shard.cast("long").alias("shard"), "len")


@query
def elegant_pair_roundtrip(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"))
    z = hashing.pair(F.col("l_orderkey"), F.col("l_linenumber"))
    x, y = hashing.unpair(F.col("z"))
    return rows.withColumn("z", z).withColumn("x", x.cast("long")).withColumn("y", y.cast("long"))


@query
def id_split_roundtrip(spark, sf):
    rows = T.read(spark, sf, "orders").select(F.col("o_orderkey").cast("long"))
    local, rest = hashing.split_id(F.col("o_orderkey"), T.SHARDS)
    return rows.withColumn("local", local.cast("long")).withColumn("rest", rest.cast("long")).withColumn("back", hashing.join_id(F.col("local"), F.col("rest"), T.SHARDS))


@query
def jump_hash_buckets(spark, sf):
    return T.read(spark, sf, "part").select(F.col("p_partkey").cast("long"), hashing.jump_bucket(F.col("p_partkey").cast("long"), 32).cast("long").alias("bucket"))


def _name_index(spark, sf, **more) -> I.SearchIndex:
    dims = T.name_dims(spark, sf, **more.get("dims", {}))
    corpus = T.names(spark, sf)
    vec = T.name_vectors(spark, sf) if more.get("vectors") else None
    return I.SearchIndex(I.build(corpus, dims), dims, corpus, vec)


def _matches(spark, sf, tfidf: bool) -> DataFrame:
    index = _name_index(spark, sf)
    parsed = S.parsed_queries(T.asked(spark, sf), index)
    return S.keyword_matches(parsed, index.postings, tfidf)


@query
def keyword_search(spark, sf):
    return _matches(spark, sf, False).select("qid", "query_id", r6(F.col("keyword")).alias("keyword"))


@query
def keyword_search_tfidf(spark, sf):
    return _matches(spark, sf, True).select("qid", "query_id", r6(F.col("keyword")).alias("keyword"))


@query
def must_have_filter(spark, sf):
    parsed = P.parse(T.asked(spark, sf), T.name_dims(spark, sf), kernel.SEARCH)
    return parsed.select("qid", F.array_join(F.transform("must_have", lambda k: F.get("words", k)), " ").alias("must"))


@query
def search_with_text(spark, sf):
    return S.search(T.asked(spark, sf), _name_index(spark, sf)).select("qid", "query_id", r6(F.col("keyword")).alias("keyword"), "query", F.col("rank").cast("long").alias("rank"))


@query
def search_topk(spark, sf):
    return S.search(T.asked(spark, sf), _name_index(spark, sf), 3, True).select("qid", "query_id", r6(F.col("keyword")).alias("keyword"), F.col("rank").cast("long").alias("rank"))


@query
def search_overfetch(spark, sf):
    index = _name_index(spark, sf)
    return S.search(T.asked(spark, sf), index, S.OVERFETCH * 2).where("rank <= 2").select("qid", "query_id", F.col("rank").cast("long").alias("rank"))


@query
def search_json(spark, sf):
    out = S.search_json(T.asked(spark, sf), _name_index(spark, sf), 2)
    ids = F.transform(F.from_json("results", "array<array<string>>"), lambda r: F.concat_ws("=", r[0], r[2]))
    return out.select("qid", F.array_join(ids, ";").alias("found"))


@query
def search_reranked(spark, sf):
    """With whether each result is at least as far as the one before."""
    out = S.search(T.asked(spark, sf), _name_index(spark, sf, vectors=True))
    far = F.coalesce("cosine", "keyword")
    ordered = far >= F.coalesce(F.lag(far).over(Window.partitionBy("qid").orderBy("rank")), F.lit(0.0)) - 1e-9
    return out.select("qid", "query_id", r6(F.col("keyword")).alias("keyword"), r6(F.col("cosine")).alias("cosine"), ordered.alias("ordered"))


def _pair_sets(spark, sf, synonyms: Column | None = None) -> DataFrame:
    rows = T.pairs(spark, sf).withColumn("words", F.split("query", " ")).withColumn("cand", text.candidate_words(text.normalize(F.col("candidate"))))
    sets = text.match_sets(F.col("words"), F.col("cand"), synonyms)
    return rows.select("qid", "cand_id", *(_joined(c).alias(n) for n, c in sets.items()))


@query
def match_miss_excess(spark, sf):
    return _pair_sets(spark, sf)


@query
def synonym_substitution(spark, sf):
    pair = F.array(F.struct(F.get("words", F.lit(0)).alias("word"), F.get(F.split("candidate", " "), F.lit(1)).alias("synonym")))
    return _pair_sets(spark, sf, pair)


@query
def excess_refund(spark, sf):
    """Every name as a query whose first word has a synonym: the first word of the next one."""
    rows = T.pairs(spark, sf).withColumn("words", F.split("query", " ")).withColumn("wrs", F.array(F.lit(0.25), F.lit(0.75)))
    rows = rows.withColumn("excess", F.split("candidate", " ")).withColumn("keyword0", F.lit(0.9))
    rows = rows.withColumn("synonyms", F.create_map(F.lit(0), F.get("excess", F.lit(1))))
    return rows.select("qid", "cand_id", r6(S.refund(F.col("keyword0"))).alias("keyword"))


def _combined(spark, sf) -> DataFrame:
    """Of every name: its words' summed vector, and how many of them are unknown."""
    rows = T.names(spark, sf).select("query_id", F.explode(F.split("query", " ")).alias("word"))
    known = rows.join(T.name_terms(spark, sf), "word").join(T.name_vectors(spark, sf), "word", "left")
    pair = F.struct(F.col("vec").cast("array<double>").alias("vec"), F.col("rel").cast("double").alias("w"))
    got = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("word", pair.alias("p")))).alias("all"), F.count_distinct(F.when(F.col("vec").isNull(), F.col("word"))).alias("unknown"))
    return got.withColumn("vec", vectors.weighted_sum(F.transform("all", lambda s: s["p"]))).drop("all")


@query
def vec_combined(spark, sf):
    rows = _combined(spark, sf).where("vec is not null").select("query_id", F.posexplode("vec").alias("place", "x"))
    return rows.select("query_id", F.col("place").cast("long").alias("place"), F.round("x", 3).alias("x"))


@query
def vec_oov(spark, sf):
    return _combined(spark, sf).select("query_id", "unknown")


@query
def vec_cosine(spark, sf):
    one = _combined(spark, sf).where("vec is not null").select("query_id", "vec").withColumn("one", F.lit(1))
    two = one.select("one", F.col("query_id").alias("other_id"), F.col("vec").alias("other"))
    return one.join(two, "one").select("query_id", "other_id", r6(vectors.cosine_distance(F.col("vec"), F.col("other"))).alias("cosine"))  # some dozens of names on either side


@query
def pair_distances(spark, sf):
    return D.distances(T.pairs(spark, sf), T.name_dims(spark, sf)).select("qid", "cand_id", r6(F.col("keyword")).alias("keyword"))


@query
def vec_diff_rerank(spark, sf):
    out = D.distances(T.pairs(spark, sf), T.name_dims(spark, sf), T.name_vectors(spark, sf))
    return out.select("qid", "cand_id", r6(F.col("keyword")).alias("keyword"), r6(F.col("cosine")).alias("cosine"))


def _synonyms(spark, sf) -> DataFrame:
    """The n-th word's synonym is ``alt`` and the word, for every third."""
    ranked = T.name_terms(spark, sf).withColumn("k", F.row_number().over(Window.orderBy("word")))
    return ranked.where("k % 3 = 0").select("word", F.concat(F.lit("alt"), "word").alias("synonym"))


@query
def synonym_variants(spark, sf):
    parsed = P.parse(T.names(spark, sf), T.name_dims(spark, sf, synonyms=_synonyms(spark, sf)), kernel.SEARCH)
    return parsed.select("query_id", F.explode("ngrams").alias("n")).select("query_id", F.col("n.ngram").alias("ngram"), r6(F.col("n.rel")).alias("rel"))


@query
def toponym_must_have(spark, sf):
    places = T.name_terms(spark, sf).withColumn("k", F.row_number().over(Window.orderBy("word"))).where("k % 4 = 1").select("word")
    parsed = P.parse(T.names(spark, sf), T.name_dims(spark, sf, toponyms=places), kernel.INDEX)
    return parsed.select("query_id", _joined(F.transform("must_have", lambda k: F.get("words", k))).alias("must"))


@query
def name_ngrams(spark, sf):
    return I.postings_of(T.names(spark, sf), T.name_dims(spark, sf)).select("ngram", "query_id", F.col("score").cast("long").alias("score"))


@query
def parse_kernel(spark, sf):
    parsed = P.parse(T.sentence_blocks(spark, sf), T.sentence_dims(spark, sf), kernel.INDEX, columns=("ngrams",), block="block")
    return parsed.select("query_id", F.explode("ngrams").alias("n")).select("query_id", F.col("n.ngram").alias("ngram"), r6(F.col("n.rel")).alias("rel"), F.col("n.pos").alias("pos"))


@query
def must_have_words(spark, sf):
    parsed = P.parse(T.sentence_blocks(spark, sf), T.sentence_dims(spark, sf), kernel.SEARCH, columns=("words", "must_have", "n_ngrams"), block="block")
    return parsed.select("query_id", _joined(F.transform("must_have", lambda k: F.get("words", k))).alias("must"), "n_ngrams")


@query
def sentence_search(spark, sf):
    """Sentences of the benchmark against all sentences of the documents; of the index the lists
    that they ask for."""
    dims = T.sentence_dims(spark, sf)
    parts = T.read(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "[.\n]")).alias("k", "query")).select((F.col("item_id") * 1000 + F.col("k")).alias("qid"), F.trim("query").alias("query")).where("query <> ''")
    asked = P.parse(parts, dims, kernel.SEARCH, columns=("ngrams",)).select(F.explode("ngrams.ngram").alias("ngram")).distinct()
    postings = I.build(T.sentence_blocks(spark, sf), dims, only=T.held(asked, "asked"), block="block")
    index = I.SearchIndex(postings, dims, texts=lambda ids: T.sentences_of(spark, sf, ids))
    return S.search(parts, index, 10, hold=lambda df: T.held(df, "nearest")).select("qid", "query_id", r6(F.col("keyword")).alias("keyword"), "rank")


@query
def item_idf(spark, sf):
    """Of the benchmark's words; one that no document has counts as if one had it."""
    n = T.read(spark, sf, "documents").count()
    words = T.item_words(spark, sf).select("word").distinct().join(T.doc_frequency(spark, sf), "word", "left")
    return words.select("word", r6(F.log2(F.lit(n) / F.coalesce("df", F.lit(1)))).alias("idf"))


@query
def three_word_ngrams(spark, sf):
    rows = T.three_words(spark, sf).select("query_id", F.concat_ws(" ", "a", "b", "c").alias("query"))
    parsed = P.parse(rows, T.name_dims(spark, sf), kernel.INDEX)
    return parsed.select("query_id", F.explode("ngrams").alias("n")).select("query_id", F.col("n.ngram").alias("ngram"), r6(F.col("n.rel")).alias("rel"), F.col("n.pos").cast("long").alias("pos"))


@query
def three_word_must(spark, sf):
    rows = T.three_words(spark, sf).select("query_id", F.concat_ws(" ", "a", "b", "c").alias("query"))
    parsed = P.parse(rows, T.name_dims(spark, sf), kernel.SEARCH)
    return parsed.select("query_id", _joined(F.transform("must_have", lambda k: F.get("words", k))).alias("must"))


@query
def joined_dimensions(spark, sf):
    """As three_word_ngrams, with the words joined with the tables instead of these broadcast."""
    rows = T.three_words(spark, sf).select("query_id", F.concat_ws(" ", "a", "b", "c").alias("query"))
    parsed = P.parse(rows, T.name_dims(spark, sf), kernel.INDEX, broadcast_rows=0)
    return parsed.select("query_id", F.explode("ngrams").alias("n")).select("query_id", F.col("n.ngram").alias("ngram"), r6(F.col("n.rel")).alias("rel"), F.col("n.pos").cast("long").alias("pos"))


@query
def stop_unit_ngrams(spark, sf):
    """Two words and a stopword, which comes first, between them or last."""
    stops = T.name_stopwords(spark, sf)
    rows = T.three_words(spark, sf).join(stops.withColumnRenamed("word", "c"), "c", "left_semi")
    for side in ("a", "b"):
        rows = rows.join(stops.withColumnRenamed("word", side), side, "left_anti")
    at = F.col("query_id") % 3
    made = F.when(at == 0, F.concat_ws(" ", "c", "a", "b")).when(at == 1, F.concat_ws(" ", "a", "c", "b")).otherwise(F.concat_ws(" ", "a", "b", "c"))
    parsed = P.parse(rows.select("query_id", made.alias("query")), P.Dimensions(T.name_terms(spark, sf), stops), kernel.INDEX)
    return parsed.select("query_id", F.explode("ngrams").alias("n")).select("query_id", F.col("n.ngram").alias("ngram"), r6(F.col("n.rel")).alias("rel"))


@query
def word_relevances(spark, sf):
    parsed = P.word_relevances(P.parse(T.names(spark, sf), T.name_dims(spark, sf), kernel.INDEX))
    return parsed.select("query_id", F.explode("word_relevances").alias("word", "share")).select("query_id", "word", r6(F.col("share")).alias("share"))


@query
def stop_weight_vectors(spark, sf):
    """Summed vectors of names, in which stopwords weigh less."""
    stops = T.name_stopwords(spark, sf).withColumn("stop", F.lit(True))
    rows = T.names(spark, sf).select("query_id", F.explode(F.split("query", " ")).alias("word")).join(T.name_terms(spark, sf), "word").join(stops, "word", "left").join(T.name_vectors(spark, sf), "word")
    weight = vectors.weight(F.col("rel").cast("double"), F.coalesce("stop", F.lit(False)))
    pair = F.struct("word", F.struct(F.col("vec").cast("array<double>").alias("vec"), weight.alias("w")).alias("p"))
    summed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(pair)).alias("all")).select("query_id", vectors.weighted_sum(F.transform("all", lambda x: x["p"])).alias("vec"))
    return summed.select("query_id", F.posexplode("vec").alias("place", "x")).select("query_id", F.col("place").cast("long").alias("place"), F.round("x", 3).alias("x"))


def _gzip_lines(spark, sf) -> str:
    path = T.scratch(spark, "lines")
    _lines(spark, sf).repartition(1).sortWithinPartitions("p_partkey").select("line").write.option("compression", "gzip").text(path)
    return path


@query
def gzip_lines(spark, sf):
    return lines.read_lines(spark, _gzip_lines(spark, sf)).select("query_id", "type", "query", "parse_error")


@query
def corpus_file(spark, sf):
    return lines.read_corpus(spark, _gzip_lines(spark, sf))


@query
def stopwords_file(spark, sf):
    path = T.scratch(spark, "stopwords")
    T.doc_stopwords(spark, sf).select(F.concat(F.lit(" "), "word", F.lit(" "))).write.text(path)
    return files.read_stopwords(spark, path)


@query
def toponyms_file(spark, sf):
    path = T.scratch(spark, "toponyms")
    T.read(spark, sf, "nation").select(F.lower("n_name")).union(T.read(spark, sf, "region").select(F.lower("r_name"))).write.text(path)
    return files.read_words(spark, path)


@query
def synonyms_file(spark, sf):
    path = T.scratch(spark, "synonyms")
    _synonyms(spark, sf).select(F.concat_ws(" ", "word", "synonym")).write.text(path)
    return files.read_synonyms(spark, path)


@query
def terms_file(spark, sf):
    path = T.scratch(spark, "terms")
    T.name_terms(spark, sf).write.parquet(path)
    return files.read_terms(spark, path)


def _vector_files(spark, sf) -> DataFrame:
    path = T.scratch(spark, "vectors")
    rows = T.name_vectors(spark, sf).orderBy("word").collect()  # some dozens of words
    T.put(spark, f"{path}/words", "\n".join(json.dumps(r["word"]) for r in rows).encode())
    T.put(spark, f"{path}/floats", b"".join(struct.pack(f"<{len(r['vec'])}f", *r["vec"]) for r in rows))
    return files.read_vectors(spark, f"{path}/words", f"{path}/floats", len(rows[0]["vec"]))


@query
def vectors_file(spark, sf):
    return _vector_files(spark, sf).select("word", F.posexplode("vec").alias("place", "x")).select("word", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query
def vector_lookup(spark, sf):
    """One word's vector, and how many words and places there are."""
    every = _vector_files(spark, sf)
    word = T.name_vectors(spark, sf).agg(F.min("word")).first()[0]
    return files.vector_of(every, word).select("word", F.lit(every.count()).cast("long").alias("n_words"), F.size("vec").cast("long").alias("size"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("x"))


@query
def ngram_rows_file(spark, sf):
    """Rows as written and read again, broken ones among them left out."""
    path = T.scratch(spark, "ngram-rows")
    files.write_ngram_rows(I.postings_of(T.names(spark, sf), T.name_dims(spark, sf)), path, 4)
    spark.createDataFrame([("x\ty\tz",), ("1\tlone",), ("2\tfar\t999",)], "line string").write.mode("append").text(path)
    return files.read_ngram_rows(spark, path).select("ngram", "query_id", F.col("score").cast("long").alias("score"))


def _written_index(spark, sf) -> str:
    path = T.scratch(spark, "index")
    _name_index(spark, sf, vectors=True).write(path)
    return path


def _postings(df: DataFrame) -> DataFrame:
    return df.select("ngram", "query_id", F.col("score").cast("long").alias("score"))


@query
def index_round_trip(spark, sf):
    return _postings(I.SearchIndex.load(spark, _written_index(spark, sf)).postings)


@query
def index_shard_ranges(spark, sf):
    """Two ranges of shards, which have every posting once between them."""
    path = _written_index(spark, sf)
    low, high = (I.SearchIndex.load(spark, path, r).postings for r in ((0, 20), (20, I.SHARDS)))
    return _postings(low.unionByName(high))


@query
def loaded_search(spark, sf):
    """keyword_search on an index that was written and loaded."""
    index = I.SearchIndex.load(spark, _written_index(spark, sf))
    parsed = S.parsed_queries(T.asked(spark, sf), index)
    return S.keyword_matches(parsed, index.postings, False, index.shards).select("qid", "query_id", r6(F.col("keyword")).alias("keyword"))


@query
def posting_lookup(spark, sf):
    """The lists of the words of the first name."""
    index = I.SearchIndex.load(spark, _written_index(spark, sf))
    first = T.names(spark, sf).orderBy("query_id").first()["query"].split()
    return _postings(index.lookup(first))


@query
def merged_dictionary_file(spark, sf):
    path = _written_index(spark, sf)
    I.write_dictionary(spark, path)
    found = spark.read.parquet(f"{path}/dictionary")
    ngram, shard = I.merged_key(F.col("key"))
    return found.where(shard == F.col("shard")).select(ngram.alias("ngram"), "len")


@query
def index_counters(spark, sf):
    corpus = T.names(spark, sf)
    return I.counters(corpus, I.postings_of(corpus, T.name_dims(spark, sf)))


@query
def streamed_postings(spark, sf):
    """Postings of a stream of names, batch by batch, with the cap applied anew."""
    path = T.scratch(spark, "stream")
    T.names(spark, sf).repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("query_id bigint, query string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    append.append_postings(stream, T.name_dims(spark, sf), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return _postings(append.compact(spark, f"{path}/out"))


def _settings(spark, sf) -> str:
    """A folder with settings and the tables that they name, on the driver's disk or the shared one."""
    path = T.scratch(spark, "settings")
    T.name_terms(spark, sf).write.parquet(f"{path}/terms")
    T.put(spark, f"{path}/stopwords.txt", b"unusedstopword\n")
    names = {"terms_relevance_file": f"{path}/terms", "stopwords_file": f"{path}/stopwords.txt", "use_word_vectors": False, "nr_shards": 8, "bucket_size": 500, "more": 1}
    local = f"{tempfile.mkdtemp(prefix='kindred-')}/config.json"  # settings are the driver's own
    Path(local).write_text(json.dumps(names))
    return local


@query
def settings_file(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        c = SearchConfig.from_json(_settings(spark, sf))
    row = (c.use_word_vectors, c.nr_shards, c.shard_size, c.bucket_size, c.id_size)
    return spark.createDataFrame([row], "use_word_vectors boolean, nr_shards bigint, shard_size bigint, bucket_size bigint, id_size bigint")


@query
def command_line(spark, sf):
    """Lines to rows, rows to an index in two parts, and its dictionary, all by commands."""
    from kindred import cli

    path, config = T.scratch(spark, "cli"), _settings(spark, sf)
    T.names(spark, sf).select(F.col("query").alias("line"), "query_id").repartition(1).sortWithinPartitions("query_id").select("line").write.option("compression", "gzip").text(f"{path}/lines")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cli.main(["shard", f"{path}/lines", "4", path, "--config", config])
        for first, last in ((0, 3), (3, 8)):
            cli.main(["index", f"{path}/ngrams", str(first), str(last), f"{path}/index", "--config", config, "--corpus", f"{path}/corpus"])
        cli.main(["merge", f"{path}/index"])
    built = I.SearchIndex.load(spark, f"{path}/index")
    named = built.postings.join(built.corpus, "query_id")
    lens = spark.read.parquet(f"{path}/index/dictionary").groupBy("ngram").agg(F.sum("len").alias("len"))
    return named.join(lens, "ngram").select("ngram", "query", F.col("score").cast("long").alias("score"), "len")
