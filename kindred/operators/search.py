"""Search by the index: postings, keyword distance, refund, rerank, top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.functions.hashing import shard_of
from kindred.operators import kernel
from kindred.operators.index import SHARDS, SearchIndex
from kindred.operators.parsing import parse
from kindred.operators.rerank import cosine_of

#: Keyword distances from this on are dropped, and candidates that the rerank sees at least.
MAX_DISTANCE, LEAST_POOL = 0.951, 200
#: What the JSON form fetches, in multiples of its count.
OVERFETCH = 30


def _tag(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("qid").cast("long"), F.col("query").cast("string")).where(F.coalesce(F.col("query"), F.lit("")) != "")


def parsed_queries(queries: DataFrame, index: SearchIndex) -> DataFrame:
    return parse(_tag(queries), index.dims, kernel.SEARCH)


def hit_weight(score: Column, query_rel: Column, with_tfidf: bool) -> Column:
    """What a posting counts: 1, or with TF-IDF how far its n-gram's weight in the stored query
    comes up to that in the query."""
    if not with_tfidf:
        return F.lit(1.0)
    return F.when(query_rel > 0, F.least(score / 100.0, query_rel) / query_rel).otherwise(F.lit(0.0))


def keyword_matches(parsed: DataFrame, postings: DataFrame, with_tfidf: bool = False, shards: int = SHARDS) -> DataFrame:
    """qid, query_id and keyword distance of all stored queries that share an n-gram, have all
    words that must be there, and are nearer than MAX_DISTANCE.

    The n-grams of the queries are looked up by an equi-join, on the shard too where postings have
    it, so that a small batch reads the shards of its own n-grams; a list has at most its cap, so a
    query meets at most its n-grams times the cap. Of several n-grams with a word the first with a
    weight counts.
    """
    grams = parsed.select("qid", F.explode("ngrams").alias("n")).select("qid", F.col("n.ngram").alias("ngram"), F.col("n.rel").alias("rel"), F.col("n.word_ids").alias("word_ids"), F.col("n.pos").alias("pos"))
    key = ["ngram"]
    if "shard" in postings.columns:
        grams, key = grams.withColumn("shard", shard_of(F.col("ngram"), shards)), ["shard", "ngram"]
    hits = grams.join(postings, key).select("qid", "query_id", "pos", F.explode(F.array_distinct("word_ids")).alias("word_id"), hit_weight(F.col("score"), F.col("rel"), with_tfidf).alias("w"))
    covered = hits.where("w > 0").groupBy("qid", "query_id", "word_id").agg(F.min_by("w", "pos").alias("w"))
    facts = parsed.select("qid", "wrs", "must_have")
    found = covered.groupBy("qid", "query_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", "w"))).alias("covered")).join(facts, "qid")
    complete = F.forall("must_have", lambda k: F.map_contains_key(F.col("covered"), k))
    total = F.aggregate(F.array_sort(F.map_entries("covered")), F.lit(0.0), lambda s, e: s + F.get(F.col("wrs"), e["key"]) * e["value"])
    out = found.where(complete).select("qid", "query_id", F.greatest(F.lit(0.0), 1 - total).alias("keyword"))
    return out.where(F.col("keyword") < MAX_DISTANCE)


def top(df: DataFrame, k: Column | int, *order: Column) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place")


def _pool(parsed: DataFrame, matches: DataFrame, index: SearchIndex, count: int, hold: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The nearest candidates, with their words set against the query's."""
    best = top(matches, max(count, LEAST_POOL), F.col("keyword"), F.col("query_id"))
    if hold is not None:
        best = hold(best)
    corpus = index.texts(best.select("query_id").distinct()) if index.texts is not None else index.corpus
    if corpus is not None:
        best = best.join(corpus.select("query_id", F.col("query").alias("stored")), "query_id", "left")
    else:
        best = best.withColumn("stored", F.lit(None).cast("string"))
    facts = parsed.select("qid", "words", "wrs", "synonyms")
    out = best.withColumn("text", F.coalesce("stored", F.lit(""))).join(facts, "qid")
    candidate = text.candidate_words(text.normalize(F.col("text")))
    index_of = F.expr("filter(transform(map_entries(synonyms), e -> struct(words[e.key] as word, e.value as synonym)), s -> s.word is not null)")
    out = out.withColumn("candidate", candidate).withColumn("pairs", index_of)
    sets = text.match_sets(F.col("words"), F.col("candidate"), F.col("pairs"))
    for name, column in sets.items():
        out = out.withColumn(name, column)
    return out


def refund(keyword: Column) -> Column:
    """The keyword distance less, for each excess word that is a word or synonym of the query, its
    part by that word's weight; never below 0."""
    place = "coalesce(try_element_at(filter(map_entries(synonyms), e -> e.value = w), -1).key, cast(size(words) - array_position(reverse(words), w) as int))"
    known = "exists(map_values(synonyms), s -> s = w) or array_contains(words, w)"
    weights = F.expr(f"transform(filter(excess, w -> {known}), w -> wrs[{place}])")
    return F.aggregate(weights, keyword, lambda d, r: F.greatest(F.lit(0.0), d - F.col("keyword0") * r))


def search(queries: DataFrame, index: SearchIndex, count: int = 100, with_tfidf: bool = False, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, query_id, keyword, cosine, query and rank (from 1): for each row of ``queries``
    (qid, query) the ``count`` nearest stored queries.

    Empty and null queries have no results, nor does any with a count below 1. cosine is null
    without vectors, or where words are missing from them; keyword ranks then. ``hold`` keeps the
    nearest candidates, as a file say, so that they aren't sought twice where the index looks up
    their texts.
    """
    spark = queries.sparkSession
    schema = "qid bigint, query_id bigint, keyword double, cosine double, query string, rank int"
    if count < 1:
        return spark.createDataFrame([], schema)
    parsed = parsed_queries(queries, index)
    pool = _pool(parsed, keyword_matches(parsed, index.postings, with_tfidf, index.shards), index, count, hold)
    pool = pool.withColumn("keyword0", F.col("keyword")).withColumn("keyword", refund(F.col("keyword0")))
    ranked = cosine_of(pool, index.vectors, index.dims)
    by = Window.partitionBy("qid").orderBy(F.coalesce("cosine", "keyword"), "query_id")
    out = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= count)
    shown = F.col("stored") if index.corpus is None and index.texts is None else F.col("text")
    return out.select("qid", "query_id", "keyword", "cosine", shown.alias("query"), "rank")


def search_json(queries: DataFrame, index: SearchIndex, count: int = 100, with_tfidf: bool = False) -> DataFrame:
    """qid and the results as one JSON array of [id, distance, query], from a larger pool."""
    wide = search(queries, index, OVERFETCH * count, with_tfidf).where(F.col("rank") <= count)
    row = F.concat(F.lit("["), F.col("query_id"), F.lit(","), F.to_json(F.struct("query_id", "keyword", "cosine"), {"ignoreNullFields": "false"}), F.lit(","), F.coalesce(F.expr("substring(to_json(struct(query as q)), 6, length(to_json(struct(query as q))) - 6)"), F.lit("null")), F.lit("]"))
    lists = wide.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("rows"))
    return lists.select("qid", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")).alias("results"))


def results(df: DataFrame):
    """Rows one by one, a partition at a time on the driver."""
    return df.toLocalIterator()
