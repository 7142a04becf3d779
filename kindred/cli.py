"""python -m kindred.cli get | dists | shard | index | merge | corpus"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.functions.hashing import shard_of
from kindred.operators import distances, index, search
from kindred.operators.parsing import Dimensions
from kindred.sources import lines, tables
from kindred.sources.config import SearchConfig


def _dims(spark: SparkSession, config: SearchConfig) -> Dimensions:
    """The tables that the settings name: relevances as Parquet, the others as lines."""
    places, synonyms = config.path(config.toponyms_file), config.path(config.synonyms_file)
    return Dimensions(
        tables.read_terms(spark, config.path(config.terms_relevance_file)),
        tables.read_stopwords(spark, config.path(config.stopwords_file)),
        tables.read_words(spark, places) if places else None,
        tables.read_synonyms(spark, synonyms) if synonyms else None,
    )


def _vectors(spark: SparkSession, config: SearchConfig):
    if not config.use_word_vectors or not config.words_file or not config.word_vecs_file:
        return None
    return tables.read_vectors(spark, config.path(config.words_file), config.path(config.word_vecs_file), config.vector_size)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred")
    sub = p.add_subparsers(dest="command", required=True)
    get = sub.add_parser("get", help="search the index")
    get.add_argument("query")
    get.add_argument("count", type=int)
    get.add_argument("--with-tfidf", action="store_true")
    dists = sub.add_parser("dists", help="distances of a query to candidates")
    dists.add_argument("query")
    dists.add_argument("candidates", help="comma-separated")
    for s in (get, dists):
        s.add_argument("-s", "--start-shard", type=int)
        s.add_argument("-e", "--end-shard", type=int)
        s.add_argument("--index", default="./index")
    shard = sub.add_parser("shard", help="n-gram rows of query files")
    shard.add_argument("path")
    shard.add_argument("shards", type=int)
    shard.add_argument("output")
    shard.add_argument("prefixes", nargs="?", default="")
    shard.add_argument("--without-i2q", action="store_true")
    shard.add_argument("--config", default="./index/config.json")
    build = sub.add_parser("index", help="postings of n-gram rows, shards first to last")
    build.add_argument("input")
    build.add_argument("first", type=int)
    build.add_argument("last", type=int)
    build.add_argument("output")
    build.add_argument("--config", default="./index/config.json")
    build.add_argument("--corpus", help="what shard has written of ids and queries")
    merge = sub.add_parser("merge", help="one dictionary of an index's shards")
    merge.add_argument("path")
    corpus = sub.add_parser("corpus", help="ids to queries")
    corpus.add_argument("path")
    corpus.add_argument("output")
    return p


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command in ("get", "dists"):
        shards = None if a.start_shard is None or a.end_shard is None else (a.start_shard, a.end_shard)
        found = index.SearchIndex.load(spark, a.index, shards)
    if a.command == "get":
        asked = spark.createDataFrame([(0, a.query)], "qid bigint, query string")
        own = search.parsed_queries(asked, found).select(F.explode("ngrams.ngram")).collect()  # of one query
        found = found.narrowed([r[0] for r in own])
        for r in search.results(search.search(asked, found, a.count, a.with_tfidf).orderBy("rank")):
            print(json.dumps([r["query_id"], r["cosine"], r["keyword"], r["query"]], ensure_ascii=False))
    elif a.command == "dists":
        rows = [(0, a.query, k, c.strip()) for k, c in enumerate(a.candidates.split(","))]
        pairs = spark.createDataFrame(rows, "qid bigint, query string, cand_id bigint, candidate string")
        for r in search.results(distances.distances(pairs, found.dims, found.vectors).orderBy("cand_id")):
            print(json.dumps([r["candidate"], r["cosine"], r["keyword"]], ensure_ascii=False))
    elif a.command == "shard":
        every = lines.read_lines(spark, a.path)
        wanted = [x.strip() for x in a.prefixes.split(",") if x.strip()]
        kept = lines.with_prefixes(every, wanted).where(~F.col("parse_error"))
        tables.write_ngram_rows(index.postings_of(kept, _dims(spark, SearchConfig.from_json(a.config))), f"{a.output}/ngrams", a.shards)
        if not a.without_i2q:
            every.select("query_id", F.coalesce("query", F.lit("")).alias("query")).write.mode("overwrite").parquet(f"{a.output}/corpus")
    elif a.command == "index":
        config = SearchConfig.from_json(a.config)
        if not 0 <= a.first < a.last <= config.nr_shards:
            raise ValueError(f"shards {a.first} to {a.last} of {config.nr_shards}")
        rows = tables.read_ngram_rows(spark, a.input).withColumn("shard", shard_of(F.col("ngram"), config.nr_shards))
        index.limit_pushed(spark, config.bucket_size)
        capped = index.cap(rows.where(F.col("shard").between(a.first, a.last - 1)), config.bucket_size)
        index.write_postings(capped, f"{a.output}/postings", others_stay=True)
        corpus = spark.read.parquet(a.corpus) if a.corpus else None
        index.SearchIndex(capped, _dims(spark, config), corpus, _vectors(spark, config), config.nr_shards).write_rest(a.output)
    elif a.command == "merge":
        index.write_dictionary(spark, a.path)
    else:
        lines.read_corpus(spark, a.path).write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
