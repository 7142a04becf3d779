"""Dimension tables, n-gram rows and word vectors from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.lines import with_ordinal


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    words = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    if words.isEmpty():
        raise ValueError(f"no stopwords in {path}")
    return words


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """word and synonym; the last line of a word counts. A line of other than two parts is an error."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.split("value", " ").alias("parts"))
    parts = lines.withColumn("parts", F.when(F.size("parts") == 2, F.col("parts")).otherwise(F.raise_error(F.lit("a synonym line has two words"))))
    return parts.groupBy(F.col("parts")[0].alias("word")).agg(F.max_by(F.col("parts")[1], "place").alias("synonym"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, rel bigint").parquet(path)


def read_ngram_rows(spark: SparkSession, path: str) -> DataFrame:
    """ngram, query_id and score from tab-separated rows; malformed rows are dropped."""
    rows = spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema("query_id bigint, ngram string, score smallint").csv(path)
    return rows.where("query_id is not null and ngram is not null and score between 0 and 255").select("ngram", "query_id", "score")


def write_ngram_rows(postings: DataFrame, path: str, shards: int) -> None:
    """Tab-separated rows, a file for each group of n-grams."""
    postings.select("query_id", "ngram", "score").repartition(shards, "ngram").write.mode("overwrite").option("sep", "\t").csv(path)


def read_vectors(spark: SparkSession, words_path: str, vectors_path: str, dimension: int) -> DataFrame:
    """word and vec, from a JSON string a line and raw rows of little-endian 32-bit floats; line
    and row of one number belong together."""
    import numpy as np

    words = with_ordinal(spark.read.text(words_path).select(F.monotonically_increasing_id().alias("place"), "value"), "place", name="word_id")
    words = words.select("word_id", F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("word"))
    rows = spark.sparkContext.binaryRecords(vectors_path, 4 * dimension).zipWithIndex().map(lambda x: (x[1], np.frombuffer(x[0], "<f4").tolist()))
    both = words.join(spark.createDataFrame(rows, "word_id bigint, vec array<float>"), "word_id", "full")
    one = F.when(F.col("word").isNotNull() & F.col("vec").isNotNull(), F.col("word")).otherwise(F.raise_error(F.lit("words and vectors differ in number")))
    return both.select(one.alias("word"), "vec")


def vector_of(vectors: DataFrame, word: str) -> DataFrame:
    """The vector of one word: a row, or none."""
    return vectors.where(F.col("word") == word)
