"""The search engine's inputs, derived from the test tables.

Short strings are the two-word names of ``part``; longer ones are sentences of ``documents``.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators.index import few
from kindred.operators.parsing import Dimensions, block_of

STOPWORDS, DOC_CAP, SHARDS = 20, 50, 64


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share (see the README)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    top = found or f"file://{tempfile.gettempdir()}"
    return f"{top.rstrip('/')}/kindred-search/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query: each name of two different words once."""
    found = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").cast("long").alias("query_id"))
    two = F.split("query", " ")
    return found.where(F.get(two, F.lit(0)) != F.get(two, F.lit(1))).select("query_id", "query")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and query: a name's second word with the next name's first."""
    rows = names(spark, sf_dir)
    following = F.lead("query").over(Window.orderBy("query_id"))  # some dozens of names
    mixed = rows.select(F.col("query_id").alias("qid"), F.concat_ws(" ", F.get(F.split("query", " "), F.lit(1)), F.get(F.split(following, " "), F.lit(0))).alias("query"), following.alias("next"))
    two = F.split("query", " ")
    return mixed.where("next is not null").where(F.get(two, F.lit(0)) != F.get(two, F.lit(1))).select("qid", "query")


def name_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevances that spread, by the words' order."""
    words = names(spark, sf_dir).select(F.explode(F.split("query", " ")).alias("word")).distinct()
    return words.select("word", (F.lit(1000) + 397 * (F.row_number().over(Window.orderBy("word")) - 1)).cast("bigint").alias("rel"))


def no_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "word string")


def name_dims(spark: SparkSession, sf_dir: str, **more: DataFrame) -> Dimensions:
    return Dimensions(name_terms(spark, sf_dir), no_words(spark), **more)


def name_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word and vec: the n-th word has the vector of id n; every seventh has none."""
    rank = F.row_number().over(Window.orderBy("word")).cast("long")
    ranked = name_terms(spark, sf_dir).select("word", rank.alias("vec_id")).where("vec_id % 7 <> 0")
    return ranked.join(read(spark, sf_dir, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vec"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query with every name: qid, query, cand_id, candidate. Both sides are some dozens."""
    left = asked(spark, sf_dir).withColumn("one", F.lit(1))
    right = names(spark, sf_dir).select(F.lit(1).alias("one"), F.col("query_id").alias("cand_id"), F.col("query").alias("candidate"))
    return left.join(right, "one").drop("one")


def three_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, a, b and c: each name's words and, by its number, a third one. Short words alone would fuse."""
    ranked = name_terms(spark, sf_dir).select("word", F.row_number().over(Window.orderBy("word")).alias("k"))
    two = F.split("query", " ")
    rows = names(spark, sf_dir).select("query_id", F.get(two, F.lit(0)).alias("a"), F.get(two, F.lit(1)).alias("b"), (F.col("query_id") % 16 + 1).alias("k"))
    return rows.join(ranked.withColumnRenamed("word", "c"), "k").where("c <> a and c <> b and greatest(length(a), length(b), length(c)) > 4").select("query_id", "a", "b", "c")


def name_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth word of the names."""
    return name_terms(spark, sf_dir).select("word", F.row_number().over(Window.orderBy("word")).alias("k")).where("k % 5 = 0").select("word")


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and word, for each word of each document's normalised text."""
    return _words(read(spark, sf_dir, "documents"), "doc_id")


def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, pos (from 0) and word of the benchmark items."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.filter(F.split(text.normalize(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")).alias("pos", "word"))
    return rows


def _words(df: DataFrame, key: str) -> DataFrame:
    normal = text.normalize(F.coalesce("text", F.lit("")))
    return df.select(key, F.explode(F.split(normal, " ")).alias("word")).where("word <> ''")


def docs_are_rows(spark: SparkSession, sf_dir: str) -> bool:
    """Whether each document is one row, and has an id."""
    ids = read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n"))
    return not ids.where("n > 1 or doc_id is null").limit(1).count()


def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents, normalised."""
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.coalesce("text", F.lit(""))).alias("text"))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word and df. A document's words are made distinct where it is read, so only counts travel;
    a document that stands in several rows counts once."""
    if docs_are_rows(spark, sf_dir):
        words = normal_texts(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word <> ''")
    else:
        words = doc_words(spark, sf_dir).distinct()
    return words.groupBy("word").agg(F.count("*").alias("df"))


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return doc_frequency(spark, sf_dir).crossJoin(F.broadcast(n)).select("word", F.round(1000 * F.log2(F.col("n") / F.col("df"))).cast("bigint").alias("rel"))  # a table of one row


def doc_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_frequency(spark, sf_dir).orderBy(F.desc("df"), "word").limit(STOPWORDS).select("word")


def _each_once(batches):
    """Every text of a batch once, so that a very common one can't overload its block."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pc.unique(b.column(0))], ["query"])


def held(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written once."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[.\n]")).alias("query")).select(F.trim("query").alias("query")).where("query <> ''")


def sentences_of(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """query_id and query of the sentences with some ids; only these travel."""
    rows = _sentence_rows(read(spark, sf_dir, "documents")).select(F.xxhash64("query").alias("query_id"), "query")
    return rows.join(few(ids), "query_id", "left_semi").distinct()


def sentence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query and block: all sentences, each once; the kernel takes the first 15 words of
    longer ones. They travel once, to their blocks, and are made distinct there. Sentences are some
    80 characters long, of which blocks come to about their size."""
    docs = read(spark, sf_dir, "documents")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = _sentence_rows(docs).mapInArrow(_each_once, "query string").withColumn("block", block_of(F.col("query"), size // 80)).repartition("block")
    return dealt.groupBy("block", "query").agg(F.lit(1)).select(F.xxhash64("query").alias("query_id"), "query", "block")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query of ``sentence_blocks``."""
    return sentence_blocks(spark, sf_dir).select("query_id", "query")


def sentence_dims(spark: SparkSession, sf_dir: str) -> Dimensions:
    places = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("word")).union(read(spark, sf_dir, "region").select(F.lower("r_name").alias("word")))
    path = scratch(spark, "df")
    doc_frequency(spark, sf_dir).write.parquet(path)  # relevances and stopwords both come from it
    df = spark.read.schema("word string, df bigint").parquet(path)
    n = read(spark, sf_dir, "documents").count()
    terms = df.select("word", F.round(1000 * F.log2(F.lit(n) / F.col("df"))).cast("bigint").alias("rel"))
    return Dimensions(terms, df.orderBy(F.desc("df"), "word").limit(STOPWORDS).select("word"), places)
