"""The capped inverted index: build, write, load, union."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.hashing import quantize, shard_of
from kindred.operators import kernel
from kindred.operators.parsing import BROADCAST_ROWS, Dimensions, parse

BUCKET_SIZE, SHARDS = 2_500, 64
#: Bytes of text whose words are counted together.
BLOCK_BYTES = 32_000_000


def postings_of(corpus: DataFrame, dims: Dimensions, block: str | None = None) -> DataFrame:
    """ngram, query_id and score (0 to 255) of every n-gram of every query of ``corpus``; ``block``
    as ``parse`` has it."""
    parsed = parse(corpus.select("query_id", "query", *([block] if block else [])), dims, kernel.INDEX, columns=("ngrams",), block=block)
    each = parsed.select("query_id", F.explode("ngrams").alias("n"))
    return each.select(F.col("n.ngram").alias("ngram"), "query_id", quantize(F.col("n.rel")).alias("score"))


def cap(postings: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """The ``bucket_size`` best postings of each n-gram: by score, then by the larger id.

    With spark.sql.optimizer.windowGroupLimitThreshold at bucket_size or more Spark keeps only so
    many of a key in each task before the shuffle, so that a very frequent n-gram can't overload
    one; ``limit_pushed`` sets that.
    """
    by = Window.partitionBy("ngram").orderBy(F.desc("score"), F.desc("query_id"))
    return postings.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= bucket_size).drop("rank")


def _best_of_block(ids: np.ndarray, texts: pa.Array, bucket_size: int) -> pa.RecordBatch:
    words = pc.split_pattern(texts, " ")
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()  # Spark sorts what is in order fast
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs, counts = np.unique(place[coded.indices.to_numpy()] * len(ids) + pc.list_parent_indices(words).to_numpy(), return_counts=True)
    word, doc = np.divmod(pairs, max(len(ids), 1))
    counts = np.minimum(counts, 255)
    best = np.lexsort((-ids[doc], -counts, word))
    word, doc, counts = word[best], doc[best], counts[best]
    first = np.searchsorted(word, np.arange(len(order)))
    kept = np.arange(len(word)) - first[word] < bucket_size
    names = coded.dictionary.take(pa.array(order[word[kept]]))
    out = pa.RecordBatch.from_arrays([names, pa.array(ids[doc[kept]]), pa.array(counts[kept].astype(np.int16))], ["ngram", "query_id", "score"])
    return out.filter(pc.not_equal(names, ""))


def counted_words(docs: DataFrame, bucket_size: int) -> DataFrame:
    """ngram, query_id and score: how often each word, between blanks, is in each text (doc_id, text;
    an id has one row), up to 255. Of a block of BLOCK_BYTES at most the ``bucket_size`` best of a
    word are returned, which are all that ``cap`` can keep of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy().astype(np.int64), b.column("text")
            block = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // BLOCK_BYTES
            ends = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(ids)]
            for low, high in zip(ends, ends[1:]):
                if low < high:
                    yield _best_of_block(ids[low:high], texts.slice(low, high - low), bucket_size)

    return docs.select("doc_id", "text").mapInArrow(run, "ngram string, query_id bigint, score smallint")


def limit_pushed(spark: SparkSession, bucket_size: int = BUCKET_SIZE) -> None:
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(name)) < bucket_size:
        spark.conf.set(name, str(bucket_size))


def build(corpus: DataFrame, dims: Dimensions, bucket_size: int = BUCKET_SIZE, only: DataFrame | None = None, block: str | None = None) -> DataFrame:
    """The capped postings of a corpus. With ``only`` (ngram) the lists of these n-grams alone, whole
    as they are in the index: others are left out before anything travels."""
    limit_pushed(corpus.sparkSession, bucket_size)
    postings = postings_of(corpus, dims, block)
    if only is not None:
        postings = postings.join(few(only.select("ngram")), "ngram", "left_semi")
    return cap(postings, bucket_size)


def few(rows: DataFrame) -> DataFrame:
    """Rows that are cheap to read twice, to be broadcast where they are at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def dictionary(postings: DataFrame) -> DataFrame:
    """ngram and the length of its list."""
    return postings.groupBy("ngram").agg(F.count("*").alias("len"))


def merge_dictionaries(dictionaries: Iterable[DataFrame]) -> DataFrame:
    """Union of dictionaries; the key says which one a line comes from."""
    marked = [d.select(F.concat(F.col("ngram"), F.lit("\0\0"), F.lit(str(k))).alias("key"), "ngram", F.lit(k).alias("shard"), "len") for k, d in enumerate(dictionaries)]
    return reduce(DataFrame.unionByName, marked)


def merged_key(key) -> tuple:
    """n-gram and shard of a merged key."""
    parts = F.split(key, "\0\0")
    return parts[0], parts[1].cast("int")


@dataclass
class SearchIndex:
    """Postings, the queries they point to, and word vectors."""

    postings: DataFrame  # ngram, query_id, score and, where it was loaded, shard
    dims: Dimensions
    corpus: DataFrame | None = None
    vectors: DataFrame | None = None  # word string, vec array<float>
    shards: int = SHARDS
    texts: Callable[[DataFrame], DataFrame] | None = None  # the corpus of some query_ids, where that costs less than all of it

    @property
    def has_corpus(self) -> bool:
        return self.corpus is not None

    def narrowed(self, ngrams: list[str]) -> SearchIndex:
        """The same with the lists of some n-grams only. Of a loaded index their shards alone are
        read, and there the row groups that can have them."""
        wanted = sorted(set(ngrams))
        postings = self.postings.where(F.col("ngram").isin(wanted))
        if "shard" in postings.columns:
            spark = postings.sparkSession
            shards = [r[0] for r in spark.createDataFrame([(x,) for x in wanted] or [("",)], "ngram string").select(shard_of(F.col("ngram"), self.shards)).distinct().collect()]
            postings = postings.where(F.col("shard").isin(shards))
        return replace(self, postings=postings)

    def lookup(self, ngrams: list[str]) -> DataFrame:
        """ngram, query_id and score of the lists of some n-grams."""
        return self.narrowed(ngrams).postings.select("ngram", "query_id", "score")

    def write(self, path: str, table: str | None = None) -> None:
        """Parquet under ``path``, by shard and sorted by n-gram, with a bloom filter on it. Ranges
        of shard and n-gram are dealt to tasks, so a large shard has several files. With ``table``
        the postings also become a bucketed table of that name."""
        write_postings(self.postings.withColumn("shard", shard_of(F.col("ngram"), self.shards)), f"{path}/postings")
        self.write_rest(path)
        if table:
            self.postings.write.mode("overwrite").bucketBy(self.shards, "ngram").sortBy("ngram").saveAsTable(table)

    def write_rest(self, path: str) -> None:
        """What an index has beside its postings."""
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.shards,)], "shards int").write.mode("overwrite").parquet(f"{path}/layout")
        frames = {"terms": self.dims.terms, "stopwords": self.dims.stopwords, "toponyms": self.dims.toponyms, "synonyms": self.dims.synonyms, "corpus": self.corpus, "vectors": self.vectors}
        for name, df in frames.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, shards: tuple[int, int] | None = None) -> SearchIndex:
        """``shards``: from and to (half-open); only those are read. It is an error if there is no
        index at ``path`` or no shard in the range."""
        jvm = spark.sparkContext._jvm

        def read(name: str) -> DataFrame | None:
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            return spark.read.parquet(f"{path}/{name}") if fs.exists(at) else None

        postings, terms, stopwords = (read(name) for name in ("postings", "terms", "stopwords"))
        if postings is None or terms is None or stopwords is None:
            raise ValueError(f"no index in {path}")
        layout = read("layout")
        n_shards = layout.first()["shards"] if layout is not None else SHARDS
        if shards:
            if not 0 <= shards[0] < shards[1] <= n_shards:
                raise ValueError(f"shards {shards[0]} to {shards[1]} of {n_shards}")
            postings = postings.where(F.col("shard").between(shards[0], shards[1] - 1))
        return cls(postings, Dimensions(terms, stopwords, read("toponyms"), read("synonyms")), read("corpus"), read("vectors"), n_shards)


def write_postings(marked: DataFrame, path: str, others_stay: bool = False) -> None:
    """Postings with their shards, as an index has them; with ``others_stay`` in place of these
    shards only."""
    dealt = marked.repartitionByRange("shard", "ngram").sortWithinPartitions("shard", "ngram", F.desc("score"))
    out = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if others_stay else "static")
    out.option("parquet.bloom.filter.enabled#ngram", "true").partitionBy("shard").parquet(path)


def write_dictionary(spark: SparkSession, path: str) -> None:
    """One dictionary of an index's shards, sorted, beside its postings."""
    keyed = spark.read.parquet(f"{path}/postings").groupBy("ngram", "shard").agg(F.count("*").alias("len"))
    key = F.concat("ngram", F.lit("\0\0"), F.col("shard").cast("string")).alias("key")
    keyed.select(key, "ngram", "shard", "len").orderBy("ngram", "shard").write.mode("overwrite").parquet(f"{path}/dictionary")


def counters(corpus: DataFrame, postings: DataFrame) -> DataFrame:
    """How much there is: n_queries, n_postings, n_ngrams and the longest list."""
    lists = dictionary(postings).agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n_postings"), F.count("*").alias("n_ngrams"), F.max("len").alias("longest"))
    return corpus.agg(F.count("*").alias("n_queries")).crossJoin(F.broadcast(lists))  # a row each
