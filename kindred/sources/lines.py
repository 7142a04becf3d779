"""Query lines: gzip text in, ids, types and queries out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_JSON_STRING = r'^"([^"\\]|\\.)*"$'


def parse_line(line: Column) -> dict[str, Column]:
    """type, query and parse_error of a line ``[id:][type:]query``, of which only what stands
    before the first tab counts; that may be a JSON string. Lines of more than three parts are
    errors, with their type and query null."""
    first = F.trim(F.get(F.split(line, "\t"), F.lit(0)))
    decoded = F.when(first.rlike(_JSON_STRING), F.from_json(F.concat(F.lit('{"v":'), first, F.lit("}")), "v string")["v"])
    plain = F.coalesce(decoded, F.regexp_replace(first, '^"+|"+$', ""))
    parts = F.split(plain, ":", -1)
    n = F.size(parts)
    kind = F.when(n == 1, F.lit("qe")).when(n == 2, F.get(parts, F.lit(0))).when(n == 3, F.get(parts, F.lit(1)))
    return {"type": kind, "query": F.when(n <= 3, F.element_at(parts, -1)), "parse_error": n > 3}


def query_kind(kind: Column) -> Column:
    """Q for queries, TUW for words of titles and addresses."""
    return F.when(kind.isin("q", "qe"), "Q").otherwise("TUW")


def with_prefixes(lines: DataFrame, prefixes: list[str]) -> DataFrame:
    """Lines of the given types; all of them if none is given. Ids are assigned before."""
    return lines.where(F.col("type").isin(prefixes)) if prefixes else lines


def with_ordinal(df: DataFrame, *order: str, name: str = "query_id") -> DataFrame:
    """Consecutive ids from 0 in the given order. A sort by range and a count for each partition;
    no task sees more than its partition."""
    ordered = df.orderBy(*order)
    schema = StructType([StructField(name, LongType(), False), *df.schema.fields])
    return df.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[1], *x[0])), schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """query_id, type, query and parse_error of all lines of the gzip files at ``path``, numbered
    over all files by name."""
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("line"))
    numbered = with_ordinal(raw, "file", "place").select("query_id", "line")
    return numbered.select("query_id", *(c.alias(n) for n, c in parse_line(F.col("line")).items()))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """query_id and query of every line; a broken line keeps its id, with an empty query."""
    return read_lines(spark, path).select("query_id", F.coalesce("query", F.lit("")).alias("query"))
