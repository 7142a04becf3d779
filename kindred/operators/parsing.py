"""The n-gram generator over a table of queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from kindred.functions.text import MISSING_RELEVANCE
from kindred.operators import kernel

#: Rows of each dimension up to which it goes to the workers whole; beyond that the words of the
#: queries are joined with it.
BROADCAST_ROWS = 500_000
#: Queries of a block, which meets the joined words together, and queries that are parsed at a time.
BLOCK_ROWS, CHUNK_ROWS = 50_000, 2_000

NGRAM = "struct<ngram:string,rel:double,word_ids:array<int>,pos:int>"
COLUMNS = ("ngrams", "words", "wrs", "must_have", "synonyms")
PARSED = f"ngrams array<{NGRAM}>, words array<string>, wrs array<double>, must_have array<int>, synonyms map<int,string>"


@dataclass
class Dimensions:
    """The tables a query's words are looked up in.

    They are taken to be the same as long as this object is in use: small ones are collected once.
    """

    terms: DataFrame  # word string, rel bigint
    stopwords: DataFrame  # word string
    toponyms: DataFrame | None = None  # word string
    synonyms: DataFrame | None = None  # word string, synonym string
    _held: dict[int, tuple | None] = field(default_factory=dict, repr=False, compare=False)

    def broadcasts(self, limit: int) -> tuple | None:
        """Relevances, stopwords, toponyms and synonyms on all workers, or nothing if one of the
        tables has more than ``limit`` rows."""
        if limit not in self._held:
            spark, found = self.terms.sparkSession, []
            for df, columns in ((self.terms, ("word", "rel")), (self.stopwords, ("word",)), (self.toponyms, ("word",)), (self.synonyms, ("word", "synonym"))):
                rows = df.select(*columns).limit(limit + 1).toArrow().to_pydict() if df is not None else {c: [] for c in columns}
                if len(rows["word"]) > limit:
                    self._held[limit] = None
                    return None
                found.append(dict(zip(*rows.values(), strict=True)) if len(columns) > 1 else set(rows["word"]))
            self._held[limit] = tuple(map(spark.sparkContext.broadcast, found))
        return self._held[limit]


_TYPE = pa.struct([
    ("ngrams", pa.list_(pa.struct([("ngram", pa.string()), ("rel", pa.float64()), ("word_ids", pa.list_(pa.int32())), ("pos", pa.int32())]))),
    ("words", pa.list_(pa.string())),
    ("wrs", pa.list_(pa.float64())),
    ("must_have", pa.list_(pa.int32())),
    ("synonyms", pa.map_(pa.int32(), pa.string())),
])


def _lists(lists: Iterable[Iterable]) -> tuple[list, list[int]]:
    """All values of some lists, and where each list ends."""
    values, ends = [], [0]
    for one in lists:
        values += one
        ends.append(len(values))
    return values, ends


def _ngrams(parsed: list[kernel.Parsed]) -> pa.Array:
    texts, ends = _lists(p.ngrams for p in parsed)
    marked = [m for p in parsed for m in p.ngrams.values()]
    ids, id_ends = _lists(own for _, own in marked)
    word_ids = pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(ids, pa.int32()))
    pos, _ = _lists(range(len(p.ngrams)) for p in parsed)
    columns = [pa.array(texts, pa.string()), pa.array([rel for rel, _ in marked], pa.float64()), word_ids, pa.array(pos, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_TYPE.field("ngrams").type.value_type)))


_MADE = {
    "ngrams": _ngrams,
    "words": lambda ps: pa.array([p.words for p in ps], _TYPE.field("words").type),
    "wrs": lambda ps: pa.array([p.shares for p in ps], _TYPE.field("wrs").type),
    "must_have": lambda ps: pa.array([p.must for p in ps], _TYPE.field("must_have").type),
    "synonyms": lambda ps: pa.array([sorted(p.synonyms.items()) for p in ps], _TYPE.field("synonyms").type),
    "n_ngrams": lambda ps: pa.array([len(p.ngrams) for p in ps], pa.int32()),
}


def _parsed(rows: pa.RecordBatch | pa.Table, mode: str, look: kernel.Lookup, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows with some columns of what their queries come to, CHUNK_ROWS at a time."""
    for batch in rows.to_batches(CHUNK_ROWS) if isinstance(rows, pa.Table) else (rows.slice(k, CHUNK_ROWS) for k in range(0, len(rows), CHUNK_ROWS)):
        found = [kernel.parse(q, mode, look) for q in batch.column("query").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(_MADE[c](found) for c in columns)], ["row", *columns])


def _with_tables(mode: str, columns: tuple[str, ...], terms, stops, toponyms, dictionary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = kernel.Lookup(terms.value.get, stops.value.__contains__, toponyms.value.__contains__, dictionary.value)
        for b in batches:
            yield from _parsed(b, mode, look, columns)

    return run


def _words(mode: str):
    def run(rows: pa.Table) -> pa.Table:
        found = set()
        for q in rows.column("query").to_pylist():
            words, glued = kernel.tokenize(q or "", mode, {})
            found.update(words, glued.values())
        block = pa.repeat(rows.column("block")[0], len(found))
        return pa.table([block, pa.array(found, pa.string())], ["block", "word"])

    return run


def _with_facts(mode: str, columns: tuple[str, ...], empty: pa.Schema):
    def run(rows: pa.Table, facts: pa.Table) -> pa.Table:
        words = facts.column("word").to_pylist()
        held = lambda name: zip(words, facts.column(name).to_pylist(), strict=True)
        stop, place = ({w for w, said in held(name) if said} for name in ("stop", "toponym"))
        other = {w: s for w, s in held("synonym") if s is not None}
        out = list(_parsed(rows, mode, kernel.Lookup(dict(held("rel")).get, stop.__contains__, place.__contains__, other), columns))
        return pa.Table.from_batches(out) if out else empty.empty_table()

    return run


def _facts(given: DataFrame, dims: Dimensions, mode: str) -> DataFrame:
    """What the tables say about the words of each block of queries, and about their synonyms: each
    block's distinct words meet the tables and come back, without the queries."""
    flag = lambda df, name: df.select("word").distinct().withColumn(name, F.lit(True))
    every = given.groupBy("block").applyInArrow(_words(mode), "block bigint, word string").withColumn("synonym", F.lit(None).cast("string"))
    if dims.synonyms is not None:
        pairs = every.drop("synonym").join(dims.synonyms.groupBy("word").agg(F.max("synonym").alias("synonym")), "word", "left").select("block", "word", "synonym")
        others = pairs.where("synonym is not null").select("block", F.col("synonym").alias("word"), F.lit(None).cast("string").alias("synonym"))
        every = pairs.unionByName(others).groupBy("block", "word").agg(F.max("synonym").alias("synonym"))
    known = every.join(dims.terms.groupBy("word").agg(F.first("rel").alias("rel")), "word", "left").join(flag(dims.stopwords, "stop"), "word", "left")
    known = known.join(flag(dims.toponyms, "toponym"), "word", "left") if dims.toponyms is not None else known.withColumn("toponym", F.lit(None).cast("boolean"))
    return known.where("rel is not null or stop or toponym or synonym is not null").select("block", "word", "rel", "synonym", "stop", "toponym")


def block_of(query: Column, rows: int) -> Column:
    """The block of a query: of ``rows`` queries some BLOCK_ROWS have the same. It goes by the text alone."""
    return F.pmod(F.xxhash64(query), F.lit(rows // BLOCK_ROWS + 1)).cast("bigint")


def parse(queries: DataFrame, dims: Dimensions, mode: str = kernel.INDEX, column: str = "query", broadcast_rows: int = BROADCAST_ROWS, columns: tuple[str, ...] = COLUMNS, block: str | None = None) -> DataFrame:
    """``queries`` with the columns of PARSED, or some of these (``columns``; n_ngrams may be among
    them). A null query has no words and no n-grams.

    Tables of at most ``broadcast_rows`` rows each go to the workers whole, once for ``dims``; with
    any larger one, of which there is no limit, the words of blocks of queries are joined with the
    tables, and a block's queries meet its words. Both ways give the same. Columns may have any
    names. ``block`` names a column that says by ``block_of`` which block a query belongs to, and
    by which ``queries`` may be partitioned already; it is not returned.
    """
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    row = F.struct(*(quoted(c).alias(c) for c in queries.columns if c != block)).alias("row")
    tables = dims.broadcasts(broadcast_rows)
    if tables is not None:
        given = queries.select(row, quoted(column).alias("query"))
    else:
        which = block_of(quoted(column), queries.count()) if block is None else quoted(block)
        given = queries.select(which.alias("block"), row, quoted(column).alias("query"))
    kinds = StructType([StructField("row", given.schema["row"].dataType), *(f for f in StructType.fromDDL(f"{PARSED}, n_ngrams int") if f.name in columns)])
    columns = tuple(f.name for f in kinds)[1:]
    if tables is not None:
        parsed = given.mapInArrow(_with_tables(mode, columns, *tables), kinds)
    else:
        facts = _facts(given.select("block", "query"), dims, mode)
        parsed = given.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(_with_facts(mode, columns, to_arrow_schema(kinds)), kinds)
    return parsed.select("row.*", *columns)


def word_relevances(parsed: DataFrame) -> DataFrame:
    """A map from each distinct word to its share; the last of repeated words counts."""
    last = F.expr("map_from_entries(transform(filter(sequence(0, size(words) - 1), i -> size(words) > 0 and array_position(slice(words, i + 2, size(words)), words[i]) = 0), i -> struct(words[i], wrs[i])))")
    return parsed.withColumn("word_relevances", F.when(F.size("words") > 0, last))


def term_relevance(documents_words: DataFrame, n: int) -> DataFrame:
    """word and rel, round(1000 * log2(n / df)), from a table of (doc, word)."""
    return documents_words.distinct().groupBy("word").agg(F.count("*").alias("df")).select("word", F.round(1000 * F.log2(F.lit(n) / F.col("df"))).cast("bigint").alias("rel"))


def relevance(word: str = "rel"):
    return F.coalesce(F.col(word), F.lit(MISSING_RELEVANCE))
