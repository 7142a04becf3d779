"""Token-ID output: Parquet files with one list of ids for each document.

The files hold the documents in ascending ``doc_id`` order, one range of ids to a file. Token ids
are dictionary-encoded, ids and counts delta-encoded (Parquet data pages of version 2), row groups
and pages have set sizes, and the writer adds the column and offset indexes, so that a filter on
``doc_id`` reads the pages that hold the documents and a query of counts reads no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import doc_order, ship

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
END_ID = 2


@dataclass(frozen=True)
class Layout:
    """How the files are laid out. Bytes of row groups and pages, before compression."""

    row_group_bytes: int = 16 << 20
    page_bytes: int = 128 << 10
    page_rows: int = 2_000
    dictionary_bytes: int = 1 << 20
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(self.dictionary_bytes),
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#tokens.list.element": "true",
            "compression": self.codec,
        }


def _encode(tokenizer: str | None, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = bpe.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for block in bpe.blocks(batches, "text", 4_000_000):
            offsets, ids = bpe.with_end(*encoder.encode(block.column("text").combine_chunks()), end)
            n = block.num_rows
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), lists],
                ["doc_id", "part", "local_start", "n_tokens", "tokens"],
            )
            start += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, layout: Layout = Layout()) -> None:  # noqa: B008
    """Encode every whole text, add ``end_id`` to each, and write the ids to ``path``.

    Null texts count as empty: they give the end id alone. Documents of one ``doc_id`` (null comes
    first) all stay; they stand in the order of their texts' hashes. Further columns don't matter.
    An empty table gives files without rows.

    The texts are dealt by ranges of ``doc_id`` before they are encoded, so a task holds one block
    of texts and one row group, whatever the size of the table; a repeated id is dealt by its text.
    """
    ship(docs.sparkSession)
    order = doc_order()
    sorted_docs = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_docs.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**layout.options()).parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and (with ``tokens``) the ids of each document.

    ``start`` counts the ids of all documents before it. ``doc_ids`` picks documents: the filter
    reaches the scan and skips row groups and pages by their indexes. Without ``tokens`` no page of
    token ids is read. Only a sum for each file goes to the driver.
    """
    store = spark.read.schema(SCHEMA).parquet(path)
    sums = {r["part"]: r["n"] for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, starts = 0, {}
    for part in sorted(sums):
        starts[part] = before
        before += sums[part]
    offsets = spark.createDataFrame([*starts.items()] or [(0, 0)], "part int, part_start long")
    if doc_ids is not None:
        store = store.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    if math.prod((len(starts), 32)) <= 8 << 20:  # a row of at most 32 bytes for each file
        offsets = F.broadcast(offsets)
    found = store.join(offsets, "part").withColumn("start", F.col("part_start") + F.col("local_start"))
    return found.select("doc_id", "start", "n_tokens", *(["tokens"] if tokens else []))


def _crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(bpe.crc32s(ids, offsets[:-1], offsets[1:]))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
