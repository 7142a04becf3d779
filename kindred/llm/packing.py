"""Best-fit packing of token sequences, planned on a histogram of lengths.

The planner sees how many pieces there are of each length, at most ``capacity`` numbers, and packs
the counts: longest first, each into the fullest sequence that still has room. Pieces then take
the planned slots by their rank among the pieces of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import scratch, ship

CAPACITY, END_ID = 1024, 2
#: Bytes of text that a worker encodes at once.
BLOCK_BYTES = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"
#: Of one length: first rank, number of sequences, slots in each, first sequence, offset there.
Slot = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[Slot]], int]:
    """Slots for every length, and the number of sequences.

    Sequences that are equal so far are one group, so time and result depend on the number of
    different lengths and not on the number of pieces. Within a slot list, ranks go first through
    the sequences, then to the next slot in each.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: first sequence, number
    rooms: list[int] = []
    slots: dict[int, list[Slot]] = defaultdict(list)
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, first, n = capacity, made, left
            each = room // length
            full = min(n, left // each)
            last = left - full * each if full < n and left - full * each < each else 0
            for bins, held in ((full, each), (1, last)):
                if held and bins:
                    slots[length].append((rank, bins, held, first, capacity - room))
                    rank += bins * held
                    left -= bins * held
                    put(room - held * length, first, bins)
                    first, n = first + bins, n - bins
            if room == capacity:
                made = first
            else:
                put(room, first, n)
    return dict(slots), made


def _cut(tokenizer: str | None, end: int, capacity: int, kept: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe.encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for block in bpe.blocks(batches, "text", BLOCK_BYTES):
            offsets, ids = bpe.with_end(*encoder.encode(block.column("text").combine_chunks()), end)
            sizes = np.diff(offsets)
            n_pieces = -(-sizes // capacity)
            head = sizes - (n_pieces - 1) * capacity  # the first piece of each
            doc = np.repeat(np.arange(len(sizes)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            length = np.where(piece == 0, head[doc], capacity)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            begin = offsets[doc] + start
            # rank in this partition: those seen before, and the order within the block
            by = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(doc), np.int64)
            rank[by] = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            rank += seen[length]
            seen += counts
            lists = [pa.ListArray.from_arrays(pa.array(np.append(begin, offsets[-1]), pa.int32()), pa.array(ids, pa.int32()))] if kept else []
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").combine_chunks().cast(pa.int64()).take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length),
                    pa.array(bpe.crc32s(ids, begin, begin + length)),
                    pa.array(np.full(len(doc), part, np.int32)),
                    pa.array(rank),
                    *lists,
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank", *(["ids"] if kept else [])],
            )

    return run


def _take(slots: dict[int, list[Slot]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.array(v, np.int64) for k, v in slots.items()}
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("length_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[by])) + 1
            for rows in np.split(by, cuts):
                if len(rows):
                    size = int(length[rows[0]])
                    t = tables[size]
                    found = t[np.searchsorted(t[:, 0], rank[rows], side="right") - 1]
                    within = rank[rows] - found[:, 0]
                    sequence[rows] = found[:, 3] + within % found[:, 1]
                    offset[rows] = found[:, 4] + within // found[:, 1] * size
            keep = [i for i, name in enumerate(b.schema.names) if name != "length_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece (from 0), start (ids of its document before it),
    length, ids_crc32, sequence_id, offset (its place in the sequence, without gaps from 0) and,
    with ``ids``, the token ids. Only documents of more than ``capacity`` tokens, the end id
    counted, are cut; their first piece has what the full ones leave.

    A null text counts as empty and gives a piece of the end id alone. Rows of one doc_id are
    packed each for itself. An empty table gives no rows. Other columns of ``docs`` don't matter.

    The pieces are written once, so that ranks taken in a partition hold. Counts by partition and
    length are summed up over partitions for each length, and joined on both: no length, however
    common, meets in one task. The driver gets ``capacity`` counts.
    """
    spark = docs.sparkSession
    ship(spark)
    path = scratch(spark, "pieces")
    written = PIECES + ", ids array<int>" * ids
    docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id, capacity, ids), written).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(written).parquet(path)
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    ranked = pieces.join(ranks, ["length", "part"]).withColumn("length_rank", F.col("before") + F.col("part_rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return ranked.select(*columns, "length_rank").mapInArrow(_take(slots), f"{kinds}, sequence_id long, offset long")
