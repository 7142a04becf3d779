"""Near-duplicate groups by b-bit MinHash.

Every document becomes its set of distinct word shingles. Documents of one set form a class and go
on as one. Minima of ``n_hashes`` hash functions give band keys; after that only their low bits
are kept, packed. Classes that share a band are candidates: bit counts of the packed signatures,
corrected for chance collisions, estimate their similarity, and those near or above the threshold
are confirmed on full sets.

Links are found in two steps, and only as many as the components need. First each class meets the
pivot of its buckets that looks most similar, and both classes of every bucket of two meet. Then,
in larger buckets that still hold more than one component, all pairs across components are examined, in blocks of a set size that different tasks
take; a block reports the links that join components and no others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import Workspace, fresh, ship
from kindred.llm.graph import components

ROWS, BANDS, BITS = 5, 40, 4
#: Estimates this far below the threshold still count: five standard deviations at 0.8.
SLACK = 0.147
#: Classes of one block, and bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 512, 2_000_000
#: Classes of one bucket that a task gets in a join on the bucket, about.
SALTED = 2_048
#: Bits of the filter that says which documents' sets are wanted, at most: 16 MB.
FILTER_BITS = 1 << 27

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: a published 64-bit finalizer
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text: ``size`` words, or all if there are fewer."""
    offsets, data = bpe.text_bytes(texts)
    data = _LOWER[data]
    on = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = on.copy(), on.copy()
    if len(on):
        begins[1:] &= ~on[:-1] | edge[1:-1]
        ends[:-1] &= ~on[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(begins, offsets)
    bounds = np.empty(2 * len(begins) + 1, np.int64)
    bounds[:-1:2], bounds[1::2], bounds[-1] = begins, ends, len(data)
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = words.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()
    named = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    word = named[coded.indices.to_numpy()]
    n = len(word)
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole[: max(0, n - size + 1)] = _mix(whole[: max(0, n - size + 1)] * _STEP + word[k : n - size + 1 + k]) if n >= size else 0
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(whole[a : b - size + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = _mix(h * _STEP + word[k : k + 1])
            yield h
        else:
            yield np.zeros(0, np.uint64)


class Hashes:
    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(low), 4096):
            np.minimum(out, (self.a * low[None, k : k + 4096] + self.b).min(axis=1), out=out)
        return out


#: A row's doc_id, and two hashes of its text.
KEY = ("doc_id", "text_1", "text_2")


def _keyed(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_1"), F.xxhash64(F.lit(1), "text").alias("text_2")]


def _features(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(ROWS * BANDS)
        for block in bpe.blocks(batches, "text", 4_000_000):
            n_shingles, digest, minima = [], [], np.zeros((block.num_rows, ROWS * BANDS), np.uint32)
            for k, own in enumerate(shingle_sets(block.column("text").combine_chunks(), size)):
                n_shingles.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                if len(own):
                    minima[k] = hashes.minima(own)
            keys = np.zeros((block.num_rows, BANDS), np.uint64)
            for r in range(ROWS):
                keys = _mix(keys * _STEP + minima[:, r::ROWS])
            low = (minima & 15).astype(np.uint8)
            packed = low[:, ::2] | (low[:, 1::2] << 4)
            yield pa.RecordBatch.from_arrays(
                [
                    *(block.column(c).combine_chunks() for c in KEY),
                    pa.array(np.array(n_shingles, np.int64)),
                    pa.array(digest, pa.binary()),
                    pa.array([x.tobytes() for x in packed], pa.binary()),
                    pa.array([x.tobytes() for x in keys], pa.binary()),
                ],
                [*KEY, "n_shingles", "digest", "signature", "bands"],
            )

    return run


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and band; the band's number is in the key."""
    number = np.arange(BANDS, dtype=np.uint64)
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.uint64).reshape(-1, BANDS)
            keys = _mix(keys + number * _STEP).view(np.int64)
            ids = np.repeat(b.column("class_id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], ["class_id", "band"])


_NIBBLES = np.uint64(0x1111111111111111)


def _signatures(rows: list[bytes]) -> np.ndarray:
    wide = -(-len(rows[0]) // 8) * 8
    return np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in rows), np.uint64).reshape(len(rows), -1)


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures: the share of equal low bits, less what chance gives."""
    d = x ^ y
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    differ = np.bitwise_count(d & _NIBBLES).sum(axis=-1, dtype=np.int32)
    chance = 2.0**-BITS
    return (1 - differ / (ROWS * BANDS) - chance) / (1 - chance)


def _estimate(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = similarity(_signatures(b.column("signature").to_pylist()), _signatures(b.column("pivot_signature").to_pylist()))
                keep = pa.array(s >= least)
                yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in ("u", "v", "n")), pa.array(s).filter(keep)], ["u", "v", "n", "estimate"])

    return run


def _linked(a: set[int], b: set[int], percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(a & b)
    return 100 * both >= percent * (small + large - both)


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64) for c in ("left_set", "right_set"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])

    return run


def _filter_of(hashes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter, two bits for each of ``n`` values of the column h. Its words, at most
    FILTER_BITS / 64, are what goes to the driver; with more values it lets more pass."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _sets(size: int, wanted):
    """The sets of the texts that the filter lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        last = np.uint64(len(words) * 64 - 1)

        def passing() -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column("h").to_numpy().view(np.uint64)
                keep = np.ones(len(h), bool)
                for at in (h & last, (h >> np.uint64(32)) & last):
                    keep &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                yield b.filter(pa.array(keep))

        for block in bpe.blocks(passing(), "text", 4_000_000):
            found = [x.tobytes() for x in shingle_sets(block.column("text").combine_chunks(), size)]
            digest = pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), digest, pa.array(found, pa.binary())], ["doc_id", "digest", "shingles"])

    return run


def _pairs(group: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block that look similar and are of different components."""
    comp = group.column("component").to_numpy()
    if (comp == comp[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sig = _signatures(group.column("signature").to_pylist())
    side = group.column("block").to_numpy()
    across = side.min() != side.max()
    left, right = [], []
    for k in range(len(sig) - 1):
        other = np.flatnonzero((comp[k + 1 :] != comp[k]) & ((side[k + 1 :] != side[k]) if across else True)) + k + 1
        if len(other):
            near = other[similarity(sig[k][None], sig[other]) >= least]
            left.append(np.full(len(near), k))
            right.append(near)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of equal (band, i, j) of sorted batches; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("band", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, a])
            if key != last and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sorted_by_group(df: DataFrame) -> DataFrame:
    return df.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _open(least: float):
    """The classes of a block that have a similar one in another component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, ids = [], []
        for group in _groups(batches):
            if group.num_rows > 1:
                left, right = _pairs(group, least)
                if len(left):
                    found = group.column("class_id").to_numpy()[np.union1d(left, right)]
                    ids.append(found)
                    bands.append(np.full(len(found), group.column("band")[0].as_py()))
            if len(ids) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bands)), pa.array(np.concatenate(ids))], ["band", "class_id"])
                bands, ids = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bands)), pa.array(np.concatenate(ids))], ["band", "class_id"])

    return run


def _links(group: pa.RecordBatch, least: float, percent: int) -> list[tuple[int, int]]:
    left, right = _pairs(group, least)
    if not len(left):
        return []
    sig = _signatures(group.column("signature").to_pylist())
    raw, ids, comp = group.column("shingles"), group.column("class_id").to_pylist(), group.column("component").to_pylist()
    keys = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.uint64).reshape(group.num_rows, BANDS)
    own = _mix(keys + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)
    here = int((own[left[0]] == group.column("band")[0].as_py()).argmax())
    first = (own[left] == own[right]).argmax(axis=1) == here  # a pair is examined in the first band it shares
    left, right = left[first], right[first]
    by = np.argsort(-similarity(sig[left], sig[right]), kind="stable")
    held: dict[int, set[int]] = {}
    top: dict[int, int] = {}
    links = []

    def root(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    def members(k: int) -> set[int]:
        if k not in held:
            held[k] = set(np.frombuffer(raw[k].as_buffer(), np.uint64).tolist())
        return held[k]

    for a, b in zip(left[by].tolist(), right[by].tolist(), strict=True):
        x, y = root(comp[a]), root(comp[b])
        if x != y and _linked(members(a), members(b), percent):
            top[max(x, y)] = min(x, y)
            links.append((ids[a], ids[b]))
    return links


def _join_up(least: float, percent: int):
    """Links of a block that join components: similar pairs first, none within what is joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows > 1 and (links := _links(group, least, percent)):
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id; all its columns stay.

    Of a group's documents that share its smallest doc_id, or have none as all its documents do, the
    one with the smallest digest of its shingle set stays; of rows that repeat both a doc_id and a
    shingle set, one. Other rows that share a doc_id don't matter to each other. A text without words,
    null or empty, is in no group: all such rows stay. An empty table gives no rows; columns may have
    any names.
    """
    run = Workspace(docs.sparkSession)
    seen, _, first = _grouped(docs, shingle, percent, run)
    same = seen["doc_id"].eqNullSafe(first["component_id"]) & (seen["digest"] == first["first_digest"])
    worded = seen.join(first, same, "left_semi").groupBy("doc_id", "digest").agg(F.min(F.struct("text_1", "text_2")).alias("text"), F.count("*").alias("n"))
    wordless = seen.where("n_shingles = 0").groupBy("doc_id", "digest", F.struct("text_1", "text_2").alias("text")).agg(F.lit(1).cast("long").alias("n"))
    first = run.write(worded.unionByName(wordless), "first")
    own, named = {}, docs
    for c, of in zip(KEY, _keyed(docs), strict=True):
        own[c] = fresh(f"_{c}", named)
        named = named.withColumn(own[c], of)
    kept = first.select(F.col("doc_id").alias("a"), F.col("text.text_1").alias("b"), F.col("text.text_2").alias("c"))
    # a third of the rows may lack a doc_id: texts' hashes deal them
    rows = named.join(kept, named[own["doc_id"]].eqNullSafe(kept["a"]) & (named[own["text_1"]] == kept["b"]) & (named[own["text_2"]] == kept["c"]), "left_semi")
    if first.where("n > 1").limit(1).count():
        alone = fresh("_alone", rows)
        wordless = ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
        rows = rows.withColumn(alone, F.when(wordless, F.monotonically_increasing_id())).dropDuplicates([*own.values(), alone]).drop(alone)
    return rows.drop(*own.values())


def find_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Words are what blanks part, A-Z lower-cased. Two documents are linked if their shingle sets
    have at least ``percent`` % of their union in common; component_id is the smallest doc_id that
    links lead to, the document's own included, and kept says whether that is its own.

    A text without words, null or empty, has no shingles, no links and stays. Rows of one doc_id
    are documents each for itself and all have their row. A null doc_id is above all others.
    Other columns don't matter; an empty table gives no rows.

    A pair at the threshold is missed with a probability of (1 - 0.8^5)^40, 1.3e-7, for want of a
    common band, and 3e-7 for a low estimate. No bucket is cut: large ones are examined in more
    blocks. Texts are read whole, a few million bytes of text at a time or one longer text.
    """
    seen, of_set, _ = _grouped(docs, shingle, percent, Workspace(docs.sparkSession))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    out = seen.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left").select("doc_id", "n_shingles", component)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _salts(n: str | Column = "n") -> Column:
    """How many parts a bucket of ``n`` classes is dealt to."""
    return F.ceil((F.col(n) if isinstance(n, str) else n) / SALTED).cast("long")


def _salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of), _salts()).alias("salt")


def _to_all_salts(df: DataFrame) -> DataFrame:
    """A row for each part that its bucket is dealt to."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts() - 1)))


def _grouped(docs: DataFrame, shingle: int, percent: int, run: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's doc_id, hashes of its text, n_shingles and digest (of its set); component_id by
    digest; and of every component, component_id and first_digest, which it keeps."""
    spark = docs.sparkSession
    ship(spark)
    least = percent / 100 - SLACK
    keyed = docs.select(*_keyed(docs), "text")
    seen = run.write(keyed.mapInArrow(_features(shingle), "doc_id long, text_1 long, text_2 long, n_shingles long, digest binary, signature binary, bands binary"), "features")
    grouped = seen.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("min_doc"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = run.write(grouped.withColumn("class_id", F.monotonically_increasing_id()), "classes")

    band_rows = classes.select("class_id", "bands").mapInArrow(_bands, "class_id long, band long")
    buckets = band_rows.groupBy("band").agg(F.count("*").alias("n"), F.min("class_id").alias("pivot")).where("n > 1")
    shared = run.write(band_rows.join(buckets, "band"), "buckets")

    sig = classes.select(F.col("class_id").alias("u"), "signature")
    star = shared.where("class_id <> pivot").groupBy(F.col("class_id").alias("u"), F.col("pivot").alias("v")).agg(F.min("n").alias("n"))
    pivots = shared.where("class_id = pivot").groupBy(F.col("pivot").alias("v")).agg(F.max("n").alias("n"))
    pivots = _to_all_salts(pivots.join(sig.withColumnsRenamed({"u": "v", "signature": "pivot_signature"}), "v")).drop("n")
    star = star.join(sig, "u").withColumn("salt", _salt("u")).join(pivots, ["v", "salt"])
    near = run.write(star.select("u", "v", "n", "signature", "pivot_signature").mapInArrow(_estimate(least), "u long, v long, n long, estimate double"), "near")
    best = near.groupBy("u").agg(F.max_by("v", "estimate").alias("v")).unionByName(near.where("n = 2").select("u", "v")).distinct()

    wanted = run.write(shared.select("class_id").distinct().join(classes.select("class_id", "digest", "min_doc"), "class_id"), "wanted")
    flags = spark.sparkContext.broadcast(_filter_of(wanted.select(F.xxhash64("min_doc").alias("h")), wanted.count()))
    found = keyed.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_sets(shingle, flags), "doc_id long, digest binary, shingles binary")
    found = found.join(wanted, found["doc_id"].eqNullSafe(wanted["min_doc"]) & (found["digest"] == wanted["digest"])).select("class_id", "shingles")
    sets = run.write(found.dropDuplicates(["class_id"]), "sets")
    run.drop("wanted")
    both = best.join(sets.select(F.col("class_id").alias("u"), F.col("shingles").alias("left_set")), "u").join(sets.select(F.col("class_id").alias("v"), F.col("shingles").alias("right_set")), "v")
    links = run.write(both.mapInArrow(_confirm(percent), "u long, v long"), "links")
    run.drop("near")

    joined = run.write(components(links), "joined")
    label = F.coalesce("component", "class_id")
    marked = shared.where("n > 2").join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", "band", "n", label.alias("component"), _salt("class_id"))
    mixed = marked.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("n").alias("n")).where("a < b").select("band", "n")
    left = marked.join(_to_all_salts(mixed).drop("n"), ["band", "salt"]).join(classes.select("class_id", "signature"), "class_id")

    def dealt(df: DataFrame, blocks) -> DataFrame:
        """Each class to the pairs of blocks that its own is in."""
        own = df.withColumn("n_blocks", F.greatest(F.lit(1), blocks)).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("n_blocks")))
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        return other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "n_blocks")

    by_rows = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    candidates = dealt(left, by_rows).select("band", "i", "j", "class_id", "component", "signature", "block")
    open_rows = run.write(_sorted_by_group(candidates).mapInArrow(_open(least), "band long, class_id long").distinct(), "open")
    still = open_rows.join(marked, ["band", "class_id"]).join(classes.select("class_id", "signature", "bands", "n_shingles"), "class_id")
    sizes = still.groupBy("band").agg(F.sum(F.col("n_shingles") * 8 + BLOCK_BYTES // BLOCK_ROWS).alias("bytes"), F.max("n").alias("n"))
    fine = dealt(still.join(_to_all_salts(sizes).drop("n"), ["band", "salt"]), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("long")).join(sets, "class_id")
    fine = _sorted_by_group(fine.select("band", "i", "j", "class_id", "component", "signature", "bands", "block", "shingles"))
    more = fine.mapInArrow(_join_up(least, percent), "u long, v long")
    every = run.write(links.unionByName(more), "every")
    run.drop("buckets", "sets", "links", "joined", "open")
    groups = components(every)
    run.drop("every")

    named = classes.select("class_id", "digest", "min_doc").join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", label)
    order = F.struct(F.col("min_doc").isNull(), "min_doc", "digest")
    first = named.groupBy("component").agg(F.min("min_doc").alias("component_id"), F.min_by("digest", order).alias("first_digest"))
    return seen.select(*KEY, "n_shingles", "digest"), named.join(first, "component").select("digest", "component_id"), first
