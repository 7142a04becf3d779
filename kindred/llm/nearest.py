"""Nearest neighbours by inner product, with multi-index hashing of learned binary codes.

Vectors are extended by one component that makes all norms equal, so that the largest inner
product is the smallest angle. Rotations learned from a sample turn each into a code of signs. A
code is split into substrings, each with a table of its own; a code within Hamming radius r of a
query's has a substring within r / m of the query's, so probing the tables' keys at that distance
finds every such code. What is within r is ranked by the inner products of the original vectors.

Where neighbours are near, a few keys of each table are probed. On vectors that lie evenly, neighbours
are almost as far as strangers, and no length of substrings prunes: codes are then compared one by one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import Workspace, ship, table

#: Vectors that the codes are learned from at most (those with the smallest hashes), and of these
#: the queries that the radius is set on.
SAMPLE, PROBES = 20_000, 256
ROTATIONS, SUBSTRING_BITS, STEPS = 4, 32, 25
#: Share of true neighbours in the sample that the radius must take in.
RECALL = 0.97
#: Vectors and queries that meet in one task at most, and vectors at least while there are fewer blocks than twice the cores.
VECTOR_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 16_384, 16_384, 1_024
#: Distance of substrings up to which the keys of a table are probed one by one; there are 5,489 within
#: a distance of 3. Farther ones are so many that going through the table's own keys takes less.
PROBED = 3


class Codes:
    """Learned codes: what a vector's bits are, and the radius."""

    def __init__(self, sample: np.ndarray, scale: float, norm: float, top: int, seed: int = 3):
        """``norm``: the largest, of vectors divided by ``scale``."""
        rng = np.random.default_rng(seed)
        self.scale, self.norm = scale, norm
        x = self.extend(sample)
        self.mean = x.mean(axis=0)
        y = x - self.mean
        basis = np.linalg.eigh(y.T @ y / len(y))[1][:, ::-1]
        self.turns = []
        for _ in range(ROTATIONS):  # rotations that bring the projected sample near the corners of the cube
            turn = np.linalg.qr(rng.normal(size=basis.shape))[0]
            p = y @ basis
            for _ in range(STEPS):
                u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
                turn = vt.T @ u.T
            self.turns.append(basis @ turn)
        self.radius = self._radius(sample, top, rng)

    def extend(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        rest = np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Lines of 32-bit substrings."""
        if query:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            y = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True) * self.norm, np.zeros((len(x), 1))])
        else:
            y = self.extend(x)
        bits = np.hstack([(y - self.mean) @ t > 0 for t in self.turns])
        wide = -(-bits.shape[1] // SUBSTRING_BITS) * SUBSTRING_BITS
        bits = np.hstack([bits, np.zeros((len(bits), wide - bits.shape[1]), bool)])
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint32)

    def _radius(self, sample: np.ndarray, top: int, rng) -> int:
        pick = rng.permutation(len(sample))[:PROBES]
        scores = (sample[pick] / self.scale) @ (sample / self.scale).T
        scores[np.arange(len(pick)), pick] = -np.inf
        k = min(top, len(sample) - 1)
        if k < 1:
            return 1 << 20
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        codes, own = self.encode(sample), self.encode(sample[pick], query=True)
        away = np.bitwise_count(own[:, None, :] ^ codes[near]).sum(axis=2)
        return int(np.quantile(away, RECALL, method="higher"))


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """What differs from a key at each distance up to ``most``, together."""
    out = [np.zeros(1, np.uint32)]
    for distance in range(1, most + 1):
        rows = np.array(list(combinations(range(bits), distance)), np.uint32)
        out.append(np.concatenate([out[-1], (np.uint32(1) << rows).sum(axis=1, dtype=np.uint32)]))
    return out


class Tables:
    """The codes of some vectors, with a table for each substring: its distinct values, in order, and who has them."""

    FLIPS = _flips(SUBSTRING_BITS, PROBED)

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.keys, self.places, self.order, self.begins = [], [], [], []
        for k in range(codes.shape[1]):
            keys, place, n = np.unique(codes[:, k], return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.places.append(place.astype(np.int32))
            self.order.append(np.argsort(place, kind="stable").astype(np.int32))
            self.begins.append(np.append(0, np.cumsum(n)))

    def _probe(self, k: int, key: np.uint32, distance: int) -> np.ndarray:
        """Who has a key within the distance, by looking up each such key."""
        keys, begins = self.keys[k], self.begins[k]
        asked = key ^ self.FLIPS[distance]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        at = at[keys[at] == asked]
        return np.concatenate([self.order[k][:0], *(self.order[k][begins[i] : begins[i + 1]] for i in at)])

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Who is within ``radius`` of one query's code."""
        m = self.codes.shape[1]
        each, more = divmod(radius, m)
        found = np.zeros(len(self.codes), bool)
        for k in range(m if len(self.codes) else 0):
            least = each if k <= more else each - 1  # if every substring were farther, the sum would exceed the radius
            if 0 <= least <= PROBED and len(self.FLIPS[least]) < len(self.keys[k]):
                found[self._probe(k, query[k], least)] = True
            elif least >= 0:
                hit = np.bitwise_count(self.keys[k] ^ query[k]) <= least
                found |= hit[self.places[k]]
        some = np.flatnonzero(found)
        return some[np.bitwise_count(self.codes[some] ^ query).sum(axis=1, dtype=np.int32) <= radius]


def _pack(name: str, codes: Codes | None):
    """Each block of sorted rows as one row; of vectors, with their tables."""
    asks = name == "query"

    def row(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
        x = np.concatenate([b.column("embedding").flatten().to_numpy() for b in held]).astype(np.float64).reshape(len(ids), -1)
        made = None if codes is None else codes.encode(x, True) if asks else Tables(codes.encode(x))
        packed = [ids.tobytes(), x.tobytes(), pickle.dumps(made)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([p], pa.binary()) for p in packed)], ["block", f"{name}_ids", f"{name}_vectors", f"{name}_index"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            blocks = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[a] != last and held:
                    yield row(last, held)
                    held = []
                held.append(b.slice(a, z - a))
                last = int(blocks[a])
        if held:
            yield row(last, held)

    return run


def _best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, near: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` of ``near`` by inner product, and these."""
    with np.errstate(all="ignore"):
        if len(near) > top:
            score = np.nan_to_num(vectors[near] @ query, nan=-np.inf, posinf=np.inf, neginf=-np.inf)  # may round equal vectors apart
            least = np.partition(score, len(score) - top)[len(score) - top]
            near = near[score >= least - 1e-9 * max(1.0, abs(least))] if np.isfinite(least) else near[score >= least]
        score = (vectors[near] * query).sum(axis=1)
    best = np.lexsort((ids[near], -np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf)))[:top]
    return near[best], score[best]


def _search(codes: Codes | None, top: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                ids, query_ids = (np.frombuffer(r[f"{c}_ids"], np.int64) for c in ("vector", "query"))
                vectors, queries = (np.frombuffer(r[f"{c}_vectors"], np.float64).reshape(len(i), -1) for c, i in (("vector", ids), ("query", query_ids)))
                tables, asked = pickle.loads(r["vector_index"]), pickle.loads(r["query_index"])
                out = []
                for q in range(len(queries)):
                    near = tables.within(asked[q], codes.radius) if codes else np.arange(len(ids))
                    best, score = _best(ids, vectors, queries[q], near[ids[near] != query_ids[q]], top)
                    out.append((np.full(len(best), query_ids[q]), ids[best], score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, n: int, name: str, codes: Codes | None) -> DataFrame:
    """``n`` blocks of about the same size: block, and what it holds."""
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), "vec_id", "embedding").repartition(n, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_pack(name, codes), f"block long, {name}_ids binary, {name}_vectors binary, {name}_index binary")


def _meet(vectors: DataFrame, n_vectors: int, queries: DataFrame, n_queries: int) -> DataFrame:
    """Every block of vectors with every block of queries, dealt over the cluster by both."""

    def to_all(df: DataFrame, own: str, other: str, n: int) -> DataFrame:
        return df.withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    return to_all(vectors, "v", "q", n_queries).join(to_all(queries, "q", "v", n_vectors).hint("shuffle_hash"), ["v", "q"]).drop("v", "q")


def search(vectors: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """The ``top`` nearest vectors of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows of ``vectors`` (vec_id, embedding) whose vec_id ``every`` divides;
    candidates are all rows but the query's own. score is the inner product of the original
    vectors in double precision; equal scores stand by vec_id.

    A vector that is null, empty, all zero, or has a null or non-finite component takes no part, nor
    does one without vec_id, or of another length than most of the sample have. Of rows of one
    vec_id the one with the smallest hash counts. Further columns don't matter. Where there are
    fewer candidates than ``top`` all are returned; an empty table gives no rows.

    Finite components may be of any size; a score that overflows is infinite, and one that is no
    number ranks last.

    Every vector is indexed, once: blocks of about ``VECTOR_BLOCK`` vectors have their tables made
    and written before any query meets them. Codes and radius come from at most ``SAMPLE`` vectors;
    where these are a part of all, so many neighbours fewer set the radius. A query that finds fewer
    than ``top`` within the radius is answered by comparing it with all vectors. Each block of
    queries meets each block of vectors, so the work grows with the one times the other.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null").where(good)
    rows = rows.groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    rows = table(rows, "vectors")
    kinds = "query_id long, vec_id long, score double"
    sample = [r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.bincount([len(x) for x in sample])
    dimension = int(sizes.argmax())
    own = rows.where(F.size("embedding") == dimension)
    scale = own.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))
    facts = own.agg(F.count("*").alias("n"), F.max(length).alias("norm")).first()
    n = facts["n"]
    same = np.array([x for x in sample if len(x) == dimension])
    codes = Codes(same, scale, math.sqrt(facts["norm"]), max(1, math.ceil(top * len(same) / n)))

    asked = own.where(F.col("vec_id") % every == 0)
    n_blocks = max(math.ceil(n / VECTOR_BLOCK), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_BLOCK)))
    n_asked = max(1, math.ceil(n / every / QUERY_BLOCK))
    run = Workspace(spark)
    blocks = run.write(_blocks(own, n_blocks, "vector", codes), "vector-blocks")

    def answers(queries: DataFrame, by: Codes | None) -> DataFrame:
        return _meet(blocks, n_blocks, run.write(_blocks(queries, n_asked, "query", by), "query-blocks" if by else "lacking-blocks"), n_asked).mapInArrow(_search(by, top), kinds)

    first = run.write(answers(asked, codes), "found")
    whole = min(top, n - 1)
    counts = first.groupBy("query_id").agg(F.count("*").alias("found"))
    lacking = asked.join(counts, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("found", F.lit(0)) < whole).select("vec_id", "embedding")
    lacking = run.write(lacking, "lacking")
    if lacking.limit(1).count():
        first = first.join(lacking.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "vec_id", "score").unionByName(answers(lacking, None))
    else:
        run.drop("vector-blocks", "query-blocks")
    by = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
