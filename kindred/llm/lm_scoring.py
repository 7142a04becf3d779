"""Cross-entropy difference of two n-gram models (Moore and Lewis).

A target model is counted on chosen documents, a background model on all of them. Both are bigram
models with one vocabulary and one smoothing. Each token's loss under the background model is
subtracted from its loss under the target model, and the mean over a document scores it: low means
like the target. A document's own counts are left out of both models while it is scored.

Counts cover the whole corpus, and the vocabulary is all of its words. Words and bigrams go by
64-bit hashes. Blocks of documents count their distinct words and bigrams first, so the most
frequent one travels once for each block; partitions of the hashes sum the blocks' counts and send
every block the sums of its own words and bigrams. Nothing is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import ship, table
from kindred.llm.decontamination import Words

#: Smoothing spreads over all words, and over so many where there are fewer; unknown and start come on top.
VOCABULARY = 65_534
#: Weight of the unigram shares in the bigram model, in counts, and words of one block (of six bytes).
PRIOR, BLOCK_WORDS = 50.0, 1_400_000
#: Bytes of text for each partition of bigrams; one of words has four times as many.
PART_BYTES = 10_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: a published 64-bit finalizer
_STEP = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0)


def _hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each distinct word, and each word's place among them; the most frequent word comes first."""
    coded = words.words.dictionary_encode()
    named = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    place = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(place, minlength=len(named)), kind="stable")
    rank = np.empty(len(named), np.uint32)
    rank[order] = np.arange(len(named), dtype=np.uint32)
    return named[order], rank[place]


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _STEP + second
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """How many bytes the largest number takes, then all first bytes, all second ones, and so on."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _whole(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view("<u8")


def _parts(keys: np.ndarray, of: int) -> Iterator[tuple[int, int, int]]:
    """Each part that has some of the sorted hashes, and where they begin and end; parts are equal ranges."""
    if not len(keys):
        return
    part = (keys >> np.uint64(32)) * np.uint64(of) >> np.uint64(32)
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(begins[1:], len(part))
    yield from zip(part[begins].tolist(), begins.tolist(), ends.tolist(), strict=True)


def _packed(keys: np.ndarray, part: int, of: int) -> bytes:
    """Sorted hashes of a part: differences, the first from where the part begins."""
    return _planes(np.diff(keys, prepend=np.uint64((part << 64) // of)))


def _gather(most: int):
    """Blocks of documents, of about ``most`` words: a row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for block in bpe.blocks(batches, "text", 6 * most):
            for k in range(0, block.num_rows, 1_000_000):
                rows = block.slice(k, 1_000_000).combine_chunks()
                words = Words(rows.column("text").combine_chunks())
                named, place = _hashes(words)
                doc = rows.column("doc_id").combine_chunks()
                null = doc.is_null().to_numpy(zero_copy_only=False)
                lengths = np.diff(words.first).astype(np.int32)
                packed = [doc.fill_null(0).to_numpy().astype(np.int64), null, lengths, named]
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), *(pa.array([x.tobytes()], pa.binary()) for x in packed), pa.array([_planes(place)], pa.binary())], _BLOCK)
                n += 1

    return run


_BLOCK = ["block", "docs", "nulls", "lengths", "words", "ids"]
_BLOCK_KINDS = "block long, docs binary, nulls binary, lengths binary, words binary, ids binary"


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block that have an id, by place."""
    for row in _rows(batches):
        docs, at = np.frombuffer(row["docs"], np.int64), np.flatnonzero(~np.frombuffer(row["nulls"], bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["block"], np.int64)), pa.array(at.astype(np.int32)), pa.array(docs[at])], ["block", "place", "doc_id"])


class Block:
    """One block's tokens: for each, its document, the word before (the number of words at first) and the word."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.targets = np.zeros(len(self.docs), bool)
        if (chosen := row["chosen"]) is not None:
            self.targets[np.asarray(chosen, np.int64)] = True
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.word = _whole(row["ids"]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.docs)), self.lengths)
        start = len(self.words)
        self.before = np.concatenate(([start], self.word[:-1])) if len(self.word) else self.word
        ends = np.cumsum(self.lengths)
        self.before[(ends - self.lengths)[self.lengths > 0]] = start
        self.last = (ends - 1)[self.lengths > 0]
        named = np.append(self.words, _START)
        self.keys, self.place = np.unique(_pairs(named[self.before], named[self.word]), return_inverse=True)
        self.order = np.argsort(self.words)

    def bigrams(self) -> list[np.ndarray]:
        """Counts of each bigram in all documents and in the target's."""
        flag = self.targets[self.doc]
        return [np.bincount(self.place, minlength=len(self.keys)), np.bincount(self.place[flag], minlength=len(self.keys))]

    def unigrams(self) -> list[np.ndarray]:
        """Counts of each word, by hash, in all documents and in the target's; the same of last words, which are no contexts."""
        flag = self.targets[self.doc]
        last = self.last[flag[self.last]]
        return [np.bincount(self.word[at], minlength=len(self.words))[self.order] for at in (slice(None), flag, self.last, last)]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


_COUNTS = ["n", "target", "last", "last_target"]


def _facts(word_parts: int):
    """Each block's distinct words, to the parts that they are in; the first of these rows has its totals too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
            chosen = lengths[np.asarray(row["chosen"] if row["chosen"] is not None else [], np.int64)]
            keys = np.sort(np.frombuffer(row["words"], np.uint64))
            own = [(p, _packed(keys[a:z], p, word_parts)) for p, a, z in _parts(keys, word_parts)]
            totals = [lengths.sum(), chosen.sum(), (lengths > 0).sum(), (chosen > 0).sum()]
            parts, packed = zip(*(own or [(0, _planes(keys))]), strict=True)
            rest = [0] * (len(parts) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary()), *(pa.array([int(n), *rest], pa.int64()) for n in totals)], ["part", "keys", *_TOTALS])

    return run


_TOTALS = ["every", "chosen", "texts", "chosen_texts"]


def _distinct(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = np.sort(np.concatenate([np.cumsum(_whole(x), dtype=np.uint64) for x in pdf["keys"]]))
    return pd.DataFrame({"n": [int((keys[1:] != keys[:-1]).sum()) + min(1, len(keys))], **{c: [pdf[c].sum()] for c in _TOTALS}})


def _count(parts: int, word_parts: int):
    """Each block's counts of bigrams, to the parts from 0 on, and of words, to those after, that have some."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row)
            none = np.zeros(0, np.int64)
            out = []
            for base, of, keys, counts in ((0, parts, b.keys, [*b.bigrams(), none, none]), (parts, word_parts, b.words[b.order], b.unigrams())):
                out += [(base + p, row["block"], _packed(keys[a:z], p, of), *(_planes(x[a:z]) for x in counts)) for p, a, z in _parts(keys, of)]
            for k in range(0, len(out), 10_000):
                part, block, *packed = zip(*out[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["part", "block", "keys", *_COUNTS])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of one part for each block's hashes (less where the part begins)."""
    keys = [np.cumsum(_whole(x), dtype=np.uint64) for x in pdf["keys"]]
    ends = np.cumsum([len(x) for x in keys]).tolist()
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    out = {}
    for c in _COUNTS:
        own = np.concatenate([_whole(x) for x in pdf[c]])
        sums = np.bincount(place, own, minlength=len(unique)).astype(np.uint64) if len(own) else np.zeros(0, np.uint64)
        out[c] = [_planes(sums[place[a:z]]) if len(own) else _planes(sums) for a, z in zip([0, *ends[:-1]], ends, strict=True)]
    return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], **out})


def _own(first: np.ndarray, second: np.ndarray, width: int) -> np.ndarray:
    """How often each pair occurs, for each occurrence."""
    _, place, n = np.unique(first * width + second, return_inverse=True, return_counts=True)
    return n[place]


def _score(parts: int, places: int, totals: list[int]):
    def run(head: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        b = Block(head.iloc[0])
        pairs, words = (sums[own].sort_values("part") for own in (sums["part"] < parts, sums["part"] >= parts))
        read = lambda rows, c: np.concatenate([np.zeros(0), *(_whole(x) for x in rows[c])]).astype(np.float64)
        n, target = read(pairs, "n"), read(pairs, "target")
        every, chosen, texts, chosen_texts = totals
        by_word = np.zeros((4, len(b.words)))
        by_word[:, b.order] = [read(words, c) for c in _COUNTS]
        word, word_target = by_word[0], by_word[1]
        before, before_target = np.append(word - by_word[2], texts), np.append(word_target - by_word[3], chosen_texts)
        flag = b.targets[b.doc]
        own = _own(b.doc, b.place, len(b.keys) + 1)
        own_word, own_before = (_own(b.doc, x, len(b.words) + 1) for x in (b.word, b.before))
        size = b.lengths[b.doc]

        def loss(pair, word, before, total, less, part) -> np.ndarray:
            """``part``: the model's share of all counts; smoothing by it matches models of unlike size."""
            share = (word[b.word] - less * own_word + part) / (total - less * size + part * places)
            return -np.log((pair[b.place] - less * own + part * PRIOR * share) / (before[b.before] - less * own_before + part * PRIOR))

        background = loss(n, word, before, every, 1, 1.0)
        like = loss(target, word_target, before_target, chosen, flag.astype(float), max(chosen / every, 1e-6) if every else 1.0)
        count = len(b.docs)
        many = np.maximum(b.lengths, 1)
        sums = [np.bincount(b.doc, x, minlength=count) / many for x in (like, background, like - background)]
        docs = pd.array(b.docs, dtype="Int64")
        docs[b.nulls] = pd.NA
        return pd.DataFrame({"doc_id": docs, "n_tokens": b.lengths, "target_loss": sums[0], "background_loss": sums[1], "score": sums[2], "is_target": b.targets})

    return run


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double, is_target boolean"


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference, in nats a token)
    and is_target of every document. ``target`` has the doc_id of the target documents.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The vocabulary is
    all words of the corpus, so what is gathered grows with it.

    A null or empty text has no tokens and a score of 0. Ids that repeat in ``docs`` are documents
    each for itself; in ``target`` they count once, and null or unknown ids not at all. Without a
    target document the target model is uniform. Empty tables give no rows. Further columns don't
    matter. Very long texts are read whole: one that exceeds a block is a block by itself.

    A block sends a row to each part that has some of its hashes, so rows and time grow with the
    blocks' distinct words and bigrams, not with blocks times parts. The driver gets five numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, math.ceil(size / PART_BYTES))
    word_parts = max(1, parts // 4)
    chosen = target.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    made = table(texts.mapInArrow(_gather(BLOCK_WORDS), _BLOCK_KINDS), "blocks", compression="zstd")
    placed = made.mapInArrow(_places, "block long, place int, doc_id long").join(chosen, "doc_id")
    blocks = made.join(placed.groupBy("block").agg(F.collect_list("place").alias("chosen")), "block", "left")

    totals_kinds = ", ".join(f"{c} long" for c in _TOTALS)
    facts = blocks.select("lengths", "words", "chosen").mapInArrow(_facts(word_parts), f"part int, keys binary, {totals_kinds}")
    facts = facts.groupBy("part").applyInPandas(_distinct, f"n long, {totals_kinds}").agg(F.sum("n"), *(F.sum(c) for c in _TOTALS)).first()
    n_words, *totals = (int(x or 0) for x in facts)
    places = max(VOCABULARY, n_words) + 2

    counts = ", ".join(f"{c} binary" for c in _COUNTS)
    sent = blocks.mapInArrow(_count(parts, word_parts), f"part int, block long, keys binary, {counts}")
    sums = sent.groupBy("part").applyInPandas(_sum, f"block long, part int, {counts}")
    return blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(_score(parts, places, totals), SCORES)
