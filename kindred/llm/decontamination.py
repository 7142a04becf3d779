"""Benchmark decontamination with an FM-index for each shard of the training texts.

Benchmark items give windows of eight words. Each shard of documents is indexed; all windows are
searched backward at once, their occurrences are located, and the words they cover merge into
spans to remove. Words that no benchmark item has can't be within an occurrence: they end a run
of the indexed sequence, and runs shorter than the shortest window are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import as_row, column, ship, with_row
from kindred.llm.fm_index import FMIndex

WINDOW, LEAST_ITEMS = 8, 2
#: Bytes of text that one shard indexes (one document at least), and bytes of benchmark texts that
#: a worker holds at once; a larger benchmark is searched slice by slice.
SHARD_BYTES, SLICE_BYTES = 3_000_000, 16_000_000

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_NONE = hashlib.sha256(b"").hexdigest()


class Words:
    """Words of a column of texts: lower-cased bytes, where each starts and ends, and each text's first."""

    def __init__(self, texts: pa.Array):
        self.offsets, data = bpe.text_bytes(texts)
        self.raw = data
        data = _LETTER[data]
        on = _IS_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        starts, ends = on.copy(), on.copy()
        if len(on):
            starts[1:] &= ~on[:-1] | edge[1:-1]
            ends[:-1] &= ~on[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, and their number
        bounds = np.empty(2 * len(self.starts) + 1, np.int64)
        bounds[:-1:2], bounds[1::2], bounds[-1] = self.starts, self.ends, len(data)
        both = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        self.words = both.take(pa.array(np.arange(0, len(bounds) - 1, 2)))

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        """1 and on by the vocabulary; 0 for other words."""
        return pc.fill_null(pc.index_in(self.words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def characters(self, at: np.ndarray, text: int) -> np.ndarray:
        """Code points before places (in bytes) of one text."""
        own = self.raw[self.offsets[text] : self.offsets[text + 1]]
        before = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        return before[at - self.offsets[text]]


class Phrases:
    """The windows of some benchmark items, by length, and the items of each window.

    Items are numbered by their ids' order as strings.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = words.words.unique()
        number = words.numbers(self.vocabulary)
        names = ["" if i is None else str(i) for i, _ in items]
        self.names = sorted(set(names))
        place = {n: k for k, n in enumerate(self.names)}
        lines: dict[tuple[int, ...], set[int]] = {}
        for k, name in enumerate(names):
            own = number[words.first[k] : words.first[k + 1]].tolist()
            size = min(window, len(own))
            for a in range(len(own) - size + 1 if size else 0):
                lines.setdefault(tuple(own[a : a + size]), set()).add(place[name])
        keys = sorted(lines, key=lambda x: (len(x), x))
        self.length = np.array([len(x) for x in keys], np.int64)
        self.matrices = [(np.array([x for x in keys if len(x) == n], np.int64), np.flatnonzero(self.length == n)) for n in sorted(set(self.length.tolist()))]
        sizes = np.array([len(lines[x]) for x in keys], np.int64)
        self.item_ends = np.cumsum(sizes)
        self.item_begins = self.item_ends - sizes
        self.items = np.array([i for x in keys for i in sorted(lines[x])], np.int64)
        self.shortest = int(self.length.min()) if len(keys) else 0


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Window and first word (of all the shard's words) of every occurrence."""
    none = np.zeros(0, np.int64)
    if not phrases.shortest or not len(words.starts):
        return none, none
    number = words.numbers(phrases.vocabulary)
    breaks = number == 0
    start = np.concatenate(([True], breaks[:-1]))
    start[words.first[:-1][words.first[:-1] < len(start)]] = True
    run = np.cumsum(start | breaks)
    known = np.flatnonzero(~breaks)
    if not len(known):
        return none, none
    sizes = np.bincount(run[known])
    known = known[sizes[run[known]] >= phrases.shortest]
    if not len(known):
        return none, none
    last = np.append(run[known][1:] != run[known][:-1], True)
    slot = np.arange(len(known)) + np.cumsum(last) - last
    symbols = np.zeros(len(known) + int(last.sum()), np.int64)
    place = np.full(len(symbols), -1, np.int64)
    symbols[slot], place[slot] = number[known], known
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    which, at = [], []
    for matrix, windows in phrases.matrices:
        w, p = index.locate(*index.search(matrix))
        which.append(windows[w])
        at.append(place[p])
    return np.concatenate(which), np.concatenate(at)


def _spans(words: Words, hit: np.ndarray, text: int) -> list[dict]:
    own = hit[words.first[text] : words.first[text + 1]]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
    a, b = edge[::2] + words.first[text], edge[1::2] - 1 + words.first[text]
    return [{"start": int(x), "end": int(y)} for x, y in zip(words.characters(words.starts[a], text), words.characters(words.ends[b], text), strict=True)]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def _search(slices: list, window: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Phrases] = {}

        def phrases(k: int) -> Phrases:
            if k not in held:
                held.clear()  # one slice at a time
                held[k] = Phrases(slices[k].value, window)
                if len(slices) > 1:
                    slices[k].__dict__.pop("_value", None)  # the worker's copy; it can be loaded again
            return held[k]

        for block in bpe.blocks(batches, "text", SHARD_BYTES):
            words = Words(block.column("text").combine_chunks())
            n = block.num_rows
            hits = np.zeros(len(words.starts) + 1, np.int64)
            names: dict[int, set[str]] = {}
            for k in range(len(slices)):
                own = phrases(k)
                which, at = occurrences(words, own)
                if not len(which):
                    continue
                hits += np.bincount(at, minlength=len(hits)) - np.bincount(at + own.length[which], minlength=len(hits))
                text = np.searchsorted(words.first, at, side="right") - 1
                pair = np.unique(text * len(own.length) + which)
                text, which = pair // len(own.length), pair % len(own.length)
                many = own.item_ends[which] - own.item_begins[which]
                ends = np.cumsum(many)
                item = own.items[np.arange(ends[-1]) + np.repeat(own.item_begins[which] - (ends - many), many)]
                for x in np.unique(np.repeat(text, many) * len(own.names) + item).tolist():
                    names.setdefault(x // len(own.names), set()).add(own.names[x % len(own.names)])
            hit = np.cumsum(hits)[:-1] > 0
            covered = np.concatenate(([0], np.cumsum(hit)))
            spans = [_spans(words, hit, k) if k in names else [] for k in range(n)]
            digest = [hashlib.sha256(",".join(sorted(names[k])).encode()).hexdigest() if k in names else _NONE for k in range(n)]
            n_items = np.array([len(names.get(k, ())) for k in range(n)], np.int64)
            columns = [np.diff(words.first).astype(np.int64), np.diff(covered[words.first]).astype(np.int64), n_items]
            yield pa.RecordBatch.from_arrays(
                [block.column("row").combine_chunks(), *map(pa.array, columns), pa.array(digest), pa.array(n_items >= least), pa.array(spans, _SPAN)],
                ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return run


def _slices(benchmark: DataFrame) -> list:
    """The benchmark as broadcasts of about SLICE_BYTES each; the driver holds one at a time."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, n = benchmark.select("item_id", "text"), max(1, math.ceil(size / SLICE_BYTES))
    if n == 1:
        return [spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])]
    pick = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [spark.sparkContext.broadcast([tuple(r) for r in rows.where(pick == k).collect()]) for k in range(n)]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """The rows of ``docs`` as the struct ``row``, each with what it shares with the benchmark:

    n_words; n_hit (words within an occurrence of a window); n_items (items with a window in it);
    items_sha256 (of their ids as strings, sorted, comma-joined); contaminated (``least_items`` or
    more items); spans (merged occurrences, in code points of the text).

    A null or empty text has no words and an item without words has no windows. An item id that is
    null counts as the empty string; items of one id count once. Repeated documents are searched
    each for itself. Empty tables give no rows, or no hits. All columns of ``docs`` stay in ``row``,
    whatever their names. Texts are indexed whole: a longer one than SHARD_BYTES is a shard by itself.
    """
    spark = docs.sparkSession
    ship(spark)
    given = as_row(docs, F.col("text"))
    return given.mapInArrow(_search(_slices(benchmark), window, least_items), with_row(given, _FOUND))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the findings of ``mark_contamination``, without the other columns."""
    return mark_contamination(docs.select("doc_id", "text"), benchmark).select("row.doc_id", *(c for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")))


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("row").field("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            if spans:
                ends = [0, *(s["end"] for s in spans)]
                starts = [*(s["start"] for s in spans), len(text)]
                text = "".join(text[a:z] for a, z in zip(ends, starts, strict=True))
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("spans"), pa.array(out, pa.string())], ["row", "spans", "clean"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents, and with the spans of the others' occurrences
    cut out of their ``text`` (``n_chars``, if there is such a column, is counted anew there).

    Null and empty texts stay as they are, repeated rows stay or go together, and an empty table
    gives no rows."""
    marked = mark_contamination(docs, benchmark).where(~F.col("contaminated"))
    clean = marked.select("row", "spans").mapInArrow(_without, with_row(marked, "spans array<struct<start:int,end:int>>, clean string"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return clean.select(*((new[c] if c in new else column(c, "row")).alias(c) for c in docs.columns))
