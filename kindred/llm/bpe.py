"""Encoding of whole Arrow columns with a byte-level BPE file of the ``tokenizers`` library.

The library encodes a text on its own terms at under one megabyte a second. Here a column is cut
at places where its pre-tokenizer always cuts too, the parts are looked up by their bytes in a
table of numpy arrays, each distinct part that isn't there goes through the library's model, and the
ids of all texts are gathered from there with numpy. The
result equals ``Tokenizer.encode_batch`` on the whole texts (see ``tests/llm/test_texts.py``), special
tokens that stand in a text included: the text is cut there and they get their own id. Other kinds
of tokenizer files go through ``encode_batch``.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa

# The pre-tokenizing pattern of byte-level BPE vocabularies of this kind.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what the library's \s has; Python's has more
PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"""

_WORD, _SPACE, _BLANK, _MARK, _QUOTE, _HIGH = range(6)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _WORD
_CLASS[32] = _SPACE
_CLASS[9:14] = _BLANK
_CLASS[39] = _QUOTE
_CLASS[128:] = _HIGH

#: Size of a worker's memory of parts, after which those go that have not turned up again. A part counts
#: as one and an eighth for each of its ids; one of more than ``SHORT`` bytes for every 32 bytes of it too.
#: So it holds about 900,000 parts of prose, at some 70 bytes each.
CACHED = 1_600_000
#: Bytes of a part that fit its key of two 64-bit words, beside their number.
SHORT = 15
#: Parts that are looked up at once.
STEP = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.special_pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.in_parts = (
            not any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
        )
        self.model = self.tokenizer.model
        self.split = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.parts = Parts()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than the texts) and the ids of all texts; null counts as empty."""
        n = len(texts)
        if not self.in_parts:
            found = [x.ids for x in self.tokenizer.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            offsets = np.zeros(n + 1, np.int64)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            return offsets, np.fromiter((i for x in found for i in x), np.int32, offsets[-1])
        offsets, data = text_bytes(texts)
        if not len(data):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int32)
        cuts = self._cuts(data, offsets, self._specials(data, offsets))
        part = self._indices(data, cuts)
        sizes = self.parts.lengths.take(part)
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = _slices(self.parts.flat, self.parts.begins.take(part), sizes)
        before = np.concatenate(([0], ends))
        return before[np.searchsorted(cuts, offsets)], ids

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens stand in the texts."""
        raw = data.tobytes() if self.special else b""
        if not any(x in raw for x in self.special):
            return []
        bounds = offsets.tolist()
        return [m.span() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in self.special_pattern.finditer(raw, a, b)]

    @staticmethod
    def _cuts(data: np.ndarray, offsets: np.ndarray, specials: list[tuple[int, int]]) -> np.ndarray:
        """Starts of parts, and the end. Each is a place where a pre-token starts."""
        kind = _CLASS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        for a, b in specials:  # what stands between them is a text of its own
            edge[[a, b]] = True
        cut = edge.copy()
        prev, here = kind[:-1], kind[1:]
        shown = lambda k: (k == _WORD) | (k == _MARK) | (k == _QUOTE)  # noqa: E731  visible ASCII
        seen = shown(kind)
        after = np.concatenate((seen[2:], [False])) & ~edge[2:]
        space = here == _SPACE
        inner = space & (seen[:-1] | after)
        blank = here == _BLANK
        inner |= blank & seen[:-1]
        inner[1:] |= seen[:-2] & (prev == _BLANK)[1:] & seen[2:]  # after a longer run the lookahead would differ
        inner |= (prev == _WORD) & (here == _MARK)
        inner |= (prev == _MARK) & (here == _WORD)
        cut[1:-1] |= inner
        cut[0] = cut[-1] = True
        for a, b in specials:
            cut[a + 1 : b] = False
        return np.flatnonzero(cut).astype(np.int64)

    def _indices(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The number of each part; those that aren't known yet are learned."""
        if self.parts.weight() > CACHED:
            self.parts = self.parts.again()
            if 2 * self.parts.weight() > CACHED:
                self.parts = Parts()
        words = np.zeros(len(data) // 8 + 3, "<u8")
        words.view(np.uint8)[: len(data)] = data
        starts, ends = cuts[:-1], cuts[1:]
        part = np.empty(len(starts), np.int64)
        for k in range(0, len(part), STEP):
            part[k : k + STEP] = self.parts.find(*_keys(words, starts[k : k + STEP], ends[k : k + STEP]))
        self.parts.seen[part] = True  # -1 marks the last one, which does no harm
        if len(rows := np.flatnonzero(part < 0)):
            held = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            found = held.take(pa.array(rows)).dictionary_encode()
            which = found.indices.to_numpy()
            one = np.empty(len(found.dictionary), np.int64)
            one[which] = rows  # a row of each, whichever
            on = gc.isenabled()
            gc.disable()
            try:
                part[rows] = self._learn(found.dictionary.to_pylist(), *_keys(words, starts[one], ends[one]))[which]
            finally:
                if on:
                    gc.enable()
        return part

    def _learn(self, parts: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of different parts that the table of keys doesn't have; long ones may be known."""
        tokenize, letters, split, special, long = self.model.tokenize, self.letters, self.split, self.special, self.parts.long
        ids: list[int] = []
        sizes, out, number = [], [], self.parts.n
        for p in parts:
            if len(p) > SHORT:
                if (at := long.get(p, -1)) >= 0:
                    out.append(at)
                    continue
                long[p] = number
                self.parts.long_bytes += len(p)
            before = len(ids)
            word = p[1:] if p[:1] == b" " else p
            if p in special:
                ids.append(special[p])
            elif word.isalpha() or word.decode().isalpha():  # one pre-token
                ids += [t.id for t in tokenize(p.decode("latin-1").translate(letters))]
            else:
                for piece in split(p.decode()):
                    ids += [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]
            sizes.append(len(ids) - before)
            out.append(number)
            number += 1
        numbers = np.array(out, np.int64)
        new = numbers >= self.parts.n
        self.parts.keep(low[new], high[new], np.array(ids, np.int32), np.array(sizes, np.int32))
        return numbers


_SIZES = np.arange(SHORT + 2)
_LOW = np.array([(1 << 8 * min(k, 8)) - 1 for k in _SIZES.tolist()], np.uint64)
_HIGH_WORD = np.array([(1 << 8 * max(k - 8, 0)) - 1 for k in _SIZES.tolist()], np.uint64)
_LOW[-1] = _HIGH_WORD[-1] = 0
_SIZE_BITS = np.append(_SIZES[:-1], 0).astype(np.uint64) << np.uint64(56)


def _keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words that hold each part's bytes and, in the highest byte, their number; 0, 0 for a long one.

    Different parts of up to ``SHORT`` bytes have different keys. ``words`` are the bytes of all parts
    and two words of zeros at least.
    """
    size = np.minimum(ends - starts, SHORT + 1)
    at, by = starts >> 3, (starts & 7).astype(np.uint64) << np.uint64(3)
    rest, one = np.uint64(63) - by, np.uint64(1)
    low, high, after = words.take(at), words.take(at + 1), words.take(at + 2)
    low = (low >> by | (high << one) << rest) & _LOW.take(size)
    high = (high >> by | (after << one) << rest) & _HIGH_WORD.take(size) | _SIZE_BITS.take(size)
    return low, high


class Parts:
    """Parts of texts that are known, numbered, and the ids of each.

    ``slots`` is a hash table with open addressing: the number of a part, or -1. Its keys are whole,
    so a find is never a part that only has the same hash. Long parts are in a dictionary.
    """

    def __init__(self):
        self.n = 0
        self.n_flat = 0
        self.bits = 16
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low = np.zeros(1 << 15, np.uint64)
        self.high = np.zeros(1 << 15, np.uint64)
        self.begins = np.zeros(1 << 15, np.int64)
        self.lengths = np.zeros(1 << 15, np.int32)
        self.seen = np.zeros((1 << 15) + 1, bool)
        self.flat = np.zeros(1 << 17, np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def weight(self) -> int:
        return self.n + self.n_flat // 8 + self.long_bytes // 32

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of parts by their keys; -1 where there is none."""
        slot = self._slot(low, high)
        out = self.slots.take(slot).astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & ((self.low.take(out, mode="clip") != low) | (self.high.take(out, mode="clip") != high)))
        slot, low, high = slot[open_], low[open_], high[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.slots) - 1)
            at = self.slots.take(slot).astype(np.int64)
            out[open_] = at
            go = np.flatnonzero((at >= 0) & ((self.low.take(at, mode="clip") != low) | (self.high.take(at, mode="clip") != high)))
            open_, slot, low, high = open_[go], slot[go], low[go], high[go]
        return out

    def keep(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number parts that aren't known, from ``n`` on. Those with the key 0, 0 aren't found by it."""
        first, n, end = self.n, self.n + len(sizes), self.n_flat + len(ids)
        if n > len(self.low):
            self.low, self.high, self.begins, self.lengths, self.seen = (_longer(x, first, n) for x in (self.low, self.high, self.begins, self.lengths, self.seen))
        if end > len(self.flat):
            self.flat = _longer(self.flat, self.n_flat, end)
        self.low[first:n], self.high[first:n] = low, high
        self.lengths[first:n] = sizes
        self.begins[first:n] = self.n_flat + np.cumsum(sizes) - sizes
        self.flat[self.n_flat : end] = ids
        self.n, self.n_flat = n, end
        if 2 * n > len(self.slots):
            self.bits, first = (2 * n).bit_length(), 0
            self.slots = np.full(1 << self.bits, -1, np.int32)
        self._enter(first)

    def again(self) -> Parts:
        """The short parts that turned up again in a later block."""
        out = Parts()
        rows = np.flatnonzero(self.seen[: self.n] & (self.high[: self.n] > 0))
        sizes = self.lengths[rows]
        out.keep(self.low[rows], self.high[rows], _slices(self.flat, self.begins[rows], sizes), sizes)
        return out

    def _enter(self, first: int) -> None:
        """Put parts from number ``first`` on into the slots: each into the first free one."""
        number = first + np.flatnonzero(self.high[first : self.n])
        slot = self._slot(self.low[number], self.high[number])
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            left = self.slots[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.slots) - 1)


def _longer(values: np.ndarray, used: int, least: int) -> np.ndarray:
    out = np.zeros(least * 3 // 2 + 1, values.dtype)
    out[:used] = values[:used]
    return out


def _slices(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of ``values``, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat(begins - (ends - sizes), sizes)
    at += np.arange(len(at))
    return values.take(at)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a column of strings; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], np.ascontiguousarray(data[offsets[0] : offsets[-1]])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder; it keeps what it has learned from task to task."""
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give back what this worker holds and doesn't need: it may idle beside another stage's workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def blocks(batches, column: str, most: int = 8_000_000):
    """Join small Arrow batches and split large ones, to about ``most`` bytes of text (one row at least).

    At the end the worker's spare memory goes back.
    """
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most - size, side="right")) - 1))
            held.append(batch.slice(at, to - at))
            size += int(offsets[to] - offsets[at])
            at = to
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = batch = None
    trim()


def crc32s(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of slices of ids as little-endian unsigned 32-bit integers."""
    view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], np.int64)


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.int32)
    keep = np.ones(len(out), bool)
    new = offsets + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return new, out
