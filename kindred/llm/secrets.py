"""Secret scan: patterns for known forms, and a battery of randomness tests for the rest.

Patterns find assignments to names such as ``password``, access keys and long hexadecimal
strings. Every other long run of key characters is a candidate: its encoding is inferred, and
three tests measure how far it is from ordinary text of the same corpus - chi-squared against the
uniform alphabet, runs of character classes, and lag-1 serial correlation. The null hypothesis is
"characters as in ordinary text", with letter shares, class changes and serial correlation counted
over the whole corpus; short candidates have little power under it. Benjamini-Hochberg within
classes of length then bounds the share of false finds in each class.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import as_row, column, scratch, ship, with_row

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as AKIA[A-Z0-9]+ with shorter matches dropped: a run's later starts are shorter
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ENCODINGS = tuple((re.compile(p), a) for p, a in (
    (r"[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    (r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
    (r"[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
))
_PLACE = tuple({c: i for i, c in enumerate(a)} for _, a in _ENCODINGS)

#: Lower ends of the length classes in which false discoveries are controlled.
STRATA = (20, 32, 64)
_STEP, _DEEPEST = 0.05, 800  # p-values are rounded up to 10 ** (-_STEP * k)

_CLASS = np.zeros(256, np.uint8)  # lower, upper, digit, other key characters
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[43, 45, 47, 95]] = 4


@dataclass(frozen=True)
class Text:
    """What ordinary text of the corpus is like: counts of bytes, and of pairs of key characters."""

    counts: tuple[int, ...]
    pairs: int
    changes: int
    letters: tuple[float, float, float]  # pairs of lower-case letters: number, sum of products, sums about the mean

    def shares(self, encoding: int) -> np.ndarray:
        own = np.array([self.counts[ord(c)] + 1.0 for c in _ENCODINGS[encoding][1]])
        return own / own.sum()


def _base(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Start, end and encoding; not those within a span of a pattern, nor plain numbers."""
    at, reach = 0, 0  # spans of patterns that start so far, and how far they reach
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][2])
            at += 1
        s = m.group().rstrip("=")
        if s.isdigit() or b <= reach:
            continue
        for k, (pattern, _) in enumerate(_ENCODINGS):
            if pattern.fullmatch(s):
                yield a, b, k
                break


def _measures(s: str, encoding: int) -> tuple[int, int, int, float]:
    """Length, sum of squared counts, changes of class and lag-1 correlation of alphabet places."""
    place = _PLACE[encoding]
    x = np.array([place.get(c, place.get(c.lower(), 0)) for c in s])
    n = len(x)
    squares = int((np.bincount(x) ** 2).sum())
    kind = _CLASS[np.frombuffer(s.encode("ascii"), np.uint8)]
    d = x - x.mean()
    spread = float((d * d).sum())
    return n, squares, int((kind[1:] != kind[:-1]).sum()), float((d[1:] * d[:-1]).sum()) / spread if spread else 1.0


def depth(n: int, squares: int, changes: int, serial: float, encoding: int, text: Text) -> int:
    """The combined p-value against ordinary text, as the power of 10 ** -_STEP at or above it."""
    p = text.shares(encoding)
    p2, p3 = float((p**2).sum()), float((p**3).sum())
    mean = n + n * (n - 1) * p2
    var = 2 * n * (n - 1) * (p2 + 2 * (n - 2) * p3 - (2 * n - 3) * p2 * p2)
    even = (mean - squares) / math.sqrt(max(var, 1e-9))
    q = (text.changes + 1) / (text.pairs + 2)
    runs = (changes - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q))
    number, product, spread = text.letters
    usual = product / spread if number and spread else 0.0
    toward = -1.0 if usual > 0 else 1.0
    drift = toward * (serial - usual) * math.sqrt(n)
    held = [max(-4.0, min(4.0, z)) for z in (even, runs, drift)]  # no test decides alone
    z = (2 * held[0] + held[1] + held[2]) / math.sqrt(6)
    tail = 0.5 * math.erfc(z / math.sqrt(2))
    return min(_DEEPEST, int(-math.log10(max(tail, 1e-45)) / _STEP))


def _stratum(n: int) -> int:
    return sum(n >= x for x in STRATA) - 1


_SCAN = "stats array<double>, base array<struct<start:int,kind:int,end:int>>, tested array<struct<start:int,end:int,encoding:int,n:int,squares:int,changes:int,serial:double>>"
_STATS = 262  # 256 byte counts, then: pairs, changes, pairs of letters, and their sums of x, x * x and x * y


def _count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(_STATS)
    out[:256] = np.bincount(data, minlength=256)
    kind = _CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    both = (kind[1:] > 0) & (kind[:-1] > 0) & ~first[1:-1]
    out[256] = both.sum()
    out[257] = (both & (kind[1:] != kind[:-1])).sum()
    at = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 1) & ~first[1:-1])
    x, y = data[at].astype(float) - 97, data[at + 1].astype(float) - 97
    out[258:] = len(at), x.sum(), (x * x).sum(), (x * y).sum()
    return out


def _scan(kept: pa.DataType | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, arrow = np.zeros(_STATS), None
        base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        test_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.int32()), ("n", pa.int32()), ("squares", pa.int32()), ("changes", pa.int32()), ("serial", pa.float64())]))
        for block in bpe.blocks(batches, "text", 4_000_000):
            column = block.column("text").combine_chunks()
            offsets, data = bpe.text_bytes(column)
            stats += _count(data, offsets)
            base, tested = [], []
            for text in column.to_pylist():
                text = text or ""
                spans = _base(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                tested.append([dict(zip(("start", "end", "encoding", "n", "squares", "changes", "serial"), (a, b, k, *_measures(text[a:b].rstrip("="), k)), strict=True)) for a, b, k in _candidates(text, spans)])
            row = block.column("row").combine_chunks()
            arrow = row.type
            yield pa.RecordBatch.from_arrays([row, pa.nulls(len(row), pa.list_(pa.float64())), pa.array(base, base_type), pa.array(tested, test_type)], ["row", "stats", "base", "tested"])
        if arrow is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow), pa.array([stats.tolist()]), pa.nulls(1, base_type), pa.nulls(1, test_type)], ["row", "stats", "base", "tested"])

    return run


def _depths(text: Text):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for tested in b.column("tested").to_pylist() for x in tested]
            found = [(_stratum(x["n"]), depth(x["n"], x["squares"], x["changes"], x["serial"], x["encoding"], text)) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int32()), pa.array([d for _, d in found], pa.int32())], ["stratum", "depth"])

    return run


def cut_offs(counts: dict[tuple[int, int], int], alpha: float) -> dict[int, int]:
    """Benjamini-Hochberg in each length class: the least depth that counts as a find."""
    out = {}
    for stratum in {s for s, _ in counts}:
        own = sorted(((d, n) for (s, d), n in counts.items() if s == stratum), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for d, n in own:
            seen += n
            if 10 ** (-_STEP * d) <= alpha * seen / total:
                out[stratum] = d
    return out


def _finish(text: Text, least: dict[int, int], redacted: bool, marker: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, base_sha, spans, clean = [], [], [], []
            texts = b.column("row").field("text").to_pylist() if redacted else None
            for i, (base, tested) in enumerate(zip(b.column("base").to_pylist(), b.column("tested").to_pylist(), strict=True)):
                own = [(x["start"], x["kind"], x["end"]) for x in base]
                more = [(x["start"], 3, x["end"]) for x in tested if depth(x["n"], x["squares"], x["changes"], x["serial"], x["encoding"], text) >= least.get(_stratum(x["n"]), _DEEPEST + 1)]
                said = lambda found: ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in found)
                every = sorted(own + more)
                counts.append([sum(k == j for _, k, _ in every) for j in range(4)])
                base_sha.append(hashlib.sha256(said(own).encode()).hexdigest())
                spans.append(said(every))
                if redacted:
                    clean.append(_redact(texts[i], every, marker))
            n = np.array(counts, np.int64).reshape(-1, 4)
            out = [pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 2]), pa.array(base_sha, pa.string()), pa.array(spans, pa.string()), pa.array(n[:, 3])]
            yield pa.RecordBatch.from_arrays([b.column("row"), *out, *([pa.array(clean, pa.string())] if redacted else [])], ["row", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", *(["clean"] if redacted else [])])

    return run


def _redact(text: str | None, spans: list[tuple[int, int, int]], marker: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], marker]
        at = max(at, b)
    return "".join([*out, text[at:]])


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _found(docs: DataFrame, alpha: float, redacted: bool, marker: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    given = as_row(docs, F.col("text")) if redacted else docs.select(F.struct("doc_id").alias("row"), "text")
    path = scratch(spark, "secrets")
    kinds = with_row(given, _SCAN)
    given.mapInArrow(_scan(None), kinds).write.option("compression", "zstd").parquet(path)
    seen = spark.read.schema(kinds).parquet(path)
    sums = seen.where("stats is not null").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(_STATS)
    for r in sums:
        total[r["at"]] = r["n"]
    number, x, xx, xy = total[258:]
    about = x * x / max(number, 1)
    text = Text(tuple(int(v) for v in total[:256]), int(total[256]), int(total[257]), (float(number), float(xy - about), float(xx - about)))
    rows = seen.where("stats is null")
    depths = rows.where(F.size("tested") > 0).select("tested").mapInArrow(_depths(text), "stratum int, depth int")
    counts = {(r["stratum"], r["depth"]): r["n"] for r in depths.groupBy("stratum", "depth").agg(F.count("*").alias("n")).collect()}
    least = cut_offs(counts, alpha)
    return rows.select("row", "base", "tested").mapInArrow(_finish(text, least, redacted, marker), with_row(rows, _FOUND + ", clean string" * redacted))


def find_secrets(docs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every document.

    ``spans`` lists kind:start:end of all finds, in code points, by start and then by kind; a find
    of the pattern ``assign`` reaches from the name to the end of the value. ``base_sha256`` is the
    digest of the list without the randomness tests' finds. ``alpha`` bounds the expected share of
    false ones among those finds, in each class of length.

    A null or empty text has no finds: zeros, an empty list and its digest. Repeated rows are
    scanned each for itself, further columns don't matter, and an empty table gives no rows. Texts
    are scanned whole, in a time that grows with their length. The driver gets the corpus's 262 sums and a count for each class of length
    and rounded p-value, both of fixed size.
    """
    return _found(docs, alpha, False, "").select("row.doc_id", *(c.split()[0] for c in _FOUND.split(", ")))


def redact_secrets(docs: DataFrame, alpha: float = 0.01, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``marker``; overlapping ones by one.

    All rows and columns stay, whatever the columns' names; texts without finds, null ones among them, stay as they are.
    ``n_chars``, if there is such a column, is counted anew where the text changed.
    """
    found = _found(docs, alpha, True, marker)
    changed = F.col("spans") != ""
    new = {"text": F.col("clean"), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return found.select(*((new[c] if c in new else column(c, "row")).alias(c) for c in docs.columns))
