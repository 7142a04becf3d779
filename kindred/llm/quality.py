"""Quality classifier with hierarchical empirical Bayes.

Two linear classifiers, for low quality and for toxicity, are fitted on labelled documents. Their
log-likelihood ratio is a document's own evidence. Its prior comes from where it was found: rates
of the path it lies in shrink towards its host's, and those towards the rate of all, the more the
fewer documents there are. How strongly is estimated from the spread of the sites' rates.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import as_row, column, ship, table, with_row
from kindred.llm.decontamination import Words

#: Labelled documents that the classifiers are fitted on at most: those with the smallest hashes.
LABELLED = 12_000
#: Telling words that a classifier keeps at most, and how telling they must be: in log odds, and
#: in nats of what their documents' labels say against the usual rate.
LEXICON, LEAST_ODDS, SURPRISE = 4_000, 2.5, 8.5
HEADS = ("low", "toxic")
#: The rate where there are no labels at all.
UNTAUGHT = 0.05
#: Paths up to which their table is broadcast (under 10 MB).
BROADCAST_PATHS = 100_000
#: Documents from which a path's rates go to its rows by broadcast even where there are more paths.
HOT_PATH = 100_000


def _mask(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_UPPER, _LOWER, _DIGIT, _LINE, _BAR, _BANG = map(_mask, (string.ascii_uppercase, string.ascii_lowercase, string.digits, "\n", "|", "!"))
_MARK = _mask(string.punctuation)
_ODD = _MARK & ~_mask("!\"',-.:;?")


def _dense(words: Words, doc: np.ndarray, place: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Measures of form: a line for each text. ``doc`` and ``place``: each word's text and which word it is."""
    size, n_words = np.diff(words.offsets), np.diff(words.first)
    n, m = np.maximum(size, 1), np.maximum(n_words, 1)
    at = words.offsets.tolist()
    seen = np.array([np.bincount(words.raw[a:b], minlength=256) for a, b in zip(at[:-1], at[1:], strict=True)]).reshape(-1, 256)

    def count(mask: np.ndarray) -> np.ndarray:
        return seen[:, mask].sum(axis=1)

    def share(mask: np.ndarray, times: int) -> np.ndarray:
        return np.minimum(1.0, times * count(mask) / n)

    upper, lower = count(_UPPER), count(_LOWER)
    again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (place[1:] == place[:-1])], minlength=len(size))
    return np.column_stack([
        np.log1p(size) / 10,
        np.log1p(n_words) / 10,
        np.minimum(size / m, 30) / 30,
        upper / np.maximum(1, upper + lower),
        share(_ODD, 10),
        share(_MARK, 5),
        share(_DIGIT, 5),
        share(_LINE, 20),
        distinct / m,
        again / m,
        share(_BAR, 50),
        share(_BANG, 20),
    ])


@dataclass
class Features:
    """Of a block of texts: measures of form, and their distinct words, text by text."""

    dense: np.ndarray
    ends: np.ndarray  # of each text's words among the following
    words: np.ndarray  # hashes

    @classmethod
    def of(cls, texts: pa.Array) -> Features:
        words = Words(texts)
        coded = words.words.dictionary_encode()
        named = np.array([xxhash.xxh32_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint32)
        place = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        pairs = np.sort(doc * max(1, len(named)) + place)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        distinct = np.bincount(pairs // max(1, len(named)), minlength=len(texts))
        return cls(_dense(words, doc, place, distinct), np.cumsum(distinct), named[pairs % max(1, len(named))] if len(pairs) else named)

    def own(self, k: int) -> np.ndarray:
        return self.words[self.ends[k - 1] if k else 0 : self.ends[k]]


def _labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in bpe.blocks(batches, "text", 4_000_000):
        f = Features.of(block.column("text").combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array(list(f.dense), pa.list_(pa.float64())), pa.array([np.sort(f.own(k)).tobytes() for k in range(len(f.ends))], pa.binary()), *(block.column(c).combine_chunks() for c in HEADS)], ["dense", "words", *HEADS])


@dataclass
class Head:
    """A linear classifier: measures of form, and the sum of the log odds of telling words."""

    words: np.ndarray
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def evidence(self, f: Features) -> np.ndarray:
        """Log-likelihood ratio of each text."""
        x = (np.hstack([f.dense, _told(self.words, self.odds, f.words, f.ends)]) - self.mean) / self.scale
        return np.clip(self.weights[0] + x @ self.weights[1:] - self.base, -30, 30)


def _told(lexicon: np.ndarray, odds: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum and maximum (0 at least) of the odds of each text's words, of which ``ends`` says where they end."""
    out = np.zeros((len(ends), 2))
    if not len(lexicon) or not len(words):
        return out
    at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
    hit = np.flatnonzero(lexicon[at] == words)
    text, own = np.searchsorted(ends, hit, side="right"), odds[at[hit]]
    out[:, 0] = np.clip(np.bincount(text, own, minlength=len(ends)), -20, 20)
    np.maximum.at(out[:, 1], text, own)
    return out


class Vocabulary:
    """The distinct words of some documents, and each document's places among them."""

    def __init__(self, words: list[np.ndarray]):
        flat = np.concatenate([np.zeros(0, np.uint32), *words])
        self.words, place = np.unique(flat, return_inverse=True)
        self.place = place.astype(np.int32)
        self.ends = np.cumsum([len(w) for w in words], dtype=np.int64)

    def telling(self, label: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that tell the label, and their log odds, in the documents that are ``used``."""
        sizes = np.diff(self.ends, prepend=0)
        size = len(self.words)
        yes = np.bincount(self.place[np.repeat(used & (label > 0), sizes)], minlength=size)
        no = np.bincount(self.place[np.repeat(used & (label == 0), sizes)], minlength=size)
        n_yes, n_no = float(label[used].sum()), float((1 - label[used]).sum())
        odds = np.log((yes + 0.25) / (n_yes + 0.5)) - np.log((no + 0.25) / (n_no + 0.5))
        n, rate = yes + no, np.clip(n_yes / max(1.0, n_yes + n_no), 1e-6, 1 - 1e-6)
        p = np.clip(yes / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        surprise = n * (p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate)))
        keep = np.flatnonzero((odds >= LEAST_ODDS) & (surprise >= SURPRISE))
        keep = np.sort(keep[np.argsort(-odds[keep] * yes[keep], kind="stable")][:LEXICON])
        return self.words[keep], odds[keep]


def fit(dense: np.ndarray, words: list[np.ndarray], vocabulary: Vocabulary, label: np.ndarray) -> list[Head]:
    """Two classifiers, whose evidence is averaged: the telling words of each come from one half of
    the documents and its weights from the other, so a word that tells by chance counts little."""
    half = np.arange(len(label)) % 2 == 0
    return [_fit(dense, words, vocabulary, label, h) for h in (half, ~half)]


def _fit(dense: np.ndarray, words: list[np.ndarray], vocabulary: Vocabulary, label: np.ndarray, half: np.ndarray) -> Head:
    """Ridge logistic regression by Newton's steps."""
    lexicon, odds = vocabulary.telling(label, half)
    rest = np.flatnonzero(~half)
    own = [words[k] for k in rest]
    x = np.hstack([dense[rest], _told(lexicon, odds, np.concatenate([np.zeros(0, np.uint32), *own]), np.cumsum([len(w) for w in own], dtype=np.int64))])
    y = label[rest]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    weights, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (y - p) - ridge @ weights
        bend = (z * (p * (1 - p))[:, None]).T @ z + ridge
        weights = weights + np.linalg.solve(bend, slope)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return Head(lexicon, odds, mean, scale, weights, float(np.log(rate / (1 - rate))))


def _train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, list[Head]], dict[str, float]]:
    picked = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long"), (F.lit(1) - F.col("quality")).alias("low"), F.col("toxic").alias("toxic"))
    picked = picked.join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")  # else labels of absent documents take places
    picked = picked.groupBy("doc_id").agg(F.max("low").cast("double").alias("low"), F.max("toxic").cast("double").alias("toxic"))
    sample = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)  # a bounded table
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *(F.first(h).alias(h) for h in HEADS))
    rows = one.select("text", *HEADS).mapInArrow(_labelled, "dense array<double>, words binary, low double, toxic double").collect()
    rows = [r for _, r in sorted({(r["words"], *(r[h] for h in HEADS)): r for r in rows}.items())]  # copies count once
    words = [np.frombuffer(r["words"], np.uint32) for r in rows]
    order = np.random.default_rng(7).permutation(len(rows))
    words = [words[k] for k in order]
    vocabulary = Vocabulary(words)
    heads, rates = {}, {}
    for h in HEADS:
        label = np.array([rows[k][h] for k in order])
        rates[h] = float(np.clip((label.sum() + 0.5) / (len(label) + 1), 1e-4, 1 - 1e-4)) if len(label) else UNTAUGHT
        if 0 < label[::2].sum() < len(label[::2]) and 0 < label[1::2].sum() < len(label[1::2]):
            heads[h] = fit(np.array([rows[k]["dense"] for k in order]), words, vocabulary, label)
    return heads, rates


def _evidence(heads: dict[str, list[Head]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in bpe.blocks(batches, "text", 4_000_000):
            f = Features.of(block.column("text").combine_chunks())
            out = [np.mean([x.evidence(f) for x in heads[h]], axis=0) if h in heads else np.zeros(block.num_rows) for h in HEADS]
            yield pa.RecordBatch.from_arrays([*(block.column(c).combine_chunks() for c in ("row", "host", "path")), *map(pa.array, out)], ["row", "host", "path", *HEADS])

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(rates: DataFrame, prior: Column, n: Column, own: Column) -> float:
    """How many documents a prior is worth: by moments of the rates about it, weighted by n.

    The variance of a site's rate is p (1 - p) (1 / n + 1 / (strength + 1)) or so; 2 at least, and
    10,000 where the sites differ no more than chance makes them.
    """
    r = rates.agg(F.sum(n * (own / n - prior) ** 2).alias("seen"), F.sum(prior * (1 - prior)).alias("chance"), F.sum(n * prior * (1 - prior)).alias("spread")).first()
    if not r["spread"] or r["seen"] is None or r["seen"] <= r["chance"]:
        return 10_000.0
    return float(min(10_000.0, max(2.0, r["spread"] / (r["seen"] - r["chance"]))))


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.4) -> DataFrame:
    """The rows of ``docs`` as the struct ``row``, with p_low and p_toxic (posteriors of low quality
    and of toxicity), path_low and path_toxic (the rates of the path that they start from) and
    keep: both posteriors under ``cut``.

    ``source`` names where a document comes from: its host is the part before the first slash (a
    scheme left out), its path the host with the first segment. A null source is a site of its
    own. Null and empty texts are judged by their form alone. Repeated rows count and are judged
    each for itself; repeated labels count once and null labels not at all. Of rows that share a
    labelled doc_id the one whose text has the smallest hash teaches. Without labels of both kinds
    there is no evidence and the rates are those of the labels; with none at all everything is
    kept. An empty table gives no rows. Texts are judged whole, a few million bytes of text at a
    time or one longer text.

    The classifiers are fitted on at most ``LABELLED`` documents; the rates cover all. Sites are
    aggregated before they travel, so a host with a third of all rows costs no more than another;
    a path's rates go back to its rows by broadcast if there are few paths or the path has many
    documents, else by a join.
    """
    spark = docs.sparkSession
    ship(spark)
    heads, rates = _train(docs, labels)
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    bare = F.regexp_replace(source, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.substring_index(bare, "/", 1)
    path = F.substring_index(F.regexp_replace(bare, "[?#].*$", ""), "/", 2)
    given = as_row(docs, F.col("text"), host.alias("host"), path.alias("path"))
    seen = table(given.mapInArrow(_evidence(heads), with_row(given, "host string, path string, low double, toxic double")), "evidence", compression="zstd")

    def alone(h: str) -> Column:
        return _logistic(F.col(h) + float(np.log(rates[h] / (1 - rates[h]))))

    paths = table(seen.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(alone(h)).alias(h) for h in HEADS)), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(h).alias(f"host_{h}") for h in HEADS))
    whole = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"host_{h}").alias(h) for h in HEADS)).first()
    mean = {h: float(np.clip((whole[h] or 0) / max(1, whole["n"] or 0), 1e-4, 1 - 1e-4)) for h in HEADS}
    for h in HEADS:
        k = _strength(hosts, F.lit(mean[h]), F.col("host_n"), F.col(f"host_{h}"))
        hosts = hosts.withColumn(f"prior_{h}", (k * mean[h] + F.col(f"host_{h}")) / (k + F.col("host_n")))
    sites = paths.join(hosts, "host")
    worth = {h: _strength(sites, F.col(f"prior_{h}"), F.col("n"), F.col(h)) for h in HEADS}
    sites = sites.select("host", "path", "n", *(F.col(h).alias(f"sum_{h}") for h in HEADS), *(f"prior_{h}" for h in HEADS))
    if paths.count() <= BROADCAST_PATHS:
        found = seen.join(F.broadcast(sites), ["host", "path"])
    else:  # paths of very many documents are few: at most the number of all documents over HOT_PATH
        hot = sites.where(F.col("n") >= HOT_PATH)
        own = seen.join(F.broadcast(hot.select("host", "path")), ["host", "path"], "left_anti").join(sites.where(F.col("n") < HOT_PATH), ["host", "path"])
        found = own.unionByName(seen.join(F.broadcast(hot), ["host", "path"]))
    out = {}
    for h in HEADS:
        rest = (worth[h] * F.col(f"prior_{h}") + F.col(f"sum_{h}") - alone(h)) / (worth[h] + F.col("n") - 1)
        out[f"path_{h}"] = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), rest))  # its own share left out
        out[f"p_{h}"] = _logistic(F.col(h) + _logit(out[f"path_{h}"]))
    scored = found.select("row", *(v.alias(c) for c, v in out.items()))
    return scored.withColumn("keep", (F.col("p_low") < cut) & (F.col("p_toxic") < cut))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id with the findings of ``score_quality``."""
    picked = docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else []))
    return score_quality(picked, labels).select("row.doc_id", "p_low", "p_toxic", "path_low", "path_toxic", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all else as it is.

    Null and empty texts and rows without doc_id are judged like others (see ``score_quality``), and
    repeated rows stay or go together. Columns may have any names. An empty table gives no rows.
    """
    return score_quality(docs, labels).where("keep").select(*(column(c, "row").alias(c) for c in docs.columns))
