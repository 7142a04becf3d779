"""Odd rows, columns of any name and very long texts, for every operator; and costs that must stay linear."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import bpe, chat, decontamination, lm_scoring, near_dedup, packing, quality, secrets, token_store
from kindred.llm.common import Workspace, column, fresh, scratch

COLUMNS = ["my col", "a-b", "x.y", "back`tick", "row", "keep", "clean", "_digest", "host", "low"]
LONG = " ".join(f"word{k % 5000}" for k in range(300_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of all kinds, in a table with such columns."""
    rows = [(1, "a plain text of some words that nobody minds"), (1, "a plain text of some words that nobody minds"), (2, None), (3, ""), (None, "no id but words"), (4, LONG), (5, "password=abcdefgh12 and so on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("host/path"))
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(COLUMNS)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*((k, 1, 0) for k in range(1, 6)), (77, 0, 1)], "doc_id long, quality int, toxic int")


def test_names_of_columns(spark, odd):
    one = odd.where("doc_id = 5").select(*(column(c) for c in odd.columns))
    assert one.columns == odd.columns and one.first()[3 + 2] == 2
    assert fresh("ROW", odd) == "ROW_" and fresh("other", odd) == "other"


def test_stages_keep_columns(spark, odd, labels):
    items = spark.createDataFrame([(1, "a plain text of some words that nobody minds")], "item_id long, text string")
    for out in (quality.keep_good(odd, labels), near_dedup.keep_first(odd), decontamination.decontaminate(odd, items), secrets.redact_secrets(odd)):
        assert out.columns == odd.columns
        got = out.collect()
        assert {(r.doc_id, r["x.y"], r["back`tick"], r["keep"]) for r in got} >= {(4, 2, 3, 5), (2, 2, 3, 5), (None, 2, 3, 5)}
        assert sum(len(r.text or "") for r in got if r.doc_id == 4) == len(LONG)
        assert out.limit(0).columns == odd.columns
    empty = odd.limit(0)
    for out in (quality.keep_good(empty, labels), near_dedup.keep_first(empty), decontamination.decontaminate(empty, items), secrets.redact_secrets(empty)):
        assert out.count() == 0


def test_very_long_texts(spark, odd, labels):
    """One text of millions of characters is read whole by all."""
    long = odd.where("doc_id = 4").select("doc_id", "text")
    n = 300_000
    assert lm_scoring.score_documents(long, labels).first()["n_tokens"] == n
    assert decontamination.find_contamination(long, spark.createDataFrame([(1, "word4999 word0 word1")], "item_id long, text string")).first()["n_hit"] == 3 * (n // 5000 - 1)
    assert near_dedup.find_groups(long, 4).first()["n_shingles"] == 5000
    assert packing.pack(long, ids=False).agg(F.sum("length")).first()[0] == len(bpe.encoder(None).encode(pa.array([LONG]))[1]) + 1
    path = scratch(spark, "tokens")
    token_store.write_tokens(long, path)
    assert token_store.read_tokens(spark, path, tokens=False).first()["n_tokens"] == len(bpe.encoder(None).encode(pa.array([LONG]))[1]) + 1
    turns = spark.createDataFrame([(1, 0, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(spark, turns).first()["loss_chars"] == len(LONG)
    assert quality.classify(odd, labels).where("doc_id = 4").count() == 1


def test_secrets_take_linear_time():
    """Candidates beside spans of patterns: twice as many take about twice as long."""
    took = []
    for n in (4_000, 32_000):
        text = " ".join(f"AKIA{k:012d} Zx{k:020d}qW" for k in range(n))
        began = time.perf_counter()
        base = secrets._base(text)
        found = list(secrets._candidates(text, base))
        took.append(time.perf_counter() - began)
        assert len(base) == n and len(found) == n
    assert took[1] < 8 * 4 * max(took[0], 0.02)


def test_blocks_send_rows_to_parts_that_have_some():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * 2)
    for parts in (1, 7, 1 << 20):
        own = list(lm_scoring._parts(keys, parts))
        assert len(own) <= min(parts, len(keys)) and [a for _, a, _ in own] == [0, *(z for _, _, z in own[:-1])] and own[-1][2] == len(keys)
        for p, a, z in own:
            assert (np.cumsum(lm_scoring._whole(lm_scoring._packed(keys[a:z], p, parts)), dtype=np.uint64) + np.uint64((p << 64) // parts) == keys[a:z]).all()
    assert list(lm_scoring._parts(keys[:0], 5)) == []


def test_scores_of_texts_without_words(spark, labels):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, "--")], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens, r.score) for r in lm_scoring.score_documents(docs, labels).collect()} == {(1, 0, 0.0), (2, 0, 0.0), (None, 0, 0.0)}


def test_intermediate_tables_go(spark):
    run = Workspace(spark)
    df = run.write(spark.range(3), "some")
    assert df.count() == 3
    run.drop("some")
    with pytest.raises(Exception):  # noqa: B017
        spark.read.schema("id long").parquet(run.paths.get("some", "nowhere")).count()


def plain_posteriors(rows, heads, rates):
    """Evidence, then path and host rates that shrink, and posteriors, a row at a time in plain Python."""
    logistic = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda p: math.log(p / (1 - p))
    clip = lambda p: min(1 - 1e-4, max(1e-4, p))
    out = [{} for _ in rows]
    for h in quality.HEADS:
        evidence = [float(np.mean([x.evidence(quality.Features.of(pa.array([t], pa.string())))[0] for x in heads[h]])) if h in heads else 0.0 for _, t, _ in rows]
        alone = [logistic(e + logit(rates[h])) for e in evidence]
        paths, hosts = {}, {}
        for (_, _, source), p in zip(rows, alone, strict=True):
            host = (source or "").split("/")[0]
            for table, key in ((paths, (host, "/".join((source or "").split("/")[:2]))), (hosts, host)):
                n, s = table.get(key, (0, 0.0))
                table[key] = n + 1, s + p
        mean = clip(sum(alone) / len(alone))

        def strength(sites):
            seen = sum(n * (s / n - prior) ** 2 for n, s, prior in sites)
            chance = sum(prior * (1 - prior) for _, _, prior in sites)
            spread = sum(n * prior * (1 - prior) for n, _, prior in sites)
            return 10_000.0 if not spread or seen <= chance else min(10_000.0, max(2.0, spread / (seen - chance)))

        k = strength([(n, s, mean) for n, s in hosts.values()])
        prior = {x: (k * mean + s) / (k + n) for x, (n, s) in hosts.items()}
        worth = strength([(n, s, prior[x[0]]) for x, (n, s) in paths.items()])
        for r, (_, _, source), e, p in zip(out, rows, evidence, alone, strict=True):
            host = (source or "").split("/")[0]
            n, s = paths[host, "/".join((source or "").split("/")[:2])]
            r[h] = logistic(e + logit(clip((worth * prior[host] + s - p) / (worth + n - 1))))
    return out


@pytest.mark.parametrize(("paths", "hot"), [(100_000, 100_000), (0, 5)])
def test_quality_equals_plain_posteriors(spark, monkeypatch, paths, hot):
    monkeypatch.setattr(quality, "BROADCAST_PATHS", paths)
    monkeypatch.setattr(quality, "HOT_PATH", hot)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").limit(400)
    rows = [(r.doc_id, r.text, ("s/" if r.doc_id % 3 else "t/") + f"p{r.doc_id % 7}/x" if r.doc_id % 11 else None) for r in docs.collect()]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    heads, rates = quality._train(given, labels)
    assert set(heads) == set(quality.HEADS)
    right = {r[0]: p for r, p in zip(rows, plain_posteriors(rows, heads, rates), strict=True)}
    for r in quality.classify(given, labels).collect():
        assert r.p_low == pytest.approx(right[r.doc_id]["low"], abs=1e-9) and r.p_toxic == pytest.approx(right[r.doc_id]["toxic"], abs=1e-9)
        assert r.keep == (right[r.doc_id]["low"] < 0.4 and right[r.doc_id]["toxic"] < 0.4)


def test_sample_is_of_documents_that_exist(spark, monkeypatch):
    """Labels of absent documents take no places, and a repeated id teaches once."""
    monkeypatch.setattr(quality, "LABELLED", 6)
    docs = spark.createDataFrame([(k // 2, f"text {k} of words") for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(500)], "doc_id long, quality int, toxic int")
    _, rates = quality._train(docs, labels)
    assert rates["low"] == pytest.approx(3.5 / 7)
