"""Operators on a corpus against plain Python: near-duplicates, models, neighbours, the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import lm_scoring, near_dedup, nearest, quality
from kindred.llm.graph import components

DOCS = "doc_id long, text string"


def plain_groups(rows, size, percent=80):
    sets, top = [], {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()))

    def root(x):
        while x in top:
            x = top[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = root(i), root(j)
                if x != y:
                    top[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def near_copies(seed=1, groups=6, copies=14, length=60):
    """Groups of copies at many distances from their origin, some of which only chains join."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, shared = [], [word() for _ in range(15)]
    for _ in range(groups):
        origin = [word() for _ in range(length)] + shared
        for k in range(copies):
            own = list(origin)
            for _ in range(k % 7):
                own[rng.randrange(length)] = word()
            rows.append(" ".join(own))
            if k % 5 == 0:
                rows.append(" ".join(own).upper())
    rows += [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 300)] * 2
    return [*enumerate(rows), *((1000 + k, t) for k, t in enumerate([None, "", " \t\n", "a", "A", "a b c", "b c a"]))]


@pytest.mark.parametrize(("size", "block"), [(4, 512), (5, 4)])
def test_near_dedup(spark, monkeypatch, size, block):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block * 4_000)
    rows = near_copies()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("component_id", F.lit("clash"))
    got = sorted(tuple(r) for r in near_dedup.find_groups(docs, size).collect())
    assert got == plain_groups(rows, size)
    kept = near_dedup.keep_first(docs, size)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in got if k]
    assert kept.columns == docs.columns


def test_near_dedup_small(spark):
    assert near_dedup.find_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "x"), (None, "x")]
    got = near_dedup.find_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id or 0, r.component_id, r.kept) for r in got)) == [(0, 3, False), (3, 3, True), (7, 7, True), (7, 7, True)]


def test_near_dedup_of_shared_ids(spark):
    """Texts under one id, or under none, are documents each for itself."""
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(7, words(0, 30)), (7, words(100, 130)), (7, words(100, 130)), (None, words(200, 230)), (None, words(300, 330)), (None, words(300, 331))]
    rows += [(3, words(400, 430)), (9, words(400, 431)), (9, words(500, 530)), (8, ""), (8, words(600, 630)), (None, words(0, 30))]
    docs = spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", source string").repartition(3)
    kept = near_dedup.keep_first(docs)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    near = [got.pop((None, words(300, n)), 0) for n in (330, 331)]
    assert sum(near) == 1 and kept.columns == docs.columns
    assert got == Counter([(7, words(0, 30)), (7, words(100, 130)), (None, words(200, 230)), (3, words(400, 430)), (9, words(500, 530)), (8, ""), (8, words(600, 630))])


def test_similarity_estimate():
    hashes = near_dedup.Hashes(near_dedup.ROWS * near_dedup.BANDS)
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.5, 0.8, 0.95):
        n = 1000
        both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        own = [np.concatenate((both, rng.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64))) for _ in range(2)]
        low = [(hashes.minima(x) & 15).astype(np.uint8) for x in own]
        a, b = near_dedup._signatures([(x[::2] | (x[1::2] << 4)).tobytes() for x in low])
        errors.append(near_dedup.similarity(a[None], b[None])[0] - share)
    assert max(map(abs, errors)) < 0.12


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_scores(rows, target):
    words = {k: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, (_, t) in enumerate(rows)}
    flag = {k: d in target for k, (d, _) in enumerate(rows)}
    size = lm_scoring.VOCABULARY + 2
    count = lambda keys, f: Counter(x for k in keys for x in f(words[k]))
    pairs, befores = (lambda w: list(zip([None, *w], w, strict=False))), (lambda w: [None, *w[:-1]] if w else [])
    chosen = [k for k in words if flag[k]]
    total = {m: sum(len(words[k]) for k in ks) for m, ks in (("all", words), ("target", chosen))}
    part = {"all": 1.0, "target": max(total["target"] / total["all"], 1e-6)}
    facts = {m: (count(ks, list), count(ks, befores), count(ks, pairs)) for m, ks in (("all", words), ("target", chosen))}
    out = []
    for k, (doc, _) in enumerate(rows):
        w = words[k]
        own = Counter(w), Counter(befores(w)), Counter(pairs(w))
        loss = {}
        for m in ("all", "target"):
            less = 1 if m == "all" or flag[k] else 0
            one, before, two = facts[m]
            at = 0.0
            for b, x in pairs(w):
                share = (one[x] - less * own[0][x] + part[m]) / (total[m] - less * len(w) + part[m] * size)
                at -= math.log((two[b, x] - less * own[2][b, x] + part[m] * lm_scoring.PRIOR * share) / (before[b] - less * own[1][b] + part[m] * lm_scoring.PRIOR))
            loss[m] = at / max(1, len(w))
        out.append((doc if doc is not None else -1, len(w), round(loss["target"], 9), round(loss["all"], 9), flag[k]))
    return sorted(out)


@pytest.mark.parametrize("block", [lm_scoring.BLOCK_WORDS, 30])
def test_lm_scores(spark, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", block)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["the", "cat", "Sat", "on", "mat", "é", "zz"], k=rng.randrange(0, 40)))) for k in range(30)] + [(90, None), (91, ""), (5, "the cat"), (None, "the end")]
    docs = spark.createDataFrame(rows, DOCS).repartition(2).withColumn("score", F.lit("clash"))
    target = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 5, 77, None)], "doc_id long")
    got = lm_scoring.score_documents(docs, target).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9), r.is_target) for r in got) == plain_scores(rows, {1, 2, 3, 5})
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in got)
    assert lm_scoring.score_documents(docs.limit(0), target).count() == 0


def test_lm_vocabulary_is_all_words(spark, monkeypatch):
    """More words than the smoothing's least number are all words of their own."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(30))) for k in range(40)]
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 3)
    got = lm_scoring.score_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k,) for k in (1, 2)], "doc_id long")).collect()
    monkeypatch.setattr(lm_scoring, "VOCABULARY", len({w for _, t in rows for w in t.split()}))
    assert sorted((r.doc_id, r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9), r.is_target) for r in got) == plain_scores(rows, {1, 2})


def test_quality_on_held_out_labels(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    rows, labels = [], []
    for k in range(900):
        low, toxic = k % 7 == 0, k % 5 == 0
        words = [word() for _ in range(rng.randrange(30, 90))]
        if low:
            words = [w + rng.choice(["***", "$$$", "%%%"]) for w in words]
        if toxic:
            words[:: len(words) // 3] = rng.choices(["vile1", "vile2", "vile3"], k=len(words[:: len(words) // 3]))
        rows.append((k, " ".join(words), f"host{k % 9}/a{k % 3}/x"))
        labels.append((k, 0 if low else 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (2000, None, None), (2001, "", "new/host"), (5, rows[5][1], rows[5][2])], "doc_id long, text string, source string").withColumn("keep", F.lit("clash"))
    seen = spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(4, None, 1), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs.drop("keep"), seen).collect()
    assert len(got) == 903
    truth = {k: q == 1 and t == 0 for k, q, t in labels}
    held = [r for r in got if r.doc_id in truth and r.doc_id % 2]
    assert sum(r.keep == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = quality.keep_good(docs, seen)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.keep}
    assert quality.classify(docs, seen.limit(0)).where("keep").count() == 903
    assert quality.classify(docs.limit(0), seen).count() == 0


def test_sparse_sites_shrink(spark):
    """A path with one document stays nearer to its host's rate than one with many."""
    rows = [(k, f"w{k} " * 5, "bad/many") for k in range(200)] + [(900, "x y z", "good/one")] + [(1000 + k, f"v{k} q", "good/many") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(r[0], int(r[2] != "bad/many"), 0) for r in rows if r[0] % 2 == 0 and r[0] != 900], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[1].path_low > got[900].path_low > 0


@pytest.mark.parametrize("n", [12, 400])
def test_neighbours(spark, monkeypatch, n):
    monkeypatch.setattr(nearest, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 16)
    monkeypatch.setattr(nearest, "LEAST_BLOCK", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 16)) + rng.integers(0, 4, n)[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(n + 1, x[0].tolist()), (n + 2, x[0].tolist())]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [1.0] * 15 + [None]), (None, [1.0] * 16), (5100, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, *odd, rows[1]], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in nearest.search(df, every=20, top=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids, y = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    right = asked = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, own in got.items():
        s = y @ y[ids == q][0]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(order) + 1))
        assert all(abs(s[ids == v][0] - score) < 1e-9 for _, v, score in own)
        assert [(-score, v) for _, v, score in own] == sorted((-score, v) for _, v, score in own)
        right += len({v for _, v, _ in own} & set(ids[order].tolist()))
        asked += len(order)
    assert right / asked >= 0.9
    assert nearest.search(df.limit(0)).count() == 0


def test_recall_against_exact_answer(spark):
    """All queries of sf0.1, each against all vectors."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = defaultdict(set)
    for r in nearest.search(df, every=20, top=20).collect():
        got[r.query_id].add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    right = [len(got[int(ids[q])] & set(ids[np.argsort(-s)[:20]].tolist())) for q, s in zip(asked, scores, strict=True)]
    assert len(asked) == 100 and sum(right) / (20 * len(asked)) >= 0.9


def test_huge_components(spark):
    rows = [(k, [1e200 * (k % 3), float(k), -1.0]) for k in range(1, 50)] + [(100, [1e300, 1e300, 1.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, top=3).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in (20, 40, 100) for k in (1, 2, 3)}
    with np.errstate(all="ignore"):
        score = {(q, i): float((np.array(dict(rows)[q]) * np.array(v)).sum()) for q in (20, 40, 100) for i, v in rows if i != q}
    for q in (20, 40, 100):
        best = sorted((-score[q, i], i) for i, _ in rows if i != q)[:3]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == best


def test_tables_find_all_within_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 32, (9000, 8), dtype=np.uint64).astype(np.uint32)
    codes[:50] = codes[0] ^ (np.uint32(1) << rng.integers(0, 32, (50, 8), dtype=np.uint32))
    tables = nearest.Tables(codes)
    for radius in (0, 3, 7, 8, 20, 31, 110, 130):
        away = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
        assert tables.within(codes[0], radius).tolist() == np.flatnonzero(away <= radius).tolist()


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its operator decides, on a small corpus."""
    import corpus_pipeline

    copies = [(k, t + " more words here", "fr", f"src{k % 3}", 0) for k, t in near_copies(groups=3, copies=8) if t]
    copies += [(5000, "password: hunter2hunter2 and so on", "en", "src1", 0), (5001, None, None, None, None)]
    docs = spark.createDataFrame(copies, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    items = [(1, "the first item has quite a few words in it"), (2, "and the second item has even more words in it")]
    leak = [(6000, " ".join(t for _, t in items), "en", "src2", 0), (6001, f"before {items[0][1]} after", "en", "src2", 0)]
    docs.unionByName(spark.createDataFrame(leak, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs.unionByName(spark.createDataFrame(leak, docs.schema))
    frames = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k < 4:
            assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        frames.append({r.doc_id: r for r in at.collect()})
    rows = [(r.doc_id, r.text) for r in frames[0].values()]
    assert set(frames[1]) == {i for i, _, _, kept in plain_groups(rows, 5) if kept}
    assert 6000 not in frames[2] and frames[2][6001].text == "before  after" and set(frames[2]) == set(frames[1]) - {6000}
    assert frames[3][5000].text == "[SECRET] and so on" and frames[3][5001].text is None and set(frames[3]) == set(frames[2])
    assert set(frames[4]) == set(frames[3])
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in ran} == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in at.collect()}
