"""The inputs of the registered queries."""

from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import index as I
from kindred.operators import kernel
from kindred.operators import parsing as P
from kindred.plans import queries as Q
from kindred.plans import tables as T


def test_sentences_of_any_length(spark, tmp_path):
    long = " ".join(f"word{chr(97 + k)}" for k in range(20))
    spark.createDataFrame([(1, f"Alone. two words.{long}\n.."), (2, "two words"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = T.sentences(spark, str(tmp_path))
    assert sorted(r["query"] for r in found.collect()) == sorted(["Alone", "two words", long])
    dims = P.Dimensions(T.doc_terms(spark, str(tmp_path)), T.no_words(spark))
    for mode in (kernel.INDEX, kernel.SEARCH):
        assert all(r["ngrams"] for r in P.parse(found, dims, mode).collect())


def test_capped_lists_of_documents(spark, tmp_path, monkeypatch):
    """Words are counted where documents are read, and pairs of word and document don't travel."""
    monkeypatch.setattr(I, "BLOCK_BYTES", 200)
    monkeypatch.setattr(T, "DOC_CAP", 3)
    rows = [(k, " ".join(["the"] * (k % 4 * 100 + 1) + [f"w{k % 3}", "über", f"x{k}"]) + ".\n") for k in range(20)] + [(90, None), (91, " "), (-5, "the the")]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{one}/documents.parquet")
    spark.createDataFrame([*rows, (3, "the w0"), (None, "the")], "doc_id long, text string").write.parquet(f"{two}/documents.parquet")
    for at in (one, two):
        got = Q.QUERIES["inverted_index_capped"](spark, at)
        want = I.cap(Q._doc_postings(spark, at), 3)
        assert got.schema["score"].dataType == want.schema["score"].dataType and got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert {r.ngram: r.len for r in Q.QUERIES["posting_lengths"](spark, at).collect()}["the"] == 3
    plan = Q.QUERIES["inverted_index_capped"](spark, one)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "doc_id" not in plan.split("Exchange hashpartitioning")[0]


def test_normal_form(spark):
    """As the earlier patterns had it, of white space of all kinds and digits in all places."""
    odd = ["ab12", "a12", "ab1 12", "ab12cd345 6", "\u00a0 12 \u3000", "x\t12\x85", "\u200312", "12ab34", "ab-12", "a b12.5", "abé12", "\u0663\u0664 ab\u0663\u0664", "\x1c12", "", " \n "]
    df = spark.createDataFrame([(s,) for s in odd], "s string")
    was = F.lower(F.translate("s", text.BLANKED + text.DELETED, " " * len(text.BLANKED)))
    for mark, spelled in text.UMLAUTS:
        was = F.replace(was, F.lit(mark), F.lit(spelled))
    was = F.regexp_replace(F.regexp_replace(was, r"(?U)([A-Za-z]{2,}|\s|^)(\d{2,})", "$1 $2 "), r"(?U)^\s+|\s+$", "")
    assert all(a == b for a, b in df.select(text.normalize(F.col("s")), was).collect())
