"""Distances of given pairs, without an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import kernel
from kindred.operators.parsing import Dimensions, parse
from kindred.operators.rerank import cosine_of


def overlap(words: str, shares: str, synonyms: str, candidate: str, candidate_shares: str) -> str:
    """SQL of the sum over candidate words of the smaller of both weights. A word counts as the
    query's if it is one of its words (the last of equal ones) or a synonym, which goes first."""
    place = f"coalesce(try_element_at(filter(map_entries({synonyms}), e -> e.value = p.word), -1).key, cast(size({words}) - array_position(reverse({words}), p.word) as int))"
    known = f"exists(map_values({synonyms}), s -> s = p.word) or array_contains({words}, p.word)"
    pairs = f"filter(transform({candidate}, (w, i) -> struct(w as word, {candidate_shares}[i] as share)), p -> {known})"
    return f"aggregate({pairs}, 0.0D, (t, p) -> t + least({shares}[{place}], p.share))"


def distances(pairs: DataFrame, dims: Dimensions, vectors: DataFrame | None = None) -> DataFrame:
    """qid, cand_id, query, candidate, keyword and cosine of each row of ``pairs`` (qid, query,
    cand_id, candidate). An empty or null query has no distances."""
    rows = pairs.where(F.coalesce(F.col("query"), F.lit("")) != "").select("qid", "cand_id", "query", F.col("candidate").alias("text"))
    mine = parse(rows.select("query").distinct(), dims, kernel.SEARCH).select("query", "words", "wrs", "synonyms")
    other = parse(rows.select(F.col("text").alias("query")).distinct(), dims, kernel.SEARCH).select(F.col("query").alias("text"), F.col("words").alias("cand_words"), F.col("wrs").alias("cand_wrs"), F.col("synonyms").alias("cand_synonyms"))
    both = rows.join(mine, "query").join(other, rows["text"].eqNullSafe(other["text"])).drop(other["text"])
    both = both.withColumn("keyword", F.greatest(F.lit(0.0), 1 - F.expr(overlap("words", "wrs", "synonyms", "cand_words", "cand_wrs"))))
    both = both.withColumn("candidate", text.candidate_words(text.normalize(F.coalesce("text", F.lit("")))))
    pairs_of = F.expr("filter(transform(map_entries(synonyms), e -> struct(words[e.key] as word, e.value as synonym)), s -> s.word is not null)")
    for name, column in text.match_sets(F.col("words"), F.col("candidate"), pairs_of).items():
        both = both.withColumn(name, column)
    done = cosine_of(both, vectors, dims)
    return done.select("qid", "cand_id", "query", F.col("text").alias("candidate"), "keyword", "cosine")
