"""Cosine distances that look at what two queries don't share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.functions.text import MISSING_RELEVANCE
from kindred.operators.parsing import Dimensions

_SETS = ("words", "candidate", "match", "miss", "excess")


def _facts(pairs: DataFrame, words: DataFrame, dims: Dimensions) -> DataFrame:
    """For each distinct word of all pairs: its vector (null if unknown) and its weight."""
    stop = dims.stopwords.select("word").distinct().withColumn("stop", F.lit(True))
    named = pairs.select(F.explode(F.array_union("words", "candidate")).alias("word")).distinct()
    rel = F.coalesce(F.col("rel"), F.lit(MISSING_RELEVANCE)).cast("double")
    found = named.join(dims.terms.select("word", "rel"), "word", "left").join(stop, "word", "left").join(words.select("word", F.col("vec").cast("array<double>").alias("vec")), "word", "left")
    return found.select("word", "vec", V.weight(rel, F.coalesce("stop", F.lit(False)) | (F.octet_length("word") == 1)).alias("w"))


def rerank_rules(v: dict[str, Column], n: dict[str, Column], unknown: dict[str, Column], k: Column) -> Column:
    """The difference-aware distance: the first rule whose condition holds.

    ``v``: summed vectors of the sets; ``n``: their sizes; ``unknown``: their words without
    vectors; ``k``: the keyword distance.
    """
    m, s, x = n["match"], n["miss"], n["excess"]
    um, us, ux = unknown["match"], unknown["miss"], unknown["excess"]
    whole = F.when((unknown["words"] < n["words"]) & (unknown["candidate"] < n["candidate"]), V.cosine_distance(v["words"], v["candidate"]))
    apart = V.cosine_distance(v["excess"], v["miss"])
    one = F.lit(1.0)

    def partly(few: Column) -> Column:
        much = (m >= 2) & (m > s) & (m > x) & (k < 0.45) & (ux + um + us <= 1)
        return F.when(few, whole * k).when(much, F.when(k + whole > 0, whole * k / (k + whole)).otherwise(F.lit(0.0))).otherwise(F.least(whole + (ux + um + us) * k / (s + x), one))

    bound = F.when(s > 1, F.when(x < 2, 0.5).otherwise(0.45)).otherwise(F.when(x < 2, 0.55).otherwise(0.65))
    extra = F.greatest(F.lit(0.0), apart - bound)
    turned = V.cosine_distance(V.subtract(v["match"], v["miss"]), V.subtract(v["match"], v["excess"]))
    mixed = F.when((x >= 1) & (s >= 1) & (m <= 2) & (k > 0.45), 1.3 * turned + extra).when((x <= 2) & (s <= 2) & (m > x) & (k <= 0.45), 0.75 * turned + extra).otherwise(turned + extra)
    null = F.lit(None).cast("double")
    return (
        F.when((s == 0) & (x == 0), F.lit(0.0))
        .when((um == m) & ((us == s) | (ux == x)), null)
        .when(um == m, F.when((s > m) | (x > m), F.least(apart * (1 + k), one)).otherwise(apart))
        .when((us == s) & (ux == x), null)
        .when(us == s, F.when(whole.isNotNull(), partly((m >= 2) & (s == 0) & (x < 2) & (k < 0.3))))
        .when(ux == x, F.when(whole.isNotNull(), partly((m >= 2) & (s < 2) & (x == 0) & (k < 0.3))))
        .otherwise(mixed)
    )


def cosine_of(pairs: DataFrame, words: DataFrame | None, dims: Dimensions) -> DataFrame:
    """``pairs`` with ``cosine``. They have the arrays words, candidate, match, miss and excess, and
    keyword. A pair's word vectors come by one join on words and one aggregation."""
    if words is None:
        return pairs.withColumn("cosine", F.lit(None).cast("double"))
    key = [c for c in ("qid", "query_id", "cand_id") if c in pairs.columns]
    facts = _facts(pairs, words, dims)
    each = pairs.select(*key, F.explode(F.array_union("words", "candidate")).alias("word")).join(facts, "word")
    known = each.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("vec", "w")))).alias("facts"))
    out = pairs.join(known, key, "left")
    sums, sizes, unknown = {}, {}, {}
    for name in _SETS:
        got = F.transform(F.col(name), lambda w: F.element_at("facts", w))
        out = out.withColumn(f"{name}_vec", V.weighted_sum(got)).withColumn(f"{name}_unknown", F.size(F.filter(got, lambda p: p["vec"].isNull())))
        sums[name], unknown[name], sizes[name] = F.col(f"{name}_vec"), F.col(f"{name}_unknown"), F.size(name)
    out = out.withColumn("words_distinct", F.size(F.array_distinct("words")))
    sizes["words"] = F.col("words_distinct")
    unknown["words"] = F.size(F.array_distinct(F.filter("words", lambda w: F.element_at("facts", w)["vec"].isNull())))
    zeros = F.coalesce(*(F.transform(F.col(f"{name}_vec"), lambda a: a * 0.0) for name in ("words", "candidate")))
    for name in ("match", "miss", "excess"):
        sums[name] = F.coalesce(sums[name], zeros)
    cosine = rerank_rules(sums, sizes, unknown, F.col("keyword"))
    drop = ["facts", "words_distinct", *(f"{n}_vec" for n in _SETS), *(f"{n}_unknown" for n in _SETS)]
    return out.withColumn("cosine", F.when(~F.isnan(cosine), cosine)).drop(*drop)
