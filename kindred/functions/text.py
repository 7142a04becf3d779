"""Column expressions that normalise, split and join text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query keeps at most, and the relevance of a word that the terms don't have.
MAX_WORDS, MISSING_RELEVANCE = 15, 6666

# Marks that become a blank, and marks that go.
BLANKED, DELETED = "#@();./+-_", "!,?:'"
UMLAUTS = (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"))
#: Digits come off a word of two or more letters, or a blank before them. Each place is first asked
#: for digits, as letters are many.
DIGITS = r"(?=\d\d)(?<=[A-Za-z]{2}|\s|^)\d+"
#: What Unicode calls white space.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize(text: Column) -> Column:
    """Marks blanked or deleted, lower case, umlauts spelled out, digits set apart, ends trimmed."""
    out = F.lower(F.translate(text, BLANKED + DELETED, " " * len(BLANKED)))
    for mark, spelled in UMLAUTS:
        out = F.replace(out, F.lit(mark), F.lit(spelled))
    return F.btrim(F.regexp_replace(out, f"(?U){DIGITS}", " $0 "), F.lit(BLANKS))


def words(normal: Column) -> Column:
    """The words of a normalised text that stand by themselves: longer than a byte, a digit, or the
    first piece of one byte; at most MAX_WORDS."""
    pieces = F.filter(F.split(normal, " "), lambda w, i: (F.octet_length(w) > 1) | w.rlike("^[0-9]$") | ((i == 0) & (F.octet_length(w) == 1)))
    return F.slice(pieces, 1, MAX_WORDS)


def candidate_words(normal: Column) -> Column:
    """Distinct words that a stored text is compared by: longer than a byte, or an ASCII digit."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: (F.octet_length(w) > 1) | w.rlike("^[0-9]$")))


def bag2(a: Column, b: Column) -> Column:
    """Two strings in byte order, with a blank between."""
    return F.concat_ws(" ", F.least(a, b), F.greatest(a, b))


def bag3(a: Column, b: Column, c: Column) -> Column:
    """Three strings in byte order; of two equal first ones and a larger third, the third leads."""
    return F.when((a == b) & (b < c), F.concat_ws(" ", c, a, b)).otherwise(F.array_join(F.array_sort(F.array(a, b, c)), " "))


def has_digit(word: Column) -> Column:
    return word.rlike(r"\p{N}")


def match_sets(query: Column, candidate: Column, synonyms: Column | None = None) -> dict[str, Column]:
    """match, miss and excess words of a query and a candidate, as arrays.

    ``synonyms`` is an array of struct<word, synonym> of the candidate's: where the candidate has
    the synonym and the word isn't matched yet, the word counts as matched and the synonym is used
    up.
    """
    mine = F.array_distinct(query)
    match = F.array_intersect(mine, candidate)
    left = candidate
    if synonyms is not None:
        used = F.filter(F.coalesce(synonyms, F.array().cast("array<struct<word:string,synonym:string>>")), lambda s: F.array_contains(candidate, s["synonym"]) & ~F.array_contains(match, s["word"]))
        match = F.array_union(match, F.transform(used, lambda s: s["word"]))
        left = F.array_except(candidate, F.transform(used, lambda s: s["synonym"]))
    return {"match": match, "miss": F.array_except(mine, match), "excess": F.array_except(left, match)}
