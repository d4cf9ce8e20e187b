"""Null-preserving predicates and score formulas as column expressions.

Null means "not measured": a predicate that rejects never rejects a null, and formulas have a stated neutral value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Java: a word; + and # belong to words. In scripts written without blanks each character is a word of its own.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}ー"
WORD = rf"(?:[\p{{L}}\p{{M}}\p{{N}}+#&&[^{_UNSPACED}]]+|[\p{{L}}\p{{M}}\p{{N}}&&[{_UNSPACED}]])"


def visible(c: Column) -> Column:
    """The text without invisible characters (zero-width blanks, joiners, soft hyphens)."""
    return F.regexp_replace(c, r"\p{Cf}", "")


def rejects(predicate: Column) -> Column:
    """The predicate, with null as no rejection."""
    return F.coalesce(predicate, F.lit(False))


def first_reason(*stages: tuple[str, Column]) -> Column:
    """The name of the first stage that rejects a row; null if none does."""
    chain = None
    for name, predicate in stages:
        chain = F.when(rejects(predicate), name) if chain is None else chain.when(rejects(predicate), name)
    return chain


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether any word is in the text, in any letter case; null if the text is."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w.lower())) for w in words])


def experience_floor(c: Column) -> Column:
    """The lowest number of years of a range such as "3-6 Yrs"; 0 for freshers; null if it names none."""
    return F.when(F.contains(F.lower(c), F.lit("fresher")), 0).otherwise(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"))


def piecewise(x: Column, points: list[tuple[float, float]], neutral: float) -> Column:
    """Straight lines between the points, flat beyond the ends; `neutral` for null."""
    chain = F.when(x.isNull(), F.lit(float(neutral))).when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        chain = chain.when(x <= x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)))
    return chain.otherwise(F.lit(float(points[-1][1])))


def bands(x: Column, steps: list[tuple[float, float]], beyond: float, neutral: float) -> Column:
    """The value of the first step whose bound isn't exceeded; `beyond` after the last, `neutral` for null."""
    chain = F.when(x.isNull(), F.lit(float(neutral)))
    for bound, value in steps:
        chain = chain.when(x <= bound, F.lit(float(value)))
    return chain.otherwise(F.lit(float(beyond)))


def scaled(x: Column, low: float, high: float) -> Column:
    """0 at `low` and below, 1 at `high` and above, linear between; 0 everywhere if high <= low."""
    if high <= low:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(float(low))) / F.lit(float(high - low))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is empty or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def phrase_key(c: Column) -> Column:
    """A spelling key: lower case, letters and digits (and + #) only."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9+#]", "")


def company_key(c: Column) -> Column:
    """Lower case without brackets and signs, trailing legal forms dropped, words joined."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", " "), r"[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(words, r"( (inc|llp|llc|ltd|limited|private|pvt|gmbh|ag|corp|s a|co))+$", ""), " ", "")


def has_term(text: Column, term: Column) -> Column:
    """Whether a term stands in a lower-case text between characters that are neither letters nor digits."""
    quoted = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), term, F.lit(r"\E($|[^a-z0-9])"))
    return F.regexp_like(text, quoted)


def ngrams(words: Column, n: int) -> Column:
    """The distinct runs of `n` words, joined by blanks; the whole if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array(F.array_join(words, " ")))
