"""Free-typed values mapped to the entries of a reference list, by a prefix-filtered set-similarity join."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from jobmill.operators.skew import join_counted
from jobmill.session import cut, spread

GRAMS_A_SLIP = 3  #: grams of a name that one slip of the pen changes: a letter and the pairs on either side
GRAMS_MOVED = 2  #: grams that words in another order may change besides

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухкіјѕԁһьвмнтгпцԛԝαορνικτυχ", "aeopcyxkijsdhbbmhtrnuqwaopviktux")

# Words around a skill that speak of a wish, a level or a length of time.
AROUND = set(
    "a an and the in of with to for on or at as our using some any well very is be "
    "strong expert expertise solid good great excellent deep basic advanced intermediate beginner senior junior proven practical "
    "working work hands handson hands-on knowledge experience experienced exp proficiency proficient exposure familiarity familiar understanding "
    "ability skill skills skilled tool tools years year yrs yr y months must have musthave preferred required mandatory optional plus bonus nice nicetohave desired desirable "
    "level minimum min least version ver v".split()
)
_VERSION = re.compile(r"v?\.?\d+(?:\.(?:\d+|x))*\+?", re.I)
_WORD = re.compile(r"[^\W_]+[+#]*")


def plain(text: str) -> str:
    """Without escapes, width, accents, invisible characters, lookalikes and case."""
    while "&" in text and (less := html.unescape(text)) != text:
        text = less
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf", "Cc") or c.isspace())
        text = text.lower().translate(LOOKALIKES)
    return text.lower()


def _words(text: str) -> str:
    """The words of a plain text; an "and" is worth no more than a "&"."""
    found = _WORD.findall(text)
    return " ".join([w for w in found if w != "and"] or found)


def _bare(text: str) -> list[str]:
    """The words of a plain text without versions, and without words of wishes, levels and times at its start and,
    one after another, at its end."""
    words = []
    for chunk in text.split():
        chunk = chunk.strip("()[]{}<>.,;:!?*•·–—-_/\\|\"'`~")
        if chunk and not _VERSION.fullmatch(chunk):
            words.append(chunk)
    start, end = 0, len(words)
    while start < end and words[start] in AROUND:
        start += 1
    out = [words[start:end]]
    while end > start and words[end - 1] in AROUND:
        end -= 1
        out.append(words[start:end])
    return [_words(" ".join(x)) for x in (words, *out) if x]


def readings(value: str | None) -> list[str]:
    """What a typed value may be the name of: the whole, the part outside brackets, the part inside, each also
    without what is said around a skill."""
    if value is None:
        return []
    text = plain(value)
    parts = [text]
    if "(" in text:
        parts += [re.sub(r"\([^()]*\)?", " ", text), *re.findall(r"\(([^()]*)\)?", text)]
    return list(dict.fromkeys(r for r in (_words(text), *(x for p in parts for x in _bare(p))) if r))


def grams(name: str) -> list[str]:
    """The letters of a name and its pairs of neighbours, blanks left out; the n-th of a kind is told apart."""
    text = name.replace(" ", "")
    seen: dict[str, int] = {}
    out = []
    for g in (*text, *map("".join, zip(text, text[1:]))):
        n = seen[g] = seen.get(g, 0) + 1
        out.append(g if n == 1 else f"{g}{n}")
    return out


def needed(letters: int) -> float:
    """The Jaccard similarity of grams that a pair needs, its entry having so many letters: what as many slips as a name of this
    length bears, and words in another order, leave at the least. 1 - needed falls with the length: the longer, the stricter."""
    size = 2 * letters - 1
    lost = GRAMS_A_SLIP * slips(letters) + GRAMS_MOVED
    return max(size - lost, 1) / (size + lost)


def slips(letters: int) -> int:
    """How many slips of the pen a name of so many letters bears."""
    return 0 if letters <= 4 else 1 if letters <= 6 else 2


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from `a` to `b`, letters between swapped ones
    counted too (the unrestricted distance); above `most`, most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    cost = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, last_match = [far, i], 0
        above = cost[i]
        for j, y in enumerate(b, 1):
            k, m = last_row.get(y, 0), last_match
            if x == y:
                last_match = j
            row.append(min(above[j] + (x != y), row[j] + 1, above[j + 1] + 1, cost[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last_row[x] = i
        cost.append(row)
    return min(cost[-1][-1], most + 1)


def tolerated(name: str) -> int:
    """How many slips of the pen this name bears; short forms and names with digits bear none."""
    letters = name.replace(" ", "")
    return 0 if any(c.isdigit() for c in letters) else slips(len(letters))


def distance(reading: str, entry: str) -> int:
    """The fewest edits between a reading, its words in the best order, and an entry; above the tolerance, 99.

    The orders are searched word by word; one whose beginning is already further from every beginning of the entry is left
    at once, so that the number of words doesn't matter.
    """
    most, goal = tolerated(entry), entry.replace(" ", "")
    words = reading.split()
    if abs(sum(map(len, words)) - len(goal)) > most:
        return 99
    if "".join(words) == goal:
        return 0
    best = most + 1
    first = [list(range(len(goal) + 1))]
    todo = [(first, {}, 0, tuple(words))]
    while todo and best:
        rows, last, done, rest = todo.pop()
        if not rest:
            best = min(best, rows[-1][-1])
            continue
        for word in dict.fromkeys(rest):
            grown, seen = _grow(rows, last, done, word, goal, best - 1)
            if grown is not None:
                left = list(rest)
                left.remove(word)
                todo.append((grown, seen, done + len(word), tuple(left)))
    return best if best <= most else 99


def _grow(rows: list[list[int]], last: dict[str, int], done: int, word: str, goal: str, most: int):
    """The table of `edits`, a row for each letter so far, grown by a word's letters; None where it can't come to `most` any more."""
    rows, last = list(rows), dict(last)
    for i, x in enumerate(word, done + 1):
        above, row, match = rows[-1], [i], 0
        for j, y in enumerate(goal, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            cost = min(above[j - 1] + (x != y), row[j - 1] + 1, above[j] + 1)
            if k and m:
                cost = min(cost, rows[k - 1][m - 1] + (i - k - 1) + 1 + (j - m - 1))
            row.append(cost)
        if min(row) > most:
            return None, last
        last[x] = i
        rows.append(row)
    return rows, last


def _udf(kind):
    return lambda f: F.pandas_udf(f, kind)


@_udf(ArrayType(StringType()))
def _readings(values: pd.Series) -> pd.Series:
    return values.map(readings, na_action="ignore")


@_udf(ArrayType(StringType()))
def _grams(names: pd.Series) -> pd.Series:
    return names.map(grams, na_action="ignore")


@_udf(StringType())
def _name(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: _words(plain(t)), na_action="ignore")


VERIFIED = StructType().add("jaccard", DoubleType()).add("edits", IntegerType())


def verified(reading: str, entry: str) -> tuple[float, int]:
    """(Jaccard similarity of the grams, edits) of a pair; the edits are 99 where the similarity isn't what it needs."""
    a, b = set(grams(reading)), set(grams(entry))
    jaccard = len(a & b) / max(1, len(a | b))
    return jaccard, distance(reading, entry) if jaccard >= needed(len(entry.replace(" ", ""))) else 99


@_udf(VERIFIED)
def _verified(readings: pd.Series, entries: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([verified(a, b) for a, b in zip(readings, entries)], columns=["jaccard", "edits"]).astype({"jaccard": "float64", "edits": "int32"})


#: Otherwise its filter is pushed below the distinct step and every pair is verified once for each gram it shares.
_verified = _verified.asNondeterministic()

FURTHEST = slips(99)  #: letters by which the lengths of a pair can differ


def _letters(name: str) -> Column:
    return F.length(F.replace(F.col(name), F.lit(" "), F.lit("")))


def similar_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a name of `left` and an entry of `right` (`left_name`, `right_name`) that may be similar enough.

    left, right: one column `name`, distinct, not null. Length filter: only names whose letters are as many as some entry's, but
    for FURTHEST, have grams at all; that bounds them by the reference list, whatever the values. Prefix filter: the grams of
    every name are put in one order, the globally rarest first; a pair with the similarity that the entry's length calls for
    (`needed`) shares one of the first size - overlap + 1 grams of either side, overlap being the fewest grams that it
    has in common. The join runs on those alone, each with its size and place, and the positional filter goes over it. No pair that
    is similar enough is lost; the similarity itself is left to the caller (`verified`).
    """
    sizes = right.select(_letters("name").alias("n")).distinct()
    near = sizes.select(F.explode(F.sequence(F.col("n") - FURTHEST, F.col("n") + FURTHEST)).alias("letters")).distinct()
    fit = left.withColumn("letters", _letters("name")).join(near, "letters")
    both = fit.select(F.lit(0).alias("side"), "name", "letters").unionByName(right.select(F.lit(1).alias("side"), "name", _letters("name").alias("letters")))
    single = cut(both.select("side", "name", "letters", F.explode(_grams("name")).alias("gram")))
    rarity = cut(single.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    ordered = (
        spread(join_counted(single, rarity.withColumn("rank", F.col("n")), "gram", "n"), "side", "name")
        .groupBy("side", "name", "letters")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("g"))
    )
    size = 2 * F.col("letters") - 1
    lost = lambda n: GRAMS_A_SLIP * F.when(n <= 4, 0).when(n <= 6, 1).otherwise(2) + GRAMS_MOVED
    need = lambda n: F.greatest(2 * n - 1 - lost(n), F.lit(1)) / (2 * n - 1 + lost(n))
    overlap = lambda t, whole: F.ceil(t / (1 + t) * whole - 1e-9)
    n = F.col("letters")
    # an entry knows its similarity; a reading takes the least overlap of the entries that it can meet
    entry_least = F.greatest(overlap(need(n), size + size - 2 * FURTHEST), F.lit(1))
    met = [(n + d, F.greatest(overlap(need(n + d), size + 2 * (n + d) - 1), F.lit(1))) for d in range(-FURTHEST, FURTHEST + 1)]
    reading_least = F.least(*[F.when(m >= 1, o) for m, o in met])
    least = F.when(F.col("side") == 1, entry_least).otherwise(reading_least)
    prefix = ordered.select("side", "name", "letters", F.posexplode(F.slice("g", F.lit(1), F.greatest(size - least + 1, F.lit(1)).cast("int"))["gram"]).alias("at", "gram"))
    a, b = (prefix.where(F.col("side") == s).select("gram", *[F.col(c).alias(f"{p}_{c}") for c in ("name", "letters", "at")]) for s, p in ((0, "left"), (1, "right")))
    x, y = 2 * F.col("left_letters") - 1, 2 * F.col("right_letters") - 1
    close = F.abs(F.col("left_letters") - F.col("right_letters")) <= FURTHEST
    possible = F.least(x - F.col("left_at"), y - F.col("right_at")) >= overlap(need(F.col("right_letters")), x + y)
    return spread(a.join(b, "gram").where(close & possible).select("left_name", "right_name"), "left_name").distinct()


def canonical_values(values: DataFrame, value: str, entries: DataFrame, entry: str) -> DataFrame:
    """The entry that each distinct value stands for.

    values: any table with the text column `value`; entries: the reference list, `entry` its text column (nulls and
    repeats are left out; entries whose names are the same but for case and signs: the first in binary order).
    Columns: `value`, `n` (rows with it), `entry`, `jaccard`, `edits`; entry is null where nothing matches. Null values are left
    out; blank ones match nothing. Values are compared in several readings (`readings`); the best pair is the one
    with the highest Jaccard similarity of grams, then the fewest edits, then the first entry in binary order. A pair counts if its
    similarity is what a name of its length needs (`needed`) and its edits, words in any order, are within what one
    bears (`tolerated`). Everything runs on distinct values and distinct readings.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    typed = cut(counted.withColumn("readings", _readings("value")))
    names = typed.select(F.explode("readings").alias("name")).distinct()
    listed = entries.where(F.col(entry).isNotNull()).select(F.col(entry).alias("entry")).distinct().withColumn("name", _name("entry")).where("name != ''")
    listed = listed.groupBy("name").agg(F.min("entry").alias("entry"))
    pairs = similar_names(names, listed.select("name")).withColumn("v", _verified("left_name", "right_name")).where("v.edits < 99").select("left_name", "right_name", "v.*")
    scored = pairs.join(listed, F.col("right_name") == F.col("name")).groupBy(F.col("left_name").alias("reading"))
    best = scored.agg(F.min(F.struct((-F.col("jaccard")).alias("unlike"), "edits", "entry")).alias("best"))
    by_value = typed.select("value", F.explode("readings").alias("reading")).join(best, "reading").groupBy("value").agg(F.min("best").alias("best"))
    return typed.select("value", "n").join(by_value, "value", "left").select("value", "n", F.col("best.entry").alias("entry"), (-F.col("best.unlike")).alias("jaccard"), F.col("best.edits").alias("edits"))
