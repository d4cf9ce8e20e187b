"""Cities of typed places, learned from the corpus: the boards' own places, likeness, and what openings share.

There is no list of cities. What boards write ("city, region, country") gives the names of cities, regions and countries.
Any other form is resolved by what it contains; by the city that the blocks (records that agree on company, role and team) with
this form have in common, or that stands beside it ("Bombay", "Andheri, Mumbai"); or by its likeness to a name so known. A form that
none of this settles is a city of its own, or none where it has one or two letters or is a region.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from jobmill.llm.canonical import edits
from jobmill.operators.skew import join_counted
from jobmill.session import cut, spread

EVIDENCE = 4  #: blocks (or places) that must agree on the city of a form that looks like none
SHARE = 0.5  #: and their least share of the form's blocks (places)

# Short names of countries.
COUNTRY = {"usa": "united states", "us": "united states", "uk": "united kingdom", "uae": "united arab emirates"}

# Words that name no place.
NO_PLACE = frozenset("remote anywhere worldwide hybrid onsite on-site office".split())


def parts(location: str | None) -> list[str]:
    """The parts of a typed place, folded, without brackets and words that name no place."""
    text = unicodedata.normalize("NFKD", re.sub(r"\([^)]*\)?", " ", location or "").lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    found = (" ".join(p.split()) for p in re.split(r"[,;/|]|\s[-–—]\s", text))
    return [COUNTRY.get(p, p) for p in found if p and p not in NO_PLACE]


@F.pandas_udf(ArrayType(StringType()))
def parts_column(places: pd.Series) -> pd.Series:
    memo: dict = {}
    return pd.Series([memo[p] if p in memo else memo.setdefault(p, parts(p)) for p in places], dtype=object)


def tolerated(city: str) -> int:
    """How many slips of the pen a city's name bears."""
    return 0 if len(city) <= 3 else 1 if len(city) <= 6 else 2


@F.pandas_udf(IntegerType())
def _slips(forms: pd.Series, cities: pd.Series) -> pd.Series:
    def one(a: str, b: str) -> int:
        d = edits(a, b, tolerated(b))
        return d if d <= tolerated(b) else 99

    return pd.Series([one(a, b) for a, b in zip(forms, cities)], dtype="int32")


#: Otherwise its filter is pushed below the distinct step.
_slips = _slips.asNondeterministic()


def variants(name: str) -> list[str]:
    """The name and what is left of it without any one letter, or any two where it has five or more: names that a slip or two
    tell apart have one in common."""
    out, last = {name}, {name}
    for _ in range(2 if len(name) >= 5 else 1):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def _variants(names: pd.Series) -> pd.Series:
    return names.map(variants)


def gazetteer(own: DataFrame) -> DataFrame:
    """(part, kind, n, country) of what boards' own places (column `parts`) name: the first part of several is a city, the last a
    country, those between are regions; a single part is a city unless it is known as a country. A name's kind is the first of
    city, country, region that it is used as; a city's country is the most frequent one."""
    size = F.size("parts")
    last = F.when(size > 1, F.get("parts", size - 1))
    roles = F.transform("parts", lambda p, i: F.struct(p.alias("part"), F.when(i == 0, "city").when(i == size - 1, "country").otherwise("region").alias("kind"), F.when(i == 0, last).alias("country")))
    seen = own.where(size > 0).select(F.explode(roles).alias("r")).select("r.*").groupBy("part", "kind", "country").agg(F.count(F.lit(1)).alias("n"))
    by_kind = seen.groupBy("part", "kind").agg(F.sum("n").alias("n"), F.max_by("country", F.when(F.col("country").isNotNull(), F.col("n"))).alias("country"))
    kinds = by_kind.groupBy("part").agg(F.collect_set("kind").alias("kinds"), F.max(F.when(F.col("kind") == "city", F.col("country"))).alias("country"), F.sum("n").alias("n"))
    is_city = F.array_contains("kinds", "city") & (F.col("country").isNotNull() | ~F.array_contains("kinds", "country"))
    return kinds.select("part", F.when(is_city, "city").when(F.array_contains("kinds", "country"), "country").otherwise("region").alias("kind"), "n", F.when(is_city, F.col("country")).alias("country"))


def with_cities(records: DataFrame) -> DataFrame:
    """`records` with `city` and `country` instead of `parts`: nulls where a place is missing or wider than a city.

    records: `block`, `parts` (array), `own` (whether a board wrote it) and others. The statistics run over all rows, on distinct
    parts and on distinct (block, form); the only joins by block are of forms that aren't known with the cities of their block.
    """
    names = cut(gazetteer(records.where("own")))
    places = records.groupBy("parts").agg(F.count(F.lit(1)).alias("rows"))
    split = places.select("parts", F.posexplode_outer("parts").alias("at", "part")).join(names, "part", "left")
    kind = F.coalesce("kind", F.lit("other"))
    split = split.withColumn("name", F.struct("at", "part", "country"))
    read = split.groupBy("parts").agg(
        F.min(F.when(kind == "city", F.col("name"))).alias("c"), F.min(F.when(kind == "country", F.col("name"))).alias("k"),
        F.min(F.when(kind == "other", F.col("name"))).alias("o"), F.min(F.when(kind == "region", F.col("name"))).alias("r"),
    )
    read = cut(read.select("parts", F.col("c.part").alias("city"), F.col("o.part").alias("beside"), F.coalesce("k.part", "c.country").alias("country"),
                           F.when(F.col("c").isNull(), F.coalesce("o.part", "r.part")).alias("odd"), (F.col("o").isNull() & F.col("r").isNotNull()).alias("region")))
    known = join_counted(records, read.drop("beside").join(places, "parts"), "parts", "rows").drop("parts")
    known = cut(known)
    fits = F.coalesce(F.col("country") == F.col("city_country"), F.lit(True))
    odd = known.where("odd is not null").groupBy("block", "odd").agg(F.max("country").alias("country"))
    cities = known.where("city is not null").groupBy("block", "city").agg(F.max("country").alias("city_country"))
    near = odd.join(cities, "block").where(fits).select("block", "odd", "city")
    forms = odd.select("odd").distinct()
    # what the form contains: the longest listed name that stands in it as whole words
    words = F.split("odd", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))
    held = forms.select("odd", F.explode(runs).alias("part")).join(names.where("kind = 'city'").select("part"), "part")
    held = held.groupBy("odd").agg(F.max(F.struct(F.length("part").alias("size"), "part")).alias("top")).select("odd", F.col("top.part").alias("held"))
    # what the form's blocks, or the places that name it beside a city, have in common
    by_block = near.groupBy("odd", "block").agg(F.collect_set("city").alias("cities"))
    shared = by_block.select("odd", F.explode(F.concat("cities", F.array(F.lit("")))).alias("city")).groupBy("odd", "city").agg(F.count(F.lit(1)).alias("n"))
    shared = cut(shared)  # the row of the empty city counts the blocks
    beside = read.where("city is not null and beside is not null").join(places, "parts").groupBy(F.col("beside").alias("odd"), "city").agg(F.sum("rows").alias("n"))
    both = shared.where("city != ''").join(shared.where("city = ''").select("odd", F.col("n").alias("all")), "odd").unionByName(beside.join(beside.groupBy("odd").agg(F.sum("n").alias("all")), "odd"))
    meant = both.where((F.col("n") >= EVIDENCE) & (F.col("n") >= SHARE * F.col("all"))).groupBy("odd").agg(F.max(F.struct("n", "city")).alias("top")).select("odd", F.col("top.city").alias("meant"))
    first = cut(forms.join(held, "odd", "left").join(meant, "odd", "left").select("odd", F.coalesce("held", "meant").alias("found")))
    # what the form looks like: the name nearest to it, of those that boards use or that the evidence has settled
    listed = names.where("kind = 'city'").select(F.col("part").alias("name"), F.col("part").alias("city")).unionByName(meant.join(names.where("kind = 'city'"), F.col("part") == F.col("odd"), "left_anti").select(F.col("odd").alias("name"), F.col("meant").alias("city")))
    left = spread(first.where("found is null").select(F.col("odd").alias("left_name")), "left_name").select("left_name", F.explode(_variants("left_name")).alias("v"))
    right = spread(listed.select(F.col("name").alias("right_name")), "right_name").select("right_name", F.explode(_variants("right_name")).alias("v"))
    pairs = left.join(right, "v").select("left_name", "right_name").distinct().withColumn("slips", _slips("left_name", "right_name")).where("slips < 99")
    nearest = pairs.join(listed, F.col("right_name") == F.col("name")).groupBy(F.col("left_name").alias("odd")).agg(F.min(F.struct("slips", "city")).alias("top"), F.min("slips").alias("least"), F.collect_set(F.struct("slips", "city")).alias("all"))
    nearest = nearest.where(F.size(F.array_distinct(F.transform(F.filter("all", lambda x: x["slips"] == F.col("least")), lambda x: x["city"]))) == 1).select("odd", F.col("top.city").alias("looks"))
    second = (first.join(nearest, "odd", "left").select("odd", F.coalesce("found", "looks").alias("found")))
    # or else the nearest city of its block, which may be short
    placed = cut(odd.join(second, "odd"))
    there = cities.unionByName(placed.where("found is not null").select("block", F.col("found").alias("city"), F.col("country").alias("city_country")))
    rest = placed.where("found is null").join(there, "block").where(fits).select("block", "odd", "city").distinct()
    alike = rest.select("odd", "city").distinct().where(F.levenshtein("odd", "city", 4) >= 0).withColumn("slips", _slips("odd", "city")).where("slips < 99")
    like = rest.join(alike, ["odd", "city"]).groupBy("block", "odd").agg(F.min(F.struct("slips", "city")).alias("top")).select("block", "odd", F.col("top.city").alias("like"))
    settled = placed.join(like, ["block", "odd"], "left").select("block", "odd", F.coalesce("found", "like").alias("found"))
    joined = known.where("odd is not null").join(settled, ["block", "odd"])
    own_name = F.when(~F.col("region") & (F.length("odd") > 2), F.col("odd"))
    joined = joined.withColumn("city", F.coalesce("found", own_name)).select(*[c for c in known.columns if c not in ("odd", "region")])
    return known.where("odd is null").drop("odd", "region").unionByName(joined)
