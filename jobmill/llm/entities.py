"""Records of several sources that describe one opening, matched without a common key.

Each attribute is brought to a name: what the sources' own boards (the authoritative rows) call it, or else the typed
form itself. Typed forms that no board uses are blocked against the boards' forms, and those near none of them against each
other, by MinHash bands, and verified. Records that agree on company, role with seniority, and team form a block. The places
of a block are read by `places`. A logistic model weighs how alike company, role and place are and what else a pair
has (dates, pay, years, level); it is trained on weak labels and calibrated on labels that it hasn't seen. Records of one block
and city are one opening; a record without a city joins the opening that the model holds likeliest.
"""

from __future__ import annotations

import re
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from jobmill.llm.canonical import edits, plain
from jobmill.llm.places import parts_column, with_cities
from jobmill.operators.skew import join_counted
from jobmill.session import cut, spread

BANDS, ROWS = 40, 4  #: MinHash bands and the hashes in each
TRAIN_BLOCKS, BLOCK_SIZE = 20_000, 100  #: blocks that labelled pairs are taken from, and their greatest size
TRAIN_PAIRS = 20_000  #: the most labelled pairs that the classifier is fitted and calibrated on
MATCH = 0.5  #: probability from which a pair is a match
RIDGE = 1.0  #: how strongly the model is held to PRIOR: worth a few labels, nothing beside thousands

# Legal forms and tails of domain names in company names.
LEGAL = set("inc llp llc ltd limited private pvt gmbh ag sa corp corporation co company plc bv kg kgaa se srl spa oy ab as nv pty pte sas sarl group holding holdings".split())
DOMAIN = re.compile(r"\.(?:example|com|net|org|io|ai|co|dev|app|jobs)(?:\.[a-z]{2})?$")

# How seniority is written.
SENIORITY = {w: k for k, ws in {"senior": "senior sr snr", "junior": "junior jr jnr", "lead": "lead", "staff": "staff", "principal": "principal princ prnc prin"}.items() for w in ws.split()}

# Short forms in job titles.
TITLE_WORDS = {
    "eng": "engineer", "engr": "engineer", "dev": "developer", "mgr": "manager", "admin": "administrator", "ml": "machine learning", "qa": "quality assurance",
    "sre": "site reliability engineer", "db": "database", "fullstack": "full stack", "asst": "assistant", "exec": "executive", "assoc": "associate", "coord": "coordinator",
}
TITLE_PAIRS = {("front", "end"): "frontend", ("back", "end"): "backend", ("co", "ordinator"): "coordinator", ("m", "l"): "machine learning"}

# Notes on an advert that are no part of its title.
NOTES = set("hiring urgent immediate joiner joiners remote ok hybrid onsite full time part fulltime parttime m f d w x all genders req yrs years exp wfh apply now new opening vacancy contract permanent".split())

def company_words(name: str | None) -> list[str]:
    """The words of a company's name without brackets, article, legal forms and domain endings."""
    text = re.sub(r"\([^)]*\)?", " ", plain(name or "").strip())
    text = re.sub(r"\b(\w)\.(?=\w\.)", r"\1", DOMAIN.sub("", text))
    words = [w for w in re.findall(r"\w+", text) if w != "and"]
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    return words[1:] if len(words) > 2 and words[0] == "the" else words


def role_parts(title: str | None) -> tuple[str, str]:
    """(role, team): the role in full words, its seniority first; team "" if none is named."""
    text = re.sub(r"\b\d+\s*[-–]\s*\d+\s*(?:yrs?|years?)\b|#\w+|^\s*hiring\s*:", " ", plain(title or ""))
    chunks = [re.findall(r"[^\W_]+", c) for c in re.split(r"[,|()\[\]:]|\s[-–—]\s", text)]
    level, role, rest = "", [], []
    for words in chunks:
        if not words or all(w in NOTES for w in words):
            continue
        if len(words) == 1 and role and (found := SENIORITY.get(words[0]) or _near_level(words[0])):
            level = level or found
        elif not role:
            role = words
        else:
            rest += words
    if role and role[0] in SENIORITY and len(role) > 1:
        level, role = SENIORITY[role[0]], role[1:]
    elif role and role[-1] in SENIORITY and len(role) > 1:
        level, role = SENIORITY[role[-1]], role[:-1]
    elif len(role) > 1 and not level and (found := _near_short(role[0])):
        level, role = found, role[1:]
    out: list[str] = []
    for w in role:
        if out and (out[-1], w) in TITLE_PAIRS:
            out[-1] = TITLE_PAIRS[out[-1], w]
        else:
            out.append(TITLE_WORDS.get(w, w))
    return " ".join([level, *out] if level else out), " ".join(rest)


def _near_short(word: str) -> str | None:
    """The level whose short form a word of three or more letters misses by one slip."""
    if len(word) < 3 or word in TITLE_WORDS:
        return None
    return next((k for w, k in SENIORITY.items() if len(w) >= 3 and w not in SENIORITY.values() and edits(word, w, 1) <= 1), None)


def _near_level(word: str) -> str | None:
    if (short := _near_short(word)) is not None:
        return short
    return next((k for k in sorted(set(SENIORITY.values())) if len(word) >= 3 and edits(word, k, 2) <= (1 if len(k) < 7 else 2)), None)


def _memoised(f):
    def run(values: pd.Series) -> pd.Series:
        memo: dict = {}
        return [memo[v] if v in memo else memo.setdefault(v, f(v)) for v in values]

    return run


PARTS = StructType().add("a", StringType()).add("b", StringType())


@F.pandas_udf(PARTS)
def _role(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_memoised(role_parts)(titles), columns=["a", "b"])


@F.pandas_udf(ArrayType(StringType()))
def _company(names: pd.Series) -> pd.Series:
    return pd.Series(_memoised(company_words)(names))


_SEEDS = [(2 * int.from_bytes(blake2b(b"a%d" % n, digest_size=7).digest(), "big") + 1, int.from_bytes(blake2b(b"b%d" % n, digest_size=7).digest(), "big")) for n in range(BANDS * ROWS)]


def signature(form: str) -> list[int]:
    """One hash for each band: of the least hashes of the form's pairs of neighbouring characters."""
    text = f"^{form}$"
    kinds = np.array([int.from_bytes(blake2b(text[i : i + 2].encode(), digest_size=8).digest(), "big") for i in range(len(text) - 1)], dtype=np.uint64)
    a, b = (np.array([s[k] for s in _SEEDS], dtype=np.uint64)[:, None] for k in (0, 1))
    mixed = kinds[None, :] * a + b
    least = (mixed ^ (mixed >> np.uint64(29))).min(axis=1).reshape(BANDS, ROWS)
    return [int.from_bytes(blake2b(row.tobytes(), digest_size=8).digest(), "big", signed=True) for row in least]


@F.pandas_udf(ArrayType(LongType()))
def _signature(forms: pd.Series) -> pd.Series:
    return forms.map(signature)


@F.pandas_udf(IntegerType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> int:
        size = min(len(x), len(y))
        most = 0 if size <= 3 else 1 if size <= 6 else 2
        d = edits(x, y, most)
        return d if d <= most else 99

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


#: Otherwise its filter is pushed below the distinct step and every pair is measured once for each band it shares.
_slips = _slips.asNondeterministic()


def _banded(df: DataFrame) -> DataFrame:
    return df.withColumn("__sig", _signature("form")).select(*df.columns, F.posexplode("__sig").alias("band", "hash"))


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a form of `left` and an `other` of `right` that share kind and a MinHash band and differ by a few slips; where both
    have a `scope`, only pairs of the same."""
    on = ["kind", "band", "hash", *(["scope"] if "scope" in left.columns and "scope" in right.columns else [])]
    rest = [c for c in right.columns if c not in ("form", *on)]
    pairs = spread(_banded(spread(left, "form")), *on).join(spread(_banded(spread(right, "form")).withColumnRenamed("form", "other"), *on), on)
    close = pairs.where(F.levenshtein("form", "other", 4) >= 0)  # two swaps of neighbours are four plain edits
    return spread(close.select(*left.columns, "other", *rest), "form").distinct().withColumn("slips", _slips("form", "other")).where("slips < 99")


def link_forms(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(kind, scope, form, name, slips, n): the name that each typed form stands for.

    typed: `kind` (of attribute: forms of one kind never meet another's), `scope` and `form`, together distinct, `n` (rows with it),
    `heads` (array: the form and what it is shortened to) and `parts` (array: runs of its words, under which a listed form may stand
    within it, at the cost of one slip); listed: `kind`, `form`, `name`, `weight`, one row for each kind and form. A listed form stands
    for its own name with 0 slips; other forms are blocked with the listed ones by MinHash bands, and the verified pair with the
    fewest slips wins (then the heavier name, then the first in binary order). Forms near nothing listed are held against each other
    within their scope: a form that is the head of a longer one takes the longest, and one within a few slips of a more frequent
    one (ties: the greater in binary order) takes that. Runs on distinct forms only, the blocking on those not listed.
    """
    key, own = ["kind", "form"], ["kind", "scope", "form"]
    known = typed.join(listed.select(*key, "name"), key, "left")
    odd = cut(known.where("name is null and form != ''").select(*own, "n", "heads", "parts"))
    near = _near(odd.select(*key).distinct(), listed.where("form != ''")).select(*key, "slips", F.lit(0).alias("size"), "weight", "name")
    within = odd.select(*key, F.explode("parts").alias("part")).distinct().join(listed.withColumnRenamed("form", "part"), ["kind", "part"])
    near = near.unionByName(within.select(*key, F.lit(1).alias("slips"), F.length("part").alias("size"), "weight", "name"))
    best = near.groupBy(*key).agg(F.min(F.struct("slips", (-F.col("size")).alias("short"), (-F.col("weight")).alias("light"), "name")).alias("best"))
    linked = cut(odd.join(best, key, "left"))
    alone = linked.where("best is null").select(*own, "n", "heads")
    settled = (
        known.where("name is not null or form = ''")
        .select(*own, F.coalesce("name", "form").alias("name"), F.lit(0).alias("slips"), "n")
        .unionByName(linked.where("best is not null").select(*own, F.col("best.name").alias("name"), F.col("best.slips").alias("slips"), "n"))
    )
    whole = alone.select("kind", "scope", F.col("form").alias("name"), F.col("n").alias("weight"), F.explode("heads").alias("form"))
    whole = whole.groupBy(*own).agg(F.max(F.struct(F.length("name").alias("size"), "weight", "name")).alias("top")).select(*own, F.col("top.name").alias("name"), F.col("top.weight").alias("weight"))
    pairs = _near(alone.select(*own), whole).where("slips > 0 and form != name")
    other = pairs.groupBy(*own).agg(F.max(F.struct("weight", "name", "slips")).alias("other"))
    held = alone.join(whole, own, "left").join(other, own, "left")
    moves = F.struct(F.col("other.weight"), F.col("other.name")) > F.struct(F.col("weight"), F.col("name"))
    moves = F.coalesce(moves, F.lit(False))
    held = held.select(*own, F.when(moves, F.col("other.name")).otherwise(F.coalesce("name", "form")).alias("name"), F.when(moves, F.col("other.slips")).otherwise(0).alias("slips"), "n")
    return settled.unionByName(held)


def _listed(rows: DataFrame) -> DataFrame:
    """Of rows with `kind`, `form` and `name`, the most frequent name of each form and its `weight`."""
    counted = rows.groupBy("kind", "form", "name").agg(F.count(F.lit(1)).alias("weight"))
    return counted.groupBy("kind", "form").agg(F.max(F.struct("weight", "name")).alias("top")).select("kind", "form", F.col("top.name").alias("name"), F.col("top.weight").alias("weight"))


FEATURES = ["firm", "post", "same_city", "other_city", "near", "far", "undated", "same_pay", "other_pay", "same_years", "other_years", "same_level", "other_level"]
#: What the weights are held to, bias first: alike names and the same city speak for one opening, and so do like dates and pay.
PRIOR = [-11.5, 6.0, 6.0, 4.0, -6.0, 2.0, -0.6, 0.0, 1.5, -2.0, 1.0, -0.5, 0.5, -0.5]
EVIDENCE = ("posted", "pay", "years", "level")


def _alike(a: str, b: str, slips: Column) -> Column:
    """How alike two names are, from 0 to 1, less the share of letters that were slips of the pen on the way to them."""
    size = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.greatest(1 - (F.levenshtein(a, b) + slips) / size, F.lit(0.0))


def _evidence(days: Column, same: dict[str, Column], other: dict[str, Column]) -> dict[str, Column]:
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return {
        "near": yes(days <= 4), "far": F.coalesce(F.log1p(days), F.lit(0.0)), "undated": days.isNull().cast("double"),
        **{k: yes(c[k.partition("_")[2]]) for k in ("same_pay", "other_pay", "same_years", "other_years", "same_level", "other_level") for c in [same if k.startswith("same") else other]},
    }


def _pair_features(city: Column) -> dict[str, Column]:
    """Features of a pair with the columns a_* and b_*; city: whether the cities are the same, null where one isn't known."""
    days = F.abs(F.unix_seconds("a_posted") - F.unix_seconds("b_posted")) / 86400.0
    fields = EVIDENCE[1:]
    names = {"firm": _alike("a_firm", "b_firm", F.col("a_firm_slips") + F.col("b_firm_slips")), "post": _alike("a_post", "b_post", F.col("a_post_slips") + F.col("b_post_slips"))}
    place = {"same_city": F.coalesce(city.cast("double"), F.lit(0.0)), "other_city": F.coalesce((~city).cast("double"), F.lit(0.0))}
    return names | place | _evidence(days, {c: F.col(f"a_{c}") == F.col(f"b_{c}") for c in fields}, {c: F.col(f"a_{c}") != F.col(f"b_{c}") for c in fields})


def _probability(weights: np.ndarray, features: dict[str, Column]) -> Column:
    score = F.lit(float(weights[0]))
    for name, w in zip(FEATURES, weights[1:]):
        score = score + features[name] * float(w)
    return 1 / (1 + F.exp(-score))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30, prior: list[float] | None = None) -> np.ndarray:
    """Weights of a logistic model, bias first, by Newton's method with a ridge around `prior` (0 if none is given)."""
    x = np.hstack([np.ones((len(x), 1)), x])
    at = np.zeros(x.shape[1]) if prior is None else np.array(prior, float)
    w = at.copy()
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge / 2 * ((w - at) ** 2).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - at)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, before = np.linalg.solve(hess, grad), loss(w)
        while loss(w - step) > before and np.abs(step).max() > 1e-9:  # too far: the whole step need not lead down
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(labelled: DataFrame) -> np.ndarray:
    """Weights from weak labels: fitted on one half of a bounded sample, calibrated (Platt) on the other.

    labelled: FEATURES, `label` (0 or 1) and `order` (a hash). At most TRAIN_PAIRS rows are used, the first by hash. Both steps are held
    to what is believed beforehand (PRIOR; no change by the calibration), so that they are the same at every number of labels.
    """
    rows = labelled.orderBy("order").limit(TRAIN_PAIRS).toPandas()
    y = rows["label"].to_numpy(float)
    x, held = rows[FEATURES].to_numpy(float).reshape(len(rows), len(FEATURES)), np.arange(len(rows)) % 2 == 1
    w = fit_logistic(x[~held], y[~held], prior=PRIOR)
    shift, scale = fit_logistic((w[0] + x[held] @ w[1:])[:, None], y[held], prior=[0.0, 1.0])
    return np.concatenate([[shift + scale * w[0]], scale * w[1:]])


def _labelled(records: DataFrame) -> DataFrame:
    """Weakly labelled pairs of records with named cities.

    Records of one block are one opening if their cities are the same (1), and are not if they differ (0); each such pair is given with
    and without its cities, so that the other evidence is learned too. Neighbours by hash that share company and city but
    not the role, or role and city but not the company, are not (0). They come from a bounded number of blocks, the
    first by hash, each of at most BLOCK_SIZE records, so that the labels cost the same whatever the size of the table.
    """
    named = records.where("city is not null")
    blocks = named.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where(F.col("m").between(2, BLOCK_SIZE)).orderBy("block").limit(TRAIN_BLOCKS).select("block")
    some = cut(named.join(blocks, "block", "left_semi"))
    fields = ["job_id", "site", "city", "firm", "post", "firm_slips", "post_slips", *EVIDENCE]
    side = {s: some.select("block", *[F.col(c).alias(f"{s}_{c}") for c in fields]) for s in "ab"}
    pairs = side["a"].join(side["b"], "block").where((F.col("a_site") != F.col("b_site")) & (F.col("a_job_id") < F.col("b_job_id")))
    same = F.col("a_city") == F.col("b_city")
    parts = [pairs.withColumns(_pair_features(c)).select(*FEATURES, same.cast("int").alias("label"), F.xxhash64("a_job_id", "b_job_id", F.lit(n)).alias("order")) for n, c in enumerate((same, F.lit(None).cast("boolean")))]
    for shared, differs in (("firm", "post"), ("post", "firm")):
        w = Window.partitionBy(shared, "city").orderBy(F.xxhash64("job_id"), "job_id")
        both = some.select(*[F.col(c).alias(f"a_{c}") for c in fields], *[F.lag(c).over(w).alias(f"b_{c}") for c in fields])
        unlike = both.where(F.col(f"a_{differs}") != F.col(f"b_{differs}"))
        parts.append(unlike.withColumns(_pair_features(F.lit(True))).select(*FEATURES, F.lit(0).alias("label"), F.xxhash64("a_job_id", "b_job_id").alias("order")))
    return reduce(DataFrame.unionByName, parts)


def resolved(df: DataFrame, authoritative: Column) -> DataFrame:
    """Every record with the names of its company, role and team, its block, and its city and country where its place names them.

    df: as in `match_openings`. Columns: job_id, site, block (a digest of the names), firm, post (role and team), firm_slips,
    post_slips, city, country and EVIDENCE.
    """
    fields = ["company", "role", "site", "location", "posted_at", "salary_min_lpa", "years_required", "role_level"]
    once = df.where("job_id is not null").select("job_id", *fields, F.coalesce(authoritative, F.lit(False)).alias("own")).groupBy("job_id").agg(*[F.max(c).alias(c) for c in (*fields, "own")])
    parsed = (
        once.where("company is not null and role is not null and site is not null")
        .withColumns({"words": _company("company"), "r": _role("role"), "parts": parts_column("location")})
        .select("job_id", "site", "own", "words", F.array_join("words", "").alias("firm"), F.col("r.a").alias("post"), F.col("r.b").alias("team"), "parts",
                F.col("posted_at").alias("posted"), F.col("salary_min_lpa").alias("pay"), F.col("years_required").alias("years"), F.col("role_level").alias("level"))
        .where("firm != '' and post != ''")
    )
    parsed = cut(parsed)
    own = parsed.where("own")
    heads = F.transform(F.sequence(F.least(F.lit(2), F.size("words")), F.size("words")), lambda n: F.array_join(F.slice("words", F.lit(1), n), ""))
    firms = cut(_listed(own.select(F.lit("firm").alias("kind"), F.explode(heads).alias("form"), F.col("firm").alias("name"))))
    longest = firms.agg(F.max(F.length("form"))).first()[0] or 0
    count = F.size("words")
    last = lambda i: F.least(count, i + longest - 1)  # noqa: E731  # a word has a letter at least: no longer run can be listed
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.transform(F.sequence(F.least(i + 1, last(i)), last(i)), lambda n: F.array_join(F.slice("words", i, n - i + 1), ""))))
    named = parsed.withColumns({"firm_heads": heads, "firm_parts": F.when(count > 2, F.array_distinct(F.filter(runs, lambda r: F.length(r) <= longest))).otherwise(F.array().cast("array<string>"))}).drop("words")

    def linked(rows: DataFrame, columns: list[str], scope: Column, listed: DataFrame) -> DataFrame:
        """`rows` with the names of these columns' forms and the slips on the way to them."""
        firm = columns == ["firm"]
        typed = reduce(DataFrame.unionByName, [
            rows.groupBy(F.lit(c).alias("kind"), scope.alias("scope"), F.col(c).alias("form")).agg(F.count(F.lit(1)).alias("n"), (F.min("firm_heads") if firm else F.array(F.first(c))).alias("heads"), (F.min("firm_parts") if firm else F.array().cast("array<string>")).alias("parts"))
            for c in columns
        ])
        dims = cut(link_forms(typed, listed)).withColumn("__key", F.concat_ws("\x1f", "scope", "form"))
        for c in columns:
            dim = dims.where(F.col("kind") == c).select("__key", F.col("name").alias(f"{c}_name"), F.col("slips").alias(f"{c}_slips"), "n")
            rows = join_counted(rows.withColumn("__key", F.concat_ws("\x1f", scope, F.col(c))), dim, "__key", "n").drop("__key")
        return rows

    named = linked(named, ["firm"], F.lit(""), firms).drop("firm_heads", "firm_parts")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("form"), F.col(c).alias("name")) for c in ("post", "team")]))
    named = linked(cut(named), ["post", "team"], F.col("firm_name"), _listed(own.select(each.alias("x")).select("x.*").where("form != ''")))
    post = F.concat_ws(" / ", "post_name", F.nullif("team_name", F.lit("")))
    records = named.select("job_id", "site", "own", F.md5(F.concat_ws("\x1f", "firm_name", "post_name", "team_name")).alias("block"), F.col("firm_name").alias("firm"), post.alias("post"),
                           "firm_slips", (F.col("post_slips") + F.col("team_slips")).alias("post_slips"), "parts", *EVIDENCE)
    return cut(with_cities(cut(records)))


def _openings(records: DataFrame, weights: np.ndarray) -> DataFrame:
    """`records` with `at`, the city of their opening (null where none is likely enough), and `sure`, the probability of that.

    Named cities are certain. A record without one is compared with each opening of its block as a whole: how far it lies from the
    opening's dates, and whether its pay, years and level are among the opening's; countries must agree, and a record of another
    site be there. One row for each record and city of its block, never one for each pair of records.
    """
    named, open_ = records.where("city is not null"), records.where("city is null")
    of = {c: F.collect_set(c).alias(f"c_{c}") for c in EVIDENCE[1:]}
    openings = named.groupBy("block", "city").agg(F.min("posted").alias("c_from"), F.max("posted").alias("c_to"), F.max("country").alias("c_country"), F.min("site").alias("c_site"), F.max("site").alias("c_site2"), *of.values())
    openings = openings.withColumnRenamed("city", "at")
    met = open_.select("job_id", "site", "block", "country", "firm", "post", "firm_slips", "post_slips", *EVIDENCE).join(openings, "block")
    met = met.where(F.coalesce(F.col("country") == F.col("c_country"), F.lit(True)) & ((F.col("c_site") != F.col("site")) | (F.col("c_site2") != F.col("site"))))
    day = lambda c: F.unix_seconds(c) / 86400.0
    days = F.when(F.col("posted").isNotNull() & F.col("c_from").isNotNull(), F.greatest(day("c_from") - day("posted"), day("posted") - day("c_to"), F.lit(0.0)))
    inside = {c: F.array_contains(f"c_{c}", F.col(c)) for c in EVIDENCE[1:]}
    outside = {c: ~F.array_contains(f"c_{c}", F.col(c)) & (F.size(f"c_{c}") > 0) for c in EVIDENCE[1:]}
    features = {"firm": _alike("firm", "firm", F.col("firm_slips")), "post": _alike("post", "post", F.col("post_slips")), "same_city": F.lit(0.0), "other_city": F.lit(0.0)} | _evidence(days, inside, outside)
    likely = met.withColumn("p", _probability(weights, features)).groupBy("job_id").agg(F.max(F.struct("p", "at")).alias("top")).where(F.col("top.p") >= MATCH)
    homes = likely.select("job_id", F.col("top.at").alias("home"), F.col("top.p").alias("home_p"))
    return records.join(homes, "job_id", "left").withColumns({"at": F.coalesce("city", "home"), "sure": F.when(F.col("city").isNotNull(), 1.0).otherwise(F.col("home_p"))}).drop("home", "home_p")


def openings(df: DataFrame, authoritative: Column) -> DataFrame:
    """(job_id, opening, sure, records) of every record that has an opening: the class it belongs to and the class's size.

    `opening` is a digest of company, role, seniority, team and city, `sure` the probability of belonging to it. Arguments, and the
    records without a class, as in `match_openings`. Linear in the records; pairs are only formed by `match_openings`.
    """
    records = resolved(df, authoritative)
    placed = cut(_openings(records, train(_labelled(records))).where("at is not null").select("job_id", F.md5(F.concat_ws("\x1f", "block", "at")).alias("opening"), "sure"))
    return join_counted(placed, placed.groupBy("opening").agg(F.count(F.lit(1)).alias("records"), F.count(F.lit(1)).alias("n")), "opening", "n").select("job_id", "opening", "sure", "records")


def match_openings(df: DataFrame, authoritative: Column) -> DataFrame:
    """(job_id_a, job_id_b, confidence) of records of different sites that are one opening, job_id_a < job_id_b.

    df: all_jobs' columns job_id, company, role, site, location, posted_at, salary_min_lpa, years_required, role_level.
    authoritative: which rows name company, role, team and place in the boards' own words. Rows that share a job_id are
    one record (each field's greatest value); null ids, companies, roles and sites match nothing.
    A pair agrees on company, role, seniority and team. Named cities must be the same; a record whose place is missing or wider belongs to
    the likeliest opening of its block (`_openings`); those that belong to none match among each other, countries agreeing.
    A pair's confidence is the model's probability for it, or that of either record's belonging to the opening where that is
    less; pairs below MATCH are left out. No pair with different cities is ever formed.
    """
    records = resolved(df, authoritative)
    weights = train(_labelled(records))
    placed = cut(_openings(records, weights))
    fields = ["job_id", "site", "country", "firm", "post", "firm_slips", "post_slips", "sure", *EVIDENCE]

    def pairs(rows: DataFrame, on: list[str], city: Column, fit: Column) -> DataFrame:
        side = {s: rows.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in fields]) for s in "ab"}
        both = side["a"].join(side["b"], on).where((F.col("a_site") != F.col("b_site")) & (F.col("a_job_id") < F.col("b_job_id")) & fit)
        p = F.least(_probability(weights, _pair_features(city)), "a_sure", "b_sure")
        return both.select(F.col("a_job_id").alias("job_id_a"), F.col("b_job_id").alias("job_id_b"), p.alias("confidence"))

    together = pairs(placed.where("at is not null"), ["block", "at"], F.lit(True), F.lit(True))
    apart = pairs(placed.where("at is null"), ["block"], F.lit(None).cast("boolean"), F.coalesce(F.col("a_country") == F.col("b_country"), F.lit(True)))
    return together.unionByName(apart).where(F.col("confidence") >= MATCH)
