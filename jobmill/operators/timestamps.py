"""Times in mixed notations, precisions and zones, brought to one instant each.

A value's notation is read by a fixed table of patterns into fields. Where the digits alone leave several readings
(which number is the day, which unit an epoch number has), every valid reading is a candidate, and
expectation-maximisation over each source's mixture of readings decides; what stays open is marked.
All parsing runs as JVM expressions; only the mixtures, a few counts for each source, are fitted in Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.session import cut

# Month names in the languages that are read.
MONTHS = {
    1: "january januar janvier enero jan janv ene",
    2: "february februar février fevrier febrero feb févr fevr",
    3: "march märz maerz mars marzo mar mär mrz",
    4: "april avril abril apr avr abr",
    5: "may mai mayo",
    6: "june juni juin junio jun",
    7: "july juli juillet julio jul juil",
    8: "august août aout agosto aug ago",
    9: "september septembre septiembre sep sept",
    10: "october oktober octobre octubre oct okt",
    11: "november novembre noviembre nov",
    12: "december dezember décembre decembre diciembre dec dez déc dic",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}

_MON = r"([\p{L}]{3,12})\.?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(am|pm|a\.m\.|p\.m\.)?"
_ZONE = r"\s*((?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?(?:\[[^\]]*\])?"
_CLOCK = rf"(?:(?:,|\s+at|\s+um)?[t\s]\s*{_TIME}(?:\s*uhr)?{_ZONE})?"

#: family -> pattern over the trimmed lower-case text and the replacement that lays out
#: first|second|third|hour|minute|second|fraction|half|zone, the first three being the date's parts as named.
FAMILIES = {
    "ymd": (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_CLOCK}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "basic": (r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*()((?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?)?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "dmony": (rf"^(?:[\p{{L}}]{{2,12}}\.?,?\s+)?(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]+(?:de\s+)?{_MON}[\s-]+(?:de\s+)?(\d{{4}}){_CLOCK}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "mondy": (rf"^(?:[\p{{L}}]{{2,12}}\.?,\s+)?{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_CLOCK}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "dots": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_CLOCK}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "slashes": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_CLOCK}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "dashes": (rf"^(\d{{1,2}})-(\d{{1,2}})-(\d{{4}}){_CLOCK}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "epoch": (r"^(-?\d{9,19})(?:\.(\d+))?$", "$1|$2|||||||"),
}
#: The families whose digits leave several readings, with those readings and the share each has before any data.
READINGS = {
    "dots": {"dmy": 0.95, "mdy": 0.05},
    "slashes": {"dmy": 0.5, "mdy": 0.5},
    "dashes": {"dmy": 0.7, "mdy": 0.3},
    "epoch": {"s": 0.25, "ms": 0.25, "us": 0.25, "ns": 0.25},
}
PRIOR_ROWS = 4.0  #: how many rows the share before any data weighs
PLAUSIBLE_YEARS = (1990, 2100)  #: a reading outside is possible, but a thousand times less likely
IMPLAUSIBLE = 1e-3
ROUNDS = 25
DECIDED = 0.6  #: a reading is marked as resolved from this posterior on

# Letters that name an offset of daylight-saving time.
SUMMER_LETTERS = ["edt", "cdt", "mdt", "pdt", "adt", "ndt", "akdt", "cest", "eest", "west", "bst", "aedt", "acdt", "nzdt", "brst"]
UTC_LETTERS = ["z", "utc", "gmt", "ut"]


def _read(df: DataFrame, value: str) -> DataFrame:
    """Adds what a value's text says: `__family`, the clock's `__tod` (milliseconds, null if impossible), `__zone_text`,
    and `__c`, the valid readings as `array<struct<reading, wall_ms>>` (wall times as if in UTC; empty if none).

    The steps are columns of their own, each used by the next, so that no expression is written out twice in the plan.
    """
    text = F.lower(F.regexp_replace(F.regexp_replace(F.col(value), r"(?U)\s+", " "), r"^ | $", ""))
    family, fields = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (pattern, layout) in reversed(FAMILIES.items()):
        family = F.when(F.col("__t").rlike(pattern), F.lit(name)).otherwise(family)
        fields = F.when(F.col("__family") == name, F.regexp_replace("__t", pattern, layout)).otherwise(fields)

    def part(at: int) -> Column:
        piece = F.get("__l", F.lit(at))
        return F.when(piece != "", piece)

    def number(at: int) -> Column:
        return part(at).try_cast("int")

    names = F.create_map(*[F.lit(x) for pair in MONTH_OF.items() for x in pair])
    epoch, named = F.col("__family") == "epoch", F.col("__family").isin("dmony", "mondy")
    fixed = F.col("__family").isin("ymd", "basic", "dmony", "mondy")
    df = df.withColumn("__t", text).withColumn("__family", family).withColumn("__l", F.split(fields, r"\|"))
    df = df.withColumns(
        {
            "__a": number(0),
            "__b": F.when(named, F.try_element_at(names, part(1))).otherwise(number(1)),
            "__d": number(2),
            "__h": F.when(~epoch, F.coalesce(number(3), F.lit(0))),
            "__half": part(7),
            "__mi": F.when(~epoch, F.coalesce(number(4), F.lit(0))),
            "__s": F.when(~epoch, F.coalesce(number(5), F.lit(0))),
            "__fine": F.when(~epoch, F.rpad(F.substring(F.coalesce(part(6), F.lit("")), 1, 3), 3, "0").cast("long")),
            "__zone_text": F.regexp_replace(F.coalesce(part(8), F.lit("")), " ", ""),
            "__whole": F.when(epoch, part(0).try_cast("decimal(20,0)")),
            "__digits": F.when(epoch, F.rpad(F.coalesce(part(1), F.lit("")), 3, "0")),
        }
    )
    half = F.col("__half")
    hour = F.when(half.isNull(), F.col("__h")).when(F.col("__h").between(1, 12), F.col("__h") % 12 + F.when(half.startswith("p"), 12).otherwise(0))
    df = df.withColumn("__h", hour)
    tod = ((F.col("__h") * 60 + F.col("__mi")) * 60 + F.col("__s")).cast("long") * 1000 + F.col("__fine")
    possible = (F.col("__h") <= 23) & (F.col("__mi") <= 59) & (F.col("__s") <= 59)
    order = {"1": (F.when(fixed, F.col("__a")).otherwise(F.col("__d")), F.col("__b"), F.when(fixed, F.col("__d")).otherwise(F.col("__a")))}
    order["2"] = (F.when(~fixed, F.col("__d")), F.col("__a"), F.col("__b"))
    df = df.withColumn("__tod", F.when(possible, tod)).withColumns({f"__{k}{n}": c for n, triple in order.items() for k, c in zip("ymd", triple)})
    for n in "12":
        ok = F.col(f"__y{n}").between(1, 9999) & F.col(f"__m{n}").between(1, 12) & F.col(f"__d{n}").between(1, 31)
        df = df.withColumn(f"__first{n}", F.when(ok, F.make_date(F.when(ok, F.col(f"__y{n}")), F.when(ok, F.col(f"__m{n}")), F.lit(1))))
    for n in "12":
        day = F.date_add(F.col(f"__first{n}"), F.col(f"__d{n}") - 1)
        real = day <= F.last_day(F.col(f"__first{n}"))
        df = df.withColumn(f"__ms{n}", F.when(real, F.unix_date(day).cast("long") * 86_400_000 + F.col("__tod")))
    whole = F.col("__whole")
    units = {"s": whole * 1000 + F.substring("__digits", 1, 3).cast("int"), "ms": whole, "us": F.floor(whole / 1000), "ns": F.floor(whole / 1_000_000)}
    readings = [("only", F.when(fixed, F.col("__ms1"))), ("dmy", F.when(~fixed & ~epoch, F.col("__ms1"))), ("mdy", F.when(~fixed & ~epoch, F.col("__ms2")))]
    readings += [(u, F.when(epoch & (F.abs(x) < 253_402_300_800_000), x.try_cast("long"))) for u, x in units.items()]
    df = df.withColumns({f"__r_{name}": ms for name, ms in readings})
    found = F.filter(F.array(*[F.struct(F.lit(name).alias("reading"), F.col(f"__r_{name}").alias("wall_ms")) for name, _ in readings]), lambda x: x["wall_ms"].isNotNull())
    keep = [c for c in df.columns if not c.startswith("__")]
    return df.select(*keep, "__family", "__zone_text", found.alias("__c"))


def _instant(df: DataFrame) -> DataFrame:
    """Adds `utc_ms` from `__wall`, `__zone_text` and `__zone`: by the value's own offset if it names one, else in the
    zone, where a wall time that occurs twice is the earlier instant (with letters of standard time: the later) and
    a skipped one is read with the offset before the change."""
    z, wall = F.col("__zone_text"), F.col("__wall")
    digits = F.regexp_replace(F.regexp_extract(z, r"([+-]\d{1,2}:?\d{0,2})$", 1), ":", "")
    df = df.withColumns({"__digits": F.when(z.rlike(r"[+-]\d"), digits), "__home": F.coalesce("__zone", F.lit("UTC"))})
    bare = F.regexp_replace("__digits", "[+-]", "")
    short = F.length(bare) <= 2
    minutes = F.when(short, bare.try_cast("int") * 60).otherwise(F.substring(F.lpad(bare, 4, "0"), 1, 2).try_cast("int") * 60 + F.substring(F.lpad(bare, 4, "0"), 3, 2).try_cast("int"))
    df = df.withColumns({"__offset": minutes * F.when(F.col("__digits").startswith("-"), -60_000).otherwise(60_000), "__at": F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall), F.col("__home")))})
    later = F.col("__at") + 3_600_000
    standard = (z != "") & ~z.isin(SUMMER_LETTERS)
    twice = F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(later), F.col("__home"))) == wall
    utc = (F.col("__family") == "epoch") | z.isin(UTC_LETTERS)
    instant = F.when(utc, wall).when(F.col("__offset").isNotNull(), wall - F.col("__offset")).when(standard & twice, later).otherwise(F.col("__at"))
    return df.withColumn("utc_ms", instant).drop("__digits", "__home", "__offset", "__at")


def _plausible(ms: Column) -> Column:
    low, high = (F.unix_millis(F.expr(f"timestamp '{y}-01-01 00:00:00Z'")) for y in PLAUSIBLE_YEARS)
    return ms.between(low, high)


def fit_mixtures(counts: DataFrame) -> DataFrame:
    """Expectation-maximisation of each source's shares of readings.

    `counts`: source, family, readings (array<string>), likely (array<boolean>), n: how many values of a source
    have just these valid readings. Columns: source, family, reading, share. A source has at most a few dozen
    such rows, however many values it has, so that one group is never large.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        family = pdf["family"].iloc[0]
        prior = READINGS[family]
        share = dict(prior)
        rows = list(zip(pdf["readings"], pdf["likely"], pdf["n"]))
        for _ in range(ROUNDS):
            mass = {r: PRIOR_ROWS * p for r, p in prior.items()}
            for readings, likely, n in rows:
                weight = [share[r] * (1.0 if ok else IMPLAUSIBLE) for r, ok in zip(readings, likely)]
                total = sum(weight)
                for r, w in zip(readings, weight):
                    mass[r] += n * w / total
            whole = sum(mass.values())
            share = {r: m / whole for r, m in mass.items()}
        return pd.DataFrame({"source": pdf["source"].iloc[0], "family": family, "reading": list(share), "share": list(share.values())})

    return counts.groupBy("source", "family").applyInPandas(fit, "source string, family string, reading string, share double")


def to_instants(df: DataFrame, value: str, source: str, zones: DataFrame) -> DataFrame:
    """Adds `utc_ms` (the instant in milliseconds since 1970 UTC, finer parts cut off), `reading` (the chosen one),
    `posterior` and `resolved` to the rows of `df`.

    value: the text column. source: the column whose values share a mixture of readings and a zone. zones: `source`
    and `time_zone`, one row for each source; sources without one, and null zones, are UTC. Nulls, words and dates
    that don't exist give null `utc_ms`. A value with several readings takes the likeliest; `resolved` is false
    where its posterior is under DECIDED or where readings tie (then the first in the order of READINGS).
    Columns of `df` are kept; helper names start with `__` and mustn't clash.
    The readings are written once to the shared checkpoint folder. Only values that leave their zone open are joined
    with `zones`, and only those with several readings with the mixtures; AQE splits a hot source's partition there.
    """
    read = cut(_read(df, value))
    likely = F.transform("__c", lambda x: _plausible(x["wall_ms"]))
    counts = (
        read.where((F.size("__c") >= 1) & F.col("__family").isin(list(READINGS)))
        .select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.col("__family").alias("family"), F.transform("__c", lambda x: x["reading"]).alias("readings"), likely.alias("likely"))
        .groupBy("source", "family", "readings", "likely")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mixtures = (
        fit_mixtures(counts)
        .groupBy(F.col("source").alias("__source"), F.col("family").alias("__f"))
        .agg(F.map_from_entries(F.collect_list(F.struct("reading", "share"))).alias("__shares"))
    )
    several = F.size("__c") > 1
    weights = F.transform("__c", lambda x: F.coalesce(F.try_element_at("__shares", x["reading"]), F.lit(0.0)) * F.when(_plausible(x["wall_ms"]), 1.0).otherwise(IMPLAUSIBLE))
    ambiguous = (
        read.where(several)
        .join(mixtures, (F.coalesce(F.col(source), F.lit("")) == F.col("__source")) & (F.col("__family") == F.col("__f")), "left")
        .withColumn("__w", weights)
        .withColumn("__top", F.array_max("__w"))
        .withColumn("__pick", F.get("__c", F.array_position("__w", F.col("__top")).cast("int") - 1))
        .withColumn("posterior", F.col("__top") / F.aggregate("__w", F.lit(0.0), lambda total, x: total + x))
        .drop("__source", "__f", "__shares", "__w", "__top", "__c")
    )
    plain = read.where(~several).withColumns({"__pick": F.get("__c", F.lit(0)), "posterior": F.when(F.size("__c") == 1, F.lit(1.0))}).drop("__c")
    walls = plain.unionByName(ambiguous).withColumns({"reading": F.col("__pick.reading"), "__wall": F.col("__pick.wall_ms")}).drop("__pick")
    open_zone = F.coalesce(F.col("__wall").isNotNull() & (F.col("__family") != "epoch") & ~F.col("__zone_text").rlike(r"[+-]\d") & ~F.col("__zone_text").isin(UTC_LETTERS), F.lit(False))
    zone_of = zones.select(F.col(zones.columns[0]).alias("__source"), F.col(zones.columns[1]).alias("__zone"))
    with_zone = walls.where(open_zone).join(zone_of, F.col(source) == F.col("__source"), "left").drop("__source")
    both = walls.where(~open_zone).withColumn("__zone", F.lit(None).cast("string")).unionByName(with_zone)
    return _instant(both).withColumn("resolved", F.coalesce(F.col("posterior") >= DECIDED, F.lit(False))).drop("__family", "__zone_text", "__wall", "__zone")
