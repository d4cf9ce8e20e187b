"""Relational building blocks: upserts, diffs, keyed windows, ranks, samples and bounded fuzzy joins."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmill.session import cut, spread

CELL = 8_000  #: about the most titles of a key, on each side, that one step of similar_titles compares


def upsert(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Target with the source's rows: new keys inserted, the listed columns of known keys refreshed where the source's
    value isn't null, all others kept. One row for each key on both sides."""
    s = source.select(*[F.col(c).alias(f"__s_{c}") for c in (*key, *columns)])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__s_{k}") for k in key])
    merged = target.join(s, on, "full_outer")
    keys = [F.coalesce(F.col(k), F.col(f"__s_{k}")).alias(k) for k in key]
    fresh = [F.coalesce(F.col(f"__s_{c}"), F.col(c)).alias(c) for c in columns]
    return merged.select(*keys, *fresh, *[c for c in target.columns if c not in (*key, *columns)])


def insert_absent(target: DataFrame, source: DataFrame, key: list[str], first: Column) -> DataFrame:
    """The source's rows whose key the target lacks, one for each key: the first by `first`."""
    w = Window.partitionBy(*key).orderBy(first)
    once = source.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return once.join(target.select(*key), key, "left_anti")


def diff(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """key and `action` (insert, update, deactivate, unchanged) of each key on either side; nulls compare as equal."""
    o = old.select(*key, F.struct(*compared).alias("__o"))
    n = new.select(*key, F.struct(*compared).alias("__n"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"__o.{c}").eqNullSafe(F.col(f"__n.{c}"))
    action = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "deactivate").when(same, "unchanged").otherwise("update")
    return o.join(n, key, "full_outer").select(*key, action.alias("action"))


def pick(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def pick_n(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first `n` rows of each key in `order`; whatever the size of a key, its rows are ranked by ranges."""
    return running_total(df, key, order, F.lit(1), "__n").where(F.col("__n") <= n).drop("__n")


def backlog(df: DataFrame, key: list[str], *done: DataFrame) -> DataFrame:
    """The rows that no table of `done` has the key of."""
    return reduce(lambda left, right: left.join(right.select(*key), key, "left_anti"), done, df)


def carry_forward(df: DataFrame, value: str, partition: list[str], order: str, name: str) -> DataFrame:
    """`name`: the last non-null `value` up to each row."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def round_robin(df: DataFrame, stratum: str, order: Column, n: int) -> DataFrame:
    """`n` rows taken in turn from the strata, each in `order`; adds `turn` (the place within the stratum)."""
    first = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("turn") <= n)
    return first.orderBy("turn", F.col(stratum).asc_nulls_first()).limit(n)


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over a group's rows up to each row in `order`; the order must be total.

    A group may hold any share of the rows: they are range-partitioned by group and order, summed within the
    partitions, and lifted by the totals of the partitions before (one row for each group and partition).
    The partitioned rows are written once to the shared checkpoint folder, so that both uses see the same ranges.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = cut(df.withColumn("__v", value).repartitionByRange(parts, *group, *order).withColumn("__p", F.spark_partition_id()))
    inner = Window.partitionBy(*group, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    lifts = placed.groupBy(*group, "__p").agg(F.sum("__v").alias("__t")).withColumn("__lift", F.coalesce(F.sum("__t").over(outer), F.lit(0)))
    keys = [F.col(f"__k_{c}").eqNullSafe(F.col(c)) for c in (*group, "__p")]
    renamed = lifts.select(*[F.col(c).alias(f"__k_{c}") for c in (*group, "__p")], "__lift")
    local = placed.withColumn("__here", F.sum("__v").over(inner))
    return local.join(renamed, reduce(lambda x, y: x & y, keys)).withColumn(name, F.col("__here") + F.col("__lift")).select(*df.columns, name)


def nearest_rank(df: DataFrame, value: str, percents: list[int], group: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles (the value at place ceil(p * n / 100), at least the first); nulls are left out.

    Ranks come from running totals of the counts of distinct values, so that no group's values meet in one task.
    """
    group = group or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    whole = counts.groupBy(*[F.col(c).alias(f"__w_{c}") for c in group]).agg(F.sum("__n").alias("__all"))
    upto = running_total(counts, group, [value], F.col("__n"), "__hi")
    same = [F.col(f"__w_{c}").eqNullSafe(F.col(c)) for c in group]
    ranked = upto.join(whole, reduce(lambda x, y: x & y, same)) if group else upto.withColumn("__all", whole.scalar())
    place = F.greatest(F.ceil(F.col("__p") * F.col("__all") / 100.0), F.lit(1))
    hit = ranked.withColumn("__p", F.explode(F.array(*[F.lit(p) for p in percents]))).where((F.col("__hi") - F.col("__n") < place) & (place <= F.col("__hi")))
    return hit.select(*group, F.col("__p").alias("percent"), F.col(value).alias("value"))


def children(text: Column) -> Column:
    """The members of a JSON object or array as array<struct<key, kind, text>>: STRING with its value, NESTED with its JSON, OTHER; the
    elements of an array have no key."""
    entries = F.from_json(text, "map<string,variant>")
    elements = F.from_json(text, "array<variant>")

    def one(key: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        return F.struct(key.alias("key"), F.when(kind == "STRING", "STRING").when(nested, "NESTED").otherwise("OTHER").alias("kind"), F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(nested, F.to_json(v)).alias("text"))

    no = F.lit(None).cast("string")
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.transform(elements, lambda v: one(no, v))).otherwise(F.transform(F.map_entries(entries), lambda e: one(e["key"], e["value"])))


def jaccard_pairs(df: DataFrame, group: list[str], key: str, tokens: str, similarity: float) -> DataFrame:
    """Pairs of a group's rows whose token sets have at least this Jaccard similarity: group, `<key>_a` < `<key>_b`, `jaccard`, and every
    other column of both sides with _a and _b.

    df: one row for each group and key, `tokens` an array without repeats. Prefix filter (rarest tokens first, counted over all rows), length
    filter and positional filter decide who is compared; the similarity is then exact. Empty sets and nulls match nothing.
    """
    rest = [c for c in df.columns if c not in (*group, key, tokens)]
    single = df.where(F.size(tokens) > 0).select(*group, key, F.size(tokens).alias("__m"), F.explode(tokens).alias("__t"))
    rarity = single.groupBy("__t").agg(F.count(F.lit(1)).alias("__n"))
    ordered = single.join(rarity, "__t").groupBy(*group, key, "__m").agg(F.sort_array(F.collect_list(F.struct("__n", "__t")))["__t"].alias("__o"))
    prefix = ordered.select(*group, key, "__m", F.posexplode(F.slice("__o", F.lit(1), (F.col("__m") - F.ceil(F.col("__m") * similarity - 1e-9) + 1).cast("int"))).alias("__at", "__t"))
    a, b = (prefix.select(*group, "__t", *[F.col(c).alias(f"{c}_{s}") for c in (key, "__m", "__at")]) for s in "ab")
    x, y = F.col("__m_a"), F.col("__m_b")
    possible = (x >= similarity * y - 1e-9) & (y >= similarity * x - 1e-9) & (F.least(x - F.col("__at_a"), y - F.col("__at_b")) >= similarity / (1 + similarity) * (x + y) - 1e-9)
    near = a.join(b, [*group, "__t"]).where((F.col(f"{key}_a") < F.col(f"{key}_b")) & possible).select(*group, f"{key}_a", f"{key}_b").distinct()
    side = {s: df.select(*group, F.col(key).alias(f"{key}_{s}"), F.col(tokens).alias(f"__s_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in rest]) for s in "ab"}
    both = near.join(side["a"], [*group, f"{key}_a"]).join(side["b"], [*group, f"{key}_b"])
    shared = F.size(F.array_intersect("__s_a", "__s_b"))
    found = both.withColumn("jaccard", shared / (F.size("__s_a") + F.size("__s_b") - shared)).where(F.col("jaccard") >= similarity)
    return found.select(*group, f"{key}_a", f"{key}_b", "jaccard", *[f"{c}_{s}" for c in rest for s in "ab"])


def _signatures(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each title its length; its characters' counts in 32 classes, up to 4 in unary, as 128 bits; the parities of its pairs of
    neighbouring characters in 192 classes. Two titles differ in no more of these bits than in characters or pairs."""
    sizes = np.fromiter(map(len, titles), np.int64, len(titles))
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(titles)), sizes)
    counts = np.bincount(row * 32 + (codes % np.uint64(32)).astype(np.int64), minlength=len(titles) * 32).reshape(-1, 32)
    letters = np.packbits((np.arange(4) < counts[:, :, None]).reshape(-1, 128), axis=1).view(np.uint64)
    kind = ((codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(192)
    inside = row[1:] == row[:-1]
    parity = np.bincount(row[:-1][inside] * 192 + kind[inside].astype(np.int64), minlength=len(titles) * 192).reshape(-1, 192) & 1
    return sizes, letters, np.packbits(parity.astype(bool), axis=1).view(np.uint64)


def _near(left: list[str], right: list[str], ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in left, places in right) of every pair that may reach the ratio, a few hundred thousand looked at in one go.

    With u = (1 - ratio) * total characters unmatched the titles' characters differ by at most u; there are at most u + 1 matching blocks,
    so that their pairs of neighbours differ by at most 3 * u.
    """
    (n1, c1, p1), (n2, c2, p2) = _signatures(left), _signatures(right)
    o1, o2 = np.argsort(n1, kind="stable"), np.argsort(n2, kind="stable")
    n1, c1, p1, n2, c2, p2 = n1[o1], c1[o1], p1[o1], n2[o2], c2[o2], p2[o2]
    step = max(1, 200_000 // max(1, len(right)))
    for i in range(0, len(left), step):
        x = n1[i : i + step]
        lo = np.searchsorted(n2, x[0] * ratio / (2 - ratio) - 1e-6)
        hi = np.searchsorted(n2, x[-1] * (2 - ratio) / ratio + 1e-6, "right") if ratio > 0 else len(n2)
        if lo >= hi:
            continue
        most = np.minimum((x + n2[hi - 1]) * (1 - ratio) + 1e-6, 255).astype(np.uint8)
        differ = np.bitwise_count(c1[i : i + step, None, 0] ^ c2[None, lo:hi, 0]) + np.bitwise_count(c1[i : i + step, None, 1] ^ c2[None, lo:hi, 1])
        a, b = np.nonzero(differ <= most[:, None])
        a, b = a + i, b + lo
        kept = np.bitwise_count(p1[a] ^ p2[b]).sum(axis=1) <= 3 * np.floor((n1[a] + n2[b]) * (1 - ratio) + 1e-6)
        yield o1[a[kept]], o2[b[kept]]


def similar_titles(left: DataFrame, right: DataFrame, key: str, title: str, ratio: float = 0.9, cell: int = CELL) -> DataFrame:
    """`left` rows with the most similar `right` title (`match`, its `ratio`) of equal key, where it is similar enough.

    The measure is the share of matching blocks (2 * matched / total length; ties: the greater title in binary
    order). Distinct titles only. A title that the right side has too is its own match; the others are compared with all of
    the key's right titles, by signatures first (exact bounds), then by edit distance, then measured. Pairs are only ever streamed: what
    is written and shuffled are the titles, those of a key with more than `cell` on a side once for each cell of about
    `cell` left and `cell` right ones.
    """

    @F.pandas_udf("double")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher, last = [], difflib.SequenceMatcher(None), None
        for x, y in zip(a, b):
            if y != last:  # what is known of the second text is kept while it stays
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            out.append(matcher.ratio() if matcher.real_quick_ratio() >= ratio and matcher.quick_ratio() >= ratio else 0.0)
        return pd.Series(out, dtype="float64")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for g in range(batch.num_rows):
                ls, rs = batch.column(1)[g].values, batch.column(2)[g].values
                for a, b in _near(ls.to_pylist(), rs.to_pylist(), ratio):
                    if len(a):
                        held.append((batch.column(0).take(pa.array(np.full(len(a), g))), ls.take(pa.array(a)), rs.take(pa.array(b))))
                        n += len(a)
                    if n >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], [key, "__l", "__r"])
                        held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], [key, "__l", "__r"])

    measure = measure.asNondeterministic()  # else it is evaluated by the filter and again for the result
    sides = [df.select(key, F.col(title).alias("__t"), F.lit(n == 0).alias("__in_l"), F.lit(n == 1).alias("__in_r")).dropna() for n, df in enumerate((left, right))]
    titles = cut(sides[0].unionByName(sides[1]).groupBy(key, "__t").agg(F.max("__in_l").alias("__in_l"), F.max("__in_r").alias("__in_r")))
    same = titles.where("__in_l and __in_r").select(key, F.col("__t").alias(title), F.col("__t").alias("match"), F.lit(1.0).alias("ratio"))
    sizes = titles.groupBy(key).agg(F.count_if(~F.col("__in_r")).alias("__nl"), F.count_if("__in_r").alias("__nr"))
    large = sizes.where((F.greatest("__nl", "__nr") > cell) & (F.least("__nl", "__nr") > 0)).select(key, *[F.ceil(F.col(f"__n{s}") / cell).cast("int").alias(f"__k{s}") for s in "lr"])
    cells = titles.join(F.broadcast(large), key, "left").withColumns({f"__k{s}": F.coalesce(f"__k{s}", F.lit(1)) for s in "lr"})
    own = lambda s: F.array(F.pmod(F.xxhash64("__t"), F.col(f"__k{s}")).cast("int"))
    every = lambda s: F.sequence(F.lit(0), F.col(f"__k{s}") - 1)
    cells = cells.withColumn("__a", F.explode(F.when(F.col("__in_r"), every("l")).otherwise(own("l")))).withColumn("__b", F.explode(F.when(F.col("__in_r"), own("r")).otherwise(every("r"))))
    lists = spread(cells.select(key, "__a", "__b", "__in_r", "__t"), key, "__a", "__b").groupBy(key, "__a", "__b").agg(F.collect_list(F.when(~F.col("__in_r"), F.col("__t"))).alias("__ls"), F.collect_list(F.when(F.col("__in_r"), F.col("__t"))).alias("__rs"))
    kind = left.schema[key].dataType.simpleString()
    near = lists.where("size(__ls) > 0 and size(__rs) > 0").select(key, "__ls", "__rs").mapInArrow(pairs, f"`{key}` {kind}, __l string, __r string")
    # what doesn't match must be deleted or inserted, so that the edit distance is no more than its length
    room = F.floor((F.length("__l") + F.length("__r")) * (1 - ratio) + 1e-9).cast("int")
    near = near.where(F.call_function("levenshtein", F.col("__l"), F.col("__r"), room) >= 0)
    scored = near.withColumn("ratio", measure("__l", "__r")).where(F.col("ratio") >= ratio)
    best = scored.groupBy(key, "__l").agg(F.max(F.struct("ratio", F.col("__r").alias("match"))).alias("b"))
    return same.unionByName(best.select(key, F.col("__l").alias(title), F.col("b.match").alias("match"), F.col("b.ratio").alias("ratio")))


def set_cover(items: DataFrame, group: str, item: str, covers: str, weights: dict[str, float] | None = None, most: int = 5, width: int = 20) -> DataFrame:
    """A beam search for the items of each group that cover the most weight: (group, item, place, adds).

    items: one row for each item, `covers` an array of tokens; tokens weigh 1 unless `weights` says otherwise. An item
    is only taken if it adds a token; of equal covers the fewer items, then the first ids win. The candidates of a
    group must fit into a task, as no search over them is possible otherwise.
    """
    schema = f"{items.select(F.col(group)).schema[0].simpleString().replace(':', ' ', 1)}, {items.select(F.col(item)).schema[0].simpleString().replace(':', ' ', 1)}, place int, adds double"
    weights = weights or {}

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = sorted(((i, frozenset(c if c is not None else ())) for i, c in zip(pdf[item], pdf[covers])), key=lambda x: x[0])
        weigh = lambda s: sum(weights.get(t, 1.0) for t in s)
        beams: list[tuple[tuple, frozenset]] = [((), frozenset())]
        best = beams[0]
        for _ in range(most):
            grown = {}
            for chosen, covered in beams:
                for i, c in pool:
                    if i not in chosen and not c <= covered:
                        grown.setdefault(covered | c, (*chosen, i))
            if not grown:
                break
            beams = sorted(((ch, cov) for cov, ch in grown.items()), key=lambda b: (-weigh(b[1]), b[0]))[:width]
            if weigh(beams[0][1]) > weigh(best[1]):
                best = beams[0]
        rows, seen, by = [], frozenset(), dict(pool)
        for n, i in enumerate(best[0]):
            rows.append((pdf[group].iloc[0], i, n, float(weigh(by[i] - seen))))
            seen |= by[i]
        return pd.DataFrame(rows, columns=[group, item, "place", "adds"])

    return items.select(group, item, covers).groupBy(group).applyInPandas(search, schema)
