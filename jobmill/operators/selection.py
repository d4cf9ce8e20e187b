"""Picking items for groups, and joins of points with ranges."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Item:
    """One candidate: its id, what it covers, and whether it must be taken."""

    id: object
    covers: frozenset
    pinned: bool = False


def weight_of(tokens, weights: dict) -> float:
    return sum(weights.get(t, 0.0) for t in tokens)


def pick(items: list[Item], weights: dict, most: int, least: int = 0, must: frozenset = frozenset()) -> list[Item]:
    """Items that cover much weight: pinned ones first, then by what each adds, then exchanged.

    Greedy: the item that adds most, ties by the smaller id, while anything is added and `most` isn't reached; up to `least`
    items are taken even if they add nothing. Exchange: as long as swapping a chosen item that isn't pinned for one left out adds
    weight, the best such swap is made. Promotion: a token of `must` that some item covers and none chosen does gets
    that item in place of the one whose loss costs least, unless that one alone shows another of `must`.
    """
    chosen = sorted((i for i in items if i.pinned), key=lambda i: i.id)[:most]
    rest = [i for i in items if i not in chosen]

    def shown(of: list[Item]) -> frozenset:
        return frozenset().union(*(i.covers for i in of)) if of else frozenset()

    while len(chosen) < most and rest:
        have = shown(chosen)
        best = min(rest, key=lambda i: (-weight_of(i.covers - have, weights), i.id))
        if weight_of(best.covers - have, weights) <= 0 and len(chosen) >= least:
            break
        chosen.append(best)
        rest.remove(best)
    while True:
        now, swaps = weight_of(shown(chosen), weights), []
        for out in chosen:
            if not out.pinned:
                kept = shown([c for c in chosen if c is not out])
                swaps += [(-(weight_of(kept | i.covers, weights) - now), i.id, out.id, i, out) for i in rest]
        if not swaps or (best := min(swaps, key=lambda s: s[:3]))[0] >= -1e-12:
            break
        chosen[chosen.index(best[4])] = best[3]
        rest[rest.index(best[3])] = best[4]
    for token in sorted(must - shown(chosen)):
        proofs = [i for i in rest if token in i.covers]
        victims = [c for c in chosen if not c.pinned and not (must & c.covers - shown([d for d in chosen if d is not c]))]
        if token in shown(chosen) or not proofs or (len(chosen) >= most and not victims):
            continue
        proof = min(proofs, key=lambda i: (-weight_of(i.covers, weights), i.id))
        rest.remove(proof)
        if len(chosen) < most:
            chosen.append(proof)
        else:
            victim = min(victims, key=lambda c: (weight_of(c.covers - shown([d for d in chosen if d is not c]), weights), c.id))
            chosen[chosen.index(victim)] = proof
            rest.append(victim)
    return chosen


def pick_items(items: DataFrame, group: str, item: str, covers: str, weights: str, most: int, least: int = 0, pinned: str | None = None, must: str | None = None) -> DataFrame:
    """(group, item, place, adds) of the items picked for each group (`pick`).

    items: one row for each item; `covers` an array of tokens, `weights` a map from token to weight that is the same in all of a
    group's rows, `pinned` a boolean and `must` an array of tokens (both optional). A group's items must fit into a task, as no search
    over them is possible otherwise. Null groups and items are left out; repeated items count once, with all that they cover.
    """
    fields = {f.name: f.dataType.simpleString() for f in items.select(group, item).schema}
    cols = [F.col(covers).alias("covers"), F.col(weights).alias("weights"), (F.coalesce(F.col(pinned), F.lit(False)) if pinned else F.lit(False)).alias("pinned"), (F.col(must) if must else F.array().cast("array<string>")).alias("must")]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pool: dict = {}
        for i, c, p in zip(pdf["i"], pdf["covers"], pdf["pinned"]):
            old = pool.get(i)
            pool[i] = Item(i, frozenset(c if c is not None else ()) | (old.covers if old else frozenset()), bool(p) or bool(old and old.pinned))
        weights, must = dict(pdf["weights"].iloc[0] or {}), pdf["must"].iloc[0]
        rows, seen = [], frozenset()
        for n, x in enumerate(pick(sorted(pool.values(), key=lambda x: x.id), weights, most, least, frozenset(must if must is not None else ()))):
            rows.append((pdf["g"].iloc[0], x.id, n, float(weight_of(x.covers - seen, weights))))
            seen |= x.covers
        return pd.DataFrame(rows, columns=[group, item, "place", "adds"])

    rows = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), *cols)
    return rows.groupBy("g").applyInPandas(search, f"`{group}` {fields[group]}, `{item}` {fields[item]}, place int, adds double")


def range_join(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the ranges of the same key that they lie in, start <= at < end; all columns of both, the key once.

    Ranges are cut into pieces of `width`, so that a point meets only those of its own piece: an equi join, however many ranges a key
    has. at, start, end: bigint. Null keys, points and bounds match nothing.
    """
    pieces = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    cut = ranges.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(pieces))
    return points.withColumn("__bin", F.floor(F.col(at) / width)).join(cut, [*key, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")
