"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 50_000  #: rows of one key from which it is matched by broadcast


def join_counted(rows: DataFrame, dim: DataFrame, key: str, count: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """`rows` joined with `dim` on `key`, where `dim` has one row for each key with the number of rows it stands for.

    Keys counted above `hot` are broadcast: there can be at most len(rows) / hot of them. All others go through a
    shuffled join in which no key has more than `hot` rows. `how` is inner, left or left_semi; null keys never match.
    The count column isn't in the result.
    """
    is_hot = F.col(count) > hot
    large = F.broadcast(dim.where(is_hot).drop(count))
    small = dim.where(~is_hot).drop(count)
    keys = F.broadcast(dim.where(is_hot).select(key))
    one = "left_semi" if how == "left_semi" else "inner"
    return rows.join(large, key, one).unionByName(rows.join(keys, key, "left_anti").join(small, key, how), allowMissingColumns=False)
