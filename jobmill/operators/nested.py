"""Deeply nested records into related flat tables.

`infer_shapes` finds the shapes that a field has in raw JSON texts, `merged_type` merges them with the type of the table's own column,
`conform` brings any of the shapes into the merged type, and `flatten` explodes every array level of a nested type into a child table that carries its parent's
surrogate key and its own ordinal.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType


def infer_schema(df: DataFrame, raw: str) -> str:
    """The merged schema of all JSON texts of a column, as SQL text; conflicting shapes come out as VARIANT.

    One distributed aggregate over the whole column; texts that aren't JSON count as void. An empty column gives VOID.
    """
    return df.agg(F.schema_of_variant_agg(F.expr(f"try_parse_json(`{raw}`)")).alias("s")).first()["s"] or "VOID"


def infer_shapes(df: DataFrame, raw: str, name: str) -> dict[str, set[str]]:
    """path -> kinds (array, object, scalar) that occur below the field `name` of all raw JSON texts.

    The field's own path is "", a member's is its parent's with ".name" (in lower case), an array's elements' with "[]"; JSON
    held as text is looked into. One distributed aggregate over the whole column; only distinct (path, kind) come to the driver, as
    many as the schema has members.
    """

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        def walk(value, path: str, out: set[str]) -> None:
            if isinstance(value, str) and isinstance(inner := _loads(value), (dict, list)):
                value = inner
            if isinstance(value, dict):
                out.add(f"object {path}")
                for k, v in value.items():
                    walk(v, f"{path}.{k.lower()}", out)
            elif isinstance(value, list):
                out.add(f"array {path}")
                for v in value:
                    walk(v, path + "[]", out)
            elif value is not None:
                out.add(f"scalar {path}")

        def one(text: str) -> list[str]:
            out: set[str] = set()
            record = _loads(text)
            if isinstance(record, dict):
                walk(_lookup(record, name), "", out)
            return sorted(out)

        return texts.map(one)

    shapes: dict[str, set[str]] = {}
    for r in df.where(F.col(raw).isNotNull()).select(F.explode(found(raw)).alias("s")).distinct().collect():
        kind, _, path = r["s"].partition(" ")
        shapes.setdefault(path, set()).add(kind)
    return shapes


def merged_type(native: DataType, shapes: dict[str, set[str]], name: str, path: str = "") -> DataType:
    """The type of a table's own column, with room for every shape that its field has in raw texts.

    A text that is also an array gets a field `<name>_items` beside it; a struct that is also a scalar gives that to its field
    named most like the struct itself. Members that the table's own type lacks are left out.
    """
    if isinstance(native, ArrayType):
        # a lone element stands for an array of one
        inner = {p: set(k) for p, k in shapes.items()}
        for p, kinds in shapes.items():
            if p.startswith(path + "."):
                inner.setdefault(path + "[]" + p.removeprefix(path), set()).update(kinds)
        return ArrayType(merged_type(native.elementType, inner, name, path + "[]"))
    if not isinstance(native, StructType):
        return native
    alike = next((f.name for f in native if f.name in name or name in f.name), None)
    fields = []
    for f in native:
        below = f"{path}.{f.name}"
        metadata = {"scalar": True} if f.name == alike and "scalar" in shapes.get(path, ()) and isinstance(f.dataType, StringType) else {}
        fields.append(StructField(f.name, merged_type(f.dataType, shapes, f.name, below), True, metadata))
        if isinstance(f.dataType, StringType) and "array" in shapes.get(below, ()):
            fields.append(StructField(f"{f.name}_items", ArrayType(StringType()), True, {"array_of": f.name}))
    return StructType(fields)


def _loads(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return text


def _lookup(obj: dict, name: str):
    """The value under `name` in any letter case, at the root or inside objects that wrap it; the shallowest wins."""
    level = [obj]
    while level:
        for o in level:
            for k, v in o.items():
                if k.lower() == name.lower():
                    return v
        level = [v for o in level for v in o.values() if isinstance(v, dict)]
    return None


def conform_value(value, kind: DataType, wrapped: bool = False):
    """`value` in the shape of `kind`.

    JSON held as text is parsed; a lone value where an array belongs becomes an array of one; an array where a
    struct belongs gives its first object; a scalar where a struct belongs goes to the field whose metadata says
    `scalar`; an object where a string belongs gives its only non-null string. Null array elements stay, so that
    ordinals hold. A field with metadata `array_of` = other takes the other field's value where that is an array.
    """
    if isinstance(kind, (ArrayType, StructType)) and isinstance(value, str):
        parsed = _loads(value)
        value = parsed if isinstance(parsed, (dict, list)) or parsed is None else value
    if value is None:
        return None
    if isinstance(kind, ArrayType):
        return [conform_value(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(kind, StructType):
        if isinstance(value, list):
            value = next((v for v in value if v is not None), None)
            return conform_value(value, kind)
        if not isinstance(value, dict):
            return {f.name: str(value) if f.metadata.get("scalar") else None for f in kind}
        out = {}
        for f in kind:
            source = f.metadata.get("array_of")
            found = _lookup(value, source or f.name) if wrapped else next((v for k, v in value.items() if k.lower() == (source or f.name).lower()), None)
            out[f.name] = None if source and not isinstance(found, list) else conform_value(found, f.dataType)
        return out
    if isinstance(value, dict):
        return next((v for v in value.values() if isinstance(v, str)), None)
    if isinstance(value, list):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def conform(raw: Column, schema: StructType) -> Column:
    """The declared fields of a raw JSON text as a struct of `schema`; texts that aren't JSON objects give nulls."""

    @F.pandas_udf(StringType())
    def reshape(texts: pd.Series) -> pd.Series:
        def one(text):
            value = _loads(text)
            return json.dumps(conform_value(value, schema, wrapped=True)) if isinstance(value, dict) else None

        return texts.map(one, na_action="ignore")

    return F.from_json(reshape(raw), schema)


def surrogate(keys: list[str], ordinals: list[str]) -> Column:
    """A 128-bit surrogate of key columns and ordinals; nulls are told apart from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (*keys, *ordinals)]
    return F.md5(F.concat_ws("\x1f", *parts))


def flatten(df: DataFrame, keys: list[str], column: str, *, drop_element: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """Every array level below `column` as a child table.

    Returns path -> DataFrame, the path being the dotted place of the array. Each table has the key columns,
    `row_id` (surrogate of keys and ordinals), `parent_id` (the surrogate of the enclosing element, of the record
    at the top), `ordinal` (position in the array, from 0), one `<n>_no` column for each enclosing level and the
    element's scalar fields (`value` for arrays of scalars; structs inside are spread with `_`). Null and empty
    arrays give no rows; null elements give a row of nulls unless `drop_element` removes them, before ordinals are
    given. No shuffle: every level is one generator over the rows it comes from.
    """
    tables: dict[str, DataFrame] = {}

    def leaves(kind: DataType, at: Column, name: str) -> tuple[list[Column], list[tuple[str, Column, ArrayType]]]:
        flat, arrays = [], []
        if isinstance(kind, StructType):
            for f in kind:
                sub = f"{name}_{f.name}" if name else f.name
                x, y = leaves(f.dataType, at[f.name], sub)
                flat, arrays = flat + x, arrays + y
        elif isinstance(kind, ArrayType):
            arrays.append((name, at, kind))
        else:
            flat.append(at.alias(name or "value"))
        return flat, arrays

    def walk(frame: DataFrame, path: str, at: Column, kind: ArrayType, ordinals: list[str]) -> None:
        array = F.filter(at, drop_element) if drop_element else at
        own = f"{len(ordinals)}_no"
        level = frame.select(*keys, *ordinals, F.posexplode(array).alias(own, "element"))
        flat, arrays = leaves(kind.elementType, F.col("element"), "")
        tables[path] = level.select(
            *keys,
            *ordinals,
            surrogate(keys, [*ordinals, own]).alias("row_id"),
            surrogate(keys, ordinals).alias("parent_id"),
            F.col(own).alias("ordinal"),
            *flat,
        )
        for name, sub, sub_kind in arrays:
            walk(level, f"{path}.{name or 'element'}", sub, sub_kind, [*ordinals, own])

    kind = df.schema[column].dataType
    _, arrays = leaves(kind, F.col(column), "" if isinstance(kind, StructType) else column)
    for name, at, sub_kind in arrays:
        walk(df, name, at, sub_kind, [])
    return tables


def string_field(name: str, **metadata) -> StructField:
    return StructField(name, StringType(), True, metadata)
