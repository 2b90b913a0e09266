"""Struct, map, union and enum helpers, and JSON functions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def struct_insert(s, **fields: Column) -> Column:
    out = _c(s)
    for name, value in fields.items():
        out = out.withField(name, value)
    return out


def struct_concat(df_or_fields: dict[str, Column]) -> Column:
    """A struct of all the given fields, in order."""
    return F.struct(*[c.alias(n) for n, c in df_or_fields.items()])


def remap_struct(s, mapping: dict[str, str]) -> Column:
    """A struct with fields renamed and chosen: new name -> old name."""
    return F.struct(*[_c(s)[old].alias(new) for new, old in mapping.items()])


def map_extract(m, key) -> Column:
    """A list with the value, or an empty one."""
    value = F.try_element_at(_c(m), key)
    return F.when(F.map_contains_key(_c(m), key), F.array(value)).otherwise(F.filter(F.array(value), lambda _: F.lit(False)))


def map_sort_key(m) -> Column:
    """Maps have no order in Spark: their sorted entries do."""
    return F.array_sort(F.map_entries(_c(m)))


def union_value(members: dict[str, str], tag: str, value: Column) -> Column:
    """A tagged union: a struct of the tag and one nullable field for each member."""
    return F.struct(F.lit(tag).alias("tag"), *[(value if m == tag else F.lit(None)).cast(t).alias(m) for m, t in members.items()])


def union_tag(u) -> Column:
    return _c(u)["tag"]


def union_extract(u, member: str) -> Column:
    return F.when(_c(u)["tag"] == member, _c(u)[member])


class Enum:
    """Strings in a declared order."""

    def __init__(self, values: Sequence[str]) -> None:
        self.values = list(values)

    def code(self, x) -> Column:
        return F.nullif(F.array_position(F.lit(self.values), _c(x)), F.lit(0)) - 1

    def cast(self, x) -> Column:
        return F.when(_c(x).isin(self.values), _c(x))

    def first(self) -> Column:
        return F.lit(self.values[0])

    def last(self) -> Column:
        return F.lit(self.values[-1])

    def range(self) -> Column:
        return F.lit(self.values)

    def range_boundary(self, low: str | None, high: str | None) -> Column:
        a = 0 if low is None else self.values.index(low)
        b = len(self.values) if high is None else self.values.index(high) + 1
        return F.lit(self.values[a:b])


# JSON
def json_exists(j, path: str) -> Column:
    return F.get_json_object(_c(j), path).isNotNull()


def json_type(j, path: str = "$") -> Column:
    """OBJECT, ARRAY, VARCHAR, BOOLEAN, UBIGINT, BIGINT, DOUBLE or NULL."""
    v = F.try_variant_get(F.try_parse_json(_c(j)), path, "variant")
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "long")
    return (
        F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "STRING", "VARCHAR").when(kind == "BOOLEAN", "BOOLEAN")
        .when(kind == "BIGINT", F.when(number >= 0, "UBIGINT").otherwise("BIGINT")).when(kind == "VOID", "NULL").otherwise(F.when(v.isNotNull(), "DOUBLE"))
    )


def json_valid(j) -> Column:
    return F.try_parse_json(_c(j)).isNotNull()


def json_each(df: DataFrame, j: str) -> DataFrame:
    """A row for each member of an object: all columns, key, value (JSON text)."""
    return df.select("*", F.explode(F.from_json(F.col(j), "map<string,string>")).alias("key", "value"))


def _merge(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


@F.pandas_udf(T.StringType())
def json_merge_patch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else json.dumps(_merge(json.loads(x), json.loads(y)), separators=(",", ":"), ensure_ascii=False) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def json_pretty(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=4, ensure_ascii=False))


def _contains(a, b) -> bool:
    if isinstance(a, dict):
        if isinstance(b, dict) and all(k in a and _contains(a[k], v) for k, v in b.items()):
            return True
        return any(_contains(v, b) for v in a.values())
    if isinstance(a, list):
        if isinstance(b, list) and all(any(_contains(x, y) for x in a) for y in b):
            return True
        return any(_contains(x, b) for x in a)
    return a == b


@F.pandas_udf(T.BooleanType())
def json_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _contains(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype="object")
