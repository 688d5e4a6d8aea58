"""Metadata filters: a JSON-like tree compiled once to a column predicate.

Missing fields count as SQL nulls: they satisfy $ne, $nin and $not, and nothing else but an equality with null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The operators of the filter language.
OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$contains")


def parse(text: str) -> dict:
    """A filter from JSON; anything but an object is an error."""
    tree = json.loads(text) if text.strip() else {}
    if not isinstance(tree, dict):
        raise ValueError("a filter is a JSON object")
    return tree


def eq(name: str, value) -> dict:
    return {name: {"$eq": value}}


def between(name: str, low=None, high=None) -> dict:
    return {name: {k: v for k, v in (("$gte", low), ("$lte", high)) if v is not None}}


def one_of(name: str, values: list) -> dict:
    return {name: {"$in": list(values)}}


def kind_of(schema: T.StructType, name: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def true_only(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def comparable(kind: T.DataType, value) -> bool:
    """Whether a value can equal one of the kind without a conversion."""
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    return True


def equals(column: Column, kind: T.DataType, value) -> Column:
    if value is None:
        return column.isNull()
    if isinstance(kind, T.ArrayType):
        return true_only(F.array_contains(column, value)) if comparable(kind.elementType, value) else F.lit(False)
    return column.eqNullSafe(F.lit(value)) if comparable(kind, value) else F.lit(False)


def order(column: Column, kind: T.DataType, op: str, value) -> Column:
    """Numbers by size, ISO dates in text by time, other text by code points; unlike kinds never compare."""
    apply = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}[op]
    if isinstance(kind, T.StringType) and isinstance(value, str):
        a, b = F.try_to_timestamp(column), F.try_to_timestamp(F.lit(value))
        return true_only(F.when(a.isNotNull() & b.isNotNull(), apply(a, b)).otherwise(apply(column, F.lit(value))))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return true_only(apply(column, F.lit(value).cast(kind)))
    return true_only(apply(column, F.lit(value))) if comparable(kind, value) and not isinstance(value, bool) else F.lit(False)


def member(column: Column, kind: T.DataType, values: list) -> Column:
    if isinstance(kind, T.ArrayType):
        known = [v for v in values if comparable(kind.elementType, v)]
        return true_only(F.arrays_overlap(column, F.array(*map(F.lit, known)).cast(kind))) if known else F.lit(False)
    return reduce(lambda a, b: a | b, (equals(column, kind, v) for v in values), F.lit(False))


def condition(column: Column, kind: T.DataType, op: str, value) -> Column:
    if op == "$eq":
        return equals(column, kind, value)
    if op == "$ne":
        return ~equals(column, kind, value)
    if op == "$in":
        return member(column, kind, value)
    if op == "$nin":
        return ~member(column, kind, value)
    if op == "$contains":
        return equals(column, kind, value) if isinstance(kind, T.ArrayType) else true_only(F.contains(F.lower(column.cast("string")), F.lower(F.lit(str(value)))))
    if op in OPERATORS:
        return order(column, kind, op, value)
    raise ValueError(f"unknown operator {op}")


def compile_filter(tree: dict | None, schema: T.StructType, empty_or: bool = False, on_unknown: str = "raise") -> Column:
    """A predicate without nulls. An empty tree is true; an empty $or is empty_or; on_unknown false makes unknown operators false instead of an error.

    A plain value means equality, for arrays membership; a plain list means one of it. A field that the schema lacks counts as missing.
    """
    out = F.lit(True)
    for name, value in (tree or {}).items():
        if name in ("$and", "$or"):
            parts = [compile_filter(t, schema, empty_or, on_unknown) for t in value]
            joined = reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), parts) if parts else F.lit(True if name == "$and" else empty_or)
        elif name == "$not":
            joined = ~compile_filter(value, schema, empty_or, on_unknown)
        elif name.startswith("$"):
            if on_unknown == "raise":
                raise ValueError(f"unknown operator {name}")
            joined = F.lit(False)
        else:
            kind = kind_of(schema, name)
            column, kind = (F.col(name), kind) if kind is not None else (F.lit(None).cast("string"), T.StringType())
            if isinstance(value, dict):
                joined = F.lit(True)
                for op, operand in value.items():
                    if op not in OPERATORS and on_unknown == "false":
                        joined = F.lit(False)
                    else:
                        joined = joined & condition(column, kind, op, operand)
            else:
                joined = member(column, kind, value) if isinstance(value, list) else equals(column, kind, value)
        out = out & joined
    return out


@dataclass(frozen=True)
class Principal:
    tenant: str
    access_level: int = 0
    departments: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Guard:
    """The columns that carry the access rules."""

    tenant: str = "tenant_id"
    level: str = "access_level"
    public: str = "is_public"
    department: str = "department"


def without_field(tree: dict, name: str) -> dict:
    """A client's filter without any condition on a field, at any depth."""
    out = {}
    for key, value in tree.items():
        if key == name:
            continue
        if key in ("$and", "$or"):
            value = [without_field(t, name) for t in value]
        elif key == "$not":
            value = without_field(value, name)
        out[key] = value
    return out


def secured(df: DataFrame, who: Principal, client: dict | None = None, guard: Guard = Guard()) -> DataFrame:
    """The rows that a principal may see: own tenant, public or within the level, public or of an own department or of none; then the client's filter, which can't speak of tenants."""
    public = true_only(F.col(guard.public))
    allowed = F.col(guard.tenant).eqNullSafe(F.lit(who.tenant)) & (public | true_only(F.col(guard.level) <= who.access_level))
    if who.departments:
        allowed = allowed & (public | true_only(F.col(guard.department).isin(*who.departments)) | F.col(guard.department).isNull())
    return df.where(allowed).where(compile_filter(without_field(client or {}, guard.tenant), df.schema))


def distinct_values(docs: DataFrame, *fields: str) -> DataFrame:
    """(field, value, rows): every value of these text fields, missing ones left out; tenants and departments to choose from."""
    pairs = docs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("x.*")
    return pairs.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))
