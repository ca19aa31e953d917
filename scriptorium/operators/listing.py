"""List endpoints: a nested `where` filter as one column expression, sorting, pages.

A filter is a nested dictionary, as JSON or a query string gives it: {"field": {"operator": value}}, with "and" and "or"
over lists of filters; several fields, or operators of a field, must all hold. Values take the field's own type, so that
comparisons reach the scan. Fields and operators that do not exist, and values that are not of the field's type, are
errors. A field of null is only met by not_equals, not_in and exists = false. An empty filter is met by every row.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a page if none are asked for, and at most.
PAGE, MOST = 20, 100
#: Other names of operators.
SHORT = {"gt": "greater_than", "gte": "greater_than_equal", "lt": "less_than", "lte": "less_than_equal"}


class FilterError(ValueError):
    """A filter that cannot be read."""


def from_query_string(text: str) -> dict:
    """The filter of where[field][operator]=value&where[or][0][field][operator]=value...; other parameters are passed over."""
    root: dict = {}
    for name, value in parse_qsl(text, keep_blank_values=True):
        if re.fullmatch(r"where(\[[^\[\]]+\])+(\[\])?", name):
            *path, last = re.findall(r"\[([^\[\]]+)\]", name)
            at = root
            for part in path:
                at = at.setdefault(part, {})
                if not isinstance(at, dict):
                    raise FilterError(f"{name} stands beside a value")
            at[last] = value
    return _lists(root)


def _lists(node):
    """and/or have numbered parts in a query string; lists in a filter."""
    if not isinstance(node, dict):
        return node
    out = {k: _lists(v) for k, v in node.items()}
    for k in ("and", "or"):
        if isinstance(out.get(k), dict):
            if not all(i.isdigit() for i in out[k]):
                raise FilterError(f"parts of {k} are numbered")
            out[k] = [out[k][i] for i in sorted(out[k], key=int)]
    return out


def _value(value, kind: T.DataType, field: str):
    """The value in the field's type."""
    try:
        if value is None or isinstance(value, (list, dict)):
            raise ValueError(value)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}[str(value).lower()]
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return int(str(value))
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(kind, T.DecimalType):
            return Decimal(str(value))
        if isinstance(kind, T.DateType):
            return value if type(value) is date else date.fromisoformat(str(value))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
        return str(value)
    except (ValueError, KeyError, ArithmeticError) as error:
        raise FilterError(f"{value!r} is no value of {field} ({kind.simpleString()})") from error


def _many(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [v for v in str(value).split(",") if v]


def _one(column: Column, kind: T.DataType, field: str, operator: str, value) -> Column:
    operator = SHORT.get(operator, operator)
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    literal = lambda v: F.lit(_value(v, element, field)).cast(element)
    if operator == "exists":
        return column.isNotNull() if _value(value, T.BooleanType(), field) else column.isNull()
    if operator in ("in", "not_in", "all"):
        own = [literal(v) for v in _many(value)]
        if isinstance(kind, T.ArrayType):
            each = [F.array_contains(column, v) for v in own]
            met = reduce(lambda a, b: (a & b) if operator == "all" else (a | b), each, F.lit(operator == "all"))
        elif operator == "all":
            raise FilterError(f"all is for lists; {field} is {kind.simpleString()}")
        else:
            met = column.isin(*own) if own else F.lit(False)
        return (~met | column.isNull()) if operator == "not_in" else met
    if isinstance(kind, T.ArrayType):
        raise FilterError(f"{field} is a list: in, not_in, all or exists")
    if operator in ("like", "contains"):
        if not isinstance(kind, T.StringType):
            raise FilterError(f"{operator} is for text; {field} is {kind.simpleString()}")
        low = F.lower(column)
        parts = str(value).lower().split() if operator == "like" else [str(value).lower()]
        return reduce(lambda a, b: a & b, (F.contains(low, F.lit(p)) for p in parts), F.lit(True))
    if operator == "equals" and value is None:
        return column.isNull()
    if operator == "not_equals":
        return column.isNotNull() if value is None else (column != literal(value)) | column.isNull()
    compare = {"equals": Column.__eq__, "greater_than": Column.__gt__, "greater_than_equal": Column.__ge__, "less_than": Column.__lt__, "less_than_equal": Column.__le__}
    if operator not in compare:
        raise FilterError(f"unknown operator {operator}")
    return compare[operator](column, literal(value))


def where(schema: T.StructType, tree: dict) -> Column:
    """The filter as one expression over rows of this schema. A field of a struct is named with dots."""
    if not isinstance(tree, dict):
        raise FilterError(f"{tree!r} is no filter")
    parts = []
    for name, inner in tree.items():
        if name in ("and", "or"):
            if not isinstance(inner, list):
                raise FilterError(f"{name} takes a list")
            each = [where(schema, t) for t in inner]
            if each:
                parts.append(reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), each))
            continue
        kind: T.DataType = schema
        for step in name.split("."):
            if not isinstance(kind, T.StructType) or step not in kind.names:
                raise FilterError(f"unknown field {name}")
            kind = kind[step].dataType
        if not isinstance(inner, dict) or not inner:
            raise FilterError(f"{name} takes operators")
        column = F.col(".".join(f"`{s}`" for s in name.split(".")))
        parts += [_one(column, kind, name, operator, value) for operator, value in inner.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def order(schema: T.StructType, sort: str, key: str) -> list[Column]:
    """Fields in turn, a leading minus for the largest first; nulls last; the key makes it total."""
    out = []
    for field in filter(None, sort.split(",")):
        name = field.lstrip("-")
        if name not in schema.names:
            raise FilterError(f"unknown field {name}")
        out.append(F.desc_nulls_last(name) if field.startswith("-") else F.asc_nulls_last(name))
    return [*out, F.asc(key)]


def listing(rows: DataFrame, tree: dict, key: str, sort: str = "", page: int = 1, limit: int = PAGE) -> DataFrame:
    """One page of the rows that meet the filter."""
    limit, page = min(MOST, max(1, limit)), max(1, page)
    return rows.where(where(rows.schema, tree)).orderBy(*order(rows.schema, sort, key)).offset((page - 1) * limit).limit(limit)
