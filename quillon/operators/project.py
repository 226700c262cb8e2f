"""The quick way for documents that are known to be sound: one ``from_json`` with the fields that the query uses.

There is no error column: a field that does not decode is null (or its default), as is a missing required one, and
coercion, kinds and ranges are those of ``from_json``. Catalyst prunes the parsed schema to the fields in use.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PROTO_ONLY, SCALARS, Enum, List, Map, Model, ModelError, spark_type
from .decode import _default


def _wire_type(kind: Any) -> T.DataType:
    if isinstance(kind, Model) and not kind.proto:
        tree: dict = {}
        for f in kind.fields:
            if f.keys or f.decoder is not None:
                raise ModelError(f"{kind.name}.{f.name}: only decode() reads this field")
            if f.ignored:
                continue
            at, parts = tree, kind.path(f)
            for p in parts[:-1]:
                at = at.setdefault(p, {})
            at[parts[-1]] = _wire_type(f.type)
        return _struct(tree)
    if isinstance(kind, List):
        return T.ArrayType(_wire_type(kind.item))
    if isinstance(kind, Map):
        return T.MapType(T.StringType(), _wire_type(kind.value))
    if isinstance(kind, Enum):
        return T.StringType()
    if isinstance(kind, str) and kind not in PROTO_ONLY:
        return SCALARS[kind]
    raise ModelError("only decode() reads this type")


def _struct(tree: dict) -> T.StructType:
    return T.StructType([T.StructField(k, _struct(x) if isinstance(x, dict) else x) for k, x in tree.items()])


def _plain(kind: Any) -> bool:
    """Whether the wire form is the value's form."""
    if isinstance(kind, List):
        return not kind.unique and _plain(kind.item)
    return _plain(kind.value) if isinstance(kind, Map) else not isinstance(kind, Model | Enum)


def _shape(c: Column, kind: Any) -> Column:
    if isinstance(kind, Model):
        made = []
        for f in kind.fields:
            kind_of = spark_type(f.type)
            if f.ignored:
                made.append(_default(f, kind_of).alias(f.name))
                continue
            inner = c
            for p in kind.path(f):
                inner = inner.getField(p)
            inner = _shape(inner, f.type)
            made.append((F.coalesce(inner, _default(f, kind_of)) if f.has_default and f.default is not None else inner).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*made))
    if _plain(kind):
        return c
    if isinstance(kind, Enum):
        return F.when(c.isin(*kind.names), c).otherwise(F.when(c.isNotNull(), F.lit(kind.other)))
    if isinstance(kind, Map):
        return F.transform_values(c, lambda _, x: _shape(x, kind.value))
    shaped = c if _plain(kind.item) else F.transform(c, lambda x: _shape(x, kind.item))
    return F.array_distinct(shaped) if kind.unique else shaped


def project(df: DataFrame, column: str, model: Model, value: str = "value") -> DataFrame:
    """Adds ``value``: the model's fields of the JSON texts in ``column``; null where a text is no JSON object."""
    parsed = F.from_json(F.col(column), _wire_type(model), {"allowNonNumericNumbers": "false", "mode": "PERMISSIVE"})
    return df.withColumn("__wire", parsed).withColumn(value, _shape(F.col("__wire"), model)).drop("__wire")
