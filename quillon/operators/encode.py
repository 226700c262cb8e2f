"""Encoding: a column of structs and a model become a column of JSON text.

Each field's text is an expression; members with a null text are left out, so every field has its own null policy:
a null with a default is left out, a null without one is written.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import proto as P
from ..model import DYNAMIC, INTEGERS, Codec, Enum, Field, Inferred, List, Map, Model, Sealed, Singleton


def double_text(d: Column, decimals: int | None = None) -> Column:
    """JSON text of a double: whole numbers up to 1e15 end in .0, NaN and infinities are errors. ``decimals``: round the
    fraction of magnitudes from 1e-9 to 1e9 to so many digits."""
    bad = F.isnan(d) | (F.abs(d) == float("inf"))
    whole = (d == F.floor(d)) & (F.abs(d) <= 1e15)
    plain = J.text_of(d)
    if decimals is not None:
        rounded = F.format_string(f"%.{decimals}f", d)
        rounded = F.regexp_replace(F.regexp_replace(rounded, "0+$", ""), r"\.$", ".0")
        plain = F.when((F.abs(d) >= 1e-9) & (F.abs(d) < 1e9), rounded).otherwise(plain)
    return F.when(d.isNull(), None).when(bad, F.raise_error(F.lit("a number that is not finite has no JSON text"))).when(whole, F.concat(d.cast("decimal(16,0)").cast("string"), F.lit(".0"))).otherwise(plain)


def _text(c: Column, kind: Any, proto: bool, decimals: int | None) -> Column:
    """JSON text of a value that is not null."""
    if isinstance(kind, Model):
        return _object(c, kind, decimals)
    if isinstance(kind, Sealed | Inferred):
        chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for n, m in kind.options.items():
            lead = [(kind.discriminator, F.lit(f'"{n}"'))] if isinstance(kind, Sealed) and kind.discriminator not in [m.wire(f) for f in m.fields] else []
            chosen = chosen.when(c["_type"] == n, _object(c[n], m, decimals, lead))
        return chosen
    if isinstance(kind, Singleton):
        return F.lit("{}")
    if isinstance(kind, List):
        return J.elements(F.transform(c, lambda x: F.when(x.isNotNull(), _text(x, kind.item, proto, decimals))))
    if isinstance(kind, Map):
        each = F.transform(F.map_entries(c), lambda e: F.concat(J.text_of(e["key"]), F.lit(":"), F.coalesce(_text(e["value"], kind.value, proto, decimals), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))
    if isinstance(kind, Enum) or kind in ("string", "char"):
        return J.text_of(c)
    if kind == "json":
        return c
    if isinstance(kind, Codec):
        return kind.encoder(c)
    if kind in DYNAMIC:
        return F.to_json(c)
    if kind in ("float", "double"):
        return P.format_float(c) if proto else double_text(c, decimals)
    if kind in ("long", "ulong") and proto:
        return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    if kind == "boolean" or kind in INTEGERS:
        return c.cast("string")
    if kind == "bytes":
        return F.concat(F.lit('"'), P.format_base64(c), F.lit('"'))
    if kind in ("timestamp", "duration", "fieldmask"):
        made = {"timestamp": P.format_timestamp, "duration": P.format_duration, "fieldmask": P.format_fieldmask}[kind]
        return F.concat(F.lit('"'), made(c), F.lit('"'))
    if kind == "any":
        return J.members([("@type", J.text_of(c["type_url"])), ("value", c["value"])])
    return J.text_of(c)


def _proto_empty(c: Column, kind: Any) -> Column | None:
    """Whether a proto value is its type's default and is left out."""
    if isinstance(kind, List):
        return F.size(c) == 0
    if isinstance(kind, Map):
        return F.size(c) == 0
    if kind in ("string", "char"):
        return c == ""
    if kind == "boolean":
        return ~c
    if kind == "bytes":
        return F.octet_length(c) == 0
    if kind in ("byte", "short", "int", "long", "uint", "ulong", "float", "double"):
        return c == 0
    return None


def _member(c: Column, model: Model, f: Field, decimals: int | None) -> Column:
    text = f.encoder(c) if f.encoder is not None else _text(c, f.type, model.proto, decimals)
    text = F.when(c.isNotNull(), text)
    if not f.nullable and model.proto and not f.has_default and (empty := _proto_empty(c, f.type)) is not None:
        text = F.when(~empty, text)
    if f.has_default or model.proto or not f.nullable:
        return text
    return F.coalesce(text, F.lit("null"))


def _siblings(c: Column, kind: Model | Inferred, decimals: int | None) -> dict[str, Column]:
    """Texts of the keys that stand among a field's siblings; those without a value are left out."""
    found: dict[str, Column] = {}
    for name, model in kind.options.items() if isinstance(kind, Inferred) else [(None, kind)]:
        inner = c if name is None else c[name]
        for g in model.fields:
            if g.keys:
                found |= _siblings(inner[g.name], g.type, decimals)
                continue
            text = F.when(inner[g.name].isNotNull(), _member(inner[g.name], model, g, decimals))
            found[model.wire(g)] = F.coalesce(found[model.wire(g)], text) if model.wire(g) in found else text
    return found


def _object(c: Column, model: Model, decimals: int | None, lead: list = ()) -> Column:
    """Members in order of their fields; flattened and wrapped ones under their path, where the path first occurs."""
    tree: dict = {}
    for f in model.fields:
        if f.ignored:
            continue
        if f.keys:
            tree |= _siblings(c[f.name], f.type, decimals)
            continue
        at, parts = tree, model.path(f)
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = _member(c[f.name], model, f, decimals)

    def write(node: dict, first: list) -> Column:
        return J.members([*first, *((k, write(x, []) if isinstance(x, dict) else x) for k, x in node.items())])

    return write(tree, list(lead))


def encode(df: DataFrame, column: str, kind: Any, out: str = "json", decimals: int | None = None) -> DataFrame:
    """Adds ``out``: the JSON text of the values in ``column``; a null value has a null text."""
    proto = isinstance(kind, Model) and kind.proto
    return df.withColumn(out, F.when(F.col(column).isNotNull(), _text(F.col(column), kind, proto, decimals)))


def pack_any(df: DataFrame, column: str, name: str, kind: Model, out: str = "packed", prefix: str = "type.googleapis.com/") -> DataFrame:
    """Adds ``out``: the values in ``column`` as ``any`` structs of the type ``name``; a null value stays null."""
    return df.withColumn(out, P.pack_any(name, F.when(F.col(column).isNotNull(), _text(F.col(column), kind, kind.proto, None)), prefix))
