"""Codes, messages and hints of decoding errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<path:string,code:string,message:string,hint:string>"

#: Fixed table: what each code means, and what to do about it.
CODES = {
    "syntax": ("the text is no valid document", "check quotes, commas and brackets near the start of the trouble"),
    "depth": ("the document nests too deeply", "flatten it, or keep the inner part as opaque JSON"),
    "size": ("a collection is too large", "split the document"),
    "missing": ("a required field is missing", "send the field, or give it a default"),
    "null": ("null where a value is required", "make the field nullable, or give it a default"),
    "kind": ("the value is of another kind", "change the field's type, or turn on coercion or resilience"),
    "range": ("the number does not fit the type", "use a wider type"),
    "char": ("not exactly one character", "use a string"),
    "enum": ("no name of the enum", "add the name, or declare a fallback"),
    "format": ("the text has not the form of its type", "see the proto3 JSON mapping"),
    "discriminator": ("the discriminator is missing or no string", "send it, or declare a fallback subclass"),
    "subclass": ("the discriminator names no subclass", "add the subclass, or declare a fallback"),
    "inference": ("the keys fit no subclass", "send all required keys of one subclass and no key of others"),
    "unknown": ("a key that the model does not know", "remove the key, or do not decode strictly"),
    "path": ("something on the way to the field is no object", "check the flattened or wrapped path"),
    "tag": ("a tag or alias that is not defined", "define the anchor or tag handle first"),
}


def error(path: Column, code: str | Column) -> Column:
    return F.struct(path.alias("path"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def explained(raw: Column) -> Column:
    """The error with its message and hint."""
    texts = lambda i: F.create_map(*(F.lit(x) for k, v in CODES.items() for x in (k, v[i])))
    made = F.struct(raw["path"].alias("path"), raw["code"].alias("code"), F.element_at(texts(0), raw["code"]).alias("message"), F.element_at(texts(1), raw["code"]).alias("hint"))
    return F.when(raw.isNotNull(), made)
