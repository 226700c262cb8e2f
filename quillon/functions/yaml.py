"""YAML 1.2 text to and from canonical JSON text.

There is no Catalyst expression for YAML, so reading and writing run as Arrow-batched UDFs; what they give is JSON text,
and everything after that is the JSON engine. The optional PyYAML library supplies the scanner and parser (events);
scalar resolution, tags, anchors, merge keys and limits follow the 1.2 core schema here.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MAX_DEPTH

#: Nodes that aliases of one document may expand to.
MAX_NODES = 1_000_000

_INT = re.compile(r"-?[0-9]+\Z")
_FLOAT = re.compile(r"-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\Z")
_BASED = re.compile(r"-?0(?:x[0-9a-fA-F]+|o[0-7]+|b[01]+)\Z")
_CORE = "tag:yaml.org,2002:"


class YamlError(ValueError):
    """Text that is no YAML document, or one beyond a limit."""


def resolve(text: str) -> Any:
    """A plain scalar's value: null, boolean, number or string. A leading plus makes no number."""
    low = text.lower()
    if low in ("", "~", "null"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if low in (".inf", "-.inf"):
        return math.inf if low[0] == "." else -math.inf
    if low == ".nan":
        return math.nan
    return _number(text, text)


def _number(text: str, otherwise: Any) -> Any:
    if _BASED.match(text):
        value = int(text, 0)
        return value if -(1 << 63) <= value < 1 << 63 else float(value)
    if _INT.match(text):
        value = int(text)
        return value if -(1 << 63) <= value < 1 << 63 else float(value)
    return float(text) if _FLOAT.match(text) else otherwise


def _forced(tag: str, text: str) -> Any:
    """A scalar under a core tag; a text that does not fit gives the type's zero."""
    value = resolve(text)
    if tag == "str":
        return text
    if tag == "null":
        return None
    if tag == "bool":
        return value is True
    number = value if isinstance(value, int | float) and not isinstance(value, bool) else 0
    if tag == "int":
        return int(number) if math.isfinite(number) else 0
    return float(number)


class _Reader:
    """Builds plain values from parser events, document by document."""

    def __init__(self, text: str):
        import yaml

        self.y, self.events = yaml, yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # libyaml if there
        self.anchors: dict[str, Any] = {}
        self.nodes = 0

    def documents(self) -> list[Any]:
        out = []
        try:
            for e in self.events:
                if isinstance(e, self.y.DocumentStartEvent):
                    self.anchors, self.nodes = {}, 0
                    out.append(self.node(next(self.events), 0))
        except self.y.YAMLError as e:
            raise YamlError(str(e).split("\n")[0]) from None
        return out

    def node(self, e: Any, depth: int) -> Any:
        self.nodes += 1
        if depth > MAX_DEPTH or self.nodes > MAX_NODES:
            raise YamlError("the document nests or expands too far")
        y = self.y
        if isinstance(e, y.AliasEvent):
            if e.anchor not in self.anchors:
                raise YamlError(f"undefined alias {e.anchor}")
            value = self.anchors[e.anchor]
            self.nodes += _count(value)
            return value
        if isinstance(e, y.ScalarEvent):
            value = self.scalar(e)
        elif isinstance(e, y.SequenceStartEvent):
            value = []
            while not isinstance(n := next(self.events), y.SequenceEndEvent):
                value.append(self.node(n, depth + 1))
        else:
            value = {}
            fixed: set[str] = set()
            while not isinstance(n := next(self.events), y.MappingEndEvent):
                merge = isinstance(n, y.ScalarEvent) and n.value == "<<" and n.implicit[0]
                key = None if merge else self.key(self.node(n, depth + 1))
                item = self.node(next(self.events), depth + 1)
                if not merge:
                    value[key] = item
                    fixed.add(key)
                    continue
                for source in item if isinstance(item, list) else [item]:
                    if not isinstance(source, dict):
                        raise YamlError("a merge needs maps")
                    for k, x in source.items():
                        value.setdefault(k, x)  # what is there wins; a later explicit key overwrites
            if e.tag and not e.tag.startswith(_CORE):
                value = {"__tag__": e.tag.lstrip("!"), **value}
        if e.anchor:
            self.anchors[e.anchor] = value
        return value

    def scalar(self, e: Any) -> Any:
        if e.tag == "!" or (e.tag and not e.tag.startswith(_CORE)):
            return e.value
        if e.tag:
            return _forced(e.tag[len(_CORE) :], e.value)
        return resolve(e.value) if e.implicit[0] else e.value

    @staticmethod
    def key(value: Any) -> str:
        if isinstance(value, str):
            return value
        return "" if value is None else _json(value)


def _count(value: Any) -> int:
    if isinstance(value, dict):
        return 1 + sum(map(_count, value.values()))
    return 1 + sum(map(_count, value)) if isinstance(value, list) else 1


def _special(value: Any) -> Any:
    """JSON has no names for what is not finite; they become strings."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {k: _special(x) for k, x in value.items()}
    return [_special(x) for x in value] if isinstance(value, list) else value


def _json(value: Any) -> str:
    return json.dumps(_special(value), ensure_ascii=False, separators=(",", ":"))


def read_all(text: str) -> list[str]:
    """Canonical JSON of each document of a YAML text; raises YamlError."""
    return [_json(d) for d in _Reader(text).documents()]


def read_one(text: str) -> str:
    found = read_all(text)
    if len(found) > 1:
        raise YamlError("more than one document")
    return found[0] if found else "null"


_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_./-]*\Z")


def _key_text(key: str) -> str:
    plain = _PLAIN.match(key) and isinstance(resolve(key), str) and not key.endswith(":")
    return key if plain else _json(key)


def _write(value: Any, indent: int) -> list[str]:
    pad = "  " * indent
    if isinstance(value, dict) and value:
        out = []
        for k, x in value.items():
            if isinstance(x, dict | list) and x:
                out += [f"{pad}{_key_text(k)}:", *_write(x, indent + 1)]
            else:
                out.append(f"{pad}{_key_text(k)}: {_json(x)}")
        return out
    if isinstance(value, list) and value:
        out = []
        for x in value:
            if isinstance(x, dict | list) and x:
                first, *rest = _write(x, indent + 1)
                out += [f"{pad}- {first.lstrip()}", *rest]
            else:
                out.append(f"{pad}- {_json(x)}")
        return out
    return [pad + _json(value)]


def write_one(document: str) -> str:
    """Block-style YAML of a JSON text: strings double-quoted, keys bare where they can be."""
    return "\n".join(_write(json.loads(document), 0)) + "\n"


_ONE = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])
_ALL = T.StructType([T.StructField("json", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def _to_json(texts: pd.Series) -> pd.DataFrame:
    made = []
    for x in texts:
        try:
            made.append((None if x is None else read_one(x), None))
        except YamlError as e:
            made.append((None, str(e)))
    return pd.DataFrame(made, columns=["json", "error"])


def _all_to_json(texts: pd.Series) -> pd.DataFrame:
    made = []
    for x in texts:
        try:
            made.append((None if x is None else read_all(x), None))
        except YamlError as e:
            made.append((None, str(e)))
    return pd.DataFrame(made, columns=["json", "error"])


def _from_json(documents: pd.Series) -> pd.Series:
    return documents.map(lambda x: None if x is None else write_one(x))


def yaml_to_json(text: Column) -> Column:
    """struct<json, error>: one YAML document as canonical JSON text, or what is wrong with it."""
    return F.pandas_udf(_to_json, _ONE)(text)


def yaml_documents(text: Column) -> Column:
    """struct<json array, error>: all documents of a YAML text."""
    return F.pandas_udf(_all_to_json, _ALL)(text)


def json_to_yaml(document: Column) -> Column:
    return F.pandas_udf(_from_json, T.StringType())(document)
