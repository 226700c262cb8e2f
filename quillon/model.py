"""Declarative models of semi-structured documents, and their checks.

A model is a frozen description: fields with wire names, types, nullability, defaults and error policy. The operators
compile it into Catalyst columns; nothing here touches data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

#: Fixed names of scalar types and what they are in Spark. ``json`` is an opaque JSON value kept as text.
SCALARS: dict[str, T.DataType] = {
    "string": T.StringType(), "char": T.StringType(), "json": T.StringType(), "boolean": T.BooleanType(),
    "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(),
    "ulong": T.DecimalType(20, 0), "uint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "bytes": T.BinaryType(), "timestamp": T.StructType([T.StructField("seconds", T.LongType()), T.StructField("nanos", T.IntegerType())]),
    "duration": T.StructType([T.StructField("seconds", T.LongType()), T.StructField("nanos", T.IntegerType())]),
    "value": T.VariantType(), "struct": T.VariantType(), "listvalue": T.VariantType(),
    "fieldmask": T.ArrayType(T.StringType()), "any": T.StructType([T.StructField("type_url", T.StringType()), T.StructField("value", T.StringType())]),
}
INTEGERS = {"byte": (-128, 127), "short": (-32768, 32767), "int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1), "uint": (0, (1 << 32) - 1), "ulong": (0, (1 << 64) - 1)}
PROTO_ONLY = {"uint", "bytes", "timestamp", "duration", "fieldmask", "any", "value", "struct", "listvalue"}
#: What the dynamic types of proto models are on the wire, as kinds of JSON; None: any kind.
DYNAMIC = {"value": None, "struct": "OB", "listvalue": "AR"}

#: Deepest nesting, and the size of a collection that one more element may still exceed.
MAX_DEPTH, MAX_ITEMS = 255, 1_000_000


class ModelError(ValueError):
    """A model that no document could be decoded with."""


@dataclass(frozen=True)
class Enum:
    """Names on the wire; ``fallback`` stands for unknown ones, as does an entry named UNKNOWN in any case."""

    names: tuple[str, ...]
    fallback: str | None = None

    def __post_init__(self):
        if not self.names or len(set(self.names)) != len(self.names):
            raise ModelError("an enum needs distinct names")
        if self.fallback is not None and self.fallback not in self.names:
            raise ModelError(f"fallback {self.fallback} is no name of the enum")

    @property
    def other(self) -> str | None:
        return self.fallback or next((n for n in self.names if n.lower() == "unknown"), None)


@dataclass(frozen=True)
class List:
    item: Any
    unique: bool = False  # a set: first occurrences stay, in order
    item_nullable: bool = True


@dataclass(frozen=True)
class Map:
    value: Any


@dataclass(frozen=True)
class Singleton:
    """Any object stands for the one instance."""


@dataclass(frozen=True)
class Codec:
    """A type that this library does not know: how its JSON text becomes a column of ``spark_type``, and back. Stands
    wherever a type stands, in lists and maps too. A null from ``decoder`` is an error of the document."""

    name: str
    spark_type: str
    decoder: Any = field(compare=False)  # Column (the value as JSON text) -> Column
    encoder: Any = field(compare=False)  # Column -> Column (JSON text)


class Codecs:
    """A registry of codecs by type name, for models that name their types: ``codecs["Money"]``."""

    def __init__(self, *codecs: Codec):
        self._known: dict[str, Codec] = {}
        for c in codecs:
            self.register(c)

    def register(self, codec: Codec) -> Codec:
        if codec.name in self._known or codec.name in SCALARS:
            raise ModelError(f"{codec.name}: there is a codec for this type")
        self._known[codec.name] = codec
        return codec

    def __getitem__(self, name: str) -> Codec:
        if name not in self._known:
            raise ModelError(f"{name}: no codec for this type")
        return self._known[name]


@dataclass(frozen=True)
class Field:
    name: str
    type: Any
    wire: str | None = None
    nullable: bool = False
    default: Any = None
    has_default: bool = False
    resilient: bool = False
    ignored: bool = False
    flatten: str | None = None  # path whose last part is the wire name
    wrap: str | None = None  # path to which the wire name is appended
    keys: bool = False  # the nested model's keys stand among this field's siblings
    omit: str | None = None  # with keys: "empty" or "absent"
    decoder: Any = None  # Column (the value as JSON text) -> Column
    encoder: Any = None  # Column -> Column (JSON text)
    spark_type: str | None = None  # with decoder: the type of the column

    @property
    def optional(self) -> bool:
        return self.nullable or self.has_default


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...]
    resilient: bool = False  # as an element of a list: dropped if it does not decode
    proto: bool = False
    strict: bool = False  # unknown keys are errors

    def __post_init__(self):
        names, paths = [f.name for f in self.fields], {}
        if len(set(names)) != len(names):
            raise ModelError(f"{self.name}: field names repeat")
        for f in self.fields:
            check_type(f.type, self.proto, f"{self.name}.{f.name}")
            if f.flatten and f.wrap:
                raise ModelError(f"{self.name}.{f.name}: flatten and wrap exclude each other")
            for path in (f.flatten, f.wrap):
                if path is not None and not all(path.split(".")):
                    raise ModelError(f"{self.name}.{f.name}: a path has empty parts")
            if f.keys and not isinstance(f.type, Model | Inferred):
                raise ModelError(f"{self.name}.{f.name}: sibling keys need a model")
            if f.keys and (f.flatten or f.wrap):
                raise ModelError(f"{self.name}.{f.name}: sibling keys have no path")
            if f.omit and (not f.keys or not f.nullable or f.omit not in ("empty", "absent")):
                raise ModelError(f"{self.name}.{f.name}: omit needs a nullable field of sibling keys")
            if f.ignored and not f.optional:
                raise ModelError(f"{self.name}.{f.name}: an ignored field needs a default")
            if f.default is None and f.has_default and not f.nullable:
                raise ModelError(f"{self.name}.{f.name}: a default of null needs a nullable field")
            if not f.ignored and not f.keys:
                if (path := self.path(f)) in paths:
                    raise ModelError(f"{self.name}: {'.'.join(path)} is read twice")
                paths[path] = f
        owned = [k for f in self.fields if f.keys for k in f.type.known_keys()] + [p[0] for p in dict.fromkeys(p[:1] for p in paths)]
        if len(set(owned)) != len(owned):
            raise ModelError(f"{self.name}: a sibling key has two owners")
        for path in paths:
            if any(path[:k] in paths for k in range(1, len(path))):
                raise ModelError(f"{self.name}: {'.'.join(path)} lies inside another field")

    def wire(self, f: Field) -> str:
        return f.wire or (camel(f.name) if self.proto else f.name)

    def path(self, f: Field) -> tuple[str, ...]:
        if f.flatten:
            return tuple(f.flatten.split("."))
        return (*(f.wrap.split(".") if f.wrap else ()), self.wire(f))

    def known_keys(self) -> list[str]:
        found: dict[str, None] = {}
        for f in self.fields:
            if f.keys:
                found |= dict.fromkeys(f.type.known_keys())
            elif not f.ignored:
                found[self.path(f)[0]] = None
        return list(found)


@dataclass(frozen=True)
class Sealed:
    """Subclasses told apart by the string under ``discriminator``; ``fallback`` takes a missing or unknown one."""

    name: str
    options: dict[str, Model] = field(hash=False)
    discriminator: str = "type"
    fallback: str | None = None

    def __post_init__(self):
        if not self.options:
            raise ModelError(f"{self.name}: no subclasses")
        if self.fallback is not None and self.fallback not in self.options:
            raise ModelError(f"{self.name}: fallback {self.fallback} is no subclass")


@dataclass(frozen=True)
class Inferred:
    """Subclasses told apart by which keys are there: the first declared one that fits."""

    name: str
    options: dict[str, Model] = field(hash=False)

    def __post_init__(self):
        seen: dict[str, Any] = {}
        for model in self.options.values():
            for f in model.fields:
                if f.flatten or f.wrap or f.keys:
                    raise ModelError(f"{self.name}: flattened, wrapped or collected fields cannot be inferred")
                if seen.setdefault(model.wire(f), f.type) != f.type:
                    raise ModelError(f"{self.name}: {model.wire(f)} has two types")

    def known_keys(self) -> list[str]:
        return list(dict.fromkeys(k for m in self.options.values() for k in m.known_keys()))


@dataclass(frozen=True)
class Envelope:
    """A discriminator that names which payload field holds an opaque message (``payloads``: value -> field), or, with
    ``data_field``, what the one data field holds. ``targets``: value -> model of the typed message."""

    discriminator: str
    payloads: dict[str, str] = field(default_factory=dict, hash=False)
    fallback_field: str | None = None
    data_field: str | None = None
    targets: dict[str, Model] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if bool(self.payloads) == bool(self.data_field):
            raise ModelError("an envelope has payload fields or one data field")
        if self.data_field and self.fallback_field:
            raise ModelError("a data field needs no fallback")
        if len(set(self.payloads.values())) != len(self.payloads):
            raise ModelError("two discriminator values name one payload field")
        if not self.data_field and not set(self.targets) <= set(self.payloads):
            raise ModelError("a target without a payload field")


def check_type(kind: Any, proto: bool, where: str) -> None:
    if isinstance(kind, str):
        if kind not in SCALARS:
            raise ModelError(f"{where}: unknown type {kind}")
        if kind in PROTO_ONLY and not proto:
            raise ModelError(f"{where}: {kind} belongs to proto models")
    elif isinstance(kind, List):
        check_type(kind.item, proto, where)
    elif isinstance(kind, Map):
        check_type(kind.value, proto, where)
    elif not isinstance(kind, Model | Enum | Sealed | Inferred | Singleton | Codec):
        raise ModelError(f"{where}: unknown type {kind!r}")


def check_yaml(model: Model) -> None:
    """YAML models are flat: scalars, enums and collections of them."""
    for f in model.fields:
        if f.resilient or f.flatten or f.wrap or f.keys or f.decoder or f.encoder:
            raise ModelError(f"{model.name}.{f.name}: not in a YAML model")
        inner = f.type
        while isinstance(inner, List | Map):
            inner = inner.item if isinstance(inner, List) else inner.value
        if isinstance(inner, Model | Sealed | Inferred | Singleton | Codec) or inner == "json" or (inner == "bytes" and not model.proto):
            raise ModelError(f"{model.name}.{f.name}: not in a YAML model")


def unroll(build, depth: int = 3) -> Model:
    """A recursive model cut at a fixed depth: ``build(inner)`` gives the model around ``inner``; the last is JSON text."""
    model: Any = "json"
    for _ in range(depth):
        model = build(model)
    return model


def camel(name: str) -> str:
    """lowerCamelCase of a field name, the wire name of proto models."""
    head, *rest = [p for p in name.split("_") if p] or [name]
    return head[:1].lower() + head[1:] + "".join(p[:1].upper() + p[1:] for p in rest)


def spark_type(kind: Any) -> T.DataType:
    """The column type that a model's type decodes into."""
    if isinstance(kind, str):
        return SCALARS[kind]
    if isinstance(kind, Enum):
        return T.StringType()
    if isinstance(kind, Singleton):
        return T.BooleanType()
    if isinstance(kind, Codec):
        return T._parse_datatype_string(kind.spark_type)
    if isinstance(kind, List):
        return T.ArrayType(spark_type(kind.item))
    if isinstance(kind, Map):
        return T.MapType(T.StringType(), spark_type(kind.value))
    if isinstance(kind, Sealed | Inferred):
        return T.StructType([T.StructField("_type", T.StringType()), *(T.StructField(n, spark_type(m)) for n, m in kind.options.items())])
    made = []
    for f in kind.fields:
        made.append(T.StructField(f.name, T._parse_datatype_string(f.spark_type) if f.spark_type else spark_type(f.type)))
    return T.StructType(made)


def required(name: str, kind: Any, **options) -> Field:
    return Field(name, kind, **options)


def optional(name: str, kind: Any, **options) -> Field:
    """A nullable field without a default: absent is null."""
    return Field(name, kind, nullable=True, **options)


def defaulted(name: str, kind: Any, default: Any, nullable: bool = False, **options) -> Field:
    return Field(name, kind, default=default, has_default=True, nullable=nullable or default is None, **options)
