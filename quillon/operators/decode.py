"""Decoding: a column of JSON text and a model become a column of values and a column of errors.

The document is parsed once, into a VARIANT column; each field is an expression over paths of that column. Every
(sub)expression yields value and error together and is bound once, so nested models do not multiply the work. The first
error in the order of the fields counts, so every field is read, whether a query uses it or not.

Opaque parts (``json`` fields, and what custom decoders get) keep their members' order and the text of their numbers:
for models that have such parts a second reading of the document, with its numbers as strings, goes along (``kept``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json as J
from ..functions import proto as P
from ..model import DYNAMIC, INTEGERS, MAX_DEPTH, MAX_ITEMS, Codec, Enum, Envelope, Field, Inferred, List, Map, Model, ModelError, Sealed, Singleton, check_yaml, spark_type
from .errors import error, explained

#: Fixed lists: texts that stand for true and false under coercion.
TRUE, FALSE = ("1", "y", "on", "yes", "true"), ("0", "n", "no", "off", "false")

NONE = "struct<path:string,code:string>"


@dataclass(frozen=True)
class Options:
    """``coerce_numbers`` and ``coerce_booleans`` accept quoted values; ``strict`` makes unknown keys errors."""

    coerce_numbers: bool = False
    coerce_booleans: bool = False
    strict: bool = False
    yaml: bool = False  # scalars as the YAML reader takes them


def _pair(value: Column, err: Column | None, kind: T.DataType) -> Column:
    return F.struct(value.cast(kind).alias("value"), (err if err is not None else F.lit(None)).cast(NONE).alias("error"))


def _decoded(v: Column, k: Column, kind: Any, where: Column, o: Options, proto: bool, kept: Column | None = None, p: Column | None = None) -> Column:
    """struct<value, error> of a variant that is there and not JSON null. ``k``: its kind code; ``where``: its path as text;
    ``p``: its plain reading, if that is at hand."""
    made = spark_type(kind)
    if isinstance(kind, Model):
        return _object(v, k, kind, where, o, kept=kept)
    if isinstance(kind, Sealed):
        return _sealed(v, k, kind, where, o, kept=kept)
    if isinstance(kind, Inferred):
        return _inferred(v, k, kind, where, o, kept=kept)
    if isinstance(kind, Singleton):
        return _outcome(F.lit(True), F.when(k != "OB", "kind"), where, made)
    if isinstance(kind, List):
        return _list(v, kind, where, o, proto, kept)
    if isinstance(kind, Map):
        return _map(v, kind, where, o, proto, kept)
    if isinstance(kind, Enum):
        return _enum(v, k, kind, where, proto)
    if kind == "json":
        return _pair(_as_written(v, k, kept), None, made)
    if isinstance(kind, Codec):
        found = kind.decoder(_as_written(v, k, kept)).cast(made)
        return _outcome(found, F.when(found.isNull(), "format"), where, made)
    if kind in DYNAMIC:
        return _outcome(v, F.when(k != DYNAMIC[kind], "kind") if DYNAMIC[kind] else F.lit(None), where, made)
    return _scalar(v, k, kind, where, o, proto, made, _plain(v, kind) if p is None else p)


def _as_written(v: Column, k: Column, kept: Column | None) -> Column:
    """The JSON text of an opaque value."""
    return F.to_json(v) if kept is None else F.when(k == "ST", F.to_json(v)).otherwise(F.coalesce(J.unmarked(kept), F.to_json(v)))


def _opaque(kind: Any) -> T.DataType | None:
    """The type by which ``from_json`` reads the opaque parts of a type; None if it has none."""
    if kind == "json" or isinstance(kind, Codec):
        return T.StringType()
    if isinstance(kind, List | Map):
        inner = _opaque(kind.item if isinstance(kind, List) else kind.value)
        return None if inner is None else T.ArrayType(inner) if isinstance(kind, List) else T.MapType(T.StringType(), inner)
    tree: dict = {}
    for model in kind.options.values() if isinstance(kind, Sealed | Inferred) else (kind,) if isinstance(kind, Model) else ():
        _put_opaque(model, tree)
    return _tree_type(tree)


def _put_opaque(model: Model, tree: dict) -> None:
    for f in model.fields:
        if f.ignored:
            continue
        if f.keys:
            for inner in f.type.options.values() if isinstance(f.type, Inferred) else (f.type,):
                _put_opaque(inner, tree)
        elif (kind := T.StringType() if f.decoder is not None else _opaque(f.type)) is not None:
            at, parts = tree, model.path(f)
            for p in parts[:-1]:
                at = at.setdefault(p, {}) if isinstance(at, dict) else at
            if not isinstance(at, dict) or at.setdefault(parts[-1], kind) != kind:
                raise ModelError(f"{model.name}.{f.name}: two subclasses differ in what is opaque there")


def _tree_type(tree: dict) -> T.StructType | None:
    return T.StructType([T.StructField(k, _tree_type(x) if isinstance(x, dict) else x) for k, x in tree.items()]) if tree else None


def _kept_at(kept: Column | None, kind: Any, parts: tuple[str, ...]) -> Column | None:
    """What stands at a path of the second reading, if a value of that type has opaque parts."""
    if kept is None or kind is None:
        return None
    for p in parts:
        kept = kept.getField(p)
    return kept


def _code(v: Column) -> Column:
    """The kind of a variant as two letters of its type's name (see NUMBERS); null if there is none."""
    return F.substring(F.schema_of_variant(v), 1, 2)


#: Kind codes: OB object, AR array, ST string, BO boolean, VO null, and those of numbers.
NUMBERS = ("BI", "DE", "DO", "FL")


def _cell(v: Column, use, kind: Any = None) -> Column:
    """``use(variant, kind code, plain reading)`` with each evaluated once; see ``_plain`` for the last."""
    parts = lambda x: F.struct(x.alias("v"), _code(x).alias("k"), *([p.alias("p")] if (p := _plain(x, kind)) is not None else []))
    return J.bind(v, lambda x: J.bind(parts(x), lambda c: use(c["v"], c["k"], c["p"] if _plain(x, kind) is not None else None)))


def _plain(v: Column, kind: Any) -> Column | None:
    """What most variants of a scalar type are read as, whatever their kind; None for other types."""
    to = "bigint" if kind in ("byte", "short", "int", "long", "uint") else kind if kind in ("double", "boolean", "string") else None
    return None if to is None else F.try_variant_get(v, "$", to)


def _outcome(value: Column, code: Column, where: Column, made: T.DataType) -> Column:
    """The value, or the error of the code where the code is not null."""
    return F.when(code.isNull(), _pair(value, None, made)).otherwise(_pair(F.lit(None), error(where, code), made))


def _text(v: Column, k: Column) -> Column:
    """The text of a scalar variant: strings as they are, numbers as JSON."""
    return F.when(k == "ST", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _scalar(v: Column, k: Column, kind: str, where: Column, o: Options, proto: bool, made: T.DataType, p: Column | None) -> Column:
    get = lambda to: F.try_variant_get(v, "$", to)
    number = k.isin(*NUMBERS)
    if kind in ("string", "char"):
        value = F.when(k == "ST", get("string") if p is None else p)
        if o.yaml:
            value = F.when(k.isin("ST", "BO", *NUMBERS), _text(v, k))
        wrong = F.when(value.isNull(), "kind")
        return _outcome(value, wrong.when(F.char_length(value) != 1, "char") if kind == "char" else wrong, where, made)
    if kind == "boolean":
        value = F.when(k == "BO", p)
        if o.coerce_booleans:
            word = F.lower(F.when(k.isin("ST", *NUMBERS), _text(v, k)))
            value = F.coalesce(value, F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False))
        if o.yaml:
            value = F.coalesce(value, F.when(k == "ST", get("string") == "true"))
        return _outcome(value, F.when(value.isNull(), "kind"), where, made)
    if kind in INTEGERS:
        low, high = INTEGERS[kind]
        if proto:
            value = P.parse_integer(F.when(k.isin("ST", *NUMBERS), _text(v, k)), low, high)
            return _outcome(value, F.when(~k.isin("ST", *NUMBERS), "kind").when(value.isNull(), "range"), where, made)

        def rest(v: Column, k: Column) -> Column:
            """By decimal arithmetic: what is not one of the quick cases, and errors."""
            number, d, s = k.isin(*NUMBERS), F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
            exact = F.when(number, F.when(k == "DO", F.when(F.abs(d) < 1.9e19, d).cast("decimal(38,9)")).otherwise(F.try_variant_get(v, "$", "decimal(38,9)")))
            if o.coerce_numbers or o.yaml:
                exact = F.coalesce(exact, F.when((k == "ST") & s.rlike(J.NUMBER if o.yaml else J.INTEGER), s.try_cast("decimal(38,9)")))
            whole = F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact)).cast("decimal(38,0)")
            fits = whole.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
            known = F.when(~number & exact.isNull(), "kind").when(exact.isNull() | ~fits, "range")
            if o.yaml and o.coerce_numbers:
                known = F.when(number & (exact.isNull() | ~fits), "range").when(~k.isin("ST", *NUMBERS), "kind")
                whole = F.coalesce(whole, F.when(k == "ST", F.lit(0)))
            return _outcome(F.when(fits | exact.isNull(), whole), known, where, made)

        s = get("string")
        slow = J.bind(F.struct(v.alias("v"), k.alias("k")), lambda c: rest(c["v"], c["k"]))  # not part of the generated code
        if kind == "ulong":
            return slow
        within = p.isNotNull() if kind == "long" else p.between(low, high)
        quick = F.when(number & within, _pair(p, None, made))  # most numbers: no decimal arithmetic
        if o.coerce_numbers or o.yaml:
            quick = quick.when((k == "ST") & s.rlike(J.INTEGER) & within, _pair(p, None, made))
        return quick.otherwise(slow)
    if kind in ("float", "double"):
        if proto:
            value = P.parse_float(F.when(k.isin("ST", *NUMBERS), _text(v, k)))
            return _outcome(value, F.when(value.isNull(), "kind"), where, made)
        value = F.when(number, get("double") if p is None else p)
        if o.coerce_numbers or o.yaml:
            s = get("string")
            value = F.coalesce(value, F.when((k == "ST") & s.rlike(J.NUMBER), s.try_cast("double")))
        if o.yaml and o.coerce_numbers:
            value = F.coalesce(value, F.when(k == "ST", F.lit(0.0)))
        top = 3.4028234663852886e38 if kind == "float" else 1.7976931348623157e308
        return _outcome(value, F.when(value.isNull(), "kind").when(F.abs(value) > top, "range"), where, made)
    text = F.when(k == "ST", get("string"))
    if kind == "any":
        value = F.when(k == "OB", F.struct(F.try_variant_get(v, "$['@type']", "string").alias("type_url"), F.to_json(F.try_variant_get(v, "$.value", "variant")).alias("value")))
        return _outcome(value, F.when(value.isNull(), "kind").when(value["type_url"].isNull(), "format"), where, made)
    parse = {"bytes": P.parse_base64, "timestamp": P.parse_timestamp, "duration": P.parse_duration, "fieldmask": P.parse_fieldmask}[kind]
    value = parse(text)
    return _outcome(value, F.when(k != "ST", "kind").when(value.isNull(), "format"), where, made)


def _enum(v: Column, k: Column, kind: Enum, where: Column, proto: bool) -> Column:
    value = P.enum_name(F.when(k.isin("ST", *NUMBERS), _text(v, k)), kind.names) if proto else F.when(k == "ST", F.try_variant_get(v, "$", "string"))
    value = F.when(value.isin(*kind.names), value)
    text = k.isin("ST", *NUMBERS) if proto else k == "ST"
    if kind.other is not None:
        value = F.coalesce(value, F.when(text, kind.other))
    return _outcome(value, F.when(~text, "kind").when(value.isNull(), "enum"), where, T.StringType())


def _element(x: Column, kind: Any, where: Column, o: Options, proto: bool, nullable: bool, kept: Column | None) -> Column:
    made = spark_type(kind)
    absent = _pair(F.lit(None), None if nullable else error(where, "null"), made)
    return _cell(x, lambda v, k, p: F.when(k == "VO", absent).otherwise(_decoded(v, k, kind, where, o, proto, kept, p)), kind)


def _taken_apart(model: Model) -> str | None:
    """The type that takes the fields' variants of all objects of an array in one go; None if some lie deeper."""
    if model.strict or any(f.keys or len(model.path(f)) > 1 for f in model.fields if not f.ignored):
        return None
    names = [model.path(f)[0].replace("`", "``") for f in model.fields if not f.ignored]
    return f"array<struct<{', '.join(f'`{n}`: variant' for n in names)}>>" if names else None


def _drops(kind: Any) -> bool:
    return isinstance(kind, Model) and kind.resilient


def _list(v: Column, kind: List, where: Column, o: Options, proto: bool, kept: Column | None) -> Column:
    made = spark_type(kind)
    kept = kept if _opaque(kind) is not None else None
    drop = _drops(kind.item)
    taken = _taken_apart(kind.item) if drop and not o.strict else None
    items = F.try_variant_get(v, "$", taken or "array<variant>")

    def taken_apart(x: Column, i: Column) -> Column:
        """An element of which each field's variant was taken in one go; what is no object is null."""
        at = F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))
        inside = None if kept is None else F.get(kept, i)

        def field(f: Field) -> Column:
            if f.ignored:
                return _field(F.lit(None), kind.item, f, at, o)
            cell = lambda raw, k, p: _field(raw, kind.item, f, at, o, (raw, k, p), inside)
            return _cell(x.getField(kind.item.path(f)[0]), cell, f.type if f.decoder is None else None)

        each = F.struct(*(field(f).alias(f"f{n}") for n, f in enumerate(kind.item.fields)))
        read = J.bind(each, lambda s: _gathered(x, kind.item, [s[f"f{n}"] for n in range(len(kind.item.fields))], at, o))
        return F.when(x.isNull(), _pair(F.lit(None), None, spark_type(kind.item))).otherwise(read)

    def decoded(xs: Column) -> Column:
        each = F.transform(xs, taken_apart) if taken else F.transform(xs, lambda x, i: _element(x, kind.item, F.concat(where, F.lit("["), i.cast("string"), F.lit("]")), o, proto, kind.item_nullable or drop, None if kept is None else F.get(kept, i)))

        def gathered(es: Column) -> Column:
            values = F.transform(es, lambda e: e["value"])
            if drop:  # what did not decode goes, and genuine nulls with it
                return _pair(F.filter(values, lambda x: x.isNotNull()), None, made)
            first = F.get(F.filter(es, lambda e: e["error"].isNotNull()), F.lit(0))["error"]
            values = F.array_distinct(values) if kind.unique else values
            wrong = F.coalesce(F.when(F.size(es) > MAX_ITEMS + 1, error(where, "size")), first)
            return F.when(wrong.isNull(), _pair(values, None, made)).otherwise(_pair(F.lit(None), wrong, made))

        return J.bind(each, gathered)

    return F.when(items.isNull(), _pair(F.lit(None), error(where, "kind"), made)).otherwise(decoded(items))


def _map(v: Column, kind: Map, where: Column, o: Options, proto: bool, kept: Column | None) -> Column:
    made = spark_type(kind)
    kept = kept if _opaque(kind) is not None else None
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))

    def decoded(xs: Column) -> Column:
        each = F.transform(xs, lambda x: F.struct(x["key"].alias("key"), _element(x["value"], kind.value, F.concat(where, F.lit("."), x["key"]), o, proto, True, None if kept is None else F.try_element_at(kept, x["key"])).alias("v")))

        def gathered(es: Column) -> Column:
            values = F.map_from_entries(F.transform(es, lambda e: F.struct(e["key"], e["v"]["value"])))
            first = F.get(F.filter(es, lambda e: e["v"]["error"].isNotNull()), F.lit(0))["v"]["error"]
            return F.when(first.isNull(), _pair(values, None, made)).otherwise(_pair(F.lit(None), first, made))

        return J.bind(each, gathered)

    return F.when(entries.isNull(), _pair(F.lit(None), error(where, "kind"), made)).otherwise(decoded(entries))


def _default(f: Field, made: T.DataType) -> Column:
    if not f.has_default or f.default is None:
        return F.lit(None).cast(made)
    if isinstance(made, T.StructType | T.ArrayType | T.MapType):
        import json as text

        return F.from_json(F.lit(text.dumps(f.default)), made)
    return F.lit(f.default).cast(made)


def _raw(v: Column, model: Model, f: Field) -> Column:
    return F.try_variant_get(v, J.path_of(model.path(f)), "variant")


def _field(v: Column, model: Model, f: Field, where: Column, o: Options, cell: tuple | None = None, kept: Column | None = None) -> Column:
    """struct<value, error> of a field of the object in ``v``. ``cell``: the field's own variant, kind code and plain reading."""
    made = T._parse_datatype_string(f.spark_type) if f.spark_type else spark_type(f.type)
    if f.ignored:
        return _pair(_default(f, made), None, made)
    if f.keys:
        return _collected(v, f, where, o, made, kept)
    kept = _kept_at(kept, f.decoder or _opaque(f.type), model.path(f))
    use = lambda raw, k, p: _present(v, raw, k, model, f, where, o, made, kept, p)
    return use(*cell) if cell else _cell(_raw(v, model, f), use, f.type if f.decoder is None else None)


def _present(v: Column, raw: Column, k: Column, model: Model, f: Field, where: Column, o: Options, made: T.DataType, kept: Column | None, p: Column | None = None) -> Column:
    parts = model.path(f)
    here = F.concat(where, F.lit(J.shown_path(parts)[1:]))
    default = _default(f, made)
    if f.decoder is not None:
        found = f.decoder(_as_written(raw, k, kept)).cast(made)
        read = _outcome(found, F.when(found.isNull(), "format"), here, made)
    else:
        read = _decoded(raw, k, f.type, here, o, model.proto, kept, p)
    absent = _pair(default, None, made) if f.optional else _pair(F.lit(None), error(here, "missing"), made)
    null = _pair(F.lit(None), None, made) if f.nullable else _pair(F.lit(None), error(here, "null"), made)
    if model.proto and f.has_default:
        null = _pair(default, None, made)  # proto3 JSON: null is the default
    if o.yaml and not f.nullable and f.type == "string":
        null = _pair(F.lit(""), None, made)
    if f.resilient:
        null = fallback = absent
        read = J.bind(read, lambda r: F.when(r["error"].isNull(), r).otherwise(fallback))
    if len(parts) > 1:
        on_way = F.lit(None).cast(NONE)
        for n in range(len(parts) - 1, 0, -1):
            step = _code(F.try_variant_get(v, J.path_of(parts[:n]), "variant"))
            on_way = F.when(step != "OB", error(F.concat(where, F.lit(J.shown_path(parts[:n])[1:])), "path")).otherwise(on_way)
        missing = absent
        absent = missing if f.resilient else J.bind(on_way, lambda w: F.when(w.isNotNull(), _pair(F.lit(None), w, made)).otherwise(missing))
    return F.when(k.isNull(), absent).when(k == "VO", null).otherwise(read)


def _collected(v: Column, f: Field, where: Column, o: Options, made: T.DataType, kept: Column | None) -> Column:
    """A nested model whose keys stand among the field's siblings."""
    inner = f.type
    there = [(raw := F.try_variant_get(v, J.path_of((key,)), "variant")).isNotNull() & ~F.is_variant_null(raw) for key in inner.known_keys()]
    plain = Options(o.coerce_numbers, o.coerce_booleans, False, o.yaml)
    read = (_inferred if isinstance(inner, Inferred) else _object)(v, F.lit("OB"), inner, where, plain, kept=kept)
    nothing = _pair(F.lit(None), None, made)
    if f.omit == "empty":
        return F.when(~J.any_of(there), nothing).otherwise(read)
    if f.omit == "absent":
        return F.when(J.any_of([~t for t in there]), nothing).otherwise(read)
    if f.resilient:
        return J.bind(read, lambda r: F.when(r["error"].isNull(), r).otherwise(nothing))
    return read


def _gathered(v: Column, model: Model, parts: list[Column], where: Column, o: Options, also: tuple[str, ...] = ()) -> Column:
    """struct<value, error> of an object from those of its fields."""
    made = spark_type(model)
    first = F.coalesce(*(p["error"] for p in parts), F.lit(None).cast(NONE))
    if o.strict or model.strict:
        extra = F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, (*model.known_keys(), *also))))
        first = F.coalesce(F.when(F.size(extra) > 0, error(F.concat(where, F.lit("."), F.get(extra, F.lit(0))), "unknown")), first)
    value = F.struct(*(p["value"].alias(f.name) for p, f in zip(parts, model.fields)))
    return F.when(first.isNull(), _pair(value, None, made)).otherwise(_pair(F.lit(None), first, made))


def _object(v: Column, k: Column, model: Model, where: Column, o: Options, also: tuple[str, ...] = (), kept: Column | None = None) -> Column:
    made = spark_type(model)
    each = F.struct(*(_field(v, model, f, where, o, None, kept).alias(f"f{i}") for i, f in enumerate(model.fields)))
    read = J.bind(each, lambda s: _gathered(v, model, [s[f"f{i}"] for i in range(len(model.fields))], where, o, also))
    return F.when(k != "OB", _pair(F.lit(None), error(where, "kind"), made)).otherwise(read)


def _tagged(options: dict[str, Model], name: str, made: T.StructType):
    """From struct<value, error> of a subclass to that of the tagged struct."""

    def tag(inner: Column) -> Column:
        value = F.struct(F.lit(name).alias("_type"), *((inner["value"] if n == name else F.lit(None)).cast(made[n].dataType).alias(n) for n in options))
        return F.when(inner["error"].isNull(), _pair(value, None, made)).otherwise(_pair(F.lit(None), inner["error"], made))

    return tag


def _sealed(v: Column, k: Column, kind: Sealed, where: Column, o: Options, kept: Column | None = None) -> Column:
    made = spark_type(kind)
    here = F.concat(where, F.lit(J.shown_path((kind.discriminator,))[1:]))
    read = lambda n: J.bind(_object(v, k, kind.options[n], where, o, (kind.discriminator,), kept), _tagged(kind.options, n, made))

    def chosen(raw: Column, raw_k: Column, _: Column | None) -> Column:
        name = F.when(raw_k == "ST", F.try_variant_get(raw, "$", "string"))
        if kind.fallback is not None:
            other = read(kind.fallback)
        else:
            other = _pair(F.lit(None), F.when(name.isNull(), error(here, "discriminator")).otherwise(error(here, "subclass")), made)
        out = F.when(k != "OB", _pair(F.lit(None), error(where, "kind"), made))
        for n in kind.options:
            if n != kind.fallback:
                out = out.when(name == n, read(n))
        return out.otherwise(other)

    return _cell(F.try_variant_get(v, J.path_of((kind.discriminator,)), "variant"), chosen)


def _inferred(v: Column, k: Column, kind: Inferred, where: Column, o: Options, kept: Column | None = None) -> Column:
    made = spark_type(kind)
    every = kind.known_keys()
    has = {key: F.try_variant_get(v, J.path_of((key,)), "variant").isNotNull() for key in every}
    chosen = F.when(k != "OB", _pair(F.lit(None), error(where, "kind"), made))
    for n, m in kind.options.items():
        own = m.known_keys()
        fits = ~J.any_of([has[key] for key in every if key not in own])
        for f in m.fields:
            if not f.optional:
                fits = fits & has[m.wire(f)]
        fits = fits & J.any_of([has[key] for key in own])
        chosen = chosen.when(fits, J.bind(_object(v, k, m, where, o, kept=kept), _tagged(kind.options, n, made)))
    return chosen.otherwise(_pair(F.lit(None), error(where, "inference"), made))


def _second_reading(text: Column, opaque: T.DataType) -> Column:
    """The opaque parts of a document, see ``_opaque``, with their numbers marked."""
    if opaque == T.StringType():
        return F.from_json(F.concat(F.lit('{"v":'), J.marked(text), F.lit("}")), T.StructType([T.StructField("v", opaque)]))["v"]
    return F.from_json(J.marked(text), opaque, {"allowNonNumericNumbers": "false"})


def prepare(spark) -> None:
    """Session settings that decoding relies on: of duplicate keys the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def decode(df: DataFrame, column: str, kind: Any, options: Options | None = None, value: str = "value", err: str = "error", mode: str = "permissive") -> DataFrame:
    """Adds ``value`` and ``error`` (path, code, message, hint) of the documents in ``column`` (text, or UTF-8 bytes).

    ``mode``: ``permissive`` keeps all rows, ``drop`` drops those with an error, ``failfast`` raises the first error. A null
    document has a null value and no error.
    """
    prepare(df.sparkSession)
    o = options or Options()
    if mode not in ("permissive", "drop", "failfast"):
        raise ModelError(f"unknown mode {mode}")
    if o.yaml and isinstance(kind, Model):
        check_yaml(kind)
    text = F.col(column) if df.schema[column].dataType == T.StringType() else F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string"))
    made = spark_type(kind)
    root = F.lit("$")
    docs = df.withColumns({"__both": J.parsed_with_rest(text), "__deep": F.coalesce(J.deeper_than(text, MAX_DEPTH), F.lit(False)), "__half": F.coalesce(J.half_characters(text), F.lit(False))})
    docs = docs.withColumn("__doc", F.when(~F.col("__half"), J.only_value(F.col("__both"), text))).withColumn("__k", _code(F.col("__doc")))
    opaque = _opaque(kind)
    docs = docs if opaque is None else docs.withColumn("__kept", _second_reading(text, opaque))
    kept = None if opaque is None else F.col("__kept")
    doc, k = F.col("__doc"), F.col("__k")
    wrong = F.when(F.col(column).isNull(), None).when(doc.isNull(), error(root, "syntax")).when(F.col("__deep"), error(root, "depth")).when(k == "VO", error(root, "null"))
    unread = doc.isNull() | F.col("__deep") | (k == "VO")
    if isinstance(kind, Model):
        # Each field's variant, then its kind, then its value and error are columns of their own: each is evaluated once.
        plain = [i for i, f in enumerate(kind.fields) if not f.ignored and not f.keys]
        docs = docs.withColumns({f"__v{i}": _raw(doc, kind, kind.fields[i]) for i in plain})
        read_as = {i: p for i in plain if kind.fields[i].decoder is None and (p := _plain(F.col(f"__v{i}"), kind.fields[i].type)) is not None}
        docs = docs.withColumns({f"__k{i}": _code(F.col(f"__v{i}")) for i in plain} | {f"__p{i}": p for i, p in read_as.items()})
        docs = docs.withColumns({f"__f{i}": _field(doc, kind, f, root, o, (F.col(f"__v{i}"), F.col(f"__k{i}"), F.col(f"__p{i}") if i in read_as else None) if i in plain else None, kept) for i, f in enumerate(kind.fields)})
        parts = [F.col(f"__f{i}") for i in range(len(kind.fields))]
        read = F.when(k != "OB", _pair(F.lit(None), error(root, "kind"), made)).otherwise(_gathered(doc, kind, parts, root, o))
    else:
        read = _decoded(doc, k, kind, root, o, False, kept)
    staged = docs.withColumn("__read", F.when(unread, _pair(F.lit(None), wrong, made)).otherwise(read))
    # A filter on the value must not be pushed down as a second copy of the whole expression; it stops at a generator.
    # An outer one, though its array is never empty: for others Spark infers a filter on the array's size and pushes that
    # down, with hundreds of copies of what it reads.
    staged = staged.select(*df.columns, F.explode_outer(F.array("__read")).alias("__read"))
    out = staged.select(*(c for c in df.columns if c not in (value, err)), F.col("__read.value").alias(value), explained(F.col("__read.error")).alias(err))
    if mode == "drop":
        return out.filter(F.col(err).isNull())
    if mode == "failfast":
        said = F.concat(F.col(err)["message"], F.lit(" at "), F.col(err)["path"])
        return out.withColumn(value, F.when(F.col(err).isNull(), F.col(value)).otherwise(F.raise_error(said).cast(made)))
    return out


def _routed(df: DataFrame, column: str, envelope: Envelope) -> DataFrame:
    """Adds ``__doc``, the discriminator's ``__name`` and the ``__payload`` it points at, each evaluated once."""
    prepare(df.sparkSession)
    keys = [envelope.data_field] if envelope.data_field else [*envelope.payloads.values(), *filter(None, [envelope.fallback_field])]
    both = df.withColumns({"__both": J.parsed_with_rest(F.col(column)), "__kept": _second_reading(F.col(column), T.StructType([T.StructField(k, T.StringType()) for k in dict.fromkeys(keys)]))})
    docs = both.withColumn("__doc", J.only_value(F.col("__both"), F.col(column)))
    doc = F.col("__doc")
    name = F.try_variant_get(doc, J.path_of((envelope.discriminator,)), "string")

    def text(key: str) -> Column:
        v = F.try_variant_get(doc, J.path_of((key,)), "variant")
        return F.when(~F.is_variant_null(v), _as_written(v, _code(v), F.col("__kept").getField(key)))

    if envelope.data_field:
        chosen = text(envelope.data_field)
    else:
        chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for named, key in envelope.payloads.items():
            chosen = chosen.when(F.col("__name") == named, text(key))
        chosen = chosen.otherwise(text(envelope.fallback_field) if envelope.fallback_field else F.lit(None))
    return docs.withColumn("__name", name).withColumn("__payload", chosen)


def route(df: DataFrame, column: str, envelope: Envelope, payload: str = "payload") -> DataFrame:
    """Adds ``payload``: the opaque JSON text that an envelope's discriminator points at; null if it points at nothing."""
    return _routed(df, column, envelope).select(*(c for c in df.columns if c != payload), F.col("__payload").alias(payload))


def route_typed(df: DataFrame, column: str, envelope: Envelope, payload: str = "payload", value: str = "value", err: str = "error") -> DataFrame:
    """As ``route``, and the payload decoded by its target as a tagged struct; types without a target keep the text alone."""
    options = envelope.targets
    made = T.StructType([T.StructField("_type", T.StringType()), *(T.StructField(n, spark_type(m)) for n, m in options.items())])
    routed = _routed(df, column, envelope)
    at = {n: envelope.data_field or envelope.payloads[n] for n in options}
    read = F.when(F.col("__payload").isNull(), _pair(F.lit(None), None, made))
    for n, m in options.items():
        opaque = _opaque(m)
        kept = None if opaque is None else _second_reading(F.col("__payload"), opaque)
        part = F.try_variant_get(F.col("__doc"), J.path_of((at[n],)), "variant")  # the payload's own part, parsed with the rest
        read = read.when(F.col("__name") == n, J.bind(_cell(part, lambda v, k, _, m=m, kept=kept: _object(v, k, m, F.lit("$"), Options(), kept=kept)), _tagged(options, n, made)))
    staged = routed.withColumn("__read", read.otherwise(_pair(F.lit(None), None, made)))
    staged = staged.select(*df.columns, "__payload", F.explode_outer(F.array("__read")).alias("__read"))  # see decode
    return staged.select(*(c for c in df.columns if c not in (payload, value, err)), F.col("__payload").alias(payload), F.col("__read.value").alias(value), explained(F.col("__read.error")).alias(err))


def unpack_dynamic(df: DataFrame, column: str, registry: dict[str, Model], value: str = "value", err: str = "error") -> DataFrame:
    """Adds the payloads of ``any`` structs in ``column``, decoded by the model that the last part of their type URL names,
    as a tagged struct; a type that the registry does not know is null without an error."""
    prepare(df.sparkSession)
    made = T.StructType([T.StructField("_type", T.StringType()), *(T.StructField(n, spark_type(m)) for n, m in registry.items())])
    packed = F.col(column)
    docs = df.withColumns({"__name": F.element_at(F.split(packed["type_url"], "/"), -1), "__doc": F.try_parse_json(packed["value"])})
    read = F.when(F.col("__doc").isNull(), _pair(F.lit(None), None, made))
    for n, m in registry.items():
        opaque = _opaque(m)
        kept = None if opaque is None else _second_reading(packed["value"], opaque)
        read = read.when(F.col("__name") == n, J.bind(_cell(F.col("__doc"), lambda v, k, _, m=m, kept=kept: _object(v, k, m, F.lit("$"), Options(), kept=kept)), _tagged(registry, n, made)))
    staged = docs.withColumn("__read", read.otherwise(_pair(F.lit(None), None, made))).select(*df.columns, F.explode_outer(F.array("__read")).alias("__read"))
    return staged.select(*(c for c in df.columns if c not in (value, err)), F.col("__read.value").alias(value), explained(F.col("__read.error")).alias(err))
