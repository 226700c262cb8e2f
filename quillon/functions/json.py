"""Opaque JSON values as columns of text: kinds, scalar accessors, equality, pieces of JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of JSON numbers and plain integers.
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
INTEGER = r"^-?(0|[1-9][0-9]*)$"


def bind(value: Column, use) -> Column:
    """``use(x)`` with x evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def path_of(parts: tuple[str, ...]) -> str:
    """A JSON path with every key quoted."""
    return "$" + "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in parts)


def shown_path(parts: tuple[str, ...]) -> str:
    """A JSON path for people: plain keys with dots, odd ones quoted."""
    return "$" + "".join(f".{p}" if p.replace("_", "a").isalnum() and not p[0].isdigit() else f"['{p}']" for p in parts)


def kind_of_variant(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER, BOOLEAN or NULL; null where the variant is (no such value)."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return (
        F.when(v.isNull(), None)
        .when(name == "VOID", "NULL")
        .when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER")
        .otherwise(name)
    )


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def kind(raw: Column) -> Column:
    """The kind of a JSON text by its first token: containers by their first character, the rest checked whole."""
    t = trimmed(raw)
    return (
        F.when(raw.isNull(), None)
        .when(t.startswith("{"), "OBJECT")
        .when(t.startswith("["), "ARRAY")
        .when(t.startswith('"'), "STRING")
        .when(t.isin("true", "false"), "BOOLEAN")
        .when(t == "null", "NULL")
        .when(t.rlike(NUMBER), "NUMBER")
        .otherwise("INVALID")
    )


def is_json_null(raw: Column) -> Column:
    return trimmed(raw) == "null"


def as_boolean(raw: Column) -> Column:
    t = trimmed(raw)
    return F.when(t == "true", True).when(t == "false", False)


def as_long(raw: Column) -> Column:
    """A plain integer in the range of a long, else null."""
    t = trimmed(raw)
    return F.when(t.rlike(INTEGER), t.try_cast("bigint"))


def as_int(raw: Column) -> Column:
    t = trimmed(raw)
    return F.when(t.rlike(INTEGER), t.try_cast("int"))


def as_double(raw: Column) -> Column:
    """Any finite JSON number, else null."""
    t = trimmed(raw)
    d = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def as_string(raw: Column) -> Column:
    """The content of a JSON string, unescaped; null for everything else."""
    return F.when(trimmed(raw).startswith('"'), F.try_variant_get(F.try_parse_json(raw), "$", "string"))


def as_display_string(raw: Column) -> Column:
    return F.coalesce(as_string(raw), trimmed(raw))


def equal(a: Column, b: Column) -> Column:
    """Equality of the texts, byte by byte."""
    return a == b


def text_of(value: Column) -> Column:
    """The JSON text of a value of any type (null: null)."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "true"})
    return F.when(value.isNull(), "null").otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


#: Control characters, which no JSON text holds: they stand around numbers for a while.
_OPEN, _CLOSE = "\x01", "\x02"


def parsed_with_rest(text: Column) -> Column:
    """The variant of an array of the text's value and a mark after it. The parser stops behind the first value of a
    text; the mark is where it should be only if the text is one value and nothing else."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), _mark(text), F.lit("]")))


def _mark(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def only_value(with_rest: Column, text: Column) -> Column:
    """The text's value out of ``parsed_with_rest``; null if the text is not one JSON value."""
    parts = F.try_variant_get(with_rest, "$", "array<variant>")
    return bind(parts, lambda x: F.when((F.size(x) == 2) & (F.try_variant_get(F.get(x, F.lit(1)), "$", "bigint") == F.xxhash64(text)), F.get(x, F.lit(0))))


def half_characters(text: Column) -> Column:
    """Whether an escape of half a character (a surrogate) stands without its other half."""
    plain = F.regexp_replace(text, r"\\\\", "  ")  # escaped backslashes
    rest = F.regexp_replace(plain, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "")
    some = F.contains(text, F.lit("\\")) & (F.contains(text, F.lit("\\ud")) | F.contains(text, F.lit("\\uD")))
    return F.when(some, rest.rlike(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}")).otherwise(False)


def marked(document: Column) -> Column:
    """The document with its numbers as strings that start with a control character, so that reading and writing them
    keeps their text; ``unmarked`` turns them back."""
    around = F.regexp_replace(document, r'("(?:[^"\\]|\\.)*+")|(-?[0-9][0-9.eE+-]*+)', f"$1{_OPEN}$2{_CLOSE}")
    around = F.replace(around, F.lit(_OPEN + _CLOSE), F.lit(""))
    return F.replace(F.replace(around, F.lit(_OPEN), F.lit('"\\u0001')), F.lit(_CLOSE), F.lit('"'))


def unmarked(text: Column) -> Column:
    """The JSON text of a container or number that was read from a marked document."""
    inside = F.when(F.contains(text, F.lit('"\\u0001')), F.regexp_replace(text, r'"\\u0001([^"]*)"', "$1")).otherwise(text)
    return F.when(text.startswith(_OPEN), F.substr(text, F.lit(2))).otherwise(inside)


def capture(document: Column, *parts: str) -> Column:
    """The value under a path as JSON text: members in their order, numbers as they are written, no white space; null if
    absent."""
    named = "$" + "".join(f"['{p}']" for p in parts)

    def shown(v: Column) -> Column:
        kept = F.coalesce(bind(F.get_json_object(marked(document), named), unmarked), F.to_json(v))
        return F.when(v.isNull(), None).when(F.schema_of_variant(v) == "STRING", F.to_json(v)).when(F.schema_of_variant(v) == "VOID", "null").otherwise(kept)

    return bind(F.try_variant_get(F.try_parse_json(document), path_of(parts), "variant"), shown)  # both readings are made once


def members(pairs: list[tuple[Column | str, Column | None]]) -> Column:
    """A JSON object's text of (name, JSON text or null to leave the member out)."""
    made = [F.concat(F.lit('"' + n.replace("\\", "\\\\").replace('"', '\\"') + '":') if isinstance(n, str) else F.concat(text_of(n), F.lit(":")), v) for n, v in pairs]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*made)) if made else F.array().cast("array<string>"), ","), F.lit("}"))


def elements(values: Column) -> Column:
    """A JSON array's text of an array of JSON texts (null elements: null)."""
    return F.concat(F.lit("["), F.array_join(values, ",", "null"), F.lit("]"))


def deeper_than(document: Column, most: int) -> Column:
    """Whether brackets outside strings nest deeper than ``most``; counted only where there are that many."""
    outside = F.regexp_replace(F.regexp_replace(document, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.split(outside, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))
    deepest = F.aggregate(steps, start, lambda s, d: F.struct((s["at"] + d).alias("at"), F.greatest(s["top"], s["at"] + d).alias("top")), lambda s: s["top"])
    openers = F.length(document) - F.length(F.translate(document, "[{", ""))
    return F.when(F.octet_length(document) <= 2 * most, F.lit(False)).when(openers > most, deepest > most).otherwise(F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
