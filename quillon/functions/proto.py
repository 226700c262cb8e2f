"""proto3-JSON scalars: timestamps, durations, field masks, base64, 64-bit integers, well-known types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(?:[Zz]|([+-])(\d{2}):(\d{2}))$"
_SPAN = r"^(-?)(\d{1,12})(?:\.(\d{1,9}))?s$"


def _nanos(digits: Column) -> Column:
    return F.rpad(digits, 9, "0").cast("int")


def parse_timestamp(text: Column) -> Column:
    """RFC 3339 text as struct<seconds, nanos> since 1970; null if it is none."""
    part = lambda i: F.regexp_extract(text, _STAMP, i)
    at = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(" +00:00")), F.lit("yyyy-MM-dd HH:mm:ss XXX")))
    shift = F.when(part(4) == "", 0).otherwise((part(5).try_cast("int") * 3600 + part(6).try_cast("int") * 60) * F.when(part(4) == "-", -1).otherwise(1))
    made = F.struct((at - shift).cast("bigint").alias("seconds"), _nanos(part(3)).alias("nanos"))
    return F.when(text.rlike(_STAMP) & at.isNotNull(), made)


def _fraction(nanos: Column) -> Column:
    """0, 3, 6 or 9 digits."""
    digits = F.lpad(nanos.cast("string"), 9, "0")
    return (
        F.when(nanos == 0, "")
        .when(nanos % 1_000_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .when(nanos % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("."), digits))
    )


def format_timestamp(stamp: Column) -> Column:
    whole = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(stamp["seconds"]).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, _fraction(stamp["nanos"]), F.lit("Z"))


def parse_duration(text: Column) -> Column:
    """``-1.5s`` as struct<seconds, nanos>, both with the sign; null if it is none."""
    part = lambda i: F.regexp_extract(text, _SPAN, i)
    sign = F.when(part(1) == "-", -1).otherwise(1)
    made = F.struct((part(2).try_cast("bigint") * sign).alias("seconds"), (_nanos(part(3)) * sign).cast("int").alias("nanos"))
    return F.when(text.rlike(_SPAN), made)


def format_duration(span: Column) -> Column:
    sign = F.when((span["seconds"] < 0) | (span["nanos"] < 0), "-").otherwise("")
    return F.concat(sign, F.abs(span["seconds"]).cast("string"), _fraction(F.abs(span["nanos"])), F.lit("s"))


def parse_fieldmask(text: Column) -> Column:
    """``a.b,fooBar`` as ['a.b', 'foo_bar']; an empty text has no paths."""
    paths = F.transform(F.split(text, ","), lambda p: F.lower(F.regexp_replace(F.trim(p), "([A-Z])", "_$1")))
    return F.when(text.isNull(), None).otherwise(F.filter(paths, lambda p: p != ""))


def format_fieldmask(paths: Column) -> Column:
    def one(path: Column) -> Column:
        parts = F.split(path, "_")
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return F.array_join(F.transform(paths, one), ",")


def parse_base64(text: Column) -> Column:
    """Both alphabets, padding optional, white space skipped; null if it is none."""
    plain = F.rtrim(F.translate(F.regexp_replace(text, r"\s", ""), "-_=", "+/ "))
    padded = F.concat(plain, F.when(F.length(plain) % 4 == 2, "==").when(F.length(plain) % 4 == 3, "=").otherwise(""))
    return F.when(plain.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(plain) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def format_base64(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def parse_integer(text: Column, low: int, high: int) -> Column:
    """A number's text (quoted or not on the wire) as an exact integer in a range: 1.0 and 1e2 are, 1.5 is not."""
    d = F.when(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("decimal(38,9)"))
    return F.when((d == F.floor(d)) & (d >= F.lit(low).cast("decimal(38,0)")) & (d <= F.lit(str(high)).cast("decimal(38,0)")), d.cast("decimal(20,0)"))


def parse_float(text: Column) -> Column:
    """A number's text, or NaN, Infinity, -Infinity."""
    return F.when(text.isin("NaN", "Infinity", "-Infinity") | text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def format_float(value: Column) -> Column:
    """JSON text of a double: the special values are quoted names."""
    from .json import text_of

    return F.when(F.isnan(value), '"NaN"').when(value == float("inf"), '"Infinity"').when(value == float("-inf"), '"-Infinity"').otherwise(text_of(value))


def enum_name(text: Column, names: tuple[str, ...]) -> Column:
    """A name of the enum, or its number on the wire; null for others."""
    table = F.array(*map(F.lit, names))
    at = F.when(text.rlike(r"^[0-9]{1,9}$"), text.try_cast("int"))
    return F.when(text.isin(*names), text).when(at.isNotNull(), F.get(table, at))


def pack_any(type_name: str, payload: Column, prefix: str = "type.googleapis.com/") -> Column:
    return F.when(payload.isNotNull(), F.struct(F.lit(prefix + type_name).alias("type_url"), payload.alias("value")))


def unpack_any(packed: Column, type_name: str, dynamic: bool = False) -> Column:
    """The payload if the type fits; a mismatch is an error, or null if ``dynamic``."""
    fits = F.element_at(F.split(packed["type_url"], "/"), -1) == type_name
    wrong = F.lit(None).cast("string") if dynamic else F.raise_error(F.concat(F.lit(f"not a {type_name}: "), packed["type_url"]))
    return F.when(packed.isNull(), None).when(fits, packed["value"]).otherwise(wrong)


def dynamic_double(document: Column, path: str = "$") -> Column:
    """A number of a dynamic tree (Value, Struct, ListValue): always a double, whatever its text; null for other kinds."""
    v = F.try_variant_get(F.try_parse_json(document), path, "variant")
    number = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.when(number, F.try_variant_get(v, "$", "double"))
