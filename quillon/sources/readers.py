"""Files of documents as DataFrames with a text column, and back. NDJSON, whole files, encodings, YAML streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.yaml import json_to_yaml, yaml_documents
from ..operators.encode import encode


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """``document``: one row for each line that is not empty. Long files are split by line, nothing is inferred."""
    return spark.read.text(path).select(F.col("value").alias("document")).filter(F.trim("document") != "")


def write_ndjson(df: DataFrame, column: str, kind, path: str) -> None:
    """One JSON text to a line; rows with a null value are left out."""
    encode(df, column, kind, "__json").select("__json").filter("__json is not null").write.text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``document``, ``valid``: one row for each file, one document a file, in any Unicode encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").withColumn("t", transcode(F.col("content"))).select("path", F.col("t").alias("document"), F.col("t").isNotNull().alias("valid"))


def transcode(data: Column) -> Column:
    """Text of bytes in UTF-8, UTF-16 or UTF-32, by byte order mark or by where the first character's zero bytes are;
    null if the bytes are malformed."""
    head = F.hex(F.substring(data, 1, 4))
    n = F.octet_length(data)

    def cut(k: int) -> Column:
        return F.substring(data, k + 1, 1 << 30)

    def wide(bytes_: Column, charset: str) -> Column:
        digits = F.hex(bytes_)  # pairs of surrogates are checked on the digits: a decoder raises on half ones
        high, low, any_ = ("..D[89AB]", "..D[C-F]", "..D[89A-F]") if charset.endswith("LE") else ("D[89AB]..", "D[C-F]..", "D[89A-F]..")
        sound = digits.rlike(f"^(?:{high}{low}|(?!{any_})....)*+$")
        return F.when(F.octet_length(bytes_) % 2 != 0, None).when(sound, F.decode(bytes_, charset))

    utf8 = lambda bytes_: F.when(F.is_valid_utf8(bytes_.cast("string")), bytes_.cast("string"))
    return (
        F.when(head == "0000FEFF", utf32(cut(4), False))
        .when(head == "FFFE0000", utf32(cut(4), True))
        .when(head.startswith("EFBBBF"), utf8(cut(3)))
        .when(head.startswith("FEFF"), wide(cut(2), "UTF-16BE"))
        .when(head.startswith("FFFE"), wide(cut(2), "UTF-16LE"))
        .when((n >= 4) & head.startswith("000000"), utf32(data, False))
        .when((n >= 4) & head.rlike("^..000000$"), utf32(data, True))
        .when((n >= 2) & head.rlike("^00"), wide(data, "UTF-16BE"))
        .when((n >= 2) & head.rlike("^..00"), wide(data, "UTF-16LE"))
        .otherwise(utf8(data))
    )


def utf32(data: Column, little: bool) -> Column:
    """Text of UTF-32 bytes, code point by code point; null if one is out of range."""
    digits = F.hex(data)
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(data) / 4 - 1, F.lit(0)).cast("int")), lambda i: F.substr(digits, i * 8 + 1, F.lit(8)))
    if little:
        units = F.transform(units, lambda u: F.concat(*(F.substring(u, k, 2) for k in (7, 5, 3, 1))))
    points = F.transform(units, lambda u: F.conv(u, 16, 10).cast("bigint"))
    good = F.forall(points, lambda p: (p < 0x110000) & ~p.between(0xD800, 0xDFFF))

    def byte(x: Column) -> Column:
        return F.lpad(F.hex(x.cast("bigint")), 2, "0")

    def utf8(p: Column) -> Column:
        low = lambda s: F.shiftright(p, s).bitwiseAND(F.lit(63)) + 128
        return (
            F.when(p < 0x80, byte(p))
            .when(p < 0x800, F.concat(byte(F.shiftright(p, 6) + 192), byte(low(0))))
            .when(p < 0x10000, F.concat(byte(F.shiftright(p, 12) + 224), byte(low(6)), byte(low(0))))
            .otherwise(F.concat(byte(F.shiftright(p, 18) + 240), byte(low(12)), byte(low(6)), byte(low(0))))
        )

    text = F.unhex(F.array_join(F.transform(points, utf8), "")).cast("string")
    return F.when(F.octet_length(data) == 0, "").when((F.octet_length(data) % 4 == 0) & good, text)


def read_yaml(df: DataFrame, column: str) -> DataFrame:
    """A row for each YAML document of each text: ``position``, ``document`` (JSON text), ``yaml_error``. Texts that are no
    YAML give one row with the error."""
    read = df.withColumn("__y", yaml_documents(F.col(column)))
    return read.select(*df.columns, F.posexplode_outer("__y.json").alias("position", "document"), F.col("__y.error").alias("yaml_error"))


def read_yaml_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``position``, ``document``, ``yaml_error``: the documents of YAML files in any Unicode encoding."""
    return read_yaml(read_documents(spark, path).withColumnRenamed("document", "__text"), "__text").drop("__text", "valid")


def write_yaml(df: DataFrame, column: str, out: str = "yaml") -> DataFrame:
    """Adds block-style YAML of JSON texts."""
    return df.withColumn(out, json_to_yaml(F.col(column)))


def join_yaml(documents: Column) -> Column:
    """An array of YAML texts as one stream."""
    return F.array_join(documents, "---\n")
