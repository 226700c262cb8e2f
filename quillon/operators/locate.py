"""Where in a document an error is: line and column.

Decoding knows an error's path, not its place. Places are looked up here, in an Arrow-batched UDF, for the rows that
have an error; the others cost nothing but a null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"\.([^.\[]+)|\[\'(.*?)\'\]|\[(\d+)\]")
_SPACE = re.compile(r"[ \t\r\n]*")


def _after(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def place_of(text: str, path: str) -> int | None:
    """The offset of what stands at a path; of the last key of the path that is there, if the rest is missing."""
    scan = json.JSONDecoder().raw_decode
    at = _after(text, 0)
    for step in _STEP.finditer(path):
        key, number = step[1] if step[1] is not None else step[2], step[3]
        opener, closer = ("{", "}") if number is None else ("[", "]")
        if text[at : at + 1] != opener:
            return at
        found, i, here = None, 0, _after(text, at + 1)
        while text[here : here + 1] not in (closer, ""):
            name = i
            if number is None:
                name, here = scan(text, here)
                here = _after(text, _after(text, here) + 1)
            if name == (key if number is None else int(number)):
                found = here  # of equal keys the last one counts
            here = _after(text, scan(text, here)[1])
            here = _after(text, here + 1) if text[here : here + 1] == "," else here
            i += 1
        if found is None:
            return at
        at = found
    return at


def _offset(text: str, path: str, code: str) -> int:
    if code == "syntax":
        try:
            _, end = json.JSONDecoder().raw_decode(text, _after(text, 0))
            return _after(text, end)
        except json.JSONDecodeError as e:
            return e.pos
        except RecursionError:
            return 0
    try:
        return place_of(text, path) or 0
    except (json.JSONDecodeError, RecursionError):
        return 0


_PLACE = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])


def _places(texts: pd.Series, paths: pd.Series, codes: pd.Series) -> pd.DataFrame:
    found = []
    for text, path, code in zip(texts, paths, codes):
        if text is None or path is None:
            found.append((None, None))
            continue
        at = _offset(text, path, code)
        found.append((text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)))
    return pd.DataFrame(found, columns=["line", "column"]).astype("Int32")


def locate(df: DataFrame, column: str, err: str = "error") -> DataFrame:
    """The errors in ``err`` with ``line`` and ``column`` (from 1) of the value in the documents of ``column`` that they are
    about: of a missing one, of the object that lacks it; of a text that is no document, of the first thing wrong."""
    e = F.col(err)
    there = F.when(e.isNotNull(), F.col(column).cast("string"))  # only these documents go to Python
    places = df.withColumn("__place", F.pandas_udf(_places, _PLACE)(there, e["path"], e["code"]))
    return places.withColumn(err, F.when(e.isNotNull(), e.withField("line", F.col("__place.line")).withField("column", F.col("__place.column")))).drop("__place")
