import base64

import pytest
from pyspark.sql import functions as F

from quillon.functions import json as J
from quillon.functions import proto as P
from quillon.functions import yaml as Y
from quillon.model import List, Map, Model, Sealed, defaulted, optional, required
from quillon.operators.decode import prepare
from quillon.operators.encode import encode
from quillon.sources.readers import read_documents, read_ndjson, read_yaml, read_yaml_files, transcode, write_ndjson
from quillon.streaming import stream_ndjson


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_raw_json(spark):
    prepare(spark)
    texts = ['{"a"', "[", '"s"', "-0.5", "1e5", "01", "true", "tru", " null ", "", None]
    assert values(spark, texts, J.kind) == ["OBJECT", "ARRAY", "STRING", "NUMBER", "NUMBER", "INVALID", "BOOLEAN", "INVALID", "NULL", "INVALID", None]
    assert values(spark, ["2147483648", "5", "5.0", '"5"'], J.as_int) == [None, 5, None, None]
    assert values(spark, ["9223372036854775808", "-7"], J.as_long) == [None, -7]
    assert values(spark, ["1e400", "1.5", "x"], J.as_double) == [None, 1.5, None]
    assert values(spark, ['"a\\u00e9\\n"', "1"], J.as_string) == ["aé\n", None]
    assert values(spark, ['{"k":{"z" : 1.0,"a":[ ]}}', '{"k":"x\\"y"}', '{"k":null}', "{}"], lambda t: J.capture(t, "k")) == ['{"z":1.0,"a":[]}', '"x\\"y"', "null", None]
    nested = ["[" * 3 + "]" * 3, '{"a":"[[[["}', '[[1],[2]]']
    assert values(spark, nested, lambda t: J.deeper_than(t, 2)) == [True, False, False]


def test_timestamps_and_durations(spark):
    texts = ["1970-01-01T00:00:00Z", "2024-02-29t12:00:00.5+01:30", "1969-12-31T23:59:59.000000001Z", "2024-13-01T00:00:00Z", "2024-01-01 00:00:00Z", "0001-01-01T00:00:00Z"]
    found = values(spark, texts, P.parse_timestamp)
    assert [tuple(f) if f else None for f in found] == [(0, 0), (1709202600, 500_000_000), (-1, 1), None, None, (-62135596800, 0)]
    assert values(spark, texts[:3] + texts[5:], lambda t: P.format_timestamp(P.parse_timestamp(t))) == ["1970-01-01T00:00:00Z", "2024-02-29T10:30:00.500Z", "1969-12-31T23:59:59.000000001Z", "0001-01-01T00:00:00Z"]
    spans = ["1.5s", "-0.25s", "3s", "1", "-1.000001s"]
    assert [tuple(f) if f else None for f in values(spark, spans, P.parse_duration)] == [(1, 500_000_000), (0, -250_000_000), (3, 0), None, (-1, -1000)]
    assert values(spark, spans, lambda t: P.format_duration(P.parse_duration(t))) == ["1.500s", "-0.250s", "3s", None, "-1.000001s"]


def test_other_proto_scalars(spark):
    data = bytes(range(256))
    coded = base64.b64encode(data).decode()
    url = base64.urlsafe_b64encode(data[:-1]).decode().rstrip("=")
    assert [bytes(x) if x is not None else None for x in values(spark, [coded, url, " Y W I= ", "a", "a!bc", ""], P.parse_base64)] == [data, data[:-1], b"ab", None, None, b""]
    assert values(spark, ["a.b,fooBar", ""], P.parse_fieldmask) == [["a.b", "foo_bar"], []]
    assert values(spark, ["foo_bar_baz"], lambda t: P.format_fieldmask(F.array(t))) == ["fooBarBaz"]
    assert values(spark, ["7", "7.0", "7.5", "1e2", "-1", "256", "x"], lambda t: P.parse_integer(t, 0, 255)) == [7, 7, None, 100, None, None, None]
    packed = lambda t: P.pack_any("T", t)
    assert values(spark, ["{}"], lambda t: P.unpack_any(packed(t), "T")) == ["{}"] and values(spark, ["{}"], lambda t: P.unpack_any(packed(t), "U", dynamic=True)) == [None]
    with pytest.raises(Exception, match="not a U"):
        values(spark, ["{}"], lambda t: P.unpack_any(packed(t), "U"))


def test_encoding_rules(spark):
    model = Model("E", (required("d", "double"), optional("n", "string"), defaulted("o", "string", None), required("xs", List("double")), required("m", Map("string"))))
    df = spark.createDataFrame([((1e10, None, None, [0.1, None, 1e300], {"k": None}),), ((-0.5, 'q"', "x", [], {}),)], "v struct<d:double,n:string,o:string,xs:array<double>,m:map<string,string>>")
    assert sorted(r.json for r in encode(df, "v", model).collect()) == sorted(['{"d":10000000000.0,"n":null,"xs":[0.1,null,1.0E300],"m":{"k":null}}', '{"d":-0.5,"n":"q\\"","o":"x","xs":[],"m":{}}'])
    with pytest.raises(Exception, match="not finite"):
        encode(spark.createDataFrame([((float("nan"),),)], "v struct<d:double>"), "v", Model("D", (required("d", "double"),))).collect()
    sealed = Sealed("S", {"A": Model("A", (required("x", "int"),))}, discriminator="kind")
    df = spark.createDataFrame([(("A", (1,)),)], "v struct<_type:string,A:struct<x:int>>")
    assert encode(df, "v", sealed).first().json == '{"kind":"A","x":1}'


YAML = [
    ("a: 1\nb: [x, 'y', \"z\\u00e9\"]\n", '{"a":1,"b":["x","y","zé"]}'),
    ("a: yes\nb: True\nc: NULL\nd: ~\ne:\n", '{"a":"yes","b":true,"c":null,"d":null,"e":null}'),
    ("- 0x1F\n- 0o17\n- 0b101\n- +5\n- 1_000\n- .inf\n- -.INF\n- .nan\n- 1e3\n- 99999999999999999999\n", '[31,15,5,"+5","1_000","Infinity","-Infinity","NaN",1000.0,1e+20]'),
    ("t: |\n  a\n   b\nf: >-\n  x\n  y\n\n  z\n", '{"t":"a\\n b\\n","f":"x y\\nz"}'),
    ("a: !!str 5\nb: !!int '7'\nc: !!int x\nd: !!bool true\ne: ! 12\nf: !!float 3\n", '{"a":"5","b":7,"c":0,"d":true,"e":"12","f":3.0}'),
    ("x: &a {k: 1}\ny: *a\n? [1, 2]\n: z\n1: n\n~: m\n", '{"x":{"k":1},"y":{"k":1},"[1,2]":"z","1":"n","":"m"}'),
    ("%YAML 1.2\n---\nb: 2 # c\n...\n", '{"b":2}'),
    ("p: !pet\n  name: rex\n", '{"p":{"__tag__":"pet","name":"rex"}}'),
    ("d: 2024-01-01\nn: 1:30\n", '{"d":"2024-01-01","n":"1:30"}'),
    ("i: {<<: {a: 1, b: 2}, b: 3}\nj: {b: 3, <<: [{b: 4, c: 5}, {c: 6}]}\n", '{"i":{"a":1,"b":3},"j":{"b":3,"c":5}}'),
    ("", "null"),
]


@pytest.mark.parametrize("text,expected", YAML)
def test_yaml_reading(text, expected):
    assert Y.read_one(text) == expected


@pytest.mark.parametrize("text", ["a: *nope\n", "a: b: c\n", "a: [1, 2\n", "\tx: 1\n", "--- a\n--- b\n", "a: !u!x 1\n", "%YAML 1.2\n%YAML 1.2\n---\na\n", "[" * 300 + "]" * 300, "a: &a [x,x,x,x,x,x,x,x,x,x]\n" + "".join(f"{chr(98 + i)}: &{chr(98 + i)} [{','.join(['*' + chr(97 + i)] * 10)}]\n" for i in range(8))])
def test_yaml_errors(text):
    with pytest.raises(Y.YamlError):
        Y.read_one(text)


def test_yaml_round_trip():
    import json

    for value in ({"a": {"b": [1, {"c": None}, [], {}]}, "true": "no", "": "x: y", "k k": "é\n", "1": -0.5}, [], {}, "s", [[1, [2]], {"x": [{}]}]):
        assert json.loads(Y.read_one(Y.write_one(json.dumps(value)))) == value


def test_yaml_columns(spark):
    df = spark.createDataFrame([(1, "a: 1\n---\na: 2\n"), (2, "a: ["), (3, None)], "i int, t string")
    rows = read_yaml(df, "t").orderBy("i", "position").collect()
    assert [(r.i, r.position, r.document) for r in rows] == [(1, 0, '{"a":1}'), (1, 1, '{"a":2}'), (2, None, None), (3, None, None)] and rows[2].yaml_error


def test_encodings(spark):
    text = 'é😀{"a":1}'
    forms = [text.encode(c) for c in ("utf-8", "utf-8-sig", "utf-16", "utf-32")] + [b"\xfe\xff" + text.encode("utf-16-be"), b"\x00\x00\xfe\xff" + text.encode("utf-32-be")]
    plain = ['{"a":1}'.encode(c) for c in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")]
    bad = [b"\xff", b"\xc3", b"\xff\xfe\x00\xd8", b"\xfe\xff\x00", b"\x00\x00\xfe\xff\x00\x11\x00\x00"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(forms + plain + bad + [b""])], "i int, b binary")
    found = [r[0] for r in df.select("i", transcode(F.col("b")).alias("t")).orderBy("i").select("t").collect()]
    assert found == [text] * 6 + ['{"a":1}'] * 4 + [None] * 5 + [""]


def test_files_and_streams(spark, tmp_path):
    kind = Model("M", (required("a", "int"),))
    df = spark.createDataFrame([((1,),), ((2,),), (None,)], "v struct<a:int>")
    write_ndjson(df, "v", kind, f"{tmp_path}/out")
    assert sorted(r.document for r in read_ndjson(spark, f"{tmp_path}/out").collect()) == ['{"a":1}', '{"a":2}']
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/x.json").write_bytes('{"a":\n5}'.encode("utf-16"))
    assert [r.document for r in read_documents(spark, f"{tmp_path}/docs").collect()] == ['{"a":\n5}']
    (tmp_path / "docs/y.yaml").write_text("a: 1\n---\nb: [2]\n")
    assert sorted(r.document for r in read_yaml_files(spark, f"{tmp_path}/docs/y.yaml").collect()) == ['{"a":1}', '{"b":[2]}']
    stream = stream_ndjson(spark, f"{tmp_path}/out", kind).select("value.a").writeStream.format("memory").queryName("ndjson_test").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted(r.a for r in spark.table("ndjson_test").collect()) == [1, 2]


def test_capture_makes_each_reading_once(spark):
    """The document's second reading, the costly one, is not made again for each use of its text."""
    documents = ['{"k":"a"}', '{"k":{"a" : 1.50, "b":"x \\"2\\""}}', '{"k": [1.0, 2e5] }', '{"k":-0.10}', '{"k":true}', '{"k":null}', '{"j":1}', "no", None]
    read = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, d string").select("i", J.capture(F.col("d"), "k").alias("c"))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
    assert [r.c for r in read.orderBy("i").collect()] == ['"a"', '{"a":1.50,"b":"x \\"2\\""}', "[1.0,2e5]", "-0.10", "true", "null", None, None, None]
