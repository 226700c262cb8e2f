import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillon.functions import json as J
from quillon.model import Codec, Codecs, Enum, Inferred, List, Map, Model, ModelError, Sealed, Singleton, defaulted, optional, required, unroll
from quillon.operators.decode import Options, decode
from quillon.operators.encode import encode
from quillon.operators.locate import locate
from quillon.operators.project import project


def read(spark, kind, *texts, options=None, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, doc string")
    rows = decode(df, "doc", kind, options, **more).orderBy("i").collect()
    out = []
    for r in rows:
        out.append((r.error.code, r.error.path) if r.error else r.value.asDict(True) if r.value is not None else None)
    return out


def test_required_default_null(spark):
    kind = Model("M", (required("a", "int"), defaulted("b", "string", "x"), defaulted("c", "int", 5, nullable=True), optional("d", "boolean")))
    assert read(spark, kind, '{"a":1}', '{"a":2,"b":"y","c":null,"d":true,"z":[1]}', "{}", '{"a":null}', '{"a":1,"b":null}', "7", "null", None, "nope") == [
        {"a": 1, "b": "x", "c": 5, "d": None}, {"a": 2, "b": "y", "c": None, "d": True}, ("missing", "$.a"), ("null", "$.a"), ("null", "$.b"), ("kind", "$"), ("null", "$"), None, ("syntax", "$"),
    ]


def test_numbers(spark):
    kind = Model("N", (optional("i", "int"), optional("l", "long"), optional("b", "byte"), optional("u", "ulong"), optional("f", "float"), optional("d", "double")))
    ok = read(spark, kind, '{"i":1.9}', '{"i":-1.9}', '{"i":1e2}', '{"l":9223372036854775807}', '{"l":-9223372036854775808}', '{"u":18446744073709551615}', '{"d":1e-7}', '{"f":1.5}')
    assert [next(v for v in r.values() if v is not None) for r in ok] == [1, -1, 100, 2**63 - 1, -(2**63), 2**64 - 1, 1e-7, 1.5]
    bad = read(spark, kind, '{"i":2147483648}', '{"l":9223372036854775808}', '{"b":128}', '{"u":-1}', '{"d":1e999}', '{"f":1e39}', '{"i":"1"}', '{"d":"1"}', '{"d":"NaN"}', '{"i":true}')
    assert [b[0] for b in bad] == ["range"] * 6 + ["kind"] * 4
    on = Options(coerce_numbers=True)
    assert read(spark, kind, '{"i":"12"}', '{"i":"1x"}', '{"d":"1.5e1"}', '{"l":"9223372036854775807"}', options=on) == [{**ok[0], "i": 12}, ("kind", "$.i"), {**ok[0], "i": None, "d": 15.0}, {**ok[0], "i": None, "l": 2**63 - 1}]


def test_containers_and_paths(spark):
    kind = Model("C", (required("xs", List(Model("X", (required("v", "int"),)))), optional("m", Map(List("int"))), optional("s", List("string", unique=True)), optional("n", List(List("int")))))
    assert read(spark, kind, '{"xs":[{"v":1},null],"m":{"a":[1,null],"b":null},"s":["b","a","b"],"n":[[1],[],null]}') == [
        {"xs": [{"v": 1}, None], "m": {"a": [1, None], "b": None}, "s": ["b", "a"], "n": [[1], [], None]}
    ]
    assert read(spark, kind, '{"xs":[{"v":1},{"v":"x"}]}', '{"xs":[{}]}', '{"xs":{}}', '{"xs":[],"m":{"k":[1,"x"]}}', '{"xs":[],"n":[[1],["x"]]}') == [
        ("kind", "$.xs[1].v"), ("missing", "$.xs[0].v"), ("kind", "$.xs"), ("kind", "$.m.k[1]"), ("kind", "$.n[1][0]"),
    ]


def test_modes(spark):
    kind = Model("M", (required("a", "int"),))
    df = spark.createDataFrame([("{}",), ('{"a":1}',)], "doc string")
    assert decode(df, "doc", kind, mode="drop").count() == 1
    with pytest.raises(Exception, match="a required field is missing at"):
        decode(df, "doc", kind, mode="failfast").collect()
    row = decode(df, "doc", kind).filter("error is not null").first()
    assert row.error.message == "a required field is missing" and row.error.hint


def test_resilience(spark):
    lot = Model("Lot", (required("sku", "long"), optional("shelf", "string", resilient=True)), resilient=True)
    kind = Model("Stock", (required("lots", List(lot)), defaulted("state", Enum(("COUNTED", "OPEN")), "OPEN", resilient=True), optional("checked", "boolean", resilient=True)))
    assert read(spark, kind, '{"lots":[{"shelf":"a","sku":3},7,{"sku":4,"shelf":[]},null,{"shelf":"b"}],"state":["OPEN"],"checked":"yes"}') == [{"lots": [{"sku": 3, "shelf": "a"}, {"sku": 4, "shelf": None}], "state": "OPEN", "checked": None}]
    strict = Model("Count", (required("n", "int", resilient=True),))
    assert read(spark, strict, '{"n":[]}', '{"n":null}') == [("missing", "$.n"), ("missing", "$.n")]


def test_polymorphism(spark):
    kind = Sealed("Move", {"sale": Model("Sale", (required("till", "int"),)), "rest": Model("Rest", (defaulted("why", "string", "unsaid"),))}, fallback="rest")
    shown = read(spark, kind, '{"why":"x","type":"gift"}', '{"till":2,"inner":{"type":"rest"},"type":"sale"}', '{"type":[]}', '{"type":"sale","till":null}', "{}", '"sale"')
    assert [s["_type"] if isinstance(s, dict) else s for s in shown] == ["rest", "sale", "rest", ("null", "$.till"), "rest", ("kind", "$")] and shown[0]["rest"] == {"why": "x"}
    closed = Sealed("Doc", {"bill": Model("Bill", (required("total", "long"),))}, discriminator="is a")
    assert read(spark, closed, '{"total":8,"is a":"bill"}', '{"is a":"note"}', '{"total":8}') == [{"_type": "bill", "bill": {"total": 8}}, ("subclass", "$['is a']"), ("discriminator", "$['is a']")]
    weight, length = required("kg", "double"), required("cm", "double")
    inferred = Inferred("Parcel", {"Tube": Model("Tube", (length, required("wide", "int"))), "Box": Model("Box", (weight, length)), "Sack": Model("Sack", (weight, optional("label", "string")))})
    shown = read(spark, inferred, '{"kg":2}', '{"cm":1,"kg":2}', '{"label":null,"kg":2,"other":[]}', '{"wide":3,"cm":9}', '{"cm":9}', "{}", '{"cm":9,"wide":3,"kg":1}')
    assert [s["_type"] if isinstance(s, dict) else s[0] for s in shown] == ["Sack", "Box", "Sack", "Tube", "inference", "inference", "inference"]
    assert read(spark, Model("Mark", (required("seen", Singleton()),)), '{"seen":{}}', '{"seen":{"at":[1]}}', '{"seen":1}') == [{"seen": True}, {"seen": True}, ("kind", "$.seen")]


def test_nothing_is_lost_in_silence(spark):
    kind = Model("V", (required("v", "string"),))
    high, low = "\\ud83d", "\\ude00"
    assert read(spark, kind, '{"v":"a"} ', '{"v":"a"}{"v":"b"}', '{"v":"a"},1', '{"v":"a"}]x', '{"v":"a"} x', f'{{"v":"{high}{low}"}}', f'{{"v":"{high}"}}', f'{{"v":"{low}{high}"}}', f'{{"v":"\\{high}"}}', f'{{"z":"{low}","v":"a"}}') == [
        {"v": "a"}, ("syntax", "$"), ("syntax", "$"), ("syntax", "$"), ("syntax", "$"), {"v": "\U0001f600"}, ("syntax", "$"), ("syntax", "$"), {"v": "\\ud83d"}, ("syntax", "$"),
    ]


def test_opaque_parts_keep_their_text(spark):
    inner = Model("In", (optional("raw", "json"), optional("n", "int")))
    kind = Model("Out", (required("a", "json"), required("xs", List("json")), required("m", Map(inner)), optional("u", Sealed("U", {"p": Model("P", (required("q", "json"),))}), wire="odd key")))
    text = '{"a":{"z":1.0,"b":[1e400,"1.0",{"c":null}],"é":"\\"1\\\\"},"xs":[1.10,"s\\n",true,[0.0],123456789012345678901234567890123456789012.5],"m":{"k":{"raw":2.50,"n":3},"l":{"raw":"2.50"}},"odd key":{"type":"p","q":{"r":-0.0}}}'
    found = read(spark, kind, text)[0]
    assert found["a"] == '{"z":1.0,"b":[1e400,"1.0",{"c":null}],"é":"\\"1\\\\"}' and found["xs"] == ["1.10", '"s\\n"', "true", "[0.0]", "123456789012345678901234567890123456789012.5"]
    assert found["m"] == {"k": {"raw": "2.50", "n": 3}, "l": {"raw": '"2.50"', "n": None}} and found["u"]["p"] == {"q": '{"r":-0.0}'}
    with pytest.raises(ModelError):
        read(spark, Sealed("S", {"a": Model("A", (optional("x", "json"),)), "b": Model("B", (optional("x", List("json")),))}), "{}")


def test_codecs(spark):
    upper = Codec("Upper", "string", lambda raw: F.upper(J.as_string(raw)), lambda c: J.text_of(F.lower(c)))
    codecs = Codecs(upper)
    kind = Model("C", (required("a", codecs["Upper"]), required("m", Map(List(codecs["Upper"])))))
    assert read(spark, kind, '{"a":"x","m":{"k":["y",null]}}', '{"a":1,"m":{}}', '{"a":"x","m":{"k":[2]}}') == [{"a": "X", "m": {"k": ["Y", None]}}, ("format", "$.a"), ("format", "$.m.k[0]")]
    df = decode(spark.createDataFrame([('{"a":"x","m":{"k":["y"]}}',)], "doc string"), "doc", kind)
    assert encode(df, "value", kind).first().json == '{"a":"x","m":{"k":["y"]}}'
    with pytest.raises(ModelError):
        codecs.register(upper)
    with pytest.raises(ModelError):
        codecs["Lower"]


def test_places_of_errors(spark):
    kind = Model("M", (required("xs", List(Model("X", (required("odd key", "int"),)))),))
    texts = ['{\n "xs": [{"odd key": 1},\n  {"odd key": "é"}]}', '{"xs":[{"odd key":1}, {"y":[{}]}]}', '{"xs":[1 2]}', "", '{"xs":[]} trailing', '{"xs":{}}', '{"xs":[]}', '{"xs":7,"xs":[{"odd key":null}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, doc string")
    found = locate(decode(df, "doc", kind), "doc").orderBy("i").collect()
    assert [(r.error.code, r.error.line, r.error.column) if r.error else None for r in found] == [
        ("kind", 3, 15), ("missing", 1, 23), ("syntax", 1, 10), ("syntax", 1, 1), ("syntax", 1, 11), ("kind", 1, 7), None, ("null", 1, 26),
    ]


def test_yaml_models_are_checked(spark):
    df = spark.createDataFrame([("{}",)], "doc string")
    with pytest.raises(ModelError):
        decode(df, "doc", Model("Y", (optional("a", "json"),)), Options(yaml=True))


def test_wide_deep_and_odd_names(spark):
    wide = Model("W", tuple(required(f"f{i:02}", "string") for i in range(55)))
    row = {f"f{i:02}": str(i) for i in range(55)}
    assert read(spark, wide, json.dumps(row), json.dumps({k: v for k, v in row.items() if k != "f54"})) == [row, ("missing", "$.f54")]
    deep = Model("D", (required("v", "string", flatten="a.b.c.d.e.f.g"), required("k", "int", wire="odd key")))
    assert read(spark, deep, '{"a":{"b":{"c":{"d":{"e":{"f":{"g":"x"}}}}}},"odd key":1}', '{"a":{"b":[]},"odd key":1}', '{"a":{},"odd key":1}', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":"x"}}}}}}}') == [
        {"v": "x", "k": 1}, ("path", "$.a.b"), ("missing", "$.a.b.c.d.e.f.g"), ("missing", "$['odd key']"),
    ]
    tree = unroll(lambda inner: Model("T", (required("v", "int"), optional("next", inner))), 2)
    assert read(spark, tree, '{"v":1,"next":{"v":2,"next":{"v":3}}}') == [{"v": 1, "next": {"v": 2, "next": '{"v":3}'}}]


def test_sibling_keys_of_sibling_keys(spark):
    inner = Model("In", (optional("x", "int"), optional("deep", Model("D", (optional("y", "int"),)), keys=True)))
    kind = Model("Out", (required("id", "int"), required("extras", inner, keys=True)))
    assert read(spark, kind, '{"y":2,"id":1,"x":null}') == [{"id": 1, "extras": {"x": None, "deep": {"y": 2}}}]
    df = decode(spark.createDataFrame([('{"y":2,"id":1}',)], "doc string"), "doc", kind)
    assert encode(df, "value", kind).first().json == '{"id":1,"y":2}'


def test_strict_and_filters_see_one_copy(spark):
    kind = Model("M", (required("a", "int"),), strict=True)
    assert read(spark, kind, '{"a":1,"b":2}', '{"a":1}') == [("unknown", "$.b"), {"a": 1}]
    df = decode(spark.createDataFrame([('{"a":1}',)], "doc string"), "doc", kind).filter("value.a = 1").select("value.a")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1


def test_projection_of_sound_documents(spark):
    item = Model("I", (required("v", "int", wire="x"), defaulted("w", "string", "d")))
    kind = Model("P", (required("items", List(item)), required("s", List("string", unique=True)), optional("e", Enum(("A", "unknown"))), required("deep", "long", flatten="a.b"), defaulted("gone", "int", 4, ignored=True), optional("m", Map(item))))
    df = spark.createDataFrame([('{"items":[{"x":1},{"x":2,"w":"q"}],"s":["a","a"],"e":"Z","a":{"b":7},"gone":1,"m":{"k":{"x":3}}}',), ("nope",)], "doc string")
    rows = [r.value.asDict(True) if r.value else None for r in project(df, "doc", kind).collect()]
    assert rows[0] == {"items": [{"v": 1, "w": "d"}, {"v": 2, "w": "q"}], "s": ["a"], "e": "unknown", "deep": 7, "gone": 4, "m": {"k": {"v": 3, "w": "d"}}}
    with pytest.raises(ModelError):
        project(df, "doc", Model("X", (required("s", Sealed("S", {"a": item})),)))


SHEET = Model("Sheet", (
    required("key", "long"), required("title", "string"), defaulted("open", "boolean", False), required("weight", "double"), optional("remark", "string"),
    required("marks", List("string")), required("counts", Map("int")), optional("owner", Model("Owner", (optional("desk", "int"),))),
))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.fixed_dictionaries({
            "key": st.integers(-(2**63), 2**63 - 1), "title": st.text(st.characters(exclude_categories=["Cs"]), max_size=20), "open": st.booleans(), "weight": st.floats(allow_nan=False, allow_infinity=False),
            "remark": st.none() | st.text("ab\"\\\n\t\x01é/", max_size=9), "marks": st.lists(st.text("xyz", max_size=3), max_size=4), "counts": st.dictionaries(st.text('k"é', max_size=3), st.integers(-5, 5), max_size=3), "owner": st.none() | st.fixed_dictionaries({"desk": st.none() | st.integers(-9, 9)}),
        }), min_size=1, max_size=30,
    )
)
def test_round_trip(spark, rows):
    texts = [json.dumps(r) for r in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, doc string")
    coded = encode(decode(df, "doc", SHEET), "value", SHEET)
    again = decode(coded.select("i", "json"), "json", SHEET).orderBy("i").collect()
    for r, back in zip(rows, again):
        assert back.error is None and back.value.asDict(True) == r and json.loads(back.json) == r


def test_what_is_decoded_is_read_once(spark):
    """Nothing that decoding reads is copied into a filter below it: a costly column made once is evaluated once."""
    made = spark.createDataFrame([('{"k":1}',), (None,), ("{}",)], "doc string").select(F.get_json_object("doc", "$").alias("doc"))
    read = decode(made, "doc", Model("P", (optional("k", "long"),), proto=True)).select("doc", "value.k")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("get_json_object") == 1
    assert sorted((r.doc or "", r.k or 0) for r in read.collect()) == [("", 0), ('{"k":1}', 1), ("{}", 0)]
