"""One query for each operator of the inventory, and the same result in plain SQL.

Documents are made from columns of the tables with JSON functions, pass through the operators, and come back as flat
columns; the oracle computes those columns from the tables. Every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import proto as P
from ..functions.yaml import json_to_yaml, yaml_to_json
from ..model import Codec, Codecs, Enum, Envelope, Inferred, List, Map, Model, Sealed, Singleton, defaulted, optional, required
from ..operators.decode import Options, decode, prepare, route, route_typed, unpack_dynamic
from ..operators.encode import encode, pack_any
from ..operators.locate import locate
from ..operators.project import project
from ..sources.readers import join_yaml, read_documents, read_ndjson, read_yaml, transcode, write_ndjson
from ..sources.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mod(column: str, n: int) -> Column:
    return F.col(column) % n


def doc(*parts: str | Column) -> Column:
    """A JSON text from literal pieces and columns (which become their JSON text)."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else J.text_of(p) for p in parts))


# Sources, projection, defaults ---------------------------------------------------------------------------------------

PROPS = Model("Props", (required("k", "int"),))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(CAST(json_extract(props, '$.k') AS INTEGER))::BIGINT AS k_sum FROM events GROUP BY event_type")
def json_decode_events(spark, sf_dir):
    read = decode(table(spark, sf_dir, "events"), "props", PROPS)
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value.k").alias("k_sum"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_decode_bytes(spark, sf_dir):
    read = decode(table(spark, sf_dir, "events").withColumn("raw", F.encode("props", "UTF-8")), "raw", PROPS)
    return read.select("event_id", F.col("value.k").alias("k"))


ORDER = Model("Order", (required("o_orderkey", "long", wire="id"), required("o_custkey", "long", wire="customer"), required("o_orderstatus", Enum(("F", "O", "P"))), required("o_totalprice", "double", wire="total")))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def json_roundtrip_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.struct(*(f.name for f in ORDER.fields)).alias("order"))
    return decode(encode(rows, "order", ORDER).select("json"), "json", ORDER).select("value.*")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, max(o_custkey) AS last FROM orders GROUP BY o_orderstatus")
def json_project_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.struct(*(f.name for f in ORDER.fields)).alias("order"))
    read = project(encode(rows, "order", ORDER).select("json"), "json", ORDER).select("value.*")
    return read.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_custkey").alias("last"))


@query("SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS author FROM customer")
def project_flattened(spark, sf_dir):
    head = doc('{"id":', F.col("c_custkey"), ',"address":{"segment":', F.col("c_mktsegment"), ',"place":{"nation":', F.col("c_nationkey"), "}}")
    tail = F.when(mod("c_custkey", 2) == 0, doc(',"account":{"contact":{"name":', F.col("c_name"), "}}}")).otherwise("}")
    return project(table(spark, sf_dir, "customer").select(F.concat(head, tail).alias("json")), "json", FLAT).select("value.*")


@query("SELECT event_id, (event_id % 5) AS shown FROM events")
def duplicate_keys_last_wins(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", doc('{"a":-1,"extra":[{"a":7}],"a":', mod("event_id", 5), "}").alias("json"))
    return decode(made, "json", Model("Twice", (required("shown", "long", wire="a"),))).select("event_id", "value.shown")


@query("SELECT c_custkey, c_name AS label, 'none' AS note FROM customer")
def ignored_and_renamed(spark, sf_dir):
    model = Model("Card", (required("label", "string", wire="name"), defaulted("note", "string", "none", ignored=True)))
    made = table(spark, sf_dir, "customer").select("c_custkey", doc('{"note":"sent","name":', F.col("c_name"), "}").alias("json"))
    return decode(made, "json", model).select("c_custkey", "value.label", "value.note")


@query("""SELECT c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN 'anonymous' ELSE c_name END AS name,
  CASE WHEN c_custkey % 15 IN (0, 3, 6, 9, 12) THEN 42 WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer""")
def defaults_vs_null(spark, sf_dir):
    model = Model("Customer", (defaulted("name", "string", "anonymous"), defaulted("nation", "int", 42, nullable=True)))
    full = doc('{"name":', F.col("c_name"), ',"nation":', F.when(mod("c_custkey", 5) != 0, F.col("c_nationkey")), "}")
    made = table(spark, sf_dir, "customer").select("c_custkey", F.when(mod("c_custkey", 3) == 0, "{}").otherwise(full).alias("json"))
    return decode(made, "json", model).select("c_custkey", "value.name", "value.nation")


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'null' WHEN o_orderkey % 3 = 0 THEN 'kind' WHEN o_orderkey % 2 = 0 THEN 'syntax' ELSE 'none' END AS code,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN '$.items[1].price' WHEN o_orderkey % 2 = 0 THEN '$' ELSE 'none' END AS path, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2""")
def error_paths(spark, sf_dir):
    model = Model("Cart", (required("items", List(Model("Item", (required("price", "double"),)))),))
    second = F.when(mod("o_orderkey", 7) == 0, "{}").when(mod("o_orderkey", 5) == 0, '{"price":null}').when(mod("o_orderkey", 3) == 0, '{"price":"1"}').when(mod("o_orderkey", 2) == 0, '{"price":1,,}').otherwise('{"price":2}')
    made = table(spark, sf_dir, "orders").select(F.concat(F.lit('{"items":[{"price":1.5},'), second, F.lit("]}")).alias("json"))
    read = decode(made, "json", model).select(F.coalesce("error.code", F.lit("none")).alias("code"), F.coalesce("error.path", F.lit("none")).alias("path"))
    return read.groupBy("code", "path").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS kept FROM orders WHERE o_orderkey % 4 <> 0")
def drop_mode(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(F.when(mod("o_orderkey", 4) == 0, "[1 2]").otherwise('{"k":1}').alias("json"))
    return decode(made, "json", PROPS, mode="drop").agg(F.count("*").alias("kept"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'missing trail' ELSE s_name END AS shown FROM supplier")
def failfast_mode(spark, sf_dir):
    model = Model("Supplier", (defaulted("shown", "string", "missing trail"),))
    made = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(mod("s_suppkey", 3) == 0, "{}").otherwise(doc('{"shown":', F.col("s_name"), "}")).alias("json"))
    return decode(made, "json", model, mode="failfast").select("s_suppkey", "value.shown")


# Reshaping -----------------------------------------------------------------------------------------------------------

FLAT = Model("Flat", (required("id", "long"), required("nation", "int", flatten="address.place.nation"), required("segment", "string", flatten="address.segment"), optional("author", "string", flatten="account.contact.name")))


@query("SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS author FROM customer")
def flatten_customer(spark, sf_dir):
    head = doc('{"id":', F.col("c_custkey"), ',"address":{"segment":', F.col("c_mktsegment"), ',"place":{"nation":', F.col("c_nationkey"), "}}")
    tail = F.when(mod("c_custkey", 2) == 0, doc(',"account":{"contact":{"name":', F.col("c_name"), "}}}")).otherwise("}")
    return decode(table(spark, sf_dir, "customer").select(F.concat(head, tail).alias("json")), "json", FLAT).select("value.*")


SHIPPED = Model("Shipped", (
    required("order", "long"), required("line", "int"), required("part", "long", wrap="goods"), required("supplier", "long", wrap="goods.source"),
    required("quantity", "long", wrap="goods"), required("mode", "string", wrap="transport.by"), required("late", "boolean", wrap="transport"),
))


@query("""SELECT l_orderkey AS "order", l_linenumber AS line, '{"order":' || l_orderkey || ',"line":' || l_linenumber || ',"goods":{"part":' || l_partkey || ',"source":{"supplier":' || l_suppkey || '},"quantity":' || l_quantity::BIGINT
  || '},"transport":{"by":{"mode":"' || l_returnflag || '"},"late":' || (l_linenumber > 3) || '}}' AS json FROM lineitem""")
def wrap_shipment(spark, sf_dir):
    row = F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.floor("l_quantity").alias("quantity"), F.col("l_returnflag").alias("mode"), (F.col("l_linenumber") > 3).alias("late"))
    return encode(table(spark, sf_dir, "lineitem").select(row.alias("row")), "row", SHIPPED).select("row.order", "row.line", "json")


@query("""SELECT l_orderkey AS "order", l_linenumber::INTEGER AS line, l_partkey AS part, l_suppkey AS supplier, l_quantity::BIGINT AS quantity, l_returnflag AS mode, l_linenumber > 3 AS late FROM lineitem""")
def wrap_decodes_by_path(spark, sf_dir):
    return decode(wrap_shipment(spark, sf_dir).select("json"), "json", SHIPPED).select("value.*")


@query("""SELECT c_custkey AS id, '{"id":' || c_custkey || ',"address":{"place":{"nation":' || c_nationkey || '},"segment":"' || c_mktsegment || '"},"account":{"contact":{"name":' || CASE WHEN c_custkey % 2 = 0 THEN '"' || c_name || '"' ELSE 'null' END || '}}}' AS json FROM customer""")
def flatten_encodes_by_path(spark, sf_dir):
    """A flattened field is written where it was read."""
    return encode(flatten_customer(spark, sf_dir).select(F.struct("id", "nation", "segment", "author").alias("row")), "row", FLAT).select("row.id", "json")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '$.a.b' END AS wrong, CASE WHEN s_suppkey % 2 <> 0 THEN s_nationkey END AS c FROM supplier")
def flatten_blocked(spark, sf_dir):
    made = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(mod("s_suppkey", 2) == 0, '{"a":{"b":7}}').otherwise(doc('{"a":{"b":{"c":', F.col("s_nationkey"), "}}}")).alias("json"))
    read = decode(made, "json", Model("Deep", (required("c", "int", flatten="a.b.c"),)))
    return read.select("s_suppkey", F.col("error.path").alias("wrong"), "value.c")


PAIR = Model("Extras", (optional("e1", "string"), optional("e2", "string")))


def _keys_table(spark, sf_dir) -> DataFrame:
    one, two = F.when(mod("p_partkey", 3) != 0, doc(',"e1":', F.col("p_brand"))).otherwise(""), F.when(mod("p_partkey", 2) != 0, doc(',"e2":', F.col("p_type"))).when(mod("p_partkey", 4) == 0, ',"e2":null').otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(doc('{"id":', F.col("p_partkey")), one, two, F.lit("}")).alias("json"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS e1, CASE WHEN p_partkey % 2 <> 0 THEN p_type END AS e2 FROM part")
def wrapped_keys(spark, sf_dir):
    model = Model("Part", (required("id", "long"), required("extras", PAIR, keys=True)))
    return decode(_keys_table(spark, sf_dir), "json", model).select("p_partkey", "value.extras.e1", "value.extras.e2")


@query("SELECT p_partkey, p_partkey % 6 = 0 AS no_empty, p_partkey % 3 = 0 OR p_partkey % 2 = 0 AS no_absent FROM part")
def wrapped_keys_omit(spark, sf_dir):
    made = _keys_table(spark, sf_dir)
    read = decode(made, "json", Model("Part", (optional("extras", PAIR, keys=True, omit="empty"),)), value="a", err="ea")
    read = decode(read, "json", Model("Part", (optional("extras", PAIR, keys=True, omit="absent"),)), value="b", err="eb")
    return read.select("p_partkey", F.col("a.extras").isNull().alias("no_empty"), F.col("b.extras").isNull().alias("no_absent"))


@query("""SELECT p_partkey, '{"id":' || p_partkey || CASE WHEN p_partkey % 3 <> 0 THEN ',"e1":"' || p_brand || '"' ELSE '' END || CASE WHEN p_partkey % 2 <> 0 THEN ',"e2":"' || p_type || '"' ELSE '' END || '}' AS json FROM part""")
def wrapped_keys_encode(spark, sf_dir):
    model = Model("Part", (required("id", "long"), required("extras", PAIR, keys=True)))
    return encode(decode(_keys_table(spark, sf_dir), "json", model).select("p_partkey", "value"), "value", model).select("p_partkey", "json")


@query("SELECT p_partkey, p_size AS depth0, p_size + 1 AS depth1, '{\"v\":' || (p_size + 2) || '}' AS rest FROM part")
def recursive_unrolled(spark, sf_dir):
    from ..model import unroll

    tree = unroll(lambda inner: Model("Tree", (required("v", "int"), optional("child", inner))), 2)
    made = table(spark, sf_dir, "part").select("p_partkey", doc('{"v":', F.col("p_size"), ',"child":{"v":', F.col("p_size") + 1, ',"child":{"v":', F.col("p_size") + 2, "}}}").alias("json"))
    v = "value"
    return decode(made, "json", tree).select("p_partkey", F.col(f"{v}.v").alias("depth0"), F.col(f"{v}.child.v").alias("depth1"), F.col(f"{v}.child.child").alias("rest"))


# Coercion, resilience, strictness ------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS bare, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey END AS quoted, l_linenumber % 2 = 1 AS refused FROM lineitem")
def coerce_numbers(spark, sf_dir):
    model = Model("Numbers", (required("bare", "long"), required("quoted", "long")))
    rows = table(spark, sf_dir, "lineitem")
    made = rows.select("l_orderkey", "l_linenumber", doc('{"bare":', F.col("l_quantity"), ',"quoted":"', F.col("l_orderkey"), '"}').alias("json"))
    on = decode(made, "json", model, Options(coerce_numbers=True), value="on", err="e1")
    off = decode(on, "json", model, value="off", err="e2")
    even = mod("l_linenumber", 2) == 0
    return off.select("l_orderkey", "l_linenumber", F.col("on.bare").alias("bare"), F.when(even, F.col("on.quoted")).alias("quoted"), (~even & (F.col("e2.code") == "kind")).alias("refused"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN true END AS flag,
  CASE WHEN o_orderkey % 8 = 6 THEN true END AS plain FROM orders""")
def coerce_booleans(spark, sf_dir):
    words = ("1", "0", '"Y"', '"no"', '"ON"', '"off"', "true", '"maybe"')
    text = F.get(F.array(*map(F.lit, words)), mod("o_orderkey", 8).cast("int"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('{"flag":'), text, F.lit("}")).alias("json"))
    model = Model("Flag", (required("flag", "boolean"),))
    read = decode(decode(made, "json", model, Options(coerce_booleans=True), value="a", err="ea"), "json", model, value="b", err="eb")
    return read.select("o_orderkey", F.col("a.flag").alias("flag"), F.col("b.flag").alias("plain"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 100 END AS i, CASE WHEN p_partkey % 4 = 3 THEN 'range' END AS wrong FROM part")
def truncate_fractions(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ("1.9", "-1.9", "1e2", "3000000000"))), mod("p_partkey", 4).cast("int"))
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"i":'), text, F.lit("}")).alias("json"))
    return decode(made, "json", Model("I", (required("i", "int"),))).select("p_partkey", "value.i", F.col("error.code").alias("wrong"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS standard, c_nationkey AS nation FROM customer")
def resilient_field(spark, sf_dir):
    model = Model("C", (defaulted("status", Enum(("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE", "standard")), "standard", resilient=True), required("nation", "int")))
    status = F.when(mod("c_custkey", 6) == 0, "null").when(mod("c_custkey", 3) == 0, '{"odd":[1]}').otherwise(J.text_of(F.col("c_mktsegment")))
    made = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{"status":'), status, doc(',"nation":', F.col("c_nationkey"), "}")).alias("json"))
    read = decode(made, "json", model)
    return read.select("c_custkey", (F.col("value.status") == "standard").alias("standard"), "value.nation")


@query("SELECT o_orderkey, 2::BIGINT + (o_orderkey % 3 <> 0)::BIGINT AS n, 1 + 3 + CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 0 END AS total FROM orders")
def resilient_list(spark, sf_dir):
    item = Model("Item", (required("v", "int"),), resilient=True)
    second = F.when(mod("o_orderkey", 3) == 0, '{"v":"2"}').otherwise('{"v":2}')
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('{"xs":[{"v":1},'), second, F.lit(',null,7,{"v":3},{}]}')).alias("json"))
    read = decode(made, "json", Model("Xs", (required("xs", List(item)),)))
    return read.select("o_orderkey", F.size("value.xs").cast("bigint").alias("n"), F.aggregate("value.xs", F.lit(0), lambda a, x: a + x["v"]).alias("total"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey END AS nation FROM supplier")
def resilient_object(spark, sf_dir):
    model = Model("S", (optional("place", Model("Place", (required("nation", "int"),)), resilient=True),))
    made = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(mod("s_suppkey", 2) == 1, doc('{"place":{"nation":', F.col("s_nationkey"), "}}")).otherwise('{"place":{"city":1}}').alias("json"))
    return decode(made, "json", model).select("s_suppkey", "value.place.nation")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' END AS code, CASE WHEN event_id % 7 = 0 THEN '$.x' END AS path FROM events")
def strict_unknown_keys(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", F.when(mod("event_id", 7) == 0, F.concat(F.lit('{"x":1,'), F.substr("props", F.lit(2)))).otherwise(F.col("props")).alias("json"))
    return decode(made, "json", PROPS, Options(strict=True)).select("event_id", "error.code", "error.path")


@query("SELECT n_nationkey, CASE n_nationkey % 10 WHEN 9 THEN 9 END AS v, CASE WHEN n_nationkey % 10 <> 9 THEN 'syntax' END AS wrong FROM nation")
def malformed_texts(spark, sf_dir):
    bad = ('{"v":01}', '{"v":-}', '{"v":1.}', '{"v":1e}', '{"v":1,}', '{"v":1', '{"v":1,"w":"\\ud800"}', "", '{"v":1 "w":2}', '{"v":9}')
    made = table(spark, sf_dir, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, bad)), mod("n_nationkey", 10)).alias("json"))
    return decode(made, "json", Model("V", (required("v", "int"),))).select("n_nationkey", "value.v", F.col("error.code").alias("wrong"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'a' WHEN 5 THEN chr(128512) WHEN 6 THEN '\\ud83d' WHEN 7 THEN 'a' END AS v,
  CASE WHEN p_partkey % 8 BETWEEN 1 AND 4 THEN 'syntax' END AS wrong FROM part""")
def trailing_text(spark, sf_dir):
    """What follows a document's value, and halves of characters, are errors and never lost in silence."""
    texts = ('{"v":"a"}', '{"v":"a"}{"v":"b"}', '{"v":"a"},{"v":"b"}', '{"v":"a"}]', '{"v":"\\ude00\\ud83d"}', '{"v":"\\ud83d\\uDE00"}', '{"v":"\\\\ud83d"}', ' {"v":"a"}\n\t ')
    made = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, texts)), mod("p_partkey", 8).cast("int")).alias("json"))
    return decode(made, "json", Model("V", (required("v", "string"),))).select("p_partkey", "value.v", F.col("error.code").alias("wrong"))


@query("""SELECT o_orderkey, '{"z":1.10,"a":[1e400,"1e1",1' || o_orderkey || '000000000000000000000000000000000001,{"k":null,"b":"1.0\\u0001"}]}' AS kept,
  '-0.50' AS number, '"t\\"x"' AS text, ['7.00', '[true,2.0]'] AS each, '{"u":5E-7}' AS below FROM orders""")
def raw_field_verbatim(spark, sf_dir):
    """Opaque fields keep the order of their members and the text of their numbers, wherever they stand."""
    model = Model("Raw", (required("kept", "json"), required("number", "json"), required("text", "json"), required("each", List("json")), required("below", "json", flatten="deep.down")))
    made = table(spark, sf_dir, "orders").select("o_orderkey", doc('{"kept": {"z":1.10, "a" :[1e400,"1e1",1', F.col("o_orderkey"), '000000000000000000000000000000000001,{"k":null,"b":"1.0\\u0001"}]},"number":-0.50,"text":"t\\"x","each":[7.00,[true,2.0]],"deep":{"down":{"u":5E-7}}}').alias("json"))
    return decode(made, "json", model).select("o_orderkey", "value.*")


@query("SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN NULL ELSE 'depth' END AS wrong FROM region")
def depth_limit(spark, sf_dir):
    deep = F.when(F.col("r_regionkey") < 2, 250).otherwise(300)
    made = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit('{"v":'), F.repeat(F.lit("["), deep), F.repeat(F.lit("]"), deep), F.lit("}")).alias("json"))
    return decode(made, "json", Model("V", (required("v", "json"),))).select("r_regionkey", F.col("error.code").alias("wrong"))


# Types ---------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, list_aggregate(list_distinct([p_brand, p_type, p_brand]), 'count')::INTEGER AS n, p_brand AS first, p_size::TINYINT AS code, substr(p_name, 1, 1) AS letter, p_retailprice * 2 AS price, p_retailprice AS low FROM part")
def scalar_types(spark, sf_dir):
    model = Model("Scalars", (required("tags", List("string", unique=True)), required("code", "byte"), required("letter", "char"), required("prices", Map("double"))))
    made = table(spark, sf_dir, "part").select("p_partkey", doc('{"tags":[', F.col("p_brand"), ",", F.col("p_type"), ",", F.col("p_brand"), '],"code":', F.col("p_size"), ',"letter":', F.substring("p_name", 1, 1), ',"prices":{"low":', F.col("p_retailprice"), ',"high":', F.col("p_retailprice") * 2, "}}").alias("json"))
    v = decode(made, "json", model)
    return v.select("p_partkey", F.size("value.tags").alias("n"), F.get("value.tags", F.lit(0)).alias("first"), "value.code", "value.letter", F.col("value.prices")["high"].alias("price"), F.col("value.prices")["low"].alias("low"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'OTHER' ELSE o_orderpriority END AS priority FROM orders")
def enum_unknown(spark, sf_dir):
    model = Model("O", (required("priority", Enum(("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "OTHER"), fallback="OTHER")),))
    made = table(spark, sf_dir, "orders").select("o_orderkey", doc('{"priority":', F.col("o_orderpriority"), "}").alias("json"))
    return decode(made, "json", model).select("o_orderkey", "value.priority")


@query("SELECT s_suppkey, upper(s_name) AS loud, '{\"loud\":\"' || lower(s_name) || '\"}' AS json FROM supplier")
def custom_codec(spark, sf_dir):
    model = Model("S", (required("loud", "string", decoder=lambda raw: F.upper(J.as_string(raw)), encoder=lambda c: J.text_of(F.lower(c)), spark_type="string"),))
    made = table(spark, sf_dir, "supplier").select("s_suppkey", doc('{"loud":', F.col("s_name"), "}").alias("raw"))
    return encode(decode(made, "raw", model), "value", model).select("s_suppkey", "value.loud", "json")


@query("SELECT p_partkey, p_retailprice AS price, [p_retailprice, 2.5] AS history, CASE WHEN p_partkey % 4 = 0 THEN 'format' END AS wrong, '{\"price\":\"USD ' || p_size || '.5\",\"history\":[]}' AS json FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, 'format', NULL FROM part WHERE p_partkey % 4 = 0")
def codec_registry(spark, sf_dir):
    """A type of someone else's, by one codec for all fields, list items and map values of that type."""
    amount = lambda raw: F.regexp_extract(J.as_string(raw), r"^USD ([0-9.]+)$", 1).try_cast("double")
    codecs = Codecs(Codec("Money", "double", amount, lambda c: J.text_of(F.concat(F.lit("USD "), c.cast("string")))))
    model = Model("Priced", (required("price", codecs["Money"]), required("history", List(codecs["Money"]))))
    money = F.concat(F.when(mod("p_partkey", 4) == 0, "EUR ").otherwise("USD "), F.col("p_retailprice").cast("string"))
    made = table(spark, sf_dir, "part").select("p_partkey", "p_size", doc('{"price":', money, ',"history":[', F.concat(F.lit("USD "), F.col("p_retailprice").cast("string")), ',"USD 2.5"]}').alias("raw"))
    read = decode(made, "raw", model)
    back = F.when(F.col("error").isNull(), F.struct((F.col("p_size") + 0.5).cast("double").alias("price"), F.array().cast("array<double>").alias("history")))
    return encode(read.withColumn("row", back), "row", model).select("p_partkey", "value.price", "value.history", F.col("error.code").alias("wrong"), "json")


@query("SELECT p_partkey, 2 AS last, 1 AS size, [p_size::BIGINT, -1] AS longs, [true, false] AS flags, [p_retailprice, 0.25] AS doubles, true AS one FROM part")
def containers(spark, sf_dir):
    """Of equal keys of a map the last counts; arrays of primitives; any object stands for a singleton."""
    model = Model("Held", (required("by_name", Map("int")), required("longs", List("long")), required("flags", List("boolean")), required("doubles", List("double")), required("one", Singleton())))
    made = table(spark, sf_dir, "part").select("p_partkey", doc('{"by_name":{"k":1,"k":2},"longs":[', F.col("p_size"), ',-1],"flags":[true,false],"doubles":[', F.col("p_retailprice"), ',0.25],"one":{"any":[1]}}').alias("json"))
    v = decode(made, "json", model)
    return v.select("p_partkey", F.col("value.by_name")["k"].alias("last"), F.size("value.by_name").alias("size"), "value.longs", "value.flags", "value.doubles", "value.one")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 END AS i, CASE p_partkey % 6 WHEN 0 THEN 0.1 WHEN 1 THEN 9007199254740993.0 WHEN 2 THEN 5e-324 END::DOUBLE AS d,
  CASE WHEN p_partkey % 6 >= 2 AND p_partkey % 6 <> 2 THEN ['range', 'range', 'kind'][p_partkey % 6 - 2] END AS wrong FROM part""")
def number_edges(spark, sf_dir):
    """A leading zero, correctly rounded doubles, and what is not finite."""
    texts = ('{"i":0.5,"d":0.1}', '{"i":0,"d":9007199254740993}', '{"d":5e-324}', '{"i":0,"d":1e400}', '{"i":0,"d":-1e999}', '{"i":0,"d":"NaN"}')
    made = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, texts)), mod("p_partkey", 6).cast("int")).alias("json"))
    return decode(made, "json", Model("E", (optional("i", "int"), required("d", "double")))).select("p_partkey", "value.i", "value.d", F.col("error.code").alias("wrong"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'size' END AS wrong, CASE WHEN r_regionkey > 0 THEN 3 END AS n FROM region")
def size_limit(spark, sf_dir):
    made = table(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 0, F.concat(F.lit('{"xs":['), F.repeat(F.lit("1,"), 1_000_002), F.lit("1]}"))).otherwise('{"xs":[1,2,3]}').alias("json"))
    return decode(made, "json", Model("X", (required("xs", List("int")),))).select("r_regionkey", F.col("error.code").alias("wrong"), F.size("value.xs").alias("n"))


@query("""SELECT o_orderkey, ['$.items[1].price', '$', '$.items[0]'][o_orderkey % 4 + 1] AS path, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 END AS line, CASE o_orderkey % 4 WHEN 0 THEN 14 WHEN 1 THEN 20 WHEN 2 THEN 4 END AS "column" FROM orders""")
def error_places(spark, sf_dir):
    """Line and column of the value that an error is about, or of the first thing wrong in a text that is no document."""
    model = Model("Cart", (required("items", List(Model("Item", (required("price", "double"),)))),))
    lines = ('{"items": [\n   {"price": 1},\n   {\n    "price": "é"}\n]}', '{"items": [\n  {"price": 1},\n  {"price": 1, "n" 2}]}', '{"items": [\n   {"x": 1}]}', '{"items": [ ]}')
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, lines)), mod("o_orderkey", 4).cast("int")).alias("json"))
    return locate(decode(made, "json", model), "json").select("o_orderkey", F.regexp_replace("error.path", r"items\[0\]\.price", "items[0]").alias("path"), "error.line", "error.column")


# Polymorphism and envelopes ------------------------------------------------------------------------------------------

CLICK, BUY, REST = Model("Click", (required("k", "int"),)), Model("Buy", (required("value", "double"),)), Model("Rest", (defaulted("raw", "string", "unknown"),))


def _typed_events(spark, sf_dir) -> DataFrame:
    made = doc('{"k":', F.get_json_object("props", "$.k").cast("int"), ',"value":', F.col("value"), ',"type":', F.col("event_type"), "}")
    return table(spark, sf_dir, "events").select("event_id", made.alias("json"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'other' END AS kind, CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
  CASE WHEN event_type = 'purchase' THEN value END AS v, CASE WHEN event_type NOT IN ('click', 'purchase') THEN 'unknown' END AS raw FROM events""")
def sealed_fallback(spark, sf_dir):
    read = decode(_typed_events(spark, sf_dir), "json", Sealed("Event", {"click": CLICK, "purchase": BUY, "other": REST}, fallback="other"))
    return read.select("event_id", F.col("value._type").alias("kind"), F.col("value.click.k").alias("k"), F.col("value.purchase.value").alias("v"), F.col("value.other.raw").alias("raw"))


@query("SELECT coalesce(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END, 'subclass') AS outcome, count(*)::BIGINT AS n FROM events GROUP BY 1")
def sealed_dispatch(spark, sf_dir):
    read = decode(_typed_events(spark, sf_dir), "json", Sealed("Event", {"click": CLICK, "purchase": BUY}))
    return read.groupBy(F.coalesce("value._type", "error.code").alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN '{"type":"click","k":' || json_extract_string(props, '$.k') || '}' END AS json FROM events""")
def sealed_encode(spark, sf_dir):
    kind = Sealed("Event", {"click": CLICK, "purchase": BUY})
    read = encode(decode(_typed_events(spark, sf_dir), "json", kind).drop("json"), "value", kind)
    return read.select("event_id", F.when(F.col("value._type") == "click", F.col("json")).alias("json"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Card' WHEN 1 THEN 'Transfer' WHEN 2 THEN 'Cash' WHEN 3 THEN 'Card' ELSE 'inference' END AS kind, CASE WHEN o_orderkey % 6 = 3 THEN 'gold' END AS club FROM orders")
def inferred_dispatch(spark, sf_dir):
    """How an order was paid is told by the keys of the payment alone."""
    paid = required("paid", "double")
    kind = Inferred("Payment", {"Transfer": Model("Transfer", (paid, required("account", "string"), optional("bank", "string"))), "Card": Model("Card", (paid, required("card", "string"), optional("club", "string"))), "Cash": Model("Cash", (paid, required("till", "int")))})
    rest = ('"card":"c"}', '"account":"a","bank":null}', '"till":4,"x":[]}', '"club":"gold","card":"c"}', '"card":"c","till":4}', '"bank":"b"}')
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(doc('{"paid":', F.col("o_totalprice"), ","), F.get(F.array(*map(F.lit, rest)), mod("o_orderkey", 6).cast("int"))).alias("json"))
    return decode(made, "json", kind).select("o_orderkey", F.coalesce("value._type", "error.code").alias("kind"), F.col("value.Card.club").alias("club"))


def _envelopes(spark, sf_dir) -> DataFrame:
    made = doc('{"eventType":', F.col("event_type"), ',"click":', F.struct(F.col("event_id").alias("id")), ',"view":', F.struct(F.col("user_id").alias("user")), ',"rest":{"z":1},"data":', F.struct("value"), "}")
    return table(spark, sf_dir, "events").select("event_id", made.alias("json"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN '{"id":' || event_id || '}' WHEN 'view' THEN '{"user":' || user_id || '}' ELSE '{"z":1}' END AS payload FROM events""")
def envelope_fat(spark, sf_dir):
    return route(_envelopes(spark, sf_dir), "json", Envelope("eventType", {"click": "click", "view": "view"}, fallback_field="rest")).select("event_id", "payload")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN event_id END AS click_id, CASE WHEN event_type = 'view' THEN user_id END AS view_user FROM events")
def envelope_typed(spark, sf_dir):
    targets = {"click": Model("C", (required("id", "long"),)), "view": Model("V", (required("user", "long"),))}
    read = route_typed(_envelopes(spark, sf_dir), "json", Envelope("eventType", {"click": "click", "view": "view"}, targets=targets))
    return read.select("event_id", F.col("value.click.id").alias("click_id"), F.col("value.view.user").alias("view_user"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events")
def envelope_generic(spark, sf_dir):
    read = route_typed(_envelopes(spark, sf_dir), "json", Envelope("eventType", data_field="data", targets={"purchase": Model("P", (required("value", "double"),))}))
    return read.select("event_id", F.col("value.purchase.value").alias("paid"))


# Opaque JSON ---------------------------------------------------------------------------------------------------------

RAW = ('{"a":1}', "[1]", '"x\\"y"', " 12 ", "1.5e2", "true", "null", "nope", "007", "12345678901")


def _raw(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, RAW)), mod("o_orderkey", 10).cast("int")).alias("raw"))


@query("""SELECT o_orderkey, ['OBJECT', 'ARRAY', 'STRING', 'NUMBER', 'NUMBER', 'BOOLEAN', 'NULL', 'INVALID', 'INVALID', 'NUMBER'][o_orderkey % 10 + 1] AS kind, o_orderkey % 10 = 6 AS is_null FROM orders""")
def raw_kind(spark, sf_dir):
    return _raw(spark, sf_dir).select("o_orderkey", J.kind(F.col("raw")).alias("kind"), J.is_json_null(F.col("raw")).alias("is_null"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN true END AS b, CASE WHEN o_orderkey % 10 = 3 THEN 12 END AS i, CASE o_orderkey % 10 WHEN 3 THEN 12 WHEN 9 THEN 12345678901 END::BIGINT AS l,
  CASE o_orderkey % 10 WHEN 3 THEN 12.0 WHEN 4 THEN 150.0 WHEN 9 THEN 12345678901.0 END::DOUBLE AS d, CASE WHEN o_orderkey % 10 = 2 THEN 'x"y' END AS s,
  ['{"a":1}', '[1]', 'x"y', '12', '1.5e2', 'true', 'null', 'nope', '007', '12345678901'][o_orderkey % 10 + 1] AS shown FROM orders""")
def raw_scalars(spark, sf_dir):
    r = F.col("raw")
    return _raw(spark, sf_dir).select("o_orderkey", J.as_boolean(r).alias("b"), J.as_int(r).alias("i"), J.as_long(r).alias("l"), J.as_double(r).alias("d"), J.as_string(r).alias("s"), J.as_display_string(r).alias("shown"))


@query("""SELECT event_id, '{"z":1.0,"k":' || json_extract_string(props, '$.k') || '}' AS captured, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def raw_capture(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", doc('{"data":{"z" : 1.0, "k":', F.get_json_object("props", "$.k").cast("int"), "}}").alias("json"))
    prepare(spark)
    read = made.select("event_id", J.capture(F.col("json"), "data").alias("captured"))
    return decode(read, "captured", PROPS).select("event_id", "captured", "value.k")


# Encoding ------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{"id":' || c_custkey || ',"a":null}' ELSE '{"id":' || c_custkey || ',"a":"' || c_name || '","b":' || c_nationkey || '}' END AS json FROM customer""")
def encode_null_policy(spark, sf_dir):
    model = Model("N", (required("id", "long"), optional("a", "string"), defaulted("b", "int", None)))
    odd = mod("c_custkey", 2) == 1
    row = F.struct(F.col("c_custkey").alias("id"), F.when(odd, F.col("c_name")).alias("a"), F.when(odd, F.col("c_nationkey")).alias("b"))
    return encode(table(spark, sf_dir, "customer").select("c_custkey", row.alias("row")), "row", model).select("c_custkey", "json")


@query("""SELECT l_orderkey, l_linenumber, '{"q":' || l_quantity::BIGINT || '.0,"n":' || l_orderkey || ',"xs":[' || l_linenumber || ',null],"m":{"a":true}}' AS json FROM lineitem""")
def encode_numbers(spark, sf_dir):
    model = Model("L", (required("q", "double"), required("n", "long"), required("xs", List("int")), required("m", Map("boolean"))))
    row = F.struct(F.floor("l_quantity").cast("double").alias("q"), F.col("l_orderkey").alias("n"), F.array("l_linenumber", F.lit(None).cast("int")).alias("xs"), F.create_map(F.lit("a"), F.lit(True)).alias("m"))
    return encode(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", row.alias("row")), "row", model).select("l_orderkey", "l_linenumber", "json")


@query("""SELECT s_suppkey, '{"t":"q\\" b\\\\ n\\n t\\t u\\u0001 / é ' || s_name || '"}' AS json FROM supplier""")
def encode_escapes(spark, sf_dir):
    row = F.struct(F.concat(F.lit('q" b\\ n\n t\t u\x01 / é '), F.col("s_name")).alias("t"))
    return encode(table(spark, sf_dir, "supplier").select("s_suppkey", row.alias("row")), "row", Model("T", (required("t", "string"),))).select("s_suppkey", "json")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{"d":0.5}' ELSE '{"d":0.333333333}' END AS json FROM part""")
def encode_nine_decimals(spark, sf_dir):
    row = F.struct(F.when(mod("p_partkey", 2) == 0, 0.5).otherwise(1 / 3).alias("d"))
    return encode(table(spark, sf_dir, "part").select("p_partkey", row.alias("row")), "row", Model("D", (required("d", "double"),)), decimals=9).select("p_partkey", "json")


# proto3 JSON ---------------------------------------------------------------------------------------------------------

BUYER = Model("Buyer", (required("cust_key", "long"), required("trade_name", "string"), required("acct_bal", "double"), defaulted("market_segment", "string", "UNSET"), optional("nation_key", "uint")), proto=True)


@query("SELECT c_custkey AS cust_key, c_name AS trade_name, c_acctbal AS acct_bal, 'UNSET' AS market_segment, c_nationkey AS nation_key, c_custkey + 9007199254740993 AS big FROM customer")
def proto_int64_quoted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    made = rows.select("c_custkey", doc('{"custKey":"', F.col("c_custkey"), '","tradeName":', F.col("c_name"), ',"acctBal":"', F.col("c_acctbal"), '","marketSegment":null,"nationKey":', F.col("c_nationkey"), "}").alias("json"), doc('{"big":', F.col("c_custkey") + 9007199254740993, "}").alias("bare"))
    read = decode(decode(made, "json", BUYER), "bare", Model("B", (required("big", "ulong"),), proto=True), value="b", err="eb")
    return read.select("value.cust_key", "value.trade_name", "value.acct_bal", "value.market_segment", "value.nation_key", F.col("b.big").cast("long").alias("big"))


@query("""SELECT c_custkey, '{' || concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN '"custKey":"' || c_custkey || '"' END, '"tradeName":"' || c_name || '"', CASE WHEN c_custkey % 3 <> 0 THEN '"acctBal":2.5' END, '"marketSegment":"' || c_mktsegment || '"') || '}' AS json FROM customer""")
def proto_omit_defaults(spark, sf_dir):
    row = F.struct(F.when(mod("c_custkey", 2) == 0, F.lit(0)).otherwise(F.col("c_custkey")).cast("long").alias("cust_key"), F.col("c_name").alias("trade_name"), F.when(mod("c_custkey", 3) == 0, 0.0).otherwise(2.5).alias("acct_bal"), F.col("c_mktsegment").alias("market_segment"), F.lit(None).cast("long").alias("nation_key"))
    return encode(table(spark, sf_dir, "customer").select("c_custkey", row.alias("row")), "row", BUYER).select("c_custkey", "json")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 4294967295 WHEN 2 THEN 7 END AS u, CASE WHEN p_partkey % 5 > 2 THEN 'range' END AS wrong FROM part")
def proto_uint32(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ("0", "4294967295", '"7"', "4294967296", "-1"))), mod("p_partkey", 5).cast("int"))
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"u":'), text, F.lit("}")).alias("json"))
    return decode(made, "json", Model("U", (required("u", "uint"),), proto=True)).select("p_partkey", "value.u", F.col("error.code").alias("wrong"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS n, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS t, CASE WHEN s_suppkey % 2 = 1 THEN true END AS b,
  '{' || concat_ws(',', CASE WHEN s_suppkey % 3 <> 0 THEN '"n":"' || s_suppkey || '"' END, CASE WHEN s_suppkey % 2 = 0 THEN '"t":"' || s_name || '"' ELSE '"b":true' END) || '}' AS json FROM supplier""")
def proto_wrappers(spark, sf_dir):
    """Wrapper messages are plain values that may be absent; a default that is set is written."""
    model = Model("W", (optional("n", "long"), optional("t", "string"), optional("b", "boolean")), proto=True)
    made = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(mod("s_suppkey", 3) == 0, '{"n":null').otherwise(doc('{"n":"', F.col("s_suppkey"), '"')), F.when(mod("s_suppkey", 2) == 0, doc(',"t":', F.col("s_name"), "}")).otherwise(',"b":true}')).alias("doc"))
    return encode(decode(made, "doc", model), "value", model).select("s_suppkey", "value.n", "value.t", "value.b", "json")


@query("""SELECT o_orderkey, o_totalprice AS amount, o_custkey::DOUBLE AS first, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'kind' END AS wrong FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'kind' FROM orders WHERE o_orderkey % 3 = 0""")
def proto_dynamic_types(spark, sf_dir):
    """Value, Struct and ListValue are dynamic trees; their numbers are read as doubles."""
    model = Model("Dynamic", (required("attributes", "struct"), required("parts", "listvalue"), optional("note", "value")), proto=True)
    parts = F.when(mod("o_orderkey", 3) == 0, '{"no":"list"}').otherwise(doc("[", F.col("o_custkey"), ',"two",null]'))
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(doc('{"attributes":{"amount":', F.col("o_totalprice"), ',"deep":{"k":[1]}},"parts":'), parts, F.when(mod("o_orderkey", 2) == 0, ',"note":"x"}').otherwise(',"note":null}')).alias("json"))
    read = decode(made, "json", model)
    get = lambda field, path, kind: F.try_variant_get(F.col(f"value.{field}"), path, kind)
    return read.select("o_orderkey", get("attributes", "$.amount", "double").alias("amount"), get("parts", "$[0]", "double").alias("first"), get("note", "$", "string").alias("note"), F.col("error.code").alias("wrong"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS kind, CASE WHEN event_type = 'click' THEN user_id END AS by_user, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events""")
def proto_any_registry(spark, sf_dir):
    """Messages of several types are packed, travel as JSON, and are unpacked by their type URL."""
    registry = {"click": Model("ClickMade", (defaulted("by_user", "long", 0),), proto=True), "purchase": Model("Purchase", (optional("paid", "double"),), proto=True)}
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.struct(F.col("user_id").alias("by_user")).alias("c"), F.struct(F.col("value").alias("paid")).alias("p"))
    rows = pack_any(pack_any(rows, "c", "click", registry["click"], "as_click"), "p", "purchase", registry["purchase"], "as_purchase")
    other = F.struct(F.lit("type.googleapis.com/other").alias("type_url"), F.lit('{"z":1}').alias("value"))
    packed = F.when(F.col("event_type") == "click", F.col("as_click")).when(F.col("event_type") == "purchase", F.col("as_purchase")).otherwise(other)
    holder = Model("Holder", (required("detail", "any"),), proto=True)
    sent = encode(rows.select("event_id", F.struct(packed.alias("detail")).alias("row")), "row", holder).select("event_id", "json")
    read = unpack_dynamic(decode(sent, "json", holder).select("event_id", "value.detail"), "detail", registry)
    return read.select("event_id", F.col("value._type").alias("kind"), F.col("value.click.by_user").alias("by_user"), F.col("value.purchase.paid").alias("paid"))


@query("""SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, ((event_id % 3) * 500000000)::INTEGER % 1000000000 AS nanos,
  strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 1 THEN '.500Z' ELSE 'Z' END AS text FROM events""")
def proto_timestamp(spark, sf_dir):
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(mod("event_id", 3) == 1, F.concat(whole, F.lit(".5Z"))).otherwise(F.concat(F.date_format(F.col("ts") + F.expr("interval 90 minutes"), "yyyy-MM-dd't'HH:mm:ss"), F.lit("+01:30")))
    stamp = table(spark, sf_dir, "events").select("event_id", P.parse_timestamp(text).alias("t"))
    return stamp.select("event_id", "t.seconds", "t.nanos", P.format_timestamp(F.col("t")).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * l_orderkey)::BIGINT AS seconds, (CASE WHEN l_linenumber % 2 = 0 THEN -250000000 ELSE 0 END)::INTEGER AS nanos,
  CASE WHEN l_linenumber % 2 = 0 THEN '-' || l_orderkey || '.250s' ELSE l_orderkey || 's' END AS text FROM lineitem""")
def proto_duration(spark, sf_dir):
    text = F.when(mod("l_linenumber", 2) == 0, F.concat(F.lit("-"), F.col("l_orderkey").cast("string"), F.lit(".25s"))).otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit("s")))
    span = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.parse_duration(text).alias("d"))
    return span.select("l_orderkey", "l_linenumber", "d.seconds", "d.nanos", P.format_duration(F.col("d")).alias("text"))


@query("SELECT doc_id, text, base64(encode(text)) AS coded FROM documents")
def proto_base64(spark, sf_dir):
    coded = P.format_base64(F.encode("text", "UTF-8"))
    url_safe = F.translate(F.rtrim(F.translate(coded, "=", " ")), "+/", "-_")
    return table(spark, sf_dir, "documents").select("doc_id", P.parse_base64(url_safe).cast("string").alias("text"), coded.alias("coded"))


@query("SELECT n_nationkey, 'foo_bar,' || lower(n_name) || '.baz_q' AS paths, 'fooBar,' || replace(lower(n_name), '_', '') || '.bazQ' AS text FROM nation")
def proto_fieldmask(spark, sf_dir):
    mask = F.concat(F.lit("fooBar,"), F.lower("n_name"), F.lit(".bazQ"))
    read = table(spark, sf_dir, "nation").select("n_nationkey", P.parse_fieldmask(mask).alias("p"))
    return read.select("n_nationkey", F.array_join("p", ",").alias("paths"), P.format_fieldmask(F.col("p")).alias("text"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 700 END AS i, CASE o_orderkey % 6 WHEN 4 THEN 'range' WHEN 5 THEN 'range' END AS wrong FROM orders""")
def proto_int32_lenient(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ('"7"', "7", "7.0", "7e2", "7.5", "4294967296"))), mod("o_orderkey", 6).cast("int"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('{"i":'), text, F.lit("}")).alias("json"))
    return decode(made, "json", Model("I", (required("i", "int"),), proto=True)).select("o_orderkey", "value.i", F.col("error.code").alias("wrong"))


@query("SELECT o_orderkey, ['F', 'O', 'P'][o_orderkey % 3 + 1] AS status, o_orderkey % 3 = 2 AS odd FROM orders")
def proto_enum_and_floats(spark, sf_dir):
    model = Model("E", (required("status", Enum(("F", "O", "P"))), required("f", "double")), proto=True)
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, ('{"status":"F","f":"1.5"}', '{"status":1,"f":2}', '{"status":"2","f":"NaN"}'))), mod("o_orderkey", 3).cast("int")).alias("json"))
    return decode(made, "json", model).select("o_orderkey", "value.status", F.isnan("value.f").alias("odd"))


@query("""SELECT event_id, 'type.googleapis.com/' || event_type AS url, CASE WHEN event_type = 'click' THEN props END AS click FROM events""")
def proto_any(spark, sf_dir):
    model = Model("Holder", (required("detail", "any"),), proto=True)
    made = table(spark, sf_dir, "events").select("event_id", F.concat(doc('{"detail":{"@type":', F.concat(F.lit("type.googleapis.com/"), F.col("event_type")), ',"value":'), F.regexp_replace("props", " ", ""), F.lit("}}")).alias("json"))
    read = decode(made, "json", model)
    click = P.unpack_any(F.col("value.detail"), "click", dynamic=True)
    return read.select("event_id", F.col("value.detail.type_url").alias("url"), F.regexp_replace(click, ":", ": ").alias("click"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'code' END AS which, CASE WHEN event_id % 2 = 0 THEN '{\"id\":\"x\",\"text\":\"t\"}' ELSE '{\"id\":\"x\",\"code\":5}' END AS json FROM events")
def proto_oneof(spark, sf_dir):
    payload = Inferred("Payload", {"text": Model("Text", (required("text", "string"),), proto=True), "code": Model("Code", (required("code", "int"),), proto=True)})
    model = Model("Oneof", (required("id", "string"), required("payload", payload, keys=True)), proto=True)
    made = table(spark, sf_dir, "events").select("event_id", F.when(mod("event_id", 2) == 0, '{"id":"x","text":"t"}').otherwise('{"id":"x","code":5}').alias("doc"))
    return encode(decode(made, "doc", model), "value", model).select("event_id", F.col("value.payload._type").alias("which"), "json")


@query("SELECT c_custkey, c_nationkey::DOUBLE AS n FROM customer")
def proto_dynamic_value(spark, sf_dir):
    prepare(spark)
    made = table(spark, sf_dir, "customer").select("c_custkey", doc('{"a":[', F.col("c_nationkey"), "]}").alias("json"))
    return made.select("c_custkey", P.dynamic_double(F.col("json"), "$.a[0]").alias("n"))


# Framing and encodings -----------------------------------------------------------------------------------------------


@query("SELECT conv_id, count(*)::BIGINT AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def ndjson_conversations(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line"))
    framed = lines.select(F.explode(F.split(F.concat("line", F.lit("\n\n")), "\n")).alias("document")).filter("document <> ''")
    read = decode(framed, "document", Model("Turn", (required("conv_id", "long"), required("text", "string"))))
    return read.groupBy("value.conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("value.text")).alias("chars"))


@query("SELECT doc_id, text FROM documents")
def encoding_sniff(spark, sf_dir):
    body = F.col("text")
    bom = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(body, charset))
    data = F.when(mod("doc_id", 4) == 0, bom("FFFE", "UTF-16LE")).when(mod("doc_id", 4) == 1, bom("FEFF", "UTF-16BE")).when(mod("doc_id", 4) == 2, bom("EFBBBF", "UTF-8")).otherwise(F.encode(body, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", transcode(data).alias("text"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0")
def ndjson_files(spark, sf_dir):
    """Values written one to a line and read back; null values leave no line."""
    model = Model("C", (required("c_custkey", "long"), required("c_name", "string"), required("c_nationkey", "long")))
    path = fresh_path(spark, "ndjson")
    rows = table(spark, sf_dir, "customer").select(F.when(mod("c_custkey", 3) != 0, F.struct("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))).alias("row"))
    write_ndjson(rows, "row", model, path)
    return decode(read_ndjson(spark, path), "document", model).select("value.*")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def document_files(spark, sf_dir):
    """Files of one document each, which spans many lines."""
    path = fresh_path(spark, "documents")
    text = doc('{\n "key": ', F.col("n_nationkey"), ',\n "name":\n  ', F.col("n_name"), ',\n\n "region": ', F.col("n_regionkey"), "\n}")
    table(spark, sf_dir, "nation").select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = decode(read_documents(spark, path).filter("valid"), "document", Model("N", (required("n_nationkey", "long", wire="key"), required("n_name", "string", wire="name"), required("n_regionkey", "long", wire="region"))))
    return read.select("value.*")


@query("SELECT s_suppkey, s_name AS text FROM supplier")
def utf32_sniff(spark, sf_dir):
    """UTF-32 of either order, with and without a byte order mark."""
    wide = lambda order: F.unhex(F.array_join(F.transform(F.filter(F.split("s_name", ""), lambda c: c != ""), lambda c: F.concat(F.lit("000000"), F.hex(c)) if order else F.concat(F.hex(c), F.lit("000000"))), ""))
    marked = F.when(mod("s_suppkey", 4) == 0, F.concat(F.unhex(F.lit("0000FEFF")), wide(True))).when(mod("s_suppkey", 4) == 1, F.concat(F.unhex(F.lit("FFFE0000")), wide(False))).when(mod("s_suppkey", 4) == 2, wide(True)).otherwise(wide(False))
    return table(spark, sf_dir, "supplier").select("s_suppkey", transcode(marked).alias("text"))


# YAML ----------------------------------------------------------------------------------------------------------------

CONFIG = Model("Config", (required("name", "string"), required("nation", "int"), required("balance", "double"), defaulted("active", "boolean", True), optional("note", "string"), required("tags", List("string"))))


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_custkey % 2 = 0 AS active, NULL::VARCHAR AS note, c_mktsegment AS tag FROM customer")
def yaml_config(spark, sf_dir):
    text = F.concat(F.lit("# customer\nname: '"), F.col("c_name"), F.lit("'\nnation: "), F.col("c_nationkey").cast("string"), F.lit("\nbalance: "), F.col("c_acctbal").cast("string"), F.lit("\nactive: "), F.when(mod("c_custkey", 2) == 0, "True").otherwise("FALSE"), F.lit("\nnote: ~\ntags:\n  - "), F.col("c_mktsegment"), F.lit("\n"))
    read = table(spark, sf_dir, "customer").select("c_custkey", yaml_to_json(text)["json"].alias("json"))
    v = decode(read, "json", CONFIG, Options(yaml=True))
    return v.select("c_custkey", "value.name", "value.nation", "value.balance", "value.active", "value.note", F.get("value.tags", F.lit(0)).alias("tag"))


@query("SELECT n_nationkey, i::INTEGER AS position, CASE WHEN i = 0 THEN n_name ELSE 'region ' || n_regionkey END AS label FROM nation, range(2) t(i)")
def yaml_multidoc(spark, sf_dir):
    stream = join_yaml(F.array(F.concat(F.lit("label: "), F.col("n_name"), F.lit("\n")), F.concat(F.lit('label: "region '), F.col("n_regionkey").cast("string"), F.lit('"\n'))))
    rows = read_yaml(table(spark, sf_dir, "nation").select("n_nationkey", stream.alias("text")), "text")
    return decode(rows, "document", Model("L", (required("label", "string"),))).select("n_nationkey", "position", "value.label")


@query("SELECT s_suppkey, s_nationkey AS a, 2 AS b, 9 AS c, 255 AS hex FROM supplier")
def yaml_anchor_merge(spark, sf_dir):
    text = F.concat(F.lit("base: &x {a: "), F.col("s_nationkey").cast("string"), F.lit(", b: 1}\nmore: &y {b: 7, c: 9}\nitem:\n  b: 2\n  <<: [*x, *y]\nhex: 0xFF\n"))
    model = Model("M", (required("a", "int", flatten="item.a"), required("b", "int", flatten="item.b"), required("c", "int", flatten="item.c"), required("hex", "int")))
    read = table(spark, sf_dir, "supplier").select("s_suppkey", yaml_to_json(text)["json"].alias("json"))
    return decode(read, "json", model).select("s_suppkey", "value.*")


@query("""SELECT p_partkey, 'name: "' || p_name || '"' || chr(10) || 'size: ' || p_size || chr(10) || 'tags:' || chr(10) || '  - "' || p_brand || '"' || chr(10) || '  - "true"' || chr(10) AS yaml FROM part""")
def yaml_write(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", F.lit("true")).alias("tags"))).alias("json"))
    return made.select("p_partkey", json_to_yaml(F.col("json")).alias("yaml"))


@query("""SELECT s_suppkey, 'first' || chr(10) || ' ' || s_name || chr(10) AS literal, 'one two' || chr(10) || 'three' AS folded, 'plain goes on' AS plain, 'a b' AS quoted, s_suppkey % 3 = 0 AS wrong FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, true FROM supplier WHERE s_suppkey % 3 = 0""")
def yaml_scalars(spark, sf_dir):
    """Literal and folded blocks with their chomping, scalars over several lines, and garbage after a document."""
    text = F.concat(F.lit("literal: |\n  first\n   "), F.col("s_name"), F.lit("\n\nfolded: >-\n  one\n  two\n\n  three\n\nplain: plain\n  goes\n  on\nquoted: \"a\n  b\"\n"), F.when(mod("s_suppkey", 3) == 0, "... garbage\n").otherwise(""))
    read = table(spark, sf_dir, "supplier").select("s_suppkey", yaml_to_json(text).alias("y"))
    fields = ("literal", "folded", "plain", "quoted")
    v = decode(read.select("s_suppkey", "y.json", (F.col("y.error").isNotNull()).alias("wrong")), "json", Model("S", tuple(required(n, "string") for n in fields)), Options(yaml=True))
    return v.select("s_suppkey", *(f"value.{n}" for n in fields), "wrong")


# Consumers of decoded columns: Spark's own relational operators ------------------------------------------------------


@query("""SELECT n_name, count(*)::BIGINT AS orders, max(o_orderkey) AS last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""")
def decoded_join_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus")).alias("json"))
    orders = decode(rows, "json", Model("O", tuple(required(n, t) for n, t in (("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "string"))))).select("value.*").filter("o_orderstatus = 'F'")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last"))
