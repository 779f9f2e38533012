"""Registered queries: mapping, typing and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.functions.rules import TextField, VariantField, to_boolean, to_integer, to_number, to_text
from sluicework.operators import shaping
from sluicework.plans.fixtures import event_docs, event_envelopes, orders_text, with_views
from sluicework.plans.registry import query, table


@query("map_rename", "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders")
def map_rename(spark, sf):
    return shaping.map_fields(
        table(spark, sf, "orders"), {"id": "$.o_orderkey", "priority": "$.o_orderpriority"}
    )


@query("map_nest", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer")
def map_nest(spark, sf):
    nested = shaping.map_fields(
        table(spark, sf, "customer"),
        {"id": "$.c_custkey", "who.name": "$.c_name", "who.place.nation": "$.c_nationkey"},
    )
    return nested.select("id", "who.name", "who.place.nation")


@query("map_flatten", with_views("event_docs") + "SELECT event_id AS id, k AS props_k FROM event_docs")
def map_flatten(spark, sf):
    return shaping.map_fields(event_docs(spark, sf), {"id": "$.event_id", "props_k": "$.props.k"})


@query(
    "map_array_element",
    with_views("event_docs")
    + "SELECT event_id, CASE WHEN n_tags > 1 THEN event_type END AS second_tag FROM event_docs",
)
def map_array_element(spark, sf):
    return shaping.map_fields(event_docs(spark, sf), {"event_id": "event_id", "second_tag": "$.tags[1]"})


@query(
    "map_default",
    with_views("event_docs") + "SELECT event_id, coalesce(note, 'none') AS note, 'gone' AS missing FROM event_docs",
)
def map_default(spark, sf):
    return shaping.map_fields(
        event_docs(spark, sf),
        {"event_id": "event_id", "note": {"path": "$.note", "default": "none"},
         "missing": {"path": "$.nowhere", "default": "gone"}},
    )


@query(
    "map_required",
    with_views("event_docs")
    + """SELECT event_id, note, CASE WHEN note IS NULL
         THEN '$.note [missing_required]: required field is absent' END AS error FROM event_docs""",
)
def map_required(spark, sf):
    return shaping.map_fields(
        event_docs(spark, sf), {"event_id": "event_id", "note": {"path": "$.note", "required": True}}
    )


@query(
    "map_absent_omitted",
    with_views("event_docs")
    + "SELECT event_id, note IS NOT NULL AS has_note FROM event_docs",
)
def map_absent_omitted(spark, sf):
    docs = event_docs(spark, sf).select("event_id", F.to_json(F.struct("note")).alias("payload"))
    good, _ = shaping.transform(docs, mapping={"text": "$.note"})
    return good.select("event_id", F.col("payload").contains('"text":').alias("has_note"))


@query("project_columns", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem")
def project_columns(spark, sf):
    return shaping.project(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"])


_NUMBERISH = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


@query(
    "coerce_integer",
    with_views("orders_text")
    + """SELECT o_orderkey, CASE WHEN regexp_matches(o_totalprice, '^[+-]?[0-9]+$')
         THEN CAST(o_totalprice AS BIGINT) END AS whole_price,
         CAST(o_custkey AS BIGINT) AS customer FROM orders_text""",
)
def coerce_integer(spark, sf):
    return orders_text(spark, sf).select(
        "o_orderkey", to_integer(TextField(F.col("o_totalprice"))).alias("whole_price"),
        to_integer(TextField(F.col("o_custkey"))).alias("customer"),
    )


@query(
    "coerce_number",
    with_views("orders_text") + "SELECT o_orderkey, TRY_CAST(o_totalprice AS DOUBLE) AS price FROM orders_text",
)
def coerce_number(spark, sf):
    return orders_text(spark, sf).select("o_orderkey", to_number(TextField(F.col("o_totalprice"))).alias("price"))


@query(
    "coerce_boolean",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true
       WHEN 3 THEN false END AS flag FROM events""",
)
def coerce_boolean(spark, sf):
    spellings = F.array(*[F.lit(x) for x in ("true", "false", "1", "0", "yes", "")])
    text = F.element_at(spellings, (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", to_boolean(TextField(text)).alias("flag"))


@query("coerce_text", "SELECT event_id, CAST(event_id AS VARCHAR) AS as_text, CAST(NULL AS VARCHAR) AS flag_text FROM events")
def coerce_text(spark, sf):
    doc = F.parse_json(F.to_json(F.struct("event_id", (F.col("value") > 1).alias("flag"))))
    docs = table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return docs.select(
        "event_id", to_text(VariantField(F.col("doc"), "$.event_id")).alias("as_text"),
        to_text(VariantField(F.col("doc"), "$.flag")).alias("flag_text"),
    )


@query(
    "integer_type_test",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN event_id END AS n
       FROM events""",
)
def integer_type_test(spark, sf):
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"')))
        .otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".0")))
    )
    docs = table(spark, sf, "events").select(
        "event_id", F.parse_json(F.concat(F.lit('{"n":'), raw, F.lit("}"))).alias("doc")
    )
    return docs.select("event_id", to_integer(VariantField(F.col("doc"), "$.n")).alias("n"))


def _error_query(rule, required=()):
    schema = {"properties": rule, "required": list(required)}

    def run(spark, sf):
        typed = shaping.type_columns(orders_text(spark, sf), schema, keep=["o_orderkey"])
        return shaping.error_parts(typed).select("o_orderkey", *rule, "path", "code")

    return run


query(
    "check_enum",
    with_views("orders_text")
    + """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN '$.o_orderstatus' END AS path,
         CASE WHEN o_orderstatus = 'P' THEN 'enum' END AS code FROM orders_text""",
)(_error_query({"o_orderstatus": {"type": "string", "enum": ["O", "F"]}}))

query(
    "check_required",
    with_views("orders_text")
    + """SELECT o_orderkey, TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice,
         CASE WHEN o_totalprice IS NULL OR o_totalprice = 'oops' THEN '$.o_totalprice' END AS path,
         CASE WHEN o_totalprice IS NULL THEN 'missing_required' WHEN o_totalprice = 'oops' THEN 'coercion' END AS code
         FROM orders_text""",
)(_error_query({"o_totalprice": {"type": "number"}}, ["o_totalprice"]))

query(
    "schema_default",
    with_views("orders_text")
    + """SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 0.5 ELSE TRY_CAST(o_totalprice AS DOUBLE) END AS o_totalprice,
         CASE WHEN o_totalprice = 'oops' THEN '$.o_totalprice' END AS path,
         CASE WHEN o_totalprice = 'oops' THEN 'coercion' END AS code FROM orders_text""",
)(_error_query({"o_totalprice": {"type": "number", "default": 0.5}}))


@query(
    "schema_strict",
    with_views("orders_text")
    + """SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN 'type_mismatch' END AS code FROM orders_text""",
)
def schema_strict(spark, sf):
    schema = {"properties": {"o_totalprice": {"type": "number"}}}
    typed = shaping.type_columns(orders_text(spark, sf), schema, coerce=False, keep=["o_orderkey"])
    return shaping.error_parts(typed).select("o_orderkey", "code")


@query(
    "empty_as_null",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'type_mismatch' END AS strict_code, CASE WHEN event_id % 2 = 1 THEN event_id END AS n FROM events",
)
def empty_as_null(spark, sf):
    cells = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.col("event_id").cast("string")).alias("n")
    )
    schema = {"properties": {"n": {"type": "integer"}}}
    typed = shaping.type_columns(cells, schema, coerce_empty_as_null=True, keep=["event_id"])
    return shaping.error_parts(typed).select("event_id", F.col("code").alias("strict_code"), "n")


@query(
    "check_nullable",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS n,
       CASE WHEN event_id % 3 = 0 THEN 'type_mismatch' END AS code FROM events""",
)
def check_nullable(spark, sf):
    payload = F.when(F.col("event_id") % 3 == 0, F.lit('{"a":null,"b":null}')).otherwise(
        F.to_json(F.struct(F.col("event_id").alias("a"), F.col("event_id").alias("b")))
    )
    docs = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    lenient, _ = shaping.transform(docs, schema={"properties": {"a": {"type": "integer", "nullable": True}}})
    strict = shaping.transform(
        lenient, schema={"properties": {"b": {"type": "integer"}}}, on_error="pass_through"
    )
    return shaping.error_parts(strict, "transform_error").select(
        "event_id", F.get_json_object("payload", "$.a").cast("bigint").alias("n"), "code"
    )


@query(
    "coerce_array",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id + user_id END AS total,
       CASE WHEN event_id % 5 = 0 THEN '$.ids[1]' END AS path FROM events""",
)
def coerce_array(spark, sf):
    second = F.when(F.col("event_id") % 5 == 0, F.lit("oops")).otherwise(F.col("user_id").cast("string"))
    docs = table(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(F.array(F.col("event_id").cast("string"), second).alias("ids"))).alias("payload")
    )
    schema = {"properties": {"ids": {"type": "array", "items": {"type": "integer"}}}}
    out = shaping.transform(docs, schema=schema, on_error="pass_through")
    ids = F.from_json("payload", "ids array<bigint>")["ids"]
    total = F.when(F.col("transform_error").isNull(), ids[0] + ids[1])
    return shaping.error_parts(out, "transform_error").select("event_id", total.alias("total"), "path")


@query("decode_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def decode_json(spark, sf):
    schema = {"type": "object", "properties": {"k": {"type": "integer"}}}
    docs = shaping.decode_json(table(spark, sf, "events").select("event_id", "props"), "props", schema)
    return docs.select("event_id", "props.k")


_ORDER_SCHEMA = {
    "type": "object", "required": ["o_totalprice"],
    "properties": {
        "o_orderkey": {"type": "integer"}, "o_totalprice": {"type": "number"},
        "tier": {"type": "string", "default": "standard"},
    },
}


def _order_documents(spark, sf):
    return orders_text(spark, sf).select("o_orderkey", F.to_json(F.struct("*")).alias("payload"))


@query(
    "transform_reject_good",
    with_views("orders_text")
    + """SELECT CAST(o_orderkey AS BIGINT) AS id, TRY_CAST(o_totalprice AS DOUBLE) AS price, 'standard' AS tier,
         o_orderpriority AS priority FROM orders_text WHERE o_totalprice IS NOT NULL AND o_totalprice <> 'oops'""",
)
def transform_reject_good(spark, sf):
    good, _ = shaping.transform(_order_documents(spark, sf), schema=_ORDER_SCHEMA)
    row = F.from_json("payload", "o_orderkey bigint, o_totalprice double, tier string, o_orderpriority string")
    return good.select(row.alias("r")).select(
        F.col("r.o_orderkey").alias("id"), F.col("r.o_totalprice").alias("price"), "r.tier",
        F.col("r.o_orderpriority").alias("priority"),
    )


@query(
    "transform_reject_rejects",
    with_views("orders_text")
    + """SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN '$.o_totalprice [missing_required]: required field is absent'
         ELSE '$.o_totalprice [coercion]: cannot use "oops" as number' END AS transform_error
         FROM orders_text WHERE o_totalprice IS NULL OR o_totalprice = 'oops'""",
)
def transform_reject_rejects(spark, sf):
    _, rejects = shaping.transform(_order_documents(spark, sf), schema=_ORDER_SCHEMA)
    return rejects.select("o_orderkey", "transform_error")


@query(
    "transform_pass_through",
    with_views("orders_text")
    + """SELECT o_orderkey, o_totalprice IS NULL OR o_totalprice = 'oops' AS failed,
         CASE WHEN o_totalprice IS NULL OR o_totalprice = 'oops' THEN NULL ELSE 'standard' END AS tier
         FROM orders_text""",
)
def transform_pass_through(spark, sf):
    docs = _order_documents(spark, sf).withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    out = shaping.transform(docs, schema=_ORDER_SCHEMA, on_error="pass_through", metadata="metadata")
    return out.select(
        "o_orderkey", F.map_contains_key("metadata", shaping.TRANSFORM_ERROR).alias("failed"),
        F.get_json_object("payload", "$.tier").alias("tier"),
    )


@query(
    "transform_mapping_and_schema",
    """SELECT CAST(event_id AS VARCHAR) AS message_id, event_id AS id, event_type AS kind, 'unknown' AS city,
       value AS amount FROM events""",
)
def transform_mapping_and_schema(spark, sf):
    good, _ = shaping.transform(
        event_envelopes(spark, sf),
        mapping={"id": "$.event_id", "what.kind": "$.event_type", "what.amount": "$.value",
                 "address.city": {"path": "$.city", "default": "unknown"}},
        schema={"properties": {"id": {"type": "integer"}}, "required": ["id"]},
    )
    row = F.from_json("payload", "id bigint, what struct<kind:string,amount:double>, address struct<city:string>")
    return good.select("message_id", row.alias("r")).select(
        "message_id", "r.id", "r.what.kind", "r.address.city", "r.what.amount"
    )


@query("transform_expression", "SELECT event_id, user_id * 10 AS scaled FROM events")
def transform_expression(spark, sf):
    good, _ = shaping.transform(
        event_envelopes(spark, sf),
        expression="to_json(named_struct('id', variant_get(doc, '$.event_id', 'bigint'), "
        "'scaled', variant_get(doc, '$.user_id', 'bigint') * 10))",
    )
    row = F.from_json("payload", "id bigint, scaled bigint")
    return good.select(row.alias("r")).select(F.col("r.id").alias("event_id"), "r.scaled")


def _matrix(coerce: bool, defaults: bool) -> None:
    """Typed documents counted per outcome under one pair of options."""
    passes = "o_totalprice IS NOT NULL AND o_totalprice <> 'oops'" if coerce else "false"
    tier = "'standard'" if defaults else "CAST(NULL AS VARCHAR)"
    sql = with_views("orders_text") + (
        f"SELECT {passes} AS passed, CASE WHEN {passes} THEN {tier} END AS tier, count(*) AS n FROM orders_text GROUP BY ALL"
    )

    def run(spark, sf):
        out = shaping.transform(
            _order_documents(spark, sf), schema=_ORDER_SCHEMA, coerce=coerce, apply_defaults=defaults,
            on_error="pass_through",
        )
        return out.groupBy(
            F.col("transform_error").isNull().alias("passed"),
            F.get_json_object("payload", "$.tier").alias("tier"),
        ).agg(F.count(F.lit(1)).alias("n"))

    query(f"transform_options_{'coerce' if coerce else 'strict'}_{'defaults' if defaults else 'bare'}", sql)(run)


for _coerce in (True, False):
    for _defaults in (True, False):
        _matrix(_coerce, _defaults)
