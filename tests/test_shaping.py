import itertools
import json

import pytest
from pyspark.sql import functions as F

from sluicework.operators.shaping import (
    check_required, decode_json, error_parts, map_fields, transform, type_columns,
)

MATRIX = [
    ({"type": "integer"}, '{"value":"7"}', {"value": 7}),
    ({"type": "integer"}, '{"value":"7.5"}', "[coercion]"),
    ({"type": "integer"}, '{"value":7.0}', "[coercion]"),
    ({"type": "number"}, '{"value":"2.5"}', {"value": 2.5}),
    ({"type": "boolean"}, '{"value":"true"}', {"value": True}),
    ({"type": "boolean"}, '{"value":"1"}', {"value": True}),
    ({"type": "boolean"}, '{"value":"0"}', {"value": False}),
    ({"type": "boolean"}, '{"value":"yes"}', "[coercion]"),
    ({"type": "string"}, '{"value":7}', {"value": "7"}),
    ({"type": "string"}, '{"value":true}', "[coercion]"),
    ({"type": "string", "enum": ["a", "b"]}, '{"value":"a"}', {"value": "a"}),
    ({"type": "string", "enum": ["a", "b"]}, '{"value":"c"}', "[enum]"),
    ({"type": "array", "items": {"type": "integer"}}, '{"value":["1","2"]}', {"value": [1, 2]}),
    ({"type": "array", "items": {"type": "integer"}}, '{"value":["1","x"]}', "$.value[1] [coercion]"),
    ({"type": "integer", "nullable": True}, '{"value":null}', {"value": None}),
    ({"type": "integer"}, '{"value":null}', "[type_mismatch]"),
    ({"type": "integer"}, '{"other":1}', "[missing_required]"),
    ({"type": "integer"}, '{"value":" 7"}', "[coercion]"),
    ({"type": "integer"}, '{"value":99999999999999999999}', "[coercion]"),
    ({"type": "string"}, '{"value":"q\\"uote\\n"}', {"value": 'q"uote\n'}),
    ({"type": "object", "properties": {"n": {"type": "integer"}}}, '{"value":{"n":"3","z":[1]}}',
     {"value": {"n": 3, "z": [1]}}),
    ({"type": "object", "properties": {"n": {"type": "integer"}}}, '{"value":{"n":"x"}}', "$.value.n [coercion]"),
    ({"contentMediaType": "application/json", "contentSchema":
        {"type": "object", "properties": {"qty": {"type": "integer"}}}},
     '{"value":"{\\"qty\\":\\"7\\"}"}', {"value": {"qty": 7}}),
    ({"type": "array", "items": {"type": "object", "properties": {"qty": {"type": "integer"}}}},
     '{"value":[{"qty":"1"},{"qty":"oops"}]}', "$.value[1].qty [coercion]"),
]


@pytest.mark.parametrize("rule,payload,expected", MATRIX)
def test_type_matrix(spark, rule, payload, expected):
    schema = {"type": "object", "properties": {"value": rule}, "required": ["value"]}
    df = spark.createDataFrame([(payload,)], "payload string")
    good, rejects = transform(df, schema=schema)
    if isinstance(expected, dict):
        assert [json.loads(r.payload) for r in good.collect()] == [expected]
        assert rejects.count() == 0
    else:
        assert good.count() == 0
        error = rejects.first().transform_error
        assert expected in error and error.startswith("$.value")


@pytest.mark.parametrize(
    "coerce,defaults,on_error", list(itertools.product([True, False], [True, False], ["reject", "pass_through"]))
)
def test_option_matrix(spark, coerce, defaults, on_error):
    schema = {"type": "object", "required": ["id"], "properties": {
        "id": {"type": "integer"}, "tier": {"type": "string", "default": "standard"}}}
    df = spark.createDataFrame(
        [('{"id":"1"}', {"k": "v"}), ('{"tier":"pro"}', {"k": "v"})],
        "payload string, metadata map<string,string>").coalesce(1)
    out = transform(df, schema=schema, coerce=coerce, apply_defaults=defaults,
                    on_error=on_error, metadata="metadata")
    fine = {"id": 1, "tier": "standard"} if defaults else {"id": 1}
    if on_error == "reject":
        good, rejects = out
        assert [json.loads(r.payload) for r in good.collect()] == ([fine] if coerce else [])
        assert good.count() + rejects.count() == 2
    else:
        got = [(json.loads(r.payload), "transform_error" in r.metadata) for r in out.collect()]
        first = (fine, False) if coerce else ({"id": "1"}, True)
        assert got == [first, ({"tier": "pro"}, True)]


def test_mapping_then_schema(spark):
    df = spark.createDataFrame([('{"first_name":"John","user_id":"42"}',)], "payload string")
    good, _ = transform(
        df,
        mapping={"firstName": "$.first_name", "id": "$.user_id",
                 "address.city": {"path": "$.city", "default": "unknown"}, "gone": "$.nope"},
        schema={"properties": {"id": {"type": "integer"}}},
    )
    assert json.loads(good.first().payload) == {
        "firstName": "John", "id": 42, "address": {"city": "unknown"}}
    df = spark.createDataFrame([('{"customer_id":"42","order":{"total":"19.99"},"items":[5,6]}',)], "payload string")
    good, rejects = transform(
        df, mapping={"id": "$.customer_id", "total": "$.order.total", "first": "$.items[0]"},
        schema={"properties": {"id": {"type": "integer"}, "total": {"type": "number"}}, "required": ["id"]})
    assert json.loads(good.first().payload) == {"id": 42, "total": 19.99, "first": 5}
    _, rejects = transform(df, mapping={"x": {"path": "$.nope", "required": True}})
    assert "[missing_required]" in rejects.first().transform_error


def test_expression_and_non_document(spark):
    df = spark.createDataFrame([('{"a":2}',), ("plain",)], "payload string")
    good, rejects = transform(df, expression="to_json(named_struct('b', variant_get(doc,'$.a','int') * 2))")
    assert [r.payload for r in good.collect()] == ['{"b":4}']
    assert [r.payload for r in rejects.collect()] == ["plain"]


def test_text_columns(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "true", '{"qty":"7"}'), ("3", "not-a-number", "1", "{}"), (None, "9", "0", "{}"), ("4", "", "no", "x")],
        "id string, amount string, active string, attributes string")
    schema = {"required": ["id"], "properties": {
        "id": {"type": "integer"}, "amount": {"type": "number", "nullable": True},
        "tier": {"type": "string", "default": "standard"}}}
    rows = type_columns(df, schema, coerce_empty_as_null=True).collect()
    assert [(r.id, r.amount, r.tier) for r in rows][:1] == [(1, 2.5, "standard")]
    parts = error_parts(type_columns(df, schema).where("error is not null")).select("path", "code").collect()
    assert sorted(map(tuple, parts)) == [("$.amount", "coercion"), ("$.amount", "coercion"), ("$.id", "missing_required")]
    assert [r.error is None for r in rows] == [True, False, False, True]
    decoded = decode_json(df, "attributes", {"type": "object", "properties": {"qty": {"type": "integer"}}})
    assert decoded.select("attributes.qty").first()[0] == 7
    assert decoded.where("error is not null").count() == 1


def test_map_fields_on_typed_frames(spark):
    df = spark.range(1).select(
        F.lit("J").alias("first_name"), F.struct(F.lit(2).alias("total")).alias("order"),
        F.array(F.lit(5)).alias("items"), F.lit(None).cast("string").alias("city"))
    out = map_fields(df, {
        "firstName": "$.first_name", "total": "$.order.total", "head": "items[0]", "beyond": "$.items[9]",
        "address.city": {"path": "$.city", "default": "unknown"}, "address.zip": {"path": "$.zip", "required": True}})
    row = out.first()
    assert (row.firstName, row.total, row.head, row.beyond, row.address.city) == ("J", 2, 5, None, "unknown")
    assert row.error == "$.zip [missing_required]: required field is absent"
    assert check_required(df, ["first_name", "city"]).first().error.startswith("$.city [missing_required]")
