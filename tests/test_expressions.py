import pytest
from pyspark.sql import functions as F

from sluicework.functions.expressions import compile_expr, referenced_fields
from sluicework.operators.filtering import (
    filter_counts,
    filter_rows,
    matches,
    require_document,
    unresolved_fields,
)

SCHEMA = (
    "id int, amount int, tier string, tags array<string>, active boolean, note string, "
    "order struct<status:string>, metadata map<string,string>"
)
ROWS = [
    (1, 25, "free", ["a", "b"], True, None, ("new",), {"kind": "a", "retry_count": "1"}),
    (2, 12500, "pro", ["b"], False, "urgent", ("refunded",), {"kind": "b", "retry_count": "9"}),
    (3, 50, "pro", [], True, "later", ("new",), {"kind": "a", "retry_count": "5"}),
]
# The published matrix of rows, expressions and the ids they keep.
CASES = [
    ("amount > 100", [2]),
    ("amount >= 50", [2, 3]),
    ("amount > 20 and amount < 100", [1, 3]),
    ("amount > 20 && amount < 100", [1, 3]),
    ("tier == 'pro'", [2, 3]),
    ('tier == "pro"', [2, 3]),
    ("tier != 'pro'", [1]),
    ("tier in ['free','pro']", [1, 2, 3]),
    ("startsWith(tier, 'p')", [2, 3]),
    ("contains(note, 'urgen')", [2]),
    ("note == null", [1]),
    ("note != null", [2, 3]),
    ("active", [1, 3]),
    ("not active", [2]),
    ("len(tags) > 1", [1]),
    ("len(tier) > 3", [1]),
    ("order.status == 'new'", [1, 3]),
    ("amount > 100 or tier == 'free'", [1, 2]),
    ("amount > 100 || tier == 'free'", [1, 2]),
    ("meta.kind == 'a'", [1, 3]),
    ("number(meta.retry_count) >= 5", [2, 3]),
    ("note == 'a && b' or id == 3", [3]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize("expression,expected", CASES)
def test_matrix_through_filter_and_flag(rows, expression, expected):
    kept = sorted(r.id for r in filter_rows(rows, expression).select("id").collect())
    assert kept == expected
    flagged = rows.select("id", matches(rows, expression).alias("m")).collect()
    assert sorted(r.id for r in flagged if r.m) == expected
    assert all(r.m is not None for r in flagged)


def test_early_errors_name_the_cause(rows):
    with pytest.raises(ValueError, match=r"number\(tier\)"):
        compile_expr("tier > 5", rows)
    with pytest.raises(ValueError, match=r"number\(meta.retry_count\)"):
        compile_expr("meta.retry_count >= 5", rows)
    for bad in ("amount >", "", "nosuch == 1", "amount + 1"):
        with pytest.raises(ValueError):
            compile_expr(bad, rows)


def test_counts_and_unresolved(rows):
    assert filter_counts(rows, "note == 'urgent'").first().asDict() == {
        "rows_read": 3, "rows_kept": 1, "rows_dropped": 2,
    }
    assert referenced_fields("order.status == 'x' and len(tags) > 1 or meta.kind == 'a'") == [
        "order.status", "tags", "meta.kind",
    ]
    seen = {r.field: (r.rows_with_field, r.unresolved) for r in
            unresolved_fields(rows, "ammount > 1 and note == 'x'").collect()}
    assert seen == {"ammount": (0, True), "note": (2, False)}


def test_filter_reaches_the_scan(spark, work):
    spark.range(10).select("id", F.col("id").cast("string").alias("t")).write.parquet(work + "/t")
    df = spark.read.parquet(work + "/t")
    plan = filter_rows(df, "id > 5 and t in ['6','7']")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id)" in plan and "GreaterThan(id,5)" in plan


def test_non_document_fails_the_job(spark):
    df = spark.createDataFrame([('{"a":1}',), ("[1]",)], "payload string")
    assert require_document(df.limit(1), "payload").count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        require_document(df, "payload").collect()


@pytest.mark.parametrize("form", ["string", "binary"])
def test_the_matrix_holds_for_documents(spark, form):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "metadata"]), {"ignoreNullFields": "false"})
    docs = rows.select(payload.cast(form).alias("payload"), "metadata")
    for expression, ids in CASES:
        kept = filter_rows(docs, expression).select(F.get_json_object(F.col("payload").cast("string"), "$.id").cast("int").alias("id"))
        assert sorted(r.id for r in kept.collect()) == ids, expression


def test_document_values_of_another_kind_are_unknown(spark):
    payloads = ['{"a":"25","b":null}', '{"a":25}', '{"a":[1]}', '{"a":{"x":1}}', '{"b":1}', "no json", "[1]", None]
    docs = spark.createDataFrame([(p,) for p in payloads], "payload string")
    for expression, n in [("a > 1", 1), ("a != 7", 1), ("a == '25'", 1), ("number(a) == 25", 2), ("b == null", 1), ("b != null", 1),
                          ("a.x == 1", 1), ("len(a) == 1", 1), ("a", 0), ("not a", 0), ("7 < a", 1), ("a in [25, 26]", 1)]:
        assert filter_rows(docs, expression).count() == n, expression
