"""Plan shapes that have to hold at scale, and the driver contract."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sluicework.operators import dedup, retention, routing, shaping, upsert
from sluicework.operators.filtering import filter_rows
from sluicework.plans.fixtures import change_feed, change_target
from sluicework.sources.files import read_objects

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_filter_and_projection_reach_the_scan(spark):
    df = shaping.project(filter_rows(lines(spark), "l_quantity >= 30 and l_returnflag in ['A','R']"), ["l_orderkey"])
    text = plan(df)
    assert "GreaterThanOrEqual(l_quantity,30.0)" in text and "In(l_returnflag, [A,R])" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text


def test_filter_on_errors_stays_above_the_rules(spark):
    df = lines(spark).select(F.col("l_quantity").cast("string").alias("q"))
    typed = shaping.type_columns(df, {"properties": {"q": {"type": "number"}}})
    good, _ = shaping.split_by_error(typed)
    assert plan(good).count("RLIKE") == 1


def test_switch_is_one_scan(spark):
    routed = routing.switch_when(lines(spark), [("l_quantity > 40", "a"), ("l_tax > 0.05", "b")], "c")
    text = plan(routed.groupBy("route").count())
    assert text.count("FileScan") == 1 and "partial_count" in text


def test_latest_per_key_combines_before_the_shuffle(spark):
    text = plan(dedup.latest_per_key(lines(spark), "l_suppkey", ["l_orderkey", "l_linenumber"]))
    assert "partial_max_by" in text and text.count("Exchange") == 1


def test_keep_last_limits_before_the_shuffle(spark):
    text = plan(retention.keep_last(lines(spark), 5, "l_suppkey", ["l_orderkey", "l_linenumber"]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_upsert_does_not_shuffle_the_target(spark):
    out = upsert.upsert(change_target(spark, SF), change_feed(spark, SF), "key", "update", ["lsn", "ordinal"])
    out.collect()
    text = plan(out)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("Initial Plan")[0]


def test_object_listing_prunes_files(spark, work):
    spark.range(9).selectExpr("cast(id as string) as value", "id % 3 as p").write.partitionBy("p").text(work + "/o")
    last = spark.read.text(work + "/o/p=1").select(F.max("_metadata.file_path")).first()[0]
    assert read_objects(spark, work + "/o", last).count() == 3


def test_contract(spark):
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{SF}/orders.parquet'")
    result = con.execute(oracle["flagship"])
    columns, expected = [d[0] for d in result.description], sorted(result.fetchall())
    assert sorted(map(tuple, contract.entry(spark).select(columns).collect())) == expected


def test_registry_without_the_training_data_folders(work):
    """A copy without ``sluicework/llm`` and ``tests/llm`` (with or without ``corpus_pipeline.py``) keeps every other query."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    expected = {k for k in contract.queries() if not k.startswith("op") and k != "pipeline"}
    for keep_pipeline in (True, False):
        copy = os.path.join(work, f"copy-{keep_pipeline}")
        shutil.copytree(os.path.join(root, "sluicework"), os.path.join(copy, "sluicework"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), copy)
        if keep_pipeline:
            shutil.copy(os.path.join(root, "corpus_pipeline.py"), copy)
        code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(','.join(sorted(q)))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300,
                             env={**os.environ, "PYTHONPATH": copy})
        assert out.returncode == 0, out.stderr
        assert set(out.stdout.strip().split(",")) == expected
