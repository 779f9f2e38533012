"""Many sinks in one pass: counts per branch, unrouted rows, failed jobs and the copy report."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sluicework.plans import copyjob
from sluicework.sinks import branches


def orders(spark):
    rows = [(i, float(i * 10), "F" if i % 3 == 0 else "O") for i in range(30)] + [(99, None, None)]
    return spark.createDataFrame(rows, "id long, price double, status string").repartition(3)


def read_back(spark, path):
    return {(r.branch, json.loads(r.value)["id"]) for r in spark.read.text(path).collect()}


def test_one_job_writes_every_branch_and_counts(spark, work):
    df = orders(spark)
    report = branches.write_branches(df, f"{work}/out", [("price > 200", "big"), ("status == 'F'", "done")], every=["all"])
    got = read_back(spark, f"{work}/out")
    big = {i for i in range(30) if i * 10 > 200}
    done = {i for i in range(30) if i % 3 == 0 and i not in big}
    assert {i for b, i in got if b == "big"} == big and {i for b, i in got if b == "done"} == done
    assert {i for b, i in got if b == "all"} == set(range(30)) | {99}
    assert report.read == 31 and report.unrouted == 31 - len(big) - len(done)
    assert report.per_branch == {"big": len(big), "done": len(done), "all": 31}
    with_default = branches.write_branches(df, f"{work}/d", [("price > 200", "big")], default="rest")
    assert with_default.unrouted == 0 and with_default.per_branch["rest"] == 31 - len(big)


def test_a_failed_job_publishes_nothing(spark, work):
    df = orders(spark).withColumn("price", F.when(F.col("id") == 17, F.raise_error(F.lit("boom"))).otherwise(F.col("price")))
    with pytest.raises(Exception):
        branches.write_branches(df, f"{work}/out", [("price > 200", "big")], every=["all"])
    published = [d for d in os.listdir(f"{work}/out")] if os.path.exists(f"{work}/out") else []
    assert not [d for d in published if d.startswith("branch=")]


def test_refusals(spark, work):
    df = orders(spark)
    with pytest.raises(ValueError, match="twice"):
        branches.write_branches(df, f"{work}/o", [("price > 1", "a")], every=["a"])
    with pytest.raises(ValueError, match="letters"):
        branches.write_branches(df, f"{work}/o", [("price > 1", "a/b")])
    with pytest.raises(ValueError, match="column branch"):
        branches.write_branches(df.withColumn("branch", F.lit(1)), f"{work}/o", every=["x"])


def test_copy_reports_unrouted_rows(spark, work):
    orders(spark).write.parquet(f"{work}/in")
    sink = {"kind": "branches", "path": f"{work}/out", "when": [["price > 200", "big"]]}
    report = copyjob.copy(spark, {"kind": "table", "path": f"{work}/in"}, sink)
    assert report.read == 31 and report.rows == 9
    assert any("unrouted 22" in n for n in report.notes)
