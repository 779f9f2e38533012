"""All registered queries, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.operators import filtering, routing, shaping
from sluicework.plans import (  # noqa: F401
    filtering as _filtering, jobs, keyed, measuring, reading, routing as _routing, shaping as _shaping, writing,
)
from sluicework.plans.registry import ORACLE, QUERIES, query, table

_SCHEMA = {
    "required": ["id", "total"],
    "properties": {"id": {"type": "integer"}, "total": {"type": "number"}, "status": {"type": "string", "enum": ["O", "F", "P"]}},
}


@query(
    "flagship",
    """SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS route,
       status AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM (SELECT *, o_orderstatus AS status FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('O', 'F')) GROUP BY ALL""",
)
def flagship(spark, sf_dir):
    """Filter, type, route and count in one scan and one small shuffle."""
    orders = filtering.filter_rows(
        table(spark, sf_dir, "orders"), "o_totalprice > 1000 and o_orderstatus in ['O','F']"
    )
    renamed = orders.select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus")])
    typed = shaping.type_columns(
        renamed, _SCHEMA, mapping={"id": "o_orderkey", "total": "o_totalprice", "status": "o_orderstatus"}
    )
    good, _ = shaping.split_by_error(typed)
    routed = routing.switch_when(good, [("total > 300000", "large"), ("total > 100000", "medium")], "small")
    return routed.groupBy("route", "status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total")
    )
