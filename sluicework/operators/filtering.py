"""Row filters, their counts, and the guards around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.expressions import compile_expr, referenced_fields


def filter_rows(df: DataFrame, expression: str, metadata: str = "metadata") -> DataFrame:
    """Keep rows where the expression is true; false and unknown are both drops.

    A plain ``where`` already drops unknown, and it stays pushable to the scan.
    """
    return df.where(compile_expr(expression, df, metadata))


def matches(df: DataFrame, expression: str, metadata: str = "metadata") -> Column:
    """The expression as a two-valued flag: unknown counts as no match."""
    return F.coalesce(compile_expr(expression, df, metadata), F.lit(False))


def filter_counts(df: DataFrame, expression: str, metadata: str = "metadata") -> DataFrame:
    """One row: rows read, kept and dropped, in a single pass."""
    kept = F.count_if(matches(df, expression, metadata))
    return df.agg(F.count(F.lit(1)).alias("rows_read"), kept.alias("rows_kept")).withColumn(
        "rows_dropped", F.col("rows_read") - F.col("rows_kept")
    )


def unresolved_fields(df: DataFrame, expression: str, metadata: str = "metadata") -> DataFrame:
    """Fields of the expression and how many rows carry them; 0 means it never resolves."""
    fields = referenced_fields(expression)
    columns = {c.lower() for c in df.columns}

    def present(field: str) -> Column:
        if field.startswith("meta."):
            return F.col(metadata)[field[5:]]
        if field.split(".")[0].lower() not in columns:
            if "payload" in columns:
                # A path into the JSON document of each row: present where the document holds it.
                document = F.try_parse_json(F.col("payload").cast("string"))
                return F.try_variant_get(document, f"$.{field}", "variant")
            return F.lit(None)
        return F.expr(field)

    counted = df.agg(*[F.count(present(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("rows_with_field"))
            for i, f in enumerate(fields)
        ]
    )
    return counted.select(F.inline(pairs)).withColumn(
        "unresolved", F.col("rows_with_field") == 0
    )


def require_document(df: DataFrame, payload: str, doc: str = "doc") -> DataFrame:
    """Parse ``payload`` into a VARIANT and fail the job on the first non-object."""
    parsed = F.try_parse_json(F.col(payload))
    shape = F.schema_of_variant(parsed)
    refuse = F.raise_error(
        F.concat(F.lit("payload is not a JSON object: "), F.coalesce(F.col(payload), F.lit("null")))
    )
    return df.withColumn(doc, F.when(shape.startswith("OBJECT"), parsed).otherwise(refuse))
