"""Mapping, typing and validation of records.

Order is fixed: mapping, coercion, defaults, checks.  All of it is one projection: mapped
fields feed the rules as Columns, so a document is parsed once and never rebuilt in between.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.functions import rules
from sluicework.functions.rules import DocumentRoot, Options, Outcome, Stages, TextField, VariantField

TRANSFORM_ERROR = "transform_error"
_CODE = re.compile(r"^(\S+) \[(\w+)\]")


def _path(text: str) -> str:
    return text[2:] if text.startswith("$.") else text


def _nest(leaves: dict[str, Any], combine) -> Any:
    """Group dotted names into a tree and fold it bottom-up with ``combine``."""
    tree: dict[str, Any] = {}
    for name, leaf in leaves.items():
        node = tree
        *parents, last = name.split(".")
        for parent in parents:
            node = node.setdefault(parent, {})
        node[last] = leaf

    def fold(node):
        if isinstance(node, dict):
            return combine({k: fold(v) for k, v in node.items()})
        return node

    return fold(tree)


# --- typed frames ---------------------------------------------------------------------------


def map_fields(df: DataFrame, mapping: dict[str, Any], error: str = "error") -> DataFrame:
    """Rename, move, nest and flatten the columns of a typed frame.

    A rule is a path, or ``{"path", "default", "required"}``; dots in the output name nest.
    Spark resolves the path, so only the columns named are read from the scan.  When a rule
    has ``required`` an ``error`` column tells which field was absent.
    """
    leaves: dict[str, Column] = {}
    errors: list[Column] = []
    for name, rule in mapping.items():
        rule = {"path": rule} if isinstance(rule, str) else rule
        column = _resolve(df, _path(rule["path"]))
        if "default" in rule:
            column = F.coalesce(column, F.lit(rule["default"]))
        elif rule.get("required"):
            errors.append(
                F.when(
                    column.isNull(),
                    rules.error_text(
                        f"$.{_path(rule['path'])}", rules.MISSING_REQUIRED, "required field is absent"
                    ),
                )
            )
        leaves[name] = column

    def combine(node: dict[str, Any]) -> Any:
        return F.struct(*[c.alias(n) for n, c in node.items()])

    top: dict[str, dict[str, Column]] = {}
    for name, column in leaves.items():
        top.setdefault(name.split(".")[0], {})[name] = column
    out = []
    for head, members in top.items():
        if list(members) == [head]:
            out.append(members[head].alias(head))
        else:
            inner = {n.split(".", 1)[1]: c for n, c in members.items()}
            out.append(_nest(inner, combine).alias(head))
    if errors:
        out.append(F.coalesce(*errors).alias(error))
    return df.select(*out)


def _resolve(df: DataFrame, path: str) -> Column:
    """A path as a Column; array steps past the end and unknown fields give NULL."""
    kind, column = df.schema, None
    for name, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
        if name:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return F.lit(None).cast("string")
            kind = kind[name].dataType
            column = F.col(f"`{name}`") if column is None else column.getField(name)
        else:
            if not isinstance(kind, T.ArrayType):
                return F.lit(None).cast("string")
            kind, column = kind.elementType, F.get(column, int(index))
    return column


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns; the scan reads no others."""
    return df.select(*columns)


def type_columns(
    df: DataFrame,
    schema: dict[str, Any],
    *,
    coerce: bool = True,
    apply_defaults: bool = True,
    coerce_empty_as_null: bool = False,
    mapping: dict[str, str] | None = None,
    keep: Sequence[str] = (),
    error: str = "error",
) -> DataFrame:
    """Type the text columns of a frame by a schema, adding an ``error`` column.

    ``mapping`` gives the source column of a property where the names differ.
    """
    options = Options(coerce, apply_defaults, coerce_empty_as_null)
    needed = set(schema.get("required", []))
    known = {f.name: f.dataType for f in df.schema}
    outcomes: dict[str, Outcome] = {}
    stages = Stages()
    for name, rule in schema["properties"].items():
        source = (mapping or {}).get(name, name)
        if source not in known:
            column = F.lit(None).cast("string")
        elif isinstance(known[source], T.StringType):
            column = F.col(source)
        else:
            column = F.col(source).cast("string")
        field = TextField(column, stages)
        outcomes[name] = rules.apply_rule(field, rule, f"$.{name}", options, name in needed)
    kept = [*[F.col(c) for c in keep], *[o.value.alias(n) for n, o in outcomes.items()]]
    first = rules.first_error([o.error for o in outcomes.values()])
    return rules.settled(stages.apply(df), kept, **{error: first})


def check_required(df: DataFrame, fields: Sequence[str], error: str = "error") -> DataFrame:
    """Name the first absent field of each row."""
    checks = [
        F.when(F.col(f).isNull(), rules.error_text(f"$.{f}", rules.MISSING_REQUIRED, "required field is absent"))
        for f in fields
    ]
    return df.withColumn(error, F.coalesce(*checks))


def split_by_error(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, rejected rows with it)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def error_parts(df: DataFrame, error: str = "error") -> DataFrame:
    """Split an error text into ``path`` and ``code``."""
    return df.withColumn("path", F.regexp_extract(error, _CODE.pattern, 1)).withColumn(
        "code", F.regexp_extract(error, _CODE.pattern, 2)
    )


# --- JSON documents -------------------------------------------------------------------------


def transform(
    df: DataFrame,
    *,
    payload: str = "payload",
    mapping: dict[str, Any] | None = None,
    schema: dict[str, Any] | None = None,
    expression: str | None = None,
    coerce: bool = True,
    apply_defaults: bool = True,
    coerce_empty_as_null: bool = False,
    on_error: str = "reject",
    metadata: str | None = None,
) -> tuple[DataFrame, DataFrame] | DataFrame:
    """Reshape and validate JSON documents held as text in ``payload``.

    ``reject`` returns (good, rejects); rejects carry ``transform_error`` and the untouched
    payload.  ``pass_through`` returns one frame where failed rows keep their payload and the
    reason is in ``transform_error`` (and in ``metadata``, when that map column is named).
    ``expression`` is one Spark SQL expression over the parsed document ``doc`` that yields
    the new payload text; it runs instead of a mapping.
    """
    if on_error not in ("reject", "pass_through"):
        raise ValueError(f"on_error must be reject or pass_through, not {on_error}")
    options = Options(coerce, apply_defaults, coerce_empty_as_null)
    doc, stages = F.col("doc"), Stages()
    parsed = df.withColumn("doc", F.try_parse_json(payload))
    root = DocumentRoot(doc, F.col(payload), stages)
    if expression is not None:
        remade = F.try_parse_json(F.expr(expression))
        parsed = parsed.withColumn("doc", F.when(root.is_object, remade))
    if mapping:
        outcome = _mapped(doc, mapping, schema, options, stages)
    elif schema:
        outcome = rules.apply_object(root, schema, "$", options)
    else:
        outcome = Outcome(doc, lambda: F.to_json(doc), None, None)
    not_document = rules.error_text("$", rules.TYPE_MISMATCH, "payload is not a JSON object")
    error = F.when(root.is_object, rules.first_error([outcome.error])).otherwise(not_document)
    kept = [F.col(c) for c in df.columns]
    text = outcome.json()  # may add to the stages, so before they are applied
    shaped = rules.settled(stages.apply(parsed), kept, **{TRANSFORM_ERROR: error, "_new": text})
    if on_error == "pass_through":
        failed = F.col(TRANSFORM_ERROR).isNotNull()
        done = shaped.withColumn(payload, F.when(failed, F.col(payload)).otherwise(F.col("_new")))
        if metadata:
            noted = F.map_concat(
                F.col(metadata), F.create_map(F.lit(TRANSFORM_ERROR), F.col(TRANSFORM_ERROR))
            )
            done = done.withColumn(metadata, F.when(failed, noted).otherwise(F.col(metadata)))
        return done.drop("_new")
    good = shaped.where(F.col(TRANSFORM_ERROR).isNull()).withColumn(payload, F.col("_new"))
    rejects = shaped.where(F.col(TRANSFORM_ERROR).isNotNull())
    return good.drop("_new", TRANSFORM_ERROR), rejects.drop("_new")


def _mapped(doc: Column, mapping: dict[str, Any], schema, options: Options, stages: Stages) -> Outcome:
    """Mapping outputs as outcomes, typed by the schema property of the same (dotted) name."""
    leaves: dict[str, Outcome] = {}
    for name, rule in mapping.items():
        rule = {"path": rule} if isinstance(rule, str) else dict(rule)
        source = f"$.{_path(rule['path'])}"
        field = VariantField(doc, source, stages)
        target, needed = _schema_rule(schema, name)
        needed = needed or bool(rule.get("required"))
        if target is None:
            missing = rules.error_text(source, rules.MISSING_REQUIRED, "required field is absent")
            done = Outcome(field.here, field.raw_json, ~field.absent, F.when(field.absent, missing) if needed else None)
            if "default" in rule:
                done = _with_default(field, F.lit(json.dumps(rule["default"])))
        else:
            merged = {**target, **({"default": rule["default"]} if "default" in rule else {})}
            defaults = Options(options.coerce, options.apply_defaults or "default" in rule, options.empty_as_null)
            done = rules.apply_rule(field, merged, f"$.{name}", defaults, needed)
        leaves[name] = done
    for name, rule in ((schema or {}).get("properties") or {}).items():
        if name not in leaves and not any(n.startswith(name + ".") for n in leaves):
            absent = VariantField(F.try_parse_json(F.lit("{}")), f"$.{name}")
            needed = name in (schema or {}).get("required", [])
            leaves[name] = rules.apply_rule(absent, rule, f"$.{name}", options, needed)

    def combine(node: dict[str, Outcome]) -> Outcome:
        value = F.struct(*[o.value.alias(n) for n, o in node.items()])
        flags = [o.present for o in node.values()]
        present = None if any(f is None for f in flags) else rules.any_of(*flags)
        return Outcome(
            value, lambda: rules.object_json(list(node.items())), present,
            rules.first_error([o.error for o in node.values()]),
        )

    return _nest(leaves, combine)


def _with_default(field: VariantField, encoded: Column) -> Outcome:
    value = F.coalesce(field.here, F.parse_json(encoded))
    return Outcome(value, lambda: F.coalesce(field.raw_json(), encoded), None, None)


def _schema_rule(schema, name: str) -> tuple[dict | None, bool]:
    node, needed = schema or {}, False
    for part in name.split("."):
        inner = (node.get("properties") or {}).get(part)
        needed = part in node.get("required", [])
        if inner is None:
            return None, needed
        node = inner
    return node, needed


def decode_json(df: DataFrame, field: str, content_schema: dict[str, Any] | None = None) -> DataFrame:
    """Replace a JSON text column by its document: a struct by schema, else a VARIANT."""
    rule: dict[str, Any] = {"contentMediaType": "application/json"}
    if content_schema:
        rule["contentSchema"] = content_schema
    done = rules.apply_rule(TextField(F.col(field)), rule, f"$.{field}")
    return df.withColumn("error", done.error).withColumn(field, done.value)
