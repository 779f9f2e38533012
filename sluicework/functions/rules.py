"""Schema rules as Columns: type tests, lossless coercions, defaults and checks.

A field is read either from a text column (CSV, where NULL means absent) or from a path of a
VARIANT document (where absent, null and every JSON type stay apart).  Each rule gives the
typed value, the JSON text of the value, whether it is present, and the first error as
``$.path [code]: reason``.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the rule contract: accepted spellings and error codes.
INTEGER_TEXT = r"^[+-]?[0-9]+$"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TRUE_TEXT = ["true", "1"]
FALSE_TEXT = ["false", "0"]
COERCION = "coercion"
TYPE_MISMATCH = "type_mismatch"
MISSING_REQUIRED = "missing_required"
ENUM = "enum"

SPARK_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string"}


@dataclass(frozen=True)
class Options:
    coerce: bool = True
    apply_defaults: bool = True
    empty_as_null: bool = False


@dataclass(frozen=True)
class Outcome:
    """Result of one rule.  ``json`` is made on demand; ``error`` is None where none can occur."""

    value: Column
    json: Callable[[], Column]
    present: Column | None
    error: Column | None


class Stages:
    """Columns worth computing once, as successive projections.

    Rules use a value many times (test, error, JSON).  Written as one expression it would be
    evaluated each time; put in a stage, later expressions only refer to it.
    """

    def __init__(self, prefix: str = "_stage"):
        self.prefix, self.levels = prefix, []

    def put(self, level: int, column: Column) -> Column:
        while len(self.levels) <= level:
            self.levels.append({})
        name = f"{self.prefix}_{level}_{len(self.levels[level])}"
        self.levels[level][name] = column
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        for columns in self.levels:
            df = df.withColumns(columns) if columns else df
        return df


def settled(df: DataFrame, kept: list[Column], **columns: Column) -> DataFrame:
    """Select ``kept`` plus ``columns``, with filters on the latter staying above this point.

    The optimizer would push such a filter below the stages and so compute every rule a second
    time; it does not push through a generated row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


class _Inline(Stages):
    """No stages: inside a lambda nothing can be put aside."""

    def put(self, level: int, column: Column) -> Column:
        return column


INLINE = _Inline()


def any_of(*flags: Column | None) -> Column | None:
    """Either of the flags; None stands for one that is known to be false."""
    known = [f for f in flags if f is not None]
    return reduce(operator.or_, known) if known else None


class TextField:
    """A field held in a STRING column; NULL is absent, and every value is a string."""

    null = is_integer = is_number = is_boolean = None

    def __init__(self, column: Column, stages: Stages = INLINE, level: int = 0):
        self.text, self.stages, self.level = column, stages, level
        self.absent = column.isNull()
        self.is_array = self.is_object = F.lit(False)

    def matches(self, pattern: str) -> Column:
        return self.text.rlike(pattern)

    def among(self, words: list[str]) -> Column:
        return self.text.isin(words)

    def as_text(self, numbers: bool) -> Column:
        return self.text

    def child(self, name: str) -> "VariantField":
        return VariantField(F.try_parse_json(self.text), f"$.{name}", self.stages, self.level)

    def items(self) -> Column:
        return F.lit(None).cast("array<variant>")

    def shown(self) -> list[str | Column]:
        return ['"', self.text, '"']


class VariantField:
    """A field at a path of a VARIANT column."""

    def __init__(self, doc: Column, path: str, stages: Stages = INLINE, level: int = 0):
        self.doc, self.path, self.stages, self.start = doc, path, stages, level
        self.level = level + 2
        self.here = stages.put(level, F.try_variant_get(doc, path, "variant"))
        self.shape = stages.put(level + 1, F.schema_of_variant(self.here))
        self.text = stages.put(level + 1, F.try_variant_get(self.here, "$", "string"))
        self.absent = self.here.isNull()

    def _shaped(self, *names: str) -> Column:
        return self.shape == names[0] if len(names) == 1 else self.shape.isin(*names)

    @property
    def null(self) -> Column:
        return F.coalesce(self._shaped("VOID"), F.lit(False))

    @property
    def is_string(self) -> Column:
        return self._shaped("STRING")

    @property
    def is_integer(self) -> Column:
        return self._shaped("BIGINT")

    @property
    def is_number(self) -> Column:
        return self.shape.startswith("DECIMAL") | self._shaped("DOUBLE", "FLOAT")

    @property
    def is_boolean(self) -> Column:
        return self._shaped("BOOLEAN")

    @property
    def is_array(self) -> Column:
        return self.shape.startswith("ARRAY")

    @property
    def is_object(self) -> Column:
        return self.shape.startswith("OBJECT")

    def matches(self, pattern: str) -> Column:
        return self.is_string & self.text.rlike(pattern)

    def among(self, words: list[str]) -> Column:
        return self.is_string & self.text.isin(words)

    def as_text(self, numbers: bool) -> Column:
        kinds = any_of(self.is_string, *((self.is_integer, self.is_number) if numbers else ()))
        return F.when(kinds, self.text)

    def child(self, name: str) -> "VariantField":
        return VariantField(self.doc, f"{self.path}.{name}", self.stages, self.start)

    def items(self) -> Column:
        return F.try_variant_get(self.here, "$", "array<variant>")

    def raw_json(self) -> Column:
        return F.to_json(self.here)

    def shown(self) -> list[str | Column]:
        return [F.coalesce(self.raw_json(), F.lit(""))]


class DocumentRoot:
    """The whole document.  Its shape is known from its first character, so that no full schema
    of a large document is worked out."""

    absent = null = None

    def __init__(self, doc: Column, text: Column, stages: Stages = INLINE, level: int = 0):
        self.doc, self.path, self.stages, self.level = doc, "$", stages, level
        self.is_object = doc.isNotNull() & text.rlike(r"^\s*\{")

    def child(self, name: str) -> VariantField:
        return VariantField(self.doc, f"$.{name}", self.stages, self.level)

    def shown(self) -> list[str | Column]:
        return [F.coalesce(F.to_json(self.doc), F.lit(""))]


Field = TextField | VariantField | DocumentRoot


# Characters that JSON text must escape.
_ESCAPED = r'["\\\\\x00-\x1f]'


def scalar_json(value: Column, kind: str = "string") -> Column:
    """A scalar as JSON text. Only a string that needs escaping goes through the JSON writer."""
    if kind != "string":
        return value.cast("string")
    wrapped = F.to_json(F.array(value))
    written = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    return F.when(value.rlike(_ESCAPED), written).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def object_json(pieces: list[tuple[str, Outcome]], extra: Column | None = None) -> Column:
    """``{...}`` of the outcomes by name; absent ones leave no trace."""
    parts = []
    for name, outcome in pieces:
        member = F.concat(F.lit(json.dumps(name) + ":"), outcome.json())
        parts.append(member if outcome.present is None else F.when(outcome.present, member))
    if extra is not None:
        parts.append(F.when(extra != "", extra))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def error_text(path: str | Column, code: str, *reason: str | Column) -> Column:
    """``path [code]: reason``; neighbouring constants are joined here, not per row."""
    parts: list[str | Column] = []
    for part in (path, f" [{code}]: ", *reason):
        if parts and isinstance(part, str) and isinstance(parts[-1], str):
            parts[-1] += part
        else:
            parts.append(part)
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def no_error() -> Column:
    return F.lit(None).cast("string")


def first_error(errors: list[Column | None]) -> Column:
    known = [e for e in errors if e is not None]
    return F.coalesce(*known) if known else no_error()


# --- single-column coercions --------------------------------------------------------------


def to_integer(field: Field, coerce: bool = True) -> Column:
    ok = any_of(field.is_integer, field.matches(INTEGER_TEXT) if coerce else None)
    return F.lit(None).cast("bigint") if ok is None else F.when(ok, field.text.try_cast("bigint"))


def to_number(field: Field, coerce: bool = True) -> Column:
    """A value too large for a double is not a number."""
    ok = any_of(field.is_integer, field.is_number, field.matches(NUMBER_TEXT) if coerce else None)
    if ok is None:
        return F.lit(None).cast("double")
    value = field.text.try_cast("double")
    return F.when(ok & (F.abs(value) < float("inf")), value)


def to_boolean(field: Field, coerce: bool = True) -> Column:
    true = any_of(
        None if field.is_boolean is None else field.is_boolean & (field.text == "true"),
        field.among(TRUE_TEXT) if coerce else None,
    )
    false = any_of(
        None if field.is_boolean is None else field.is_boolean & (field.text == "false"),
        field.among(FALSE_TEXT) if coerce else None,
    )
    if true is None:
        return F.lit(None).cast("boolean")
    return F.when(true, F.lit(True)).when(false, F.lit(False))


def to_text(field: Field, coerce: bool = True) -> Column:
    return field.as_text(coerce)


_CONVERT = {
    "integer": to_integer,
    "number": to_number,
    "boolean": to_boolean,
    "string": to_text,
}


# --- one rule -----------------------------------------------------------------------------


def spark_type(rule: dict[str, Any]) -> str:
    """Spark SQL type of the value a rule yields."""
    if "contentMediaType" in rule:
        return spark_type(rule["contentSchema"]) if "contentSchema" in rule else "variant"
    kind = rule.get("type", "string")
    if kind == "array":
        return f"array<{spark_type(rule.get('items', {}))}>"
    if kind == "object":
        inner = ",".join(f"`{n}`:{spark_type(r)}" for n, r in rule.get("properties", {}).items())
        return f"struct<{inner}>" if inner else "variant"
    return SPARK_TYPES[kind]


def apply_rule(
    field: Field,
    rule: dict[str, Any],
    path: str | Column,
    options: Options = Options(),
    required: bool = False,
) -> Outcome:
    """Default, coerce and check one field."""
    if "contentMediaType" in rule:
        return _embedded(field, rule, path, options, required)
    kind = rule.get("type", "string")
    if kind == "array":
        typed = _array(field, rule, path, options)
    elif kind == "object":
        typed = apply_object(field, rule, path, options)
    else:
        typed = _scalar(field, rule, path, options)
    return _presence(field, rule, path, options, required, typed)


def _wrong_kind(field, kind: str, path, options: Options) -> Column:
    code = COERCION if options.coerce and kind not in ("array", "object") else TYPE_MISMATCH
    return error_text(path, code, "cannot use ", *field.shown(), f" as {kind}")


def _scalar(field, rule, path, options: Options) -> Outcome:
    kind = rule.get("type", "string")
    plain_text = kind == "string" and isinstance(field, TextField)
    value = field.text if plain_text else field.stages.put(field.level, _CONVERT[kind](field, options.coerce))
    error = None if plain_text else F.when(value.isNull(), _wrong_kind(field, kind, path, options))
    if "enum" in rule:
        unlisted = ~value.isin(list(rule["enum"]))
        told = error_text(path, ENUM, "not listed: ", F.coalesce(value.cast("string"), F.lit("null")))
        error = F.when(unlisted, told) if error is None else error.when(unlisted, told)
    return Outcome(value, lambda: scalar_json(value, kind), None, error)


def _array(field, rule, path, options: Options) -> Outcome:
    item_rule = rule.get("items", {})
    where = F.lit(path) if isinstance(path, str) else path

    def one(item: Column, index: Column) -> Column:
        at = F.concat(where, F.lit("["), index.cast("string"), F.lit("]"))
        done = apply_rule(VariantField(item, "$"), item_rule, at, options)
        error = no_error() if done.error is None else done.error
        return F.struct(done.value.alias("value"), done.json().alias("json"), error.alias("error"))

    each = field.stages.put(field.level, F.transform(field.items(), one))
    errors = F.filter(F.transform(each, lambda e: e["error"]), F.isnotnull)
    error = F.when(~field.is_array, _wrong_kind(field, "array", path, options)).otherwise(F.get(errors, 0))

    def text() -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(each, lambda e: e["json"]), ","), F.lit("]"))

    return Outcome(F.transform(each, lambda e: e["value"]), text, None, error)


def apply_object(field, rule, path, options: Options, extras: bool = True) -> Outcome:
    """Apply ``properties``/``required`` below ``field``; unlisted members are kept in the JSON."""
    needed = set(rule.get("required", []))
    listed: dict[str, Outcome] = {}
    errors: list[Column | None] = []

    def at(name: str) -> str | Column:
        return f"{path}.{name}" if isinstance(path, str) else F.concat(path, F.lit(f".{name}"))

    for name, inner in rule.get("properties", {}).items():
        listed[name] = apply_rule(field.child(name), inner, at(name), options, name in needed)
        errors.append(listed[name].error)
    for name in sorted(needed - set(listed)):
        absent = field.child(name).absent
        errors.append(F.when(absent, error_text(at(name), MISSING_REQUIRED, "required field is absent")))

    def text() -> Column:
        others = _unlisted_members(field, list(listed)) if extras else None
        return object_json(list(listed.items()), others)

    value = F.struct(*[o.value.alias(n) for n, o in listed.items()]) if listed else F.try_parse_json(text())
    error = first_error(errors)
    if not isinstance(field, TextField):
        error = F.when(~field.is_object, _wrong_kind(field, "object", path, options)).otherwise(error)
    return Outcome(value, text, None, error)


def _unlisted_members(field, names: list[str]) -> Column | None:
    if isinstance(field, TextField):
        return None
    members = F.when(field.is_object, F.try_variant_get(field.doc, field.path, "map<string,variant>"))
    kept = F.map_filter(members, lambda k, v: ~k.isin(names)) if names else members
    pieces = F.transform(
        F.map_entries(kept), lambda e: F.concat(scalar_json(e["key"]), F.lit(":"), F.to_json(e["value"]))
    )
    return field.stages.put(field.level, F.coalesce(F.array_join(pieces, ","), F.lit("")))


def _presence(field, rule, path, options: Options, required: bool, typed: Outcome) -> Outcome:
    """Wrap a typed outcome with the absent, null and default cases."""
    null = field.null
    if options.empty_as_null:
        null = any_of(null, field.matches(r"^$"))
        null = F.coalesce(null, F.lit(False))
    present, value, missing = ~field.absent, typed.value, None
    # A scalar or array of an absent or null field is NULL by itself.
    if rule.get("type") == "object" or options.empty_as_null or "contentMediaType" in rule:
        there = present if null is None else present & ~null
        value = F.when(there, value)
    encoded = None
    if "default" in rule and options.apply_defaults:
        encoded, kind = json.dumps(rule["default"]), spark_type(rule)
        plain = rule.get("type", "string") in SPARK_TYPES
        default = F.lit(rule["default"]).cast(kind) if plain else F.from_json(F.lit(encoded), kind)
        value, present = F.when(field.absent, default).otherwise(value), None
    elif required:
        missing = error_text(path, MISSING_REQUIRED, "required field is absent")

    def text() -> Column:
        out = typed.json()
        if null is not None:
            out = F.when(null, F.lit("null")).otherwise(out)
        return out if encoded is None else F.when(field.absent, F.lit(encoded)).otherwise(out)

    error = typed.error
    if error is not None or missing is not None or null is not None:
        error = no_error() if error is None else error
        if null is not None:
            refused = no_error() if rule.get("nullable") else error_text(path, TYPE_MISMATCH, "null is not allowed")
            error = F.when(null, refused).otherwise(error)
        error = F.when(field.absent, no_error() if missing is None else missing).otherwise(error)
    return Outcome(value, text, present, error)


def _embedded(field, rule, path, options: Options, required: bool) -> Outcome:
    """Decode a JSON document carried as text, then apply ``contentSchema`` inside it."""
    doc = field.stages.put(field.level, F.try_parse_json(field.text))
    inner = VariantField(doc, "$", field.stages, field.level + 1)
    typed = Outcome(doc, lambda: F.to_json(doc), None, None)
    if "contentSchema" in rule:
        typed = apply_rule(inner, rule["contentSchema"], path, options)
    broken = doc.isNull() if isinstance(field, TextField) else ~field.is_string | doc.isNull()
    told = error_text(path, COERCION, "field does not hold a JSON document")
    error = F.when(broken, told)
    error = error if typed.error is None else error.otherwise(typed.error)
    return _presence(field, rule, path, options, required, replace(typed, error=error))


def load_schema(path: str) -> dict[str, Any]:
    """Read a schema file once, at start; a missing file fails before any row moves."""
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


def struct_type(schema: dict[str, Any]) -> T.StructType:
    """The Spark schema a rule document stands for."""
    return T.StructType.fromDDL(
        ", ".join(f"`{n}` {spark_type(r)}" for n, r in schema.get("properties", {}).items())
    )
