"""The filter language: a thin spelling layer over Spark SQL expressions.

Spark parses, types and runs every expression.  Only the spellings that differ from Spark
SQL are rewritten here: ``&&``, ``||``, ``== null``, ``in [...]``, ``len``, ``number`` and the
``meta.`` namespace.

Where a frame holds JSON text in ``payload``, a name that is no column is a path into that
document.  Its value counts as the kind that the expression asks for (number, text, flag or array):
a value of another kind, like an absent one, gives unknown.  ``== null`` asks for a present null.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
_PLACEHOLDER = re.compile(r"\x00(\d+)\x00")
_NUMERIC_COMPARE = re.compile(
    r"(?<![\w.)\]])([A-Za-z_][\w.]*)\s*(?:==|!=|<=|>=|<|>)\s*-?\d+(?:\.\d+)?(?![\w.])"
    r"|(?<![\w.])-?\d+(?:\.\d+)?\s*(?:==|!=|<=|>=|<|>)\s*([A-Za-z_][\w.]*)(?![\w.(])"
)
_FIELD = re.compile(r"(?<![\w.\x00])([A-Za-z_]\w*(?:\.\w+)*)(?!\w)(?!\s*\()")
_WORDS = {"and", "or", "not", "in", "null", "true", "false", "is", "as", "double"}
_LEN = re.compile(r"\blen\s*\(\s*([^()]+?)\s*\)")


def _lift_literals(text: str) -> tuple[str, list[str]]:
    """Swap quoted text for placeholders so that rewriting never touches it."""
    found: list[str] = []

    def keep(match: re.Match) -> str:
        raw = match.group(0)
        if raw[0] == '"':
            raw = "'" + raw[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
        found.append(raw)
        return f"\x00{len(found) - 1}\x00"

    return _LITERAL.sub(keep, text), found


def _restore(text: str, literals: list[str]) -> str:
    # A lifted read may stand inside another one.
    while _PLACEHOLDER.search(text):
        text = _PLACEHOLDER.sub(lambda m: literals[int(m.group(1))], text)
    return text


_OPERATOR = r"(==|!=|<=|>=|=|<|>)"
_NUMBER = r"-?\d+(?:\.\d+)?(?![\w.])"
_TEXT = r"\x00\d+\x00"


def _document_fields(text: str, df: DataFrame) -> list[str]:
    """Paths of an expression that must lie in the document, longest first."""
    if "payload" not in df.columns:
        return []
    columns = {c.lower() for c in df.columns}
    outside = [f for f in referenced_fields(text) if f.split(".")[0].lower() not in columns and not f.startswith("meta.")]
    return sorted(outside, key=len, reverse=True)


def _from_document(body: str, literals: list[str], fields: list[str]) -> str:
    """Replace document paths by typed reads of the parsed payload, kept as lifted literals."""

    def lift(sql: str) -> str:
        literals.append(f"({sql})")
        return f"\x00{len(literals) - 1}\x00"

    def read(path: str, kind: str) -> str:
        return f"try_variant_get(try_parse_json(cast(payload as string)), '$.{path}', '{kind}')"

    def when(path: str, pattern: str, kind: str) -> str:
        return f"CASE WHEN schema_of_variant({read(path, 'variant')}) RLIKE '^({pattern})' THEN {read(path, kind)} END"

    def number(path: str) -> str:
        return when(path, "BIGINT|DECIMAL|DOUBLE|FLOAT", "double")

    def text(path: str) -> str:
        return when(path, "STRING", "string")

    for path in fields:
        name = rf"(?<![\w.\x00])({re.escape(path)})(?![\w.(])"
        null = f"CASE WHEN {read(path, 'variant')} IS NOT NULL THEN is_variant_null({read(path, 'variant')}) END"
        size = f"coalesce(size({when(path, 'ARRAY', 'array<variant>')}), length({text(path)}))"
        as_number = f"coalesce({number(path)}, try_cast({text(path)} as double))"
        rules = [
            (rf"\blen\s*\(\s*{name}\s*\)", lambda m: lift(size)),
            (rf"\bnumber\s*\(\s*{name}\s*\)", lambda m: lift(as_number)),
            (rf"{name}\s*!\s*=\s*null\b", lambda m: lift(f"NOT ({null})")),
            (rf"{name}\s*={{2}}\s*null\b", lambda m: lift(null)),
            (rf"{name}(?=\s*{_OPERATOR}\s*{_NUMBER})", lambda m: lift(number(path))),
            (rf"({_NUMBER}\s*{_OPERATOR}\s*){name}", lambda m: m.group(1) + lift(number(path))),
            (rf"{name}(?=\s*{_OPERATOR}\s*{_TEXT})", lambda m: lift(text(path))),
            (rf"({_TEXT}\s*{_OPERATOR}\s*){name}", lambda m: m.group(1) + lift(text(path))),
            (rf"{name}(?=\s+in\s*\[\s*{_NUMBER})", lambda m: lift(number(path))),
            (rf"{name}(?=\s+in\s*\[)", lambda m: lift(text(path))),
            (rf"(\b(?:startsWith|contains)\s*\(\s*){name}", lambda m: m.group(1) + lift(text(path))),
            (rf"{name}(?=\s*(?:==|!=)\s*(?:true|false)\b)", lambda m: lift(when(path, "BOOLEAN", "boolean"))),
            (rf"{name}(?=\s*{_OPERATOR})|(?<=[=<>])\s*{name}", lambda m: " " + lift(f"coalesce(cast({number(path)} as string), {text(path)})")),
            (name, lambda m: lift(when(path, "BOOLEAN", "boolean"))),
        ]
        for pattern, rule in rules:
            body = re.sub(pattern, rule, body)
    return body


def _column_type(df: DataFrame, reference: str) -> T.DataType:
    return df.select(F.expr(reference)).schema[0].dataType


def _in_spark_spelling(text: str, df: DataFrame, metadata: str) -> str:
    body, literals = _lift_literals(text)
    body = body.replace("&&", " and ").replace("||", " or ")
    body = _from_document(body, literals, _document_fields(text, df))
    body = re.sub(r"!\s*=\s*null\b", " is not null", body)
    body = re.sub(r"={2}\s*null\b", " is null", body)
    body = re.sub(r"\bin\s*\[([^\]]*)\]", r"in (\1)", body)
    body = re.sub(r"\bmeta\.(\w+)", rf"{metadata}['\1']", body)
    body = re.sub(r"\bnumber\s*\(\s*([^()]+?)\s*\)", r"try_cast(\1 as double)", body)

    def length(match: re.Match) -> str:
        argument = _restore(match.group(1), literals)
        kind = _column_type(df, argument)
        name = "size" if isinstance(kind, (T.ArrayType, T.MapType)) else "length"
        return f"{name}({match.group(1)})"

    return _restore(_LEN.sub(length, body), literals)


def referenced_fields(text: str) -> list[str]:
    """Field paths an expression mentions, in order of first mention."""
    body, _ = _lift_literals(text)
    seen: list[str] = []
    for name in _FIELD.findall(body):
        if name.lower() not in _WORDS and name not in seen:
            seen.append(name)
    return seen


def check_types(text: str, df: DataFrame, metadata: str = "metadata") -> None:
    """Refuse a numeric comparison on a text field, and say how to write it."""
    body, _ = _lift_literals(text)
    for left, right in _NUMERIC_COMPARE.findall(body):
        field = left or right
        is_text = field.startswith("meta.")
        if not is_text:
            try:
                is_text = isinstance(_column_type(df, field), T.StringType)
            except AnalysisException:
                continue
        if is_text:
            raise ValueError(f"`{field}` is text; compare it as number({field}) in: {text}")


def compile_expr(text: str, df: DataFrame, metadata: str = "metadata") -> Column:
    """Turn expression text into a Column checked against ``df``; raises ValueError early."""
    if not text or not text.strip():
        raise ValueError("empty expression")
    check_types(text, df, metadata)
    try:
        column = F.expr(_in_spark_spelling(text, df, metadata))
        kind = df.select(column).schema[0].dataType
    except Exception as error:  # the parser and the analyser raise different classes
        raise ValueError(f"invalid expression `{text}`: {error}") from error
    if not isinstance(kind, (T.BooleanType, T.NullType)):
        raise ValueError(f"expression `{text}` is {kind.simpleString()}, not a condition")
    return column
