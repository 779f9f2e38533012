"""Licence scan: an automaton finds notice phrases and identifier tags; tags hold expressions.

Phrases are sought as consecutive words, so their case, line breaks and punctuation don't matter.
The words after a tag ``SPDX-License-Identifier:`` up to the end of its line are a licence
expression; a shunting-yard parser turns it into postfix order and evaluates it: the licences that
it names, and whether it can be met by licences of the given set (and: both, or: one of both,
with: the licence itself, whose exception only adds rights).

Defined cases: null text is empty and has no words; a malformed expression counts as a tag without
labels; repeated rows are scanned one by one; extra columns stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicework.llm.phrases import Phrases, words_of
from sluicework.llm.text import ALNUM, Words, chunks

# The phrases and labels of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further notice phrases and their labels.
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "creative commons attribution": "cc-by",
    "cc0": "cc0", "all rights reserved": "reserved", "licensed under the apache": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
}
TAG = "spdx license identifier"

#: Licences that a corpus may use without further duties than naming its source.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})

_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|\S")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*\Z")


def postfix(expression: str) -> list[str]:
    """Postfix order of an expression, lower-cased; ValueError where it is malformed."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand:
                raise ValueError("an operator is missing")
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError("a licence is missing")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced brackets")
            stack.pop()
        elif token in _RANK:
            if operand:
                raise ValueError("a licence is missing")
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif not operand or not _NAME.match(token):
            raise ValueError("an operator is missing")
        else:
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ValueError("the expression is not complete")
    return out + stack[::-1]


def evaluate(expression: str, allowed: frozenset[str] = PERMISSIVE) -> tuple[list[str], bool]:
    """Licences that an expression names (exceptions left out), and whether ``allowed`` can meet it."""
    stack: list[tuple[list[str], bool]] = []
    for token in postfix(expression):
        if token not in _RANK:
            stack.append(([token], token in allowed))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        stack.append({"with": (left, a), "and": (left + right, a and b), "or": (left + right, a or b)}[token])
    return stack[0]


def _patterns() -> dict[tuple[str, ...], tuple[str, str]]:
    kinds = {**{p: ("more", x) for p, x in MORE.items()}, **{p: ("base", x) for p, x in BASE.items()}, TAG: ("tag", "")}
    return {tuple(words_of(p)): v for p, v in kinds.items()}


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive.

    score is 1 - 0.5 ** (base places + 2 * readable tags); permissive is null without a readable tag.
    Existing columns of these names are replaced.
    """
    added = {
        "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string",
        "score": "double", "expressions": "array<string>", "permissive": "boolean",
    }
    out = docs.drop(*added).withColumns({c: F.lit(None).cast(t) for c, t in added.items()})

    def find(batches):
        automaton = Phrases(_patterns())
        for part in chunks(batches, "text"):
            yield _scan(part, automaton, list(added))

    return out.mapInArrow(find, out.schema)


def _expression(words: Words, after: int, row: int) -> str | None:
    """The rest of the line after a tag's last word, if a colon comes first."""
    rest = words.raw[words.ends[after - 1] : words.offsets[row + 1]]
    line = rest[: int(np.argmax(rest == 10)) if (rest == 10).any() else len(rest)].tobytes().decode(errors="replace").strip()
    return re.sub(r"(\*/|-->|#>)\s*$", "", line[1:]).strip() if line.startswith(":") else None


def _scan(part: pa.RecordBatch, automaton: Phrases, added: list[str]) -> pa.RecordBatch:
    words = Words(part.column("text"), ALNUM, lower=True)
    rows, n = words.rows(), part.num_rows
    n_base, first, last, tags = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    base: dict[int, set] = {}
    more: dict[int, set] = {}
    expressions: dict[int, list] = {}
    permissive: dict[int, bool] = {}
    for begin, end, (kind, label) in automaton.find(words):
        row = int(rows[begin])
        if kind == "base":
            at = begin - int(words.heads[row])
            n_base[row] += 1
            first[row] = at if first[row] < 0 else min(first[row], at)
            last[row] = max(last[row], at)
            base.setdefault(row, set()).add(label)
        elif kind == "more":
            more.setdefault(row, set()).add(label)
        elif (text := _expression(words, end, row)) is not None:
            try:
                names, met = evaluate(text)
            except ValueError:
                continue
            tags[row] += 1
            more.setdefault(row, set()).update(names)
            expressions.setdefault(row, []).append(text)
            permissive[row] = permissive.get(row, True) and met
    found = {
        "n_words": words.counts.astype(np.int64), "n_base": n_base, "first_word": pa.array(first, pa.int64(), mask=first < 0),
        "last_word": pa.array(last, pa.int64(), mask=last < 0), "base_labels": [",".join(sorted(base.get(r, ()))) for r in range(n)],
        "labels": [",".join(sorted(base.get(r, set()) | more.get(r, set()))) for r in range(n)], "score": 1 - 0.5 ** (n_base + 2.0 * tags),
        "expressions": [expressions.get(r, []) for r in range(n)], "permissive": [permissive.get(r) for r in range(n)],
    }
    columns = [pa.array(found[c], part.schema.field(c).type) if c in added and not isinstance(found[c], pa.Array) else found.get(c, part.column(c)) for c in part.schema.names]
    return pa.RecordBatch.from_arrays(columns, names=part.schema.names)
