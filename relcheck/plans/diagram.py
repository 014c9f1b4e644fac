"""Failed conditions drawn as text, with the value of each of their parts below it."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..errors import Undecidable
from ..types import LogicalType
from .relation import Columns, Pred, Relation, _literal

# How conditions are written, and how tightly each binds.
_WRITTEN = {"OR": ("||", 2), "AND": ("&&", 3), "=": ("==", 4), "<>": ("!=", 4), "<": ("<", 4), "<=": ("<=", 4), ">": (">", 4), ">=": (">=", 4)}
_NULL = {"NULL": "==", "NOT NULL": "!="}
_COMPARE = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _shown(name: str, type: LogicalType) -> Column:
    """A cell as it is drawn; nothing for a gap."""
    text = F.col(f"`{name}`").cast("string")
    text = F.concat(F.lit('"'), text, F.lit('"')) if type.kind == "string" else text
    return F.coalesce(text, F.lit("null")) if type.nullable else text


def _parts(node: tuple, fields: dict[str, LogicalType], least: int = 0) -> tuple[str, list[tuple[int, Column]], Column]:
    """The text of a condition, the places and values that are drawn, and its own value; in brackets if it binds less tightly than that."""
    kind = node[0]
    if kind == "NOT":
        inner, drawn, value = _parts(node[1], fields, 8)
        text, own, value = f"!{inner}", 0, ~value
        drawn = [(at + 1, v) for at, v in drawn]
    elif kind in _NULL:
        text, drawn = f"{node[1]} {_NULL[kind]} null", [(0, _shown(node[1], fields[node[1]]))]
        own, cell = len(node[1]) + 1, F.col(f"`{node[1]}`")
        value = cell.isNull() if kind == "NULL" else cell.isNotNull()
    else:
        sign, tight = _WRITTEN[kind]
        if kind in ("AND", "OR"):
            (left, drawn, a), (right, more, b) = _parts(node[1], fields, tight), _parts(node[2], fields, tight + 1)
            value = a & b if kind == "AND" else a | b
        else:
            left, drawn, a = node[1], [(0, _shown(node[1], fields[node[1]]))], F.col(f"`{node[1]}`")
            what, operand = node[2]
            if what == "column":
                right, more, b = operand, [(0, _shown(operand, fields[operand]))], F.col(f"`{operand}`")
            else:
                right, more, b = json.dumps(operand, ensure_ascii=False), [], _literal(operand, fields[node[1]])
            value = _COMPARE[kind](a, b)
        own = len(left) + 1
        shift = own + len(sign) + 1
        text, drawn = f"{left} {sign} {right}", [*drawn, *[(at + shift, v) for at, v in more]]
        if tight < least:
            text, own, drawn = f"({text})", own + 1, [(at + 1, v) for at, v in drawn]
    return text, sorted([*drawn, (own, value.cast("string"))], key=lambda d: d[0]), value


def layout(text: str, places: list[int], values: list[str | None]) -> str:
    """text, a row that points at the places, and their values; a value that would touch one further right stands in a row below that."""
    marks = [(at, v) for at, v in zip(places, values, strict=True) if v is not None]
    if not marks:
        return text
    row = [0] * len(marks)
    for i in reversed(range(len(marks))):
        end = marks[i][0] + len(marks[i][1])
        row[i] = max((row[j] + 1 for j in range(i + 1, len(marks)) if marks[j][0] <= end), default=0)
    lines = [text]
    for n in range(-1, max(row) + 1):
        line = ""
        for (at, v), own in zip(marks, row, strict=True):
            if own >= n:
                line = line.ljust(at) + ("^" if n < 0 else v if own == n else "|")
        lines.append(line)
    return "\n".join(lines)


def explained(relation: Relation, condition: Callable[[Columns], Pred], name: str = "diagram") -> DataFrame:
    """The rows for which a condition isn't definitely true, each with a drawing of it in the column `name`.

    Only rows that fail go to Python, and of them only what is drawn.
    """
    asked = relation.where(condition)
    if asked.declined:
        raise Undecidable(asked.declined)
    text, drawn, _ = _parts(asked.conditions[-1].node, relation.fields)
    places = [at for at, _ in drawn]

    @F.pandas_udf("string")
    def draw(values: pd.Series) -> pd.Series:
        return values.map(lambda v: layout(text, places, list(v)))

    df = relation.violations(condition)
    ship(df.sparkSession)
    return df.withColumn(name, draw(F.array(*[v for _, v in drawn])))
