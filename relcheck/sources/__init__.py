"""Where tables come from: a registry of formats, and confined locators."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import SpecError


@dataclass(frozen=True)
class Raw:
    """A source as text: names of columns, and rows (line long, cells array<string>, places array<struct<line, col>>)."""

    header: list[str]
    rows: DataFrame


Reader = Callable[[SparkSession, str, dict[str, object]], Raw]
_formats: dict[str, tuple[Reader, dict[str, type]]] = {}


@dataclass(frozen=True)
class Source:
    """A format's name, a path below the format's base folder, and options."""

    format: str
    path: str
    options: tuple[tuple[str, object], ...] = field(default=())


def register(name: str, reader: Reader, options: dict[str, type]) -> None:
    """The last registration of a name counts."""
    _formats[name] = (reader, options)


def lookup(name: str) -> Reader:
    if name not in _formats:
        raise SpecError("unknown_format", name)
    return _formats[name][0]


def check_options(source: Source) -> list[SpecError]:
    """What is wrong with a source's options; if anything is, it isn't read."""
    lookup(source.format)
    allowed, seen, out = _formats[source.format][1], set(), []
    for name, value in source.options:
        if name in seen:
            out.append(SpecError("duplicate_option", name))
        seen.add(name)
        if name not in allowed:
            out.append(SpecError("unknown_option", name))
        elif type(value) is not allowed[name]:
            out.append(SpecError("option_type_mismatch", name))
    return out


def confined(base: str, path: str) -> str:
    """path below base; absolute paths, drives and steps upwards are refused."""
    if path.startswith(("/", "\\")) or re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) or ".." in re.split(r"[/\\]", path):
        raise SpecError("locator_escapes_root", path)
    return f"{base.rstrip('/')}/{path}"


def read(spark: SparkSession, source: Source, base: str) -> Raw:
    """A source as text; SpecError or Unreadable say why there is none."""
    return lookup(source.format)(spark, confined(base, source.path), dict(source.options))


from . import csv  # noqa: E402, F401  registers itself
