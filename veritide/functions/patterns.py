"""Patterns made portable: globs and regular expressions with one meaning on every engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex(pattern: str, ignore_case: bool = False, multiline: bool = False, dot_all: bool = False) -> str:
    """A pattern whose classes cover Unicode, as in most scripting languages, with flags in front."""
    flags = "U" + "i" * ignore_case + "m" * multiline + "s" * dot_all
    return f"(?{flags}){pattern}"


def glob(pattern: str) -> str:
    """An anchored expression for a shell pattern; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner.startswith('!') else inner}]")
            i = end
        else:
            out.append(c if c.isalnum() or c in "_/ " else f"\\{c}")
        i += 1
    return f"(?s)^{''.join(out)}$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(name: Column) -> Column:
    """From the last dot on, lower case; nothing for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def matches_globs(path: Column, patterns: list[str]) -> Column:
    """Whole path or base name fits a glob; a pattern that ends with a slash means the folder itself and all in it."""
    name, found = name_of(path), []
    for p in patterns:
        if p.endswith("/"):
            found.append(path.startswith(p) | (path == p[:-1]))
        else:
            found.append(path.rlike(glob(p)) | name.rlike(glob(p)))
    return any_of(found)


def ignored_by_globs(path: Column, patterns: list[str]) -> Column:
    """Whole path, base name or the name of any folder above fits a glob."""
    parts = F.split(path, "/")
    in_part = lambda p: F.exists(parts, lambda x: x.rlike(glob(p)))
    return any_of([path.rlike(glob(p)) | in_part(p) for p in patterns])
