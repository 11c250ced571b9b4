"""Many regular expressions over the same lines: each is tried only where its literal is.

Most patterns have pieces of plain text that every match contains. One projection tells for
a line of which patterns it has all pieces, as a bitmap with a bit for each pattern; lines without
any go at once, and a pattern runs only on lines that have its bit. Finding plain text costs
a small part of what a pattern costs, and the pieces are read off the patterns themselves.
"""

from __future__ import annotations

import re._constants as signs
import re._parser as syntax
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(pattern: str) -> list[tuple[str, ...]]:
    """Lower-case texts that every match contains, whatever its case: of each entry one at least."""

    def of(parsed) -> list[tuple[str, ...]]:
        found, run = [], ""
        for sign, value in parsed:
            if sign is signs.LITERAL:
                run += chr(value)
                continue
            found, run = [*found, (run,)], ""
            if sign is signs.SUBPATTERN:
                found += of(value[3])
            elif sign is signs.BRANCH:
                ways = [max(of(way), key=lambda some: min(map(len, some)), default=()) for way in value[1]]
                found.append(sum(ways, ()) if all(ways) else ())
            elif sign is signs.IN and all(kind is signs.LITERAL for kind, _ in value):
                found.append(tuple(chr(c) for _, c in value))
            elif sign in (signs.MAX_REPEAT, signs.MIN_REPEAT, signs.POSSESSIVE_REPEAT) and value[0]:
                found += of(value[2])
        return [some for some in [*found, (run,)] if some and all(some)]

    # Only ASCII letters have one lower case everywhere. Signs are rarer than letters, so they come first.
    found = {tuple(x.lower() for x in some) for some in of(syntax.parse(pattern)) if all(x.isascii() for x in some)}
    return sorted(found, key=lambda some: (any(c.isalnum() for x in some for c in x), -min(map(len, some)), some))


def lowered(text: Column) -> Column:
    """In lower case, with the four other letters that stand for ASCII ones where case is ignored by Unicode's rules."""
    for other, letter in zip("İıſ\u212a", "iisk", strict=True):
        text = F.replace(text, F.lit(other), F.lit(letter))
    return F.lower(text)


def might(low: Column, pattern: str) -> Column | None:
    """Whether a text in lower case has all pieces of a pattern; nothing if it has no pieces."""
    tests = [reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in some)) for some in pieces(pattern)]
    return reduce(Column.__and__, tests) if tests else None


def bitmap(low: Column, patterns: list[str]) -> Column:
    """A bit for each pattern (63 at most) that might match, of a line in lower case."""
    if len(patterns) > 63:
        raise ValueError("a bitmap has 63 patterns at most")
    bits = []
    for i, p in enumerate(patterns):
        there = might(low, p)
        bits.append(F.lit(1 << i) if there is None else F.when(there, F.lit(1 << i)).otherwise(0))
    return reduce(Column.__add__, bits, F.lit(0)).cast("long")


def marked_lines(texts: DataFrame, key: str, content: Column, patterns: list[str]) -> DataFrame:
    """(key, at, text, bits): lines, from 0 on, that might match a pattern.

    A text is put in lower case whole and once: a filter on lines that are to be lowered does so anew for each piece.
    """
    rows = texts.select(key, F.split(content, "\n").alias("text"), F.split(F.lower(content), "\n").alias("low"))
    lines = rows.select(key, F.posexplode(F.arrays_zip("text", "low")).alias("at", "line"))
    lines = lines.select(key, "at", F.col("line.text").alias("text"), F.col("line.low").alias("low"))
    return lines.withColumn("bits", bitmap(F.col("low"), patterns)).filter("bits <> 0").drop("low")


def has(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << i)) != 0
