"""Pages of large tables by keys: any page reads only the rows around it.

Order is by one number, date or time, and then by further columns, the last of them unique.
A page behind a cursor (the last row that was seen) is a range filter, which reaches the scan.
A page by its number is found from bounds: a percentile sketch of the first column cuts the
table into stretches, which are counted exactly, once; a page lies in one stretch or a few
adjacent ones, and only these are read and sorted. Ties of the first column are in one
stretch. Rows in which it is null come last, in either direction.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCHES = 1000


class Pages:
    def __init__(self, rows: DataFrame, first: str, *then: str, size: int = 20, descending: bool = False, stretches: int = STRETCHES):
        if size < 1 or not then:
            raise ValueError("pages have a row or more, and an order that ends with a key")
        self.rows, self.first, self.then, self.size, self.descending = rows, first, then, size, descending
        self._ends: list | None = None
        self._wanted = stretches

    def _order(self) -> list[Column]:
        return [F.desc_nulls_last(self.first) if self.descending else F.asc_nulls_last(self.first), *(F.asc(c) for c in self.then)]

    # By cursor

    def after(self, cursor: dict | None = None) -> DataFrame:
        """The page behind a row (its values of the order's columns), or the first page."""
        rows = self.rows
        if cursor is not None:
            equal, behind = F.lit(True), F.lit(False)
            for c in self.then:
                behind, equal = behind | (equal & (F.col(c) > F.lit(cursor[c]))), equal & (F.col(c) == F.lit(cursor[c]))
            first, value = F.col(self.first), cursor[self.first]
            if value is None:
                rows = rows.filter(first.isNull() & behind)
            else:
                value = F.lit(value)
                beyond = first < value if self.descending else first > value
                # The plain range is for the scan; nulls come last, so they are behind every cursor with a value.
                rows = rows.filter(((first <= value) if self.descending else (first >= value)) | first.isNull()).filter(beyond | first.isNull() | ((first == value) & behind))
        return rows.orderBy(*self._order()).limit(self.size)

    # By number

    def stretches(self) -> tuple[list, list[int]]:
        """Upper bounds of the stretches, in ascending order, and exact counts of them and, last, of nulls."""
        if self._ends is None:
            shares = [k / self._wanted for k in range(1, self._wanted + 1)]
            ends = self.rows.agg(F.percentile_approx(self.first, shares, 10 * self._wanted).alias("e")).first()["e"] or []
            self._ends = sorted(set(ends))
            kind = self.rows.schema[self.first].dataType.simpleString()
            bounds = F.array(*(F.lit(e).cast(kind) for e in self._ends)) if self._ends else F.array().cast(f"array<{kind}>")
            # The sketch ends with the greatest value, so every value has a stretch: the first whose end isn't below it.
            place = F.when(F.col(self.first).isNull(), len(self._ends)).otherwise(F.size(F.filter(bounds, lambda e: e < F.col(self.first))))
            found = {r["place"]: r["n"] for r in self.rows.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
            self._counts = [found.get(i, 0) for i in range(len(self._ends) + 1)]
        return self._ends, self._counts

    def total(self) -> int:
        return sum(self.stretches()[1])

    def number(self, page: int) -> DataFrame:
        """Page ``page``, from 1."""
        ends, counts = self.stretches()
        skip = (page - 1) * self.size
        order = [*(range(len(ends) - 1, -1, -1) if self.descending else range(len(ends))), len(ends)]  # of stretches, nulls last
        upto = list(accumulate(counts[i] for i in order))
        if page < 1 or not upto or skip >= upto[-1]:
            return self.rows.limit(0)
        a = bisect_right(upto, skip)
        b = min(len(order) - 1, bisect_right(upto, skip + self.size - 1))
        inside, value = [], F.col(self.first)
        with_value = [i for i in order[a : b + 1] if i < len(ends)]
        if with_value:
            low, high = min(with_value), max(with_value)
            inside.append((value <= F.lit(ends[high])) & ((value > F.lit(ends[low - 1])) if low else F.lit(True)))
        if len(ends) in order[a : b + 1]:
            inside.append(value.isNull())
        rows = self.rows.filter(reduce(Column.__or__, inside)).orderBy(*self._order())
        return rows.offset(skip - (upto[a - 1] if a else 0)).limit(self.size)
