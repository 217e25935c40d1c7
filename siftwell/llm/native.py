"""Column expressions shared by the operators that run without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space between words.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def unit_hash(key: Column) -> Column:
    """A whole number of 52 bits from the md5 of a key; the same for null as for the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")


#: Elements that ``running`` goes through one by one; longer arrays are cut into blocks of so many.
_BLOCK = 256


def running(values: Column, zero: Column, step) -> Column:
    """``zero`` and what ``step`` (of two values, in any grouping) makes of ever more of an array, from the left.

    Blocks are run through apart and then joined, so that the work is in proportion to the length.
    """

    def alone(x: Column) -> Column:
        return F.aggregate(x, F.array(zero), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))

    def blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: alone(F.slice(x, b * _BLOCK + 1, _BLOCK)))
        joined = lambda p: F.zip_with(p, alone(F.transform(p, lambda q: F.element_at(q, -1))), lambda q, so_far: F.transform(F.slice(q, 1, F.size(q) - 1), lambda v: step(so_far, v)))
        ended = lambda p: F.concat(F.flatten(F.filter(joined(p), lambda q: q.isNotNull())), F.array(F.aggregate(x, zero, step)))
        return let(parts, ended)

    return F.when(F.size(values) <= _BLOCK, alone(values)).otherwise(blocks(values))
