"""Native text statistics: DataFrame functions only.

A value that a lambda uses more than once is bound by a transform over an array of one, so that
it is worked out once for each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that parts words, and the symbols that are counted.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; an empty array for a null text or one of white space."""
    core = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(core) > 0, F.split(core, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def repeat_words(w: Column, n: int = 3) -> Column:
    """How many words lie in windows of n words that are found twice or more in the array."""

    def covered(at: Column) -> Column:
        gap = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(n), F.get(at, k + 1) - p)).otherwise(n))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        hit = F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, same(k, k - 1)), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def of(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(v) - n)
        s = F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get(v, i + k) for k in range(n))).alias("h"), i.alias("i")))
        return F.when(F.size(v) > n, let(F.sort_array(s), twice)).otherwise(F.lit(0).cast("long"))

    return let(w, of)


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line."""
    full = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return let(full, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long"))
