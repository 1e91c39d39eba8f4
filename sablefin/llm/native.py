"""Column helpers that stay in the JVM: binding, matches with positions, span lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER = "\u0001", "\u0002"
SPAN = "array<struct<s:int,e:int,t:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once although body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def searchable(text: Column) -> Column:
    """The text with the marker character exchanged for another that no pattern names; lengths stay. Null: empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)


def parts_of(text: Column, regex: str) -> Column:
    """Gaps and matches by turns, starting with a gap."""
    return F.split(F.regexp_replace(text, regex, f"{MARK}$0{MARK}"), MARK, -1)


def located(parts: Column) -> Column:
    """The matches of parts_of with start and end in code points."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        n = F.length(x)
        here = F.struct(acc["pos"].alias("s"), (acc["pos"] + n).alias("e"), x.alias("t"))
        return F.struct((acc["pos"] + n).alias("pos"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def matches(text: Column, regex: str, worth: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with positions; worth: a cheap test that must hold where there is any match."""
    found = located(parts_of(text, regex))
    return F.when(text.rlike(regex) if worth is None else worth, found).otherwise(F.array().cast(SPAN))


def ranked(spans: Column, order: int, kind: str) -> Column:
    """Spans as (s, order, kind, e), ready to be merged and sorted."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e")))


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(acc, c):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), zero, step, lambda acc: acc["sum"] % 10 == 0)


def literal_array(values, kind: str) -> Column:
    """A constant array (folded once by the planner) for lookups by position."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def probably_in(ids: DataFrame, most_bits: int = 1 << 22) -> Callable[[Column], Column]:
    """A test of long ids that holds for all of a table's (its one column) and few others: one hash into a bit array of bounded size.

    It goes before a join, so that rows that would find no partner are not shuffled.
    """
    name = ids.columns[0]
    rows = ids.count()
    bits = 1 << 12
    while bits < min(16 * rows, most_bits):
        bits *= 2
    place = lambda x: F.pmod(F.xxhash64(x, F.lit(17)), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col(name)).bitwiseAND(F.lit(63)).cast("int"))
    words = [0] * (bits // 64)
    for r in ids.groupBy(F.shiftright(place(F.col(name)), 6).alias("w")).agg(F.bit_or(bit).alias("b")).collect():  # at most bits / 64 rows
        words[r["w"]] = r["b"]
    held = literal_array(words, "bigint")
    return lambda x: F.coalesce(F.get(held, F.shiftright(place(x), 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place(x).bitwiseAND(F.lit(63)).cast("int"))) != 0, F.lit(False))
