"""Spans of regular expressions with code point offsets, from built-in column functions only.

Every step takes time in proportion to the text and, for running sums over n spans, to n log n: no
array grows span by span, and no span scans its text from the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,stop:int,text:string>"
#: Code points of a chunk, and the size in bytes up to which a text is one chunk.
CHUNK, WHOLE = 4096, 16384


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, however often and within whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], back: bool = False) -> Column:
    """join over each value of an array and all before it (after it with back), in steps of doubling width."""

    def step(now: Column, k: Column) -> Column:
        width = F.pow(F.lit(2), k).cast("int")
        if back:
            return F.transform(now, lambda x, i: F.when(i + width < F.size(now), join(x, F.get(now, i + width))).otherwise(x))
        return F.transform(now, lambda x, i: F.when(i >= width, join(x, F.get(now, i - width))).otherwise(x))

    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
    return let(values, lambda v: F.when(F.size(v) > 1, F.aggregate(rounds(v), v, step)).otherwise(v))


def located(text: Column, matches: Column, pattern: str, kind: int, keep=None) -> Column:
    """The matches that regexp_extract_all gave, with their places.

    The text between matches comes from split() by the same pattern; running sums of both lengths
    give the places. Matches for which keep(match) does not hold are left out. Only texts that have a
    match are split.
    """
    between = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    stops = running(F.zip_with(between, matches, lambda p, m: F.length(p) + F.length(m)), lambda a, b: a + b)
    spans = F.zip_with(matches, stops, lambda m, stop: F.struct(F.lit(kind).alias("kind"), (stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("text")))
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["text"]))
    return F.when(F.size(matches) > 0, spans.cast(f"array<{SPAN}>")).otherwise(none())


def chunks(text: Column) -> Column:
    """A text as chunks of CHUNK code points; a short one as a single chunk."""
    return F.when(F.octet_length(text) <= WHOLE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def piece(parts: Column, start: Column, stop: Column) -> Column:
    """The code points from start to stop of the text whose chunks are given, without a scan from its beginning."""
    first = F.least(F.floor(start / CHUNK), F.size(parts) - 1).cast("int")
    last = F.least(F.floor(stop / CHUNK), F.size(parts) - 1).cast("int")
    return F.when(stop > start, F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start - first * CHUNK + 1, stop - start)).otherwise("")


def apart(spans: Column, fixed: Column) -> Column:
    """Those of the spans that share no character with a fixed one; all have start and stop."""
    side = lambda x, other: F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(other).alias("fixed"), s["text"].alias("text"), s["kind"].alias("kind")))

    def free(both: Column) -> Column:
        # the furthest end of a fixed span up to here, and the nearest start of one from here
        end = running(F.transform(both, lambda s: F.when(s["fixed"], s["stop"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
        begin = running(F.transform(both, lambda s: F.when(s["fixed"], s["start"]).otherwise((1 << 31) - 1)), lambda a, b: F.least(a, b), True)
        alone = F.zip_with(F.transform(both, lambda s: s["stop"]), begin, lambda stop, b: b >= stop)
        alone = F.zip_with(F.zip_with(F.transform(both, lambda s: s["start"]), end, lambda start, e: e <= start), alone, lambda x, y: x & y)
        marked = F.zip_with(both, alone, lambda s, x: F.struct(s.alias("s"), (x & ~s["fixed"]).alias("free")))
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: F.struct(x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), x["s"]["stop"].alias("stop"), x["s"]["text"].alias("text")))

    both = F.array_sort(F.concat(side(spans, False), side(fixed, True)))
    return F.when((F.size(spans) > 0) & (F.size(fixed) > 0), let(both, free).cast(f"array<{SPAN}>")).otherwise(spans)


def listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined in the order given."""
    kinds = F.array(*[F.lit(x) for x in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def digits(text: Column) -> Column:
    """The digits of a text as an array of numbers."""
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.try_cast("int"))


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def luhn(text: Column) -> Column:
    """Whether the digits of a text have a right Luhn check digit."""
    found = F.reverse(F.filter(digits(text), lambda d: d.isNotNull()))
    doubled = F.transform(found, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number (IBAN) has a remainder of 1: first four characters last, letters as two digits."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.filter(F.split(F.concat(F.substring(bare, 5, 1 << 20), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97) == 1
