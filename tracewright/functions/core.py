"""Small building blocks shared by the other expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points Python treats as white space, and those it ends lines at.
SPACES = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ),
    )
)
BREAKS = "".join(map(chr, (*range(0x0A, 0x0E), *range(0x1C, 0x1F), 0x85, 0x2028, 0x2029)))
# the same white space as a character class; the Unicode property is one test per character
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NEWLINE = rf"(?:\r\n|[{BREAKS}])"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[blank_to_null(v) for v in values[:-1]], values[-1])


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def unify_lines(text: Column) -> Column:
    """Every line end as ``\\n``; the end of the last line is not kept.

    Most texts have plain line ends only. They are told by byte search and never reach the regular expression.
    """

    def plain(t: Column) -> Column:
        odd = F.lit(False)
        for mark in BREAKS.replace("\n", ""):
            odd = odd | F.contains(t, F.lit(mark))
        return F.when(odd, F.regexp_replace(t, NEWLINE, "\n")).otherwise(t)

    def without_last_end(t: Column) -> Column:
        return F.when(F.endswith(t, F.lit("\n")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)

    return bind(bind(text, plain), without_last_end)


def split_lines(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return bind(text, lambda t: F.when(t == "", none).otherwise(F.split(unify_lines(t), "\n")))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def fixed(value: Column, digits: int) -> Column:
    """Decimal text rounded half to even on the stored binary value."""
    shape = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", value, F.lit(shape))


def any_prefix(text: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | F.startswith(text, F.lit(prefix))
    return test
