"""Ignore-file patterns as regular expressions, built by Spark from a column of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.core import bind, strip


def is_pattern_line(raw: Column) -> Column:
    """Lines that count: not blank, not a comment (indented ones are comments too), not a lone ``/`` or ``!``."""
    return bind(strip(raw), lambda line: ~line.isin("", "/", "!") & ~F.startswith(line, F.lit("#")))


def is_negated(pattern: Column) -> Column:
    return F.startswith(strip(pattern), F.lit("!"))


def pattern_regex(pattern: Column) -> Column:
    """A whole-path expression for one pattern.

    Covers ``*``, ``?``, ``**``, character sets, escapes, a leading ``!`` or ``/`` and a trailing ``/``. A pattern with a
    slash before its end is anchored at the root, any other may start below any folder; whatever lies
    under a matching folder matches too.
    """
    text = F.regexp_replace(strip(pattern), r"\A!", "")
    text = F.regexp_replace(text, r"\A\\([!#])", "$1")
    rooted = text.rlike(r"\A/|/[^/]")
    folder = F.endswith(text, F.lit("/"))
    bare = F.regexp_replace(F.regexp_replace(text, r"\A/", ""), r"/\z", "")
    # control characters stand in for wildcards while the rest is quoted
    marked = F.regexp_replace(bare, r"\A(?:\*\*/)+", "\x01")
    marked = F.regexp_replace(marked, r"/(?:\*\*/)+", "\x02")
    marked = F.regexp_replace(marked, r"/\*\*\z", "\x03")
    marked = F.regexp_replace(marked, r"\*+", "\x04")
    marked = F.regexp_replace(marked, r"\?", "\x05")
    marked = F.regexp_replace(marked, r"\[!([^\]]+)\]", "\x06$1\x07")
    marked = F.regexp_replace(marked, r"\[([^\]]+)\]", "\x08$1\x07")
    quoted = F.regexp_replace(marked, r"\\(?=.)", "")
    quoted = F.regexp_replace(quoted, r"([\\^$.|+(){}\[\]&~#])", r"\\$1")
    for mark, meaning in (
        ("\x01", "(?:.*/)?"),
        ("\x02", "/(?:.*/)?"),
        ("\x03", "/.*"),
        ("\x04", "[^/]*"),
        ("\x05", "[^/]"),
        ("\x06", "[^"),
        ("\x08", "["),
        ("\x07", "]"),
    ):
        quoted = F.replace(quoted, F.lit(mark), F.lit(meaning))
    start = F.when(rooted | F.startswith(marked, F.lit("\x01")), "").otherwise("(?:.*/)?")
    end = F.when(folder, "/.*").when(F.endswith(marked, F.lit("\x03")), "").otherwise("(?:/.*)?")
    return F.concat(F.lit(r"\A"), start, quoted, end, F.lit(r"\z"))


def last_match_ignores(path: Column, runs: Column) -> Column:
    """Whether the last matching run of patterns is a positive one.

    ``runs`` is an ordered array of ``struct<negated, regex>``. ``regexp_instr`` keeps the compiled
    expression between rows, which a column argument of ``rlike`` would not.
    """
    step = lambda ignored, run: F.when(
        F.call_function("regexp_instr", path, run["regex"]) > 0, ~run["negated"]
    ).otherwise(ignored)
    return bind(runs, lambda r: F.when(r.isNull(), False).otherwise(F.aggregate(r, F.lit(False), step)))
