"""Unified diffs: splitting, numbering, counting.

A diff arrives as one text per row and every step here stays within its row, so none of it shuffles. Texts are
cut at headers by look-ahead, and positions inside the pieces come from array indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.core import BREAKS, bind, capture, first_filled, split_lines, strip, unify_lines, words
from tracewright.functions.text import diff_heading

GAP = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]"
# Header forms of git's unified diffs.
HUNK = rf"@@{GAP}*-[0-9]+,?[0-9]*{GAP}*\+([0-9]+),?[0-9]*{GAP}*@@"
HUNK_LINE = rf"(?:\A|\n)(?=@@)(?=[^\n]*{HUNK})"
FILE_LINE = r"(?:\A|\n)(?=diff --git a/[^\n]*? b/)"
FILE_HEADER = r"\Adiff --git a/([^\n]*?) b/([^\n]*)"
FILE_START = rf"(?=diff --git a/[^{BREAKS}]*? b/)(?:\A|(?<=[{BREAKS}]))"
OLD_PATH = r"\Adiff --git a/(.*?) b/"
KEPT_PREFIX, DROPPED_PREFIX = "src/", "src/languages"


def file_sections(raw_diff: Column) -> Column:
    """The files of one raw diff as ``array<struct<ord, path, old_path, patch>>``.

    Text before the first header is dropped. When a path occurs twice its last patch wins, in the place of
    the first.
    """

    def entry(section: Column, at: Column) -> Column:
        # only the first line goes through the expressions
        def split(head: Column) -> Column:
            return F.when(
                head.rlike(FILE_HEADER),
                F.struct(
                    F.regexp_extract(head, FILE_HEADER, 2).alias("path"),
                    at.alias("ord"),
                    F.regexp_extract(head, FILE_HEADER, 1).alias("old_path"),
                    F.substr(section, F.length(head) + 2).alias("patch"),
                ),
            )

        return bind(F.substring_index(section, "\n", 1), split)

    pieces = F.filter(
        F.transform(F.split(unify_lines(raw_diff), FILE_LINE), entry),
        lambda e: e.isNotNull() & (e["path"] != ""),
    )

    def last_wins(by_path: Column) -> Column:
        # F.get gives null outside the array, which never equals a path
        firsts = F.filter(by_path, lambda e, i: ~F.get(by_path, i - 1)["path"].eqNullSafe(e["path"]))
        lasts = F.filter(by_path, lambda e, i: ~F.get(by_path, i + 1)["path"].eqNullSafe(e["path"]))
        return F.zip_with(
            firsts,
            lasts,
            lambda f, x: F.struct(f["ord"].alias("ord"), x["path"], x["old_path"], x["patch"]),
        )

    return F.array_sort(bind(F.array_sort(pieces), last_wins))


def keep_source_sections(raw_diff: Column) -> Column:
    """The diff reduced to files whose old path is under ``src/`` but not ``src/languages``, trimmed."""

    def keep(section: Column) -> Column:
        old = capture(section, OLD_PATH)
        return F.coalesce(F.startswith(old, F.lit(KEPT_PREFIX)) & ~F.startswith(old, F.lit(DROPPED_PREFIX)), F.lit(False))

    return strip(F.array_join(F.filter(F.split(raw_diff, FILE_START), keep), ""))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def _counted(line: Column) -> Column:
    """Lines that exist in the new file: context and additions."""
    header = F.startswith(line, F.lit("@@")) | F.startswith(line, F.lit("+++"))
    return (line != "") & ~header & ~F.startswith(line, F.lit("-"))


def _hunks(patch: Column) -> Column:
    """Hunks as ``array<struct<start, lines>>``; the text before the first hunk has no start."""

    def entry(text: Column) -> Column:
        head = F.when(F.startswith(text, F.lit("@@")), F.substring_index(text, "\n", 1))
        return F.struct(capture(head, HUNK).try_cast("int").alias("start"), F.split(text, "\n").alias("lines"))

    return F.transform(F.split(patch, HUNK_LINE), entry)


def numbered_patch(patch: Column) -> Column:
    """The patch with the new file's line number before every context and added line."""

    def number(hunk: Column) -> Column:
        def merge(lines: Column) -> Column:
            live = F.filter(lines, lambda s: _counted(s["line"]))
            rest = F.filter(lines, lambda s: ~_counted(s["line"]))
            shown = F.transform(
                live,
                lambda s, i: F.struct(
                    s["pos"].alias("pos"),
                    F.concat((hunk["start"] + i).cast("string"), F.lit(" "), s["line"]).alias("line"),
                ),
            )
            return F.array_join(F.transform(F.array_sort(F.concat(shown, rest)), lambda s: s["line"]), "\n")

        placed = F.transform(hunk["lines"], lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
        return F.when(hunk["start"].isNull(), F.array_join(hunk["lines"], "\n")).otherwise(bind(placed, merge))

    return F.array_join(F.transform(_hunks(patch), number), "\n")


def changed_lines(patch: Column) -> Column:
    """Distinct new-file line numbers of added lines, ascending."""

    def added(hunk: Column) -> Column:
        live = F.transform(
            F.filter(hunk["lines"], _counted),
            lambda line, i: F.when(F.startswith(line, F.lit("+")), hunk["start"] + i),
        )
        none = F.array().cast("array<int>")
        return F.when(hunk["start"].isNull(), none).otherwise(F.filter(live, lambda n: n.isNotNull()))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(_hunks(patch), added))))


def patch_status(patch: Column) -> Column:
    """added, removed or modified, from the lines before the first hunk."""
    head = F.element_at(F.split(patch, "\n@@", 2), 1)
    return (
        F.when(F.contains(head, F.lit("deleted file mode")), "removed")
        .when(F.contains(head, F.lit("new file mode")), "added")
        .otherwise("modified")
    )


def line_counts(patch: Column) -> Column:
    """Added and removed lines of a patch as ``struct<additions, deletions>``; file headers do not count."""

    def marked(lines: Column, mark: str) -> Column:
        hit = lambda x: F.startswith(x, F.lit(mark)) & ~F.startswith(x, F.lit(mark * 3))
        return F.size(F.filter(lines, hit))

    def count(lines: Column) -> Column:
        return F.struct(marked(lines, "+").alias("additions"), marked(lines, "-").alias("deletions"))

    return bind(split_lines(patch), count)


def split_diffs(df: DataFrame, raw_diff: str = "raw_diff") -> DataFrame:
    """One row per file of each raw diff."""
    other = [c for c in df.columns if c != raw_diff]
    return df.select(*other, F.inline(file_sections(F.col(raw_diff))))


def describe_patches(files: DataFrame) -> DataFrame:
    """Add status and counts to rows with a ``patch``."""
    patch = F.col("patch")
    counted = files.withColumns({"status": patch_status(patch), "_counts": line_counts(patch)})
    return counted.select(*files.columns, "status", "_counts.*")


def with_patches(stats: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """File statistics with their patches, matched on the new path, or the old one of a removed file.

    ``stats`` has the API's ``new`` and ``old`` structs; files without any path are dropped.
    """
    named = stats.withColumn("filename", first_filled(F.col("new.path"), F.coalesce(F.col("old.path"), F.lit(""))))
    named = named.filter(F.col("filename") != "").select(
        *keys,
        "filename",
        F.coalesce("status", F.lit("modified")).alias("status"),
        F.coalesce("lines_added", F.lit(0)).alias("additions"),
        F.coalesce("lines_removed", F.lit(0)).alias("deletions"),
    )
    return named.join(patches.select(*keys, F.col("path").alias("filename"), "patch"), [*keys, "filename"], "left")


def has_patch(patch: Column) -> Column:
    return F.coalesce(patch, F.lit("")) != ""


def review_section(filename: Column, status: Column, added: Column, removed: Column, patch: Column) -> Column:
    """One file as shown to a reviewer: heading and numbered patch."""
    return F.concat(diff_heading(filename, status, added, removed), numbered_patch(patch))


def review_text(raw_diff: Column) -> Column:
    """All files of one raw diff for a reviewer, in order, with blank lines between them."""

    def show(s: Column) -> Column:
        return bind(
            line_counts(s["patch"]),
            lambda n: review_section(s["path"], patch_status(s["patch"]), n["additions"], n["deletions"], s["patch"]),
        )

    return F.array_join(F.transform(F.filter(file_sections(raw_diff), lambda s: s["patch"] != ""), show), "\n\n")


def reviewed_files(raw_diff: Column) -> Column:
    """Paths of the files of one raw diff that have a patch, in order."""
    return F.transform(F.filter(file_sections(raw_diff), lambda s: s["patch"] != ""), lambda s: s["path"])


def changed_line_rows(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per changed line of each file."""
    return files.select(*keys, F.explode(changed_lines(F.col("patch"))).alias("line"))
