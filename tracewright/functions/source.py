"""Summaries of TypeScript source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.core import any_prefix, bind, split_lines, strip

# What an index of the tree leaves out, and the shapes it looks for.
IGNORED_PREFIXES = (
    "src/types",
    "src/styles",
    "src/stories",
    "src/setup",
    "src/languages",
    "src/utils",
    "src/libs/API/parameters",
)
IGNORED_FILES = ("src/libs/DateUtils.ts",)
IGNORED_SUFFIX = "types.ts"
# space and words are taken whole, and a word is tried from its start only: any other way ends in the same match or in none
DECLARATION = (
    r"(?U)(/\*\*[\s\S]*?\*/)?\s*+"
    r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*\([^)]*\)\s*=>|(?<!\w)(\w++)\s*:\s*function\s*\([^)]*\))"
)
RETURN_BLOCK = r"(?U)return\s*\(([\s\S]+?)\);"
RETURN_TERNARY = r"(?U)return\s+[^?]*\?\s*\(([\s\S]+?)\)\s*:\s*\(([\s\S]+?)\);"
LINT_COMMENT = r"(?dU)//\s*eslint-disable.*"
CONNECT_BLOCK = r"Onyx\.connect\(\{[\s\S]*?\}\);"
TYPE_LITERAL = r"(?U)type\s+\w+\s*=\s*\{[^}]*\}"
PREVIEW_LINES = 150
PREVIEW_CHARS = 500


def tree_path(path: Column) -> Column:
    """The path from its first ``src/`` on; the whole path if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(src/.*)", 1), F.lit("")), path)


def is_ignored_source(path: Column) -> Column:
    return any_prefix(path, IGNORED_PREFIXES) | path.isin(*IGNORED_FILES) | F.endswith(path, F.lit(IGNORED_SUFFIX))


def clean_source(content: Column) -> Column:
    """Source without imports, lint switches, connect blocks, type literals and empty lines."""
    kept = F.filter(split_lines(content), lambda line: ~F.startswith(strip(line), F.lit("import")))
    text = F.array_join(kept, "\n")
    for pattern in (LINT_COMMENT, CONNECT_BLOCK, TYPE_LITERAL):
        text = F.regexp_replace(text, pattern, "")
    solid = F.filter(split_lines(text), lambda line: ~strip(line).isin("", ";"))
    return F.array_join(solid, "\n")


def signatures(content: Column) -> Column:
    """Lines of each declared function: its doc comment, if any, and its name."""

    def lines(match: Column) -> Column:
        doc = strip(F.regexp_extract(match, DECLARATION, 1))
        name = F.concat(*[F.regexp_extract(match, DECLARATION, g) for g in (2, 3, 4)])
        shown = F.array(F.concat(F.lit("function "), name, F.lit("(...)")))
        return bind(doc, lambda d: F.when(d == "", shown).otherwise(F.concat(F.split(d, "\n"), shown)))

    return F.flatten(F.transform(F.regexp_extract_all(content, F.lit(DECLARATION), 0), lines))


def jsx_lines(content: Column) -> Column:
    """Non-empty lines of what components return: plain blocks first, then both arms of ternaries."""
    plain = F.regexp_extract_all(content, F.lit(RETURN_BLOCK), 1)
    arms = F.flatten(
        F.zip_with(
            F.regexp_extract_all(content, F.lit(RETURN_TERNARY), 1),
            F.regexp_extract_all(content, F.lit(RETURN_TERNARY), 2),
            lambda left, right: F.array(left, right),
        )
    )

    def lines(block: Column) -> Column:
        text = block
        for raw, shown in (("\\n", "\n"), ("\\'", "'"), ('\\"', '"')):
            text = F.replace(text, F.lit(raw), F.lit(shown))
        return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")

    return F.flatten(F.transform(F.concat(plain, arms), lines))


def file_summary(path: Column, cleaned: Column) -> Column:
    """Library files give signatures, components their markup, all others their first lines."""
    return (
        F.when(F.startswith(path, F.lit("src/libs/")), signatures(cleaned))
        .when(F.endswith(path, F.lit(".tsx")), jsx_lines(cleaned))
        .otherwise(F.slice(split_lines(cleaned), 1, PREVIEW_LINES))
    )
