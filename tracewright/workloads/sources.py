"""Source text and its index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import source
from tracewright.plans.source_index import index_sources, longest_first, preview
from tracewright.workloads.base import ctes, query, t

IMPORTS = "import {x} from 'y';\n  import z\n// eslint-disable-next-line foo\n"
TYPES = "\ntype Props = {\n  a: string;\n};\nOnyx.connect({\n key: 1,\n});\n;\n"
DOC, FUNCTION = "/** Makes page ", ".\n * Twice.\n */\nfunction page"
RETURN, ARROW = "(a) {\n  return (\n    <b>", "</b>\n\n  );\n}\nconst go"
ARMS = " = (x) => {\n return x ? (\n<i>it\\'s\\nx</i>) : (<u/>);\n};\n"


def _code(name: Column) -> Column:
    return F.concat(
        F.lit(IMPORTS), "html", F.lit(TYPES), F.lit(DOC), name, F.lit(FUNCTION), name,
        F.lit(RETURN), "url", F.lit(ARROW), name, F.lit(ARMS),
    )


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as source files: the language decides folder and kind."""
    kind = (
        F.when(F.contains("url", F.lit("/en/")), F.lit("src/libs/"))
        .when(F.contains("url", F.lit("/fr/")), F.lit("src/languages/"))
        .otherwise(F.lit("src/pages/"))
    )
    suffix = F.when(F.contains("url", F.lit("/de/")), ".tsx").otherwise(".ts")
    name = F.col("page_id").cast("string")
    path = F.concat(F.lit("/home/app/"), kind, F.lit("p"), name, suffix)
    return t(spark, d, "pages").select("page_id", source.tree_path(path).alias("path"), _code(name).alias("content"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return index_sources(_files(spark, d))


def _q(text: str) -> str:
    """A text as SQL literals joined by line ends."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


CODE = rf"""code AS (
  SELECT page_id, (CASE WHEN contains(url, '/en/') THEN 'src/libs/' WHEN contains(url, '/fr/') THEN 'src/languages/'
      ELSE 'src/pages/' END) || 'p' || page_id || (CASE WHEN contains(url, '/de/') THEN '.tsx' ELSE '.ts' END) AS path,
    {_q(IMPORTS)} || html || {_q(TYPES)} || {_q(DOC)} || page_id || {_q(FUNCTION)} || page_id || {_q(RETURN)} || url
    || {_q(ARROW)} || page_id || {_q(ARMS)} AS content
  FROM pages)"""
CLEANED = r"""cleaned AS (
  SELECT page_id, path, content, array_to_string(list_filter(string_split(
    regexp_replace(regexp_replace(regexp_replace(
      array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT starts_with(trim(l, e' \t\r'), 'import')), chr(10)),
      '//\s*eslint-disable.*', '', 'g'), 'Onyx\.connect\(\{[\s\S]*?\}\);', '', 'g'), 'type\s+\w+\s*=\s*\{[^}]*\}', '', 'g'),
    chr(10)), lambda l: trim(l, e' \t\r') NOT IN ('', ';')), chr(10)) AS cleaned
  FROM code)"""
DECLARED = (
    r"(/\*\*[\s\S]*?\*/)?\s*"
    r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*\([^)]*\)\s*=>|(\w+)\s*:\s*function\s*\([^)]*\))"
)
RETURNED = r"return\s*\(([\s\S]+?)\);"
TERNARY = r"return\s+[^?]*\?\s*\(([\s\S]+?)\)\s*:\s*\(([\s\S]+?)\);"
UNESCAPED = r"""replace(replace(replace(b, '\n', chr(10)), '\''', ''''), '\"', '"')"""


def _signatures_sql(column: str) -> str:
    part = lambda g: f"regexp_extract_all({column}, '{DECLARED}', {g})"
    return f"""flatten(list_transform(list_zip({part(1)}, {part(2)}, {part(3)}, {part(4)}), lambda m:
    (CASE WHEN coalesce(m[1], '') = '' THEN [] ELSE string_split(trim(m[1], e' \\t\\n\\r'), chr(10)) END)
    || ['function ' || coalesce(m[2], '') || coalesce(m[3], '') || coalesce(m[4], '') || '(...)']))"""


def _jsx_sql(column: str) -> str:
    part = lambda g: f"regexp_extract_all({column}, '{TERNARY}', {g})"
    return f"""flatten(list_transform(
    regexp_extract_all({column}, '{RETURNED}', 1) || flatten(list_transform(list_zip({part(1)}, {part(2)}), lambda a: [a[1], a[2]])),
    lambda b: list_filter(list_transform(string_split({UNESCAPED}, chr(10)), lambda l: trim(l, e' \\t\\r')), lambda l: l <> '')))"""


@query(ctes(CODE, CLEANED) + "SELECT page_id, cleaned FROM cleaned")
def source_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("page_id", source.clean_source(F.col("content")).alias("cleaned"))


@query(ctes(CODE) + f"SELECT page_id, array_to_string({_signatures_sql('content')}, chr(10)) AS signatures FROM code")
def source_signatures(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_join(source.signatures(F.col("content")), "\n")
    return _files(spark, d).select("page_id", found.alias("signatures"))


@query(ctes(CODE) + f"SELECT page_id, array_to_string({_jsx_sql('content')}, chr(10)) AS jsx FROM code")
def jsx_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("page_id", F.array_join(source.jsx_lines(F.col("content")), "\n").alias("jsx"))


INDEX = f"""index_lines AS (
  SELECT path, CASE WHEN starts_with(path, 'src/libs/') THEN {_signatures_sql('cleaned')}
    WHEN ends_with(path, '.tsx') THEN {_jsx_sql('cleaned')}
    ELSE list_slice(string_split(cleaned, chr(10)), 1, 150) END AS lines
  FROM cleaned WHERE NOT starts_with(path, 'src/languages'))"""


@query(
    ctes(CODE, CLEANED, INDEX)
    + "SELECT path, len(lines)::INTEGER AS size, array_to_string(lines, chr(10)) AS lines FROM index_lines"
)
def source_index(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return index.select("path", F.size("lines").alias("size"), F.array_join("lines", "\n").alias("lines"))


@query()
def source_previews(spark: SparkSession, d: str) -> DataFrame:
    """Starts of the summaries as Python shows lists; SQL has no such form."""
    return preview(_index(spark, d))


@query(ctes(CODE, CLEANED, INDEX) + "SELECT path, len(lines)::INTEGER AS lines FROM index_lines")
def source_sizes(spark: SparkSession, d: str) -> DataFrame:
    return longest_first(_index(spark, d))
