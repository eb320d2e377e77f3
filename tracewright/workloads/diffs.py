"""Reading unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import diffs, paths
from tracewright.plans import reviewing as plan
from tracewright.schemas import DIFFSTAT_PAGE
from tracewright.sources.files import page_values
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.feeds import DIFF_FILES, DIFF_LINES, NUMBERED_LINES

ID = "pull_request_id"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return diffs.split_diffs(feeds.raw_diffs(spark, d))


@query(ctes(DIFF_FILES) + "SELECT doc_id AS pull_request_id, ord::INTEGER AS ord, path, old_path, patch FROM patches")
def diff_split(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select(ID, "ord", "path", "old_path", "patch")


KEPT = r""",
kept_flags AS (
  SELECT *, last_value(CASE WHEN starts_with(line, 'diff --git a/') THEN regexp_extract(line, '^diff --git a/(.*?) b/', 1) END
    IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS old FROM diff_order),
kept AS (
  SELECT doc_id, coalesce(trim(string_agg(line, chr(10) ORDER BY pos)
    FILTER (WHERE starts_with(old, 'src/') AND NOT starts_with(old, 'src/languages')), e' \t\n\r'), '') AS kept,
    string_agg(line, chr(10) ORDER BY pos) AS whole
  FROM kept_flags GROUP BY doc_id)"""


@query(ctes(DIFF_LINES + KEPT) + "SELECT doc_id AS pull_request_id, kept FROM kept")
def diff_filter_src(spark: SparkSession, d: str) -> DataFrame:
    return feeds.raw_diffs(spark, d).select(ID, diffs.keep_source_sections(F.col("raw_diff")).alias("kept"))


@query(
    ctes(DIFF_LINES + KEPT)
    + r"""SELECT doc_id AS pull_request_id,
  len(list_filter(string_split_regex(whole, '\s+'), lambda w: w <> ''))::INTEGER AS words_before,
  len(list_filter(string_split_regex(kept, '\s+'), lambda w: w <> ''))::INTEGER AS words_after FROM kept"""
)
def diff_word_counts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_diff")
    return feeds.raw_diffs(spark, d).select(
        ID,
        diffs.word_count(raw).alias("words_before"),
        diffs.word_count(diffs.keep_source_sections(raw)).alias("words_after"),
    )


@query(
    ctes(DIFF_FILES, NUMBERED_LINES)
    + """SELECT doc_id AS pull_request_id, path,
  string_agg(coalesce(num || ' ', '') || line, chr(10) ORDER BY pos) AS numbered
FROM numbered_lines GROUP BY doc_id, path"""
)
def patch_numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select(ID, "path", diffs.numbered_patch(F.col("patch")).alias("numbered"))


@query(
    ctes(DIFF_FILES, NUMBERED_LINES)
    + """SELECT DISTINCT doc_id AS pull_request_id, path, num::INTEGER AS line FROM numbered_lines
WHERE num IS NOT NULL AND starts_with(line, '+')"""
)
def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    return diffs.changed_line_rows(_files(spark, d), [ID, "path"])


STATS = """stats AS (
  SELECT doc_id, path, ord, CASE WHEN bool_or(line = 'deleted file mode 100644') THEN 'removed'
      WHEN bool_or(line = 'new file mode 100644') THEN 'added' ELSE 'modified' END AS status,
    count(*) FILTER (WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')) AS additions,
    count(*) FILTER (WHERE starts_with(line, '-') AND NOT starts_with(line, '---')) AS deletions
  FROM file_lines GROUP BY ALL)"""


@query(
    ctes(DIFF_FILES, STATS)
    + """SELECT doc_id AS pull_request_id, path, status, additions::INTEGER AS additions, deletions::INTEGER AS deletions
FROM stats"""
)
def patch_stats(spark: SparkSession, d: str) -> DataFrame:
    return diffs.describe_patches(_files(spark, d)).select(ID, "path", "status", "additions", "deletions")


@query(
    ctes(DIFF_FILES)
    + """, listed AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN 'docs' WHEN lang = 'en' THEN 'src' WHEN lang = 'fr' THEN 'src/languages'
      ELSE 'docs' END || '/' || source || '/m0.py' AS filename, lang, n_chars
  FROM documents UNION ALL SELECT doc_id, 'gone/' || source, lang, n_chars FROM documents)
SELECT l.doc_id AS pull_request_id, l.filename, CASE WHEN lang = 'en' THEN 'modified' ELSE 'renamed' END AS status,
  n_chars::INTEGER AS additions, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END::INTEGER AS deletions,
  length(p.patch)::INTEGER AS patch_length
FROM listed l LEFT JOIN patches p ON p.doc_id = l.doc_id AND p.path = l.filename"""
)
def diffstat_join(spark: SparkSession, d: str) -> DataFrame:
    """API pages of file statistics with the patches cut from the raw diff."""
    base = F.when(F.col("lang") == "en", "src").when(F.col("lang") == "fr", "src/languages").otherwise("docs")
    path = F.concat(base, F.lit("/"), "source", F.lit("/m0.py"))
    removed = F.when(F.col("lang") != "fr", 1)
    status = F.when(F.col("lang") != "en", "renamed")
    stat = lambda new, old: F.struct(
        status.alias("status"),
        F.col("n_chars").alias("lines_added"),
        removed.alias("lines_removed"),
        F.struct(new.alias("path")).alias("new"),
        F.struct(old.alias("path")).alias("old"),
    )
    values = F.array(stat(path, F.lit("before")), stat(F.lit(""), F.concat(F.lit("gone/"), "source")))
    pages = t(spark, d, "documents").select(
        F.col("doc_id").alias(ID), F.to_json(F.struct(values.alias("values"))).alias("body")
    )
    joined = diffs.with_patches(page_values(pages, DIFFSTAT_PAGE)[0], _files(spark, d), [ID])
    return joined.select(ID, "filename", "status", "additions", "deletions", F.length("patch").alias("patch_length"))


REVIEWED = """sections AS (
  SELECT n.doc_id, n.path, s.ord, '## File: ' || n.path || chr(10) || 'Status: ' || s.status || chr(10) || 'Changes: +'
    || s.additions || ' -' || s.deletions || chr(10) || chr(10)
    || string_agg(coalesce(n.num || ' ', '') || n.line, chr(10) ORDER BY n.pos) AS section
  FROM numbered_lines n JOIN stats s ON s.doc_id = n.doc_id AND s.path = n.path
  GROUP BY n.doc_id, n.path, s.ord, s.status, s.additions, s.deletions)"""


@query(
    ctes(DIFF_FILES, NUMBERED_LINES, STATS, REVIEWED)
    + """SELECT doc_id AS pull_request_id, string_agg(section, chr(10) || chr(10) ORDER BY ord) AS shown
FROM sections GROUP BY doc_id"""
)
def review_prompt_diff(spark: SparkSession, d: str) -> DataFrame:
    return feeds.raw_diffs(spark, d).select(ID, diffs.review_text(F.col("raw_diff")).alias("shown"))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """Ignore lines of each language's repository: a folder per source, then general rules with a negation."""
    seen = t(spark, d, "documents").select("lang", "source").distinct()
    folders = seen.select(
        F.col("lang").alias("repo_id"),
        F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("ord"),
        F.concat(F.lit("/vendor/"), "source", F.lit("/")).alias("pattern"),
    )
    rules = F.array(*[F.lit(r) for r in ("# comment", "", "src/src1*/", "!m0.py", "/docs/**/m[23].py", "*.log")])
    general = seen.select("lang").distinct().select(F.col("lang").alias("repo_id"), F.posexplode(rules).alias("ord", "pattern"))
    return folders.unionByName(general.withColumn("ord", F.col("ord") + 1000))


IGNORED_SQL = r"""CASE WHEN regexp_matches(path, '^docs/(.*/)?m[23]\.py(/.*)?$') THEN true
  WHEN regexp_matches(path, '^(.*/)?m0\.py(/.*)?$') THEN false
  WHEN regexp_matches(path, '^src/src1[^/]*/.*$') THEN true ELSE false END"""


@query(ctes(DIFF_FILES) + f"SELECT doc_id AS pull_request_id, path, {IGNORED_SQL} AS ignored FROM patches")
def ignore_patterns(spark: SparkSession, d: str) -> DataFrame:
    files = paths.flag_ignored(_files(spark, d), _patterns(spark, d), "path")
    return files.select(ID, "path", "ignored")


@query(
    ctes(DIFF_FILES, NUMBERED_LINES, STATS, REVIEWED)
    + f"SELECT doc_id AS pull_request_id, ord::INTEGER AS ord, path AS filename, section FROM sections WHERE NOT ({IGNORED_SQL})"
)
def review_input(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: split, drop ignored files, number and head each section."""
    job = plan.review_input(feeds.raw_diffs(spark, d), _patterns(spark, d))
    return job.sections.select(ID, "ord", "filename", "section")


@query(
    ctes(DIFF_FILES)
    + "SELECT doc_id AS pull_request_id, string_agg(path, ',' ORDER BY ord) AS files FROM patches GROUP BY doc_id"
)
def files_reviewed(spark: SparkSession, d: str) -> DataFrame:
    files = diffs.reviewed_files(F.col("raw_diff"))
    return feeds.raw_diffs(spark, d).select(ID, F.array_join(files, ",").alias("files"))


@query(
    ctes(DIFF_FILES, NUMBERED_LINES, STATS, REVIEWED)
    + f"""SELECT doc_id AS pull_request_id, (ord // 2)::BIGINT AS chunk,
  string_agg(section, chr(10) || chr(10) ORDER BY ord) AS text
FROM sections WHERE NOT ({IGNORED_SQL}) GROUP BY ALL"""
)
def review_prompt_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The sections of file rows joined per change, here at most two to a text."""
    job = plan.review_input(feeds.raw_diffs(spark, d), _patterns(spark, d))
    return plan.prompt_chunks(job.sections, 2).drop("repo_id")
