"""The given tables in the shapes the operators take, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.schemas import BLOCKER_LABEL, COMMENT_LABELS, USER_TAG
from tracewright.workloads.base import t

REPO = "main"


def _repo() -> Column:
    return F.lit(REPO).alias("repo_id")


def _hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("int")


# --- issues are suppliers, changes are parts, links are the parts suppliers shipped


def pull_requests(spark: SparkSession, d: str) -> DataFrame:
    marked = F.when(F.col("p_brand") == "Brand#11", F.lit("[CP Staging] ")).otherwise("")
    return t(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        _repo(),
        F.concat(marked, "p_name").alias("title"),
        F.when(F.col("p_size") >= 5, F.concat(F.lit(" Check "), "p_type")).alias("test"),
        F.when(F.col("p_size") > 45, "").otherwise(F.concat(F.lit("Changes "), "p_name")).alias("explanation"),
        F.when(F.col("p_size") == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat("p_brand", F.lit(".ts")), F.concat("p_type", F.lit("'s.ts"))))
        .alias("files"),
        F.when(F.col("p_size") <= 40, F.concat(F.lit("Touches "), "p_type")).alias("code_diff_summary"),
    )


PULLS = """pulls AS (
  SELECT p_partkey AS id, (CASE WHEN p_brand = 'Brand#11' THEN '[CP Staging] ' ELSE '' END) || p_name AS title,
    CASE WHEN p_size >= 5 THEN ' Check ' || p_type END AS test,
    CASE WHEN p_size > 45 THEN '' ELSE 'Changes ' || p_name END AS explanation,
    CASE WHEN p_size = 1 THEN [] ELSE [p_brand || '.ts', p_type || '''s.ts'] END AS files,
    CASE WHEN p_size <= 40 THEN 'Touches ' || p_type END AS code_diff_summary
  FROM part)"""


def issues(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"),
        _repo(),
        F.col("s_name").alias("title"),
        (F.col("s_nationkey") == 3).alias("is_processed"),
    )


def issue_requests(spark: SparkSession, d: str) -> DataFrame:
    labels = F.when(F.col("s_acctbal") > 0, F.array(F.lit(BLOCKER_LABEL), F.lit("Daily"))).otherwise(
        F.array(F.lit("Daily"))
    )
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("issue_id"), _repo(), labels.alias("labels"))


def links(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("issue_id"), F.col("l_partkey").alias("pull_request_id")
    )
    return rows.distinct().withColumn("repo_id", F.lit(REPO))


LINKS = "links AS (SELECT DISTINCT l_suppkey AS issue_id, l_partkey AS pull_request_id FROM lineitem)"


def vectors(spark: SparkSession, d: str, key: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias(key), _repo(), "embedding")


VECTORS = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
SCORES = """scores AS (
  SELECT l.issue_id, l.pull_request_id, list_cosine_similarity(i.v, p.v) AS score
  FROM links l JOIN vectors i ON i.vec_id = l.issue_id JOIN vectors p ON p.vec_id = l.pull_request_id)"""

# --- bodies of changes and issues wrap the documents' text


def bodies(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(
        F.lit("Hi\n### Explanation of Change\n<!-- why -->\n"), "text", F.lit("\n\n\n\n### Fixed issues\n$ #"), "doc_id",
        F.lit("\r\n$ https://tracker.test/org/"), "source", F.lit("/issues/"), "n_chars",
        F.lit("\n$ [#"), F.col("doc_id") + 1, F.lit("](https://tracker.test/org/src1/issues/9)\n### tests\r\n- [ ] open "),
        "lang", F.lit("\n<!-- hidden\n -->\n"), "text", F.lit("\n\n\n- [x] done\n### PR Author Checklist\n- [ ] x"),
    )
    return t(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        _repo(),
        F.concat("source", F.lit(" in "), "lang").alias("title"),
        body.alias("body"),
        F.array(F.concat(F.lit("src/"), "source"), F.concat(F.lit("it's/"), "lang")).alias("files"),
        F.concat(F.lit("has "), "n_chars").alias("code_diff_summary"),
    )


BODIES = r"""bodies AS (
  SELECT doc_id, source || ' in ' || lang AS title, source, lang, n_chars,
    'Hi' || chr(10) || '### Explanation of Change' || chr(10) || '<!-- why -->' || chr(10) || text
    || repeat(chr(10), 4) || '### Fixed issues' || chr(10) || '$ #' || doc_id
    || chr(13) || chr(10) || '$ https://tracker.test/org/' || source || '/issues/' || n_chars
    || chr(10) || '$ [#' || (doc_id + 1) || '](https://tracker.test/org/src1/issues/9)' || chr(10)
    || '### tests' || chr(13) || chr(10) || '- [ ] open ' || lang || chr(10) || '<!-- hidden' || chr(10) || ' -->'
    || chr(10) || text || repeat(chr(10), 3) || '- [x] done' || chr(10) || '### PR Author Checklist' || chr(10)
    || '- [ ] x' AS body
  FROM documents)"""


def issue_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(
        "text", F.lit("\n## Action performed:\n1. "), "source", F.lit("\n"), "text",
        F.lit("\n## Expected Result:\nok\n## Actual Result:\nbad "), "lang", F.lit("\n\n## Workaround:\nnone"),
    )
    return t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), _repo(), F.concat("source", F.lit("?")).alias("title"), body.alias("body")
    )


# --- commits are orders


def commits(spark: SparkSession, d: str) -> DataFrame:
    branch = F.when(F.col("o_orderstatus") == "F", "production").otherwise("staging")
    message = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit('Revert "Merge pull request #'), "o_orderkey", F.lit('"')))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Fix it\nMerge pull request #"), "o_orderkey"))
        .otherwise(F.concat(F.lit("Merge pull request #"), "o_custkey", F.lit(" from team/b\n\nMerge pull request #1")))
    )
    sha = F.concat_ws("-", "o_custkey", F.month("o_orderdate"))
    issue = F.year("o_orderdate").cast("bigint")
    return t(spark, d, "orders").select(
        _repo(), issue.alias("issue_id"), branch.alias("branch"), sha.alias("sha"), message.alias("message")
    )


COMMITS = """commits AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'production' ELSE 'staging' END AS branch,
    o_custkey || '-' || month(o_orderdate) AS sha, year(o_orderdate) AS issue_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Revert "Merge pull request #' || o_orderkey || '"'
      WHEN '2-HIGH' THEN 'Fix it' || chr(10) || 'Merge pull request #' || o_orderkey
      ELSE 'Merge pull request #' || o_custkey || ' from team/b' || chr(10) || chr(10) || 'Merge pull request #1' END
      AS message
  FROM orders)"""

# --- raw diffs: every seven lines of a document are a file, with a second hunk in it


def raw_diffs(spark: SparkSession, d: str) -> DataFrame:
    base = (
        F.when(F.col("lang") == "en", "src").when(F.col("lang") == "fr", "src/languages").otherwise("docs")
    )
    renamed = F.when(F.col("lang") == "de", "pkg").otherwise(base)

    def block(line: Column, i: Column) -> Column:
        file_no = F.pmod(F.floor(i / 7), F.lit(4)).cast("string")
        tail = F.concat(F.lit("/"), "source", F.lit("/m"), file_no, F.lit(".py"))
        old, new = F.concat(base, tail), F.concat(renamed, tail)
        mode = F.when(file_no == "1", "\nnew file mode 100644").when(file_no == "2", "\ndeleted file mode 100644")
        span = F.concat((i + 1).cast("string"), F.lit(",7"))
        header = F.concat(
            F.lit("diff --git a/"), old, F.lit(" b/"), new, F.coalesce(mode, F.lit("")),
            F.lit("\n--- a/"), old, F.lit("\n+++ b/"), new, F.lit("\n@@ -"), span, F.lit(" +"), span, F.lit(" @@ fn\n"),
        )
        second = F.concat(F.lit("@@ -"), (i + 30).cast("string"), F.lit(" +"), (i + 50).cast("string"), F.lit(" @@\n"))
        mark = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.pmod(F.col("doc_id") + i, F.lit(3)) + 1).cast("int"))
        lead = F.when(F.pmod(i, F.lit(7)) == 0, header).when(F.pmod(i, F.lit(7)) == 4, second).otherwise("")
        return F.concat(lead, F.when(line == "", "").otherwise(F.concat(mark, line)))

    diff = F.array_join(F.transform(F.split("text", "\n"), block), "\n")
    return t(spark, d, "documents").select(
        F.col("doc_id").alias("pull_request_id"), F.col("lang").alias("repo_id"), diff.alias("raw_diff")
    )


# one row per line of the same diffs
DIFF_LINES = r"""source_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
    CASE lang WHEN 'en' THEN 'src' WHEN 'fr' THEN 'src/languages' ELSE 'docs' END AS old_base,
    CASE lang WHEN 'en' THEN 'src' WHEN 'fr' THEN 'src/languages' WHEN 'de' THEN 'pkg' ELSE 'docs' END AS new_base,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents),
diff_pieces AS (
  SELECT doc_id, i,
    (CASE WHEN i % 7 = 0 THEN
      ['diff --git a/' || old_base || '/' || source || '/m' || ((i // 7) % 4) || '.py b/'
        || new_base || '/' || source || '/m' || ((i // 7) % 4) || '.py']
      || (CASE (i // 7) % 4 WHEN 1 THEN ['new file mode 100644'] WHEN 2 THEN ['deleted file mode 100644'] ELSE [] END)
      || ['--- a/' || old_base || '/' || source || '/m' || ((i // 7) % 4) || '.py',
          '+++ b/' || new_base || '/' || source || '/m' || ((i // 7) % 4) || '.py',
          '@@ -' || (i + 1) || ',7 +' || (i + 1) || ',7 @@ fn']
      WHEN i % 7 = 4 THEN ['@@ -' || (i + 30) || ' +' || (i + 50) || ' @@'] ELSE [] END)
    || [CASE WHEN line = '' THEN '' ELSE (['+', '-', ' '])[(doc_id + i) % 3 + 1] || line END] AS pieces
  FROM source_lines),
diff_order AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos
  FROM (SELECT doc_id, i, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS j FROM diff_pieces))"""
# files of each diff: segment number, paths, and the lines below the header
DIFF_FILES = (
    DIFF_LINES
    + r""",
diff_segments AS (
  SELECT *, sum(CASE WHEN starts_with(line, 'diff --git a/') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY pos) AS seg
  FROM diff_order),
diff_heads AS (
  SELECT doc_id, seg, regexp_extract(line, '^diff --git a/(.*?) b/(.*)$', 1) AS old_path,
    regexp_extract(line, '^diff --git a/(.*?) b/(.*)$', 2) AS path
  FROM diff_segments WHERE starts_with(line, 'diff --git a/')),
diff_kept AS (
  SELECT doc_id, path, max(seg) AS seg, min(seg) - 1 AS ord, max_by(old_path, seg) AS old_path
  FROM diff_heads GROUP BY doc_id, path),
file_lines AS (
  SELECT k.doc_id, k.path, k.ord, k.old_path, s.pos, s.line
  FROM diff_kept k JOIN diff_segments s ON s.doc_id = k.doc_id AND s.seg = k.seg
  WHERE NOT starts_with(s.line, 'diff --git a/')),
patches AS (
  SELECT doc_id, path, ord, old_path, string_agg(line, chr(10) ORDER BY pos) AS patch
  FROM file_lines GROUP BY ALL)"""
)
# the same lines with the number each has in the new file
NUMBERED_LINES = r"""hunk_lines AS (
  SELECT *, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END) OVER w AS hunk,
    last_value(CASE WHEN starts_with(line, '@@')
      THEN regexp_extract(line, '@@\s*-\d+,?\d*\s*\+(\d+),?\d*\s*@@', 1)::INTEGER END IGNORE NULLS) OVER w AS start,
    line <> '' AND NOT starts_with(line, '@@') AND NOT starts_with(line, '+++') AND NOT starts_with(line, '-') AS counted
  FROM file_lines WINDOW w AS (PARTITION BY doc_id, path ORDER BY pos)),
numbered_lines AS (
  SELECT *, CASE WHEN counted AND start IS NOT NULL THEN
    start + sum(CASE WHEN counted THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, path, hunk ORDER BY pos) - 1 END AS num
  FROM hunk_lines)"""

# --- findings and comments are line items


def _repo_of_supplier() -> Column:
    return F.concat(F.lit("r"), F.pmod(F.col("l_suppkey"), F.lit(5))).alias("repo_id")


FOUND = (
    "Possible hardcoded password",
    "Use of weak MD5 hash for security",
    "subprocess call with shell enabled",
    "Standard random generators are not suitable for tokens",
    "Starting a process with a partial path",
)
SAID = (
    "Move the hard-coded secret to the vault",
    "Rename this variable",
    "Prefer another hash than md5 here",
    "The shell is not needed for this subprocess",
    "Split this long function",
    "Process path is partial",
    "Tokens need a better generator",
)


def _picked(texts: tuple[str, ...], key: str) -> Column:
    """One of the texts by a number, and the order it is about."""
    chosen = F.get(F.array(*[F.lit(x) for x in texts]), (F.col(key) % len(texts)).cast("int"))
    return F.concat(chosen, F.lit(", order "), "l_orderkey")


def raw_findings(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_partkey").cast("int")
    suffix = F.when(_hundredths("l_tax") > 7, ".ts").otherwise(".py")
    dot = F.when(F.col("l_linestatus") == "O", "./").otherwise("")
    level = F.when(F.col("l_returnflag") == "A", "LOW").when(F.col("l_returnflag") == "N", "MEDIUM").otherwise("HIGH")
    return t(spark, d, "lineitem").select(
        _repo_of_supplier(),
        F.col("l_suppkey").alias("pull_request_id"),
        F.concat(dot, F.lit("src/m"), "l_linenumber", suffix).alias("filename"),
        line.alias("line_number"),
        F.when(F.col("l_quantity") > 25, F.array(line - 2, line, line - 1)).alias("line_range"),
        level.alias("issue_severity"),
        F.concat(F.lit("B10"), "l_linenumber").alias("test_id"),
        _picked(FOUND, "l_linenumber").alias("issue_text"),
    )


FINDINGS = f"""findings AS (
  SELECT l_suppkey AS pull_request_id,
    'src/m' || l_linenumber || (CASE WHEN round(l_tax * 100) > 7 THEN '.ts' ELSE '.py' END) AS file_path,
    l_partkey::INTEGER AS line, CASE WHEN l_quantity > 25 THEN (l_partkey - 2)::INTEGER END AS start_line,
    CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'medium' ELSE 'high' END AS severity,
    'B10' || l_linenumber AS rule_id, ({list(FOUND)})[l_linenumber % {len(FOUND)} + 1] || ', order ' || l_orderkey AS description
  FROM lineitem)"""


def changed(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(
        _repo_of_supplier(),
        F.col("l_suppkey").alias("pull_request_id"),
        F.concat(F.lit("src/m"), "l_linenumber", F.lit(".py")).alias("file"),
        (F.col("l_partkey").cast("int") + _hundredths("l_discount")).alias("line"),
    )


CHANGED = """changed AS (
  SELECT DISTINCT l_suppkey AS pull_request_id, 'src/m' || l_linenumber || '.py' AS file,
    (l_partkey + round(l_discount * 100))::INTEGER AS line
  FROM lineitem)"""


def review_comments(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in COMMENT_LABELS])
    end = F.col("l_partkey").cast("int") + _hundredths("l_tax")
    return t(spark, d, "lineitem").select(
        _repo_of_supplier(),
        F.col("l_suppkey").alias("pull_request_id"),
        F.concat(F.lit("src/m"), "l_linenumber", F.lit(".py")).alias("file"),
        end.alias("line"),
        F.when(F.col("l_quantity") < 40, F.col("l_partkey").cast("int")).alias("start_line"),
        _picked(SAID, "l_orderkey").alias("content"),
        F.coalesce(F.get(labels, _hundredths("l_discount")), F.lit("todo")).alias("label"),
    )


COMMENTS = f"""comments AS (
  SELECT l_suppkey AS pull_request_id, 'src/m' || l_linenumber || '.py' AS file,
    (l_partkey + round(l_tax * 100))::INTEGER AS line,
    CASE WHEN l_quantity < 40 THEN l_partkey::INTEGER END AS start_line,
    ({list(SAID)})[l_orderkey % {len(SAID)} + 1] || ', order ' || l_orderkey AS content,
    coalesce(({list(COMMENT_LABELS)})[round(l_discount * 100)::INTEGER + 1], 'todo') AS label
  FROM lineitem)"""


def review_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each change; small quantities name files nobody comments on."""
    folder = F.when(F.col("l_quantity") >= 49, "src/m").otherwise("docs/m")
    return t(spark, d, "lineitem").select(
        _repo_of_supplier(),
        F.col("l_suppkey").alias("pull_request_id"),
        F.concat(folder, "l_linenumber", F.lit(".py")).alias("filename"),
    )


FILES = """files AS (
  SELECT DISTINCT l_suppkey AS pull_request_id,
    CASE WHEN l_quantity >= 49 THEN 'src/m' ELSE 'docs/m' END || l_linenumber || '.py' AS file
  FROM lineitem)"""

# --- users are customers, requests are orders, model calls are line items


def users(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat("c_mktsegment", F.lit(" "), "c_nationkey").alias("name"),
        F.concat(F.lit("https://img.test/"), "c_custkey").alias("avatar_url"),
        F.lit(None).cast("string").alias("email"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def usage_logs(spark: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("o_orderstatus") == "O", "blame").when(F.col("o_orderstatus") == "F", "code_review")
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        command.otherwise("unknown").alias("command_name"),
        F.concat(F.lit("https://tracker.test/c/"), "o_orderkey").alias("comment_url"),
        F.col("o_orderpriority").alias("comment_text"),
        F.col("o_orderdate").alias("created_at"),
    )


LOGS = """logs AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
    CASE o_orderstatus WHEN 'O' THEN 'blame' WHEN 'F' THEN 'code_review' ELSE 'unknown' END AS command_name,
    'https://tracker.test/c/' || o_orderkey AS comment_url, o_orderpriority AS comment_text, o_orderdate AS created_at
  FROM orders)"""


def model_calls(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("l_returnflag") == "A", "gpt-5-2025-08-07").when(F.col("l_returnflag") == "N", "gpt-5-mini-2025-08-07")
    thought = F.when(F.col("l_linestatus") == "O", (_hundredths("l_tax") * 10).cast("bigint"))
    return t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("usage_log_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        model.otherwise("house-model").alias("llm_model"),
        F.col("l_shipdate").alias("created_at"),
        F.struct(
            F.floor("l_extendedprice").alias("input_tokens"),
            F.floor("l_quantity").alias("output_tokens"),
            F.struct(thought.alias("reasoning")).alias("output_token_details"),
        ).alias("usage_metadata"),
    )


CALLS = """priced AS (
  SELECT * FROM (VALUES ('gpt-5-2025-08-07', 1.25::DOUBLE, 10::DOUBLE, 10::DOUBLE),
    ('gpt-5-mini-2025-08-07', 0.25::DOUBLE, 2::DOUBLE, 2::DOUBLE),
    ('gpt-5-nano-2025-08-07', 0.05::DOUBLE, 0.4::DOUBLE, 0.4::DOUBLE)) AS p(model, pin, pout, pthink)),
tokens AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, floor(l_extendedprice)::BIGINT AS tin,
    floor(l_quantity)::BIGINT AS tout,
    CASE WHEN l_linestatus = 'O' THEN (round(l_tax * 100) * 10)::BIGINT ELSE 0 END AS think,
    CASE l_returnflag WHEN 'A' THEN 'gpt-5-2025-08-07' WHEN 'N' THEN 'gpt-5-mini-2025-08-07' ELSE 'house-model' END AS model
  FROM lineitem),
calls AS (
  SELECT l_orderkey AS usage_log_id, l_linenumber AS line_number, l_partkey AS part, l_suppkey AS supplier,
    model AS llm_model, l_shipdate AS created_at,
    trunc(tin * ((pin / 1000000) / (pout / 1000000)))::BIGINT + tout + think AS tokens_used,
    greatest(1, trunc((tin * (pin / 1000000) + tout * (pout / 1000000) + think * (pthink / 1000000)) * 1000)::BIGINT)
      AS cost_usd_thousandths
  FROM tokens JOIN priced USING (model))"""

# --- blockers and merged changes are orders


def blockers(spark: SparkSession, d: str) -> DataFrame:
    number = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return t(spark, d, "orders").select(
        number.cast("bigint").alias("deploy_number"),
        F.concat(F.lit("https://tracker.test/d/"), number.cast("string")).alias("deploy_url"),
        F.col("o_orderdate").alias("created_at"),
    )


BLOCKERS = """blockers AS (
  SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS deploy_number,
    'https://tracker.test/d/' || date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS deploy_url,
    o_orderdate AS created_at
  FROM orders)"""


# --- comment events are conversation turns


def comment_events(spark: SparkSession, d: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    body = (
        F.when(role == "user", F.concat("text", F.lit(f" {USER_TAG} Which PR is the culprit? AGAIN")))
        .when(role == "assistant", F.concat(F.lit(f"{USER_TAG.upper()} please review full "), "text"))
        .otherwise(F.col("text"))
    )
    payload = F.struct(
        F.when(turn == 2, "deleted").when(turn == 1, "edited").otherwise("created").alias("action"),
        F.struct(
            body.alias("body"),
            F.concat_ws("/", F.lit("https://tracker.test/c"), "conv_id", "turn").alias("url"),
            F.struct(
                F.when(turn == 3, "Bot").otherwise("User").alias("type"),
                F.concat(F.lit("User"), "conv_id", F.when(turn == 5, "[bot]").otherwise("")).alias("login"),
                F.when(turn == 0, "").otherwise("A Name").alias("name"),
            ).alias("user"),
        ).alias("comment"),
        F.struct(F.when(F.col("conv_id") != 7, 5).alias("id")).alias("installation"),
        F.struct(F.lit(42).alias("id")).alias("repository"),
        F.when(
            turn != 6,
            F.struct(
                F.col("conv_id").alias("number"),
                F.when(role == "assistant", F.struct(F.lit("x").alias("url"))).alias("pull_request"),
            ),
        ).alias("issue"),
    )
    text = F.to_json(payload)
    return t(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.when(role == "system", "push").otherwise("issue_comment").alias("event_type"),
        F.when(turn == 4, F.regexp_replace(text, r"\}\z", "")).otherwise(text).alias("body"),
    )


EVENT_REASON = f"""events_in AS (
  SELECT *, CASE role WHEN 'user' THEN text || ' {USER_TAG} Which PR is the culprit? AGAIN'
      WHEN 'assistant' THEN '{USER_TAG.upper()} please review full ' || text ELSE text END AS comment_text,
    CASE WHEN turn = 4 THEN 'Invalid JSON payload' WHEN role = 'system' THEN 'Unsupported event type'
      WHEN turn = 2 THEN 'Not a comment action'
      WHEN role NOT IN ('user', 'assistant') THEN 'No {USER_TAG} mention'
      WHEN conv_id = 7 THEN 'No installation ID found'
      WHEN turn = 6 THEN 'No issue or pull request found' END AS reject_reason
  FROM conversations)"""
