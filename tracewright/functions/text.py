"""Fields cut out of free-text bodies, comments and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.core import (
    SPACE,
    bind,
    blank_to_null,
    capture,
    first_filled,
    fixed,
    split_lines,
    strip,
    words,
)
from tracewright.schemas import SIGNATURE, USER_TAG

# Headings and patterns of the body templates.
TEST_SECTION = r"(?isu)(### Tests.*?)### PR Author Checklist"
EXPLANATION_SECTION = r"(?isu)### Explanation of Change(.*?)### Fixed Issues"
STEPS_SECTION = (
    rf"(?isu)(##{SPACE}*Action{SPACE}*Performed:{SPACE}*.*?"
    rf"##{SPACE}*Expected{SPACE}*Result:{SPACE}*.*?"
    rf"##{SPACE}*Actual{SPACE}*Result:{SPACE}*.*?)##{SPACE}*Workaround:"
)
CHECKBOX = rf"- \[[ xX]\]{SPACE}*"
HTML_COMMENT = r"(?s)<!--.*?-->"
MERGE_COMMIT = r"\AMerge pull request #([0-9]+)"
RERUN_WORDS = ("again", "full", "complete")
BLAME_WORDS = r"(?i)\b(?:culprit|which pr|find pr|cause)"
REVIEW_WORDS = r"(?i)\b(?:review|feedback|analyze pr)"
# Wordings of one security concern; each counts as the same word when remarks are compared.
CONCERNS = {
    "credentials": r"hard[- ]?cod\w*|passw\w*|passphrases?|secrets?|credentials?|api[- ]?keys?",
    "hashing": r"md5|sha-?1|hash\w*",
    "shell": r"shell\w*|subprocess\w*|popen",
    "sql": r"sql\w*|query|queries",
    "randomness": r"random\w*|prng",
    "transport": r"tls|ssl|certificates?|verify",
    "parsing": r"pickle\w*|deseriali[sz]\w*|yaml|xml",
    "evaluation": r"eval|exec",
    "temporary": r"temp|temporary|tmp|mktemp",
    "assertion": r"assert\w*",
}
COMMON_WORDS = ("the", "and", "for", "this", "that", "with", "not", "are", "use", "should", "possible", "here", "from", "into", "when")
NO_TESTS = "No test steps provided."
NO_FILES = "No files listed."
NO_SUMMARY = "No code diff summary provided."
NO_EXPLANATION = "No explanation provided."


def _tidy(section: Column) -> Column:
    without_comments = F.regexp_replace(section, HTML_COMMENT, "")
    return strip(F.regexp_replace(without_comments, r"\n{3,}", "\n\n"))


def test_steps(body: Column) -> Column:
    """The test section of a change description, without boxes and hidden comments; '' if there is none."""
    section = strip(F.regexp_extract(body, TEST_SECTION, 1))
    unix = F.regexp_replace(section, r"\r\n?", "\n")
    return _tidy(F.regexp_replace(unix, CHECKBOX, ""))


def explanation(body: Column) -> Column:
    return _tidy(strip(F.regexp_extract(body, EXPLANATION_SECTION, 1)))


def reproduction_steps(body: Column) -> Column:
    return strip(F.regexp_extract(body, STEPS_SECTION, 1))


def java_quote(text: str) -> str:
    """A literal as a regular expression that Java reads the same way."""
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def linked_issue_ids(body: Column, repo_name: str) -> Column:
    """Issue numbers after a ``$``: bare, as an address, or as a link; null when there are none."""
    issues = rf"https://[^\s]*/{java_quote(repo_name)}/issues/[0-9]+"
    pattern = rf"\${SPACE}*(?:#[0-9]+|{issues}|\[#[0-9]+\]\({issues}\))"
    found = F.regexp_extract_all(body, F.lit(pattern), 0)
    number = lambda m: F.coalesce(
        capture(m, rf"\A\${SPACE}*\[#([0-9]+)\]"), F.regexp_extract(m, r"([0-9]+)\z", 1)
    ).try_cast("bigint")
    return bind(F.transform(found, number), lambda ids: F.when(F.size(ids) > 0, ids))


def merged_pull_request(message: Column) -> Column:
    """The number in a merge commit's subject; reverts of merges do not count."""
    return capture(message, MERGE_COMMIT).try_cast("bigint")


def mention_context(body: Column, tag: str = USER_TAG) -> Column:
    """Words around the first mention (10 before it, 20 from it on), or the first 50 without one."""

    def window(all_words: Column) -> Column:
        hits = F.transform(all_words, lambda w: F.contains(F.lower(w), F.lit(tag.lower())))
        at = F.array_position(hits, True).cast("int")
        start = F.greatest(at - 11, F.lit(0))
        around = F.slice(all_words, start + 1, at + 19 - start)
        return F.when(at > 0, around).otherwise(F.slice(all_words, 1, 50))

    return F.array_join(bind(words(body), window), " ")


def wants_rerun(body: Column) -> Column:
    return F.arrays_overlap(words(F.lower(body)), F.array(*[F.lit(w) for w in RERUN_WORDS]))


def classify_command(body: Column, subject: Column, tag: str = USER_TAG) -> Column:
    """Command named by the keywords near the mention; the subject decides when both kinds occur."""
    plain = F.replace(F.lower(mention_context(body, tag)), F.lit(tag.lower()), F.lit(" "))

    def decide(text: Column) -> Column:
        blame, review = text.rlike(BLAME_WORDS), text.rlike(REVIEW_WORDS)
        return (
            F.when(blame & review, F.when(subject == "PullRequest", "code_review").otherwise("blame"))
            .when(blame, "blame")
            .when(review, "code_review")
            .otherwise("unknown")
        )

    return bind(plain, decide)


def concern_words(remark: Column) -> Column:
    """What a review remark is about: its different words, without common ones, wordings of one concern as one word.

    The severity before and the rule behind a scanner's remark are left out.
    """
    bare = F.regexp_replace(F.regexp_replace(remark, r"^[A-Z]+: ", ""), r" \(Rule: [^)]*\)$", "")
    plain = F.lower(F.coalesce(bare, F.lit("")))
    for name, wordings in CONCERNS.items():
        plain = F.regexp_replace(plain, rf"\b(?:{wordings})\b", f" is_{name} ")
    found = F.regexp_extract_all(plain, F.lit(r"[a-z0-9_]{3,}"), 0)
    return F.array_except(found, F.array(*[F.lit(w) for w in COMMON_WORDS]))


def mentions(body: Column, tag: str = USER_TAG) -> Column:
    return F.contains(F.lower(body), F.lit(tag.lower()))


def is_bot(user_type: Column, login: Column) -> Column:
    kind, name = F.coalesce(F.lower(user_type), F.lit("")), F.coalesce(F.lower(login), F.lit(""))
    return (kind == "bot") | F.endswith(name, F.lit("[bot]"))


def signed_by_us(body: Column, signature: str = SIGNATURE) -> Column:
    return F.contains(body, F.lit(signature))


def blockquote(text: Column) -> Column:
    return F.array_join(F.transform(split_lines(strip(text)), lambda line: F.concat(F.lit("> "), line)), "\n")


def safe_path_name(name: Column) -> Column:
    """A path component of plain characters, at most 100 long; null for an empty name."""
    plain = F.regexp_replace(name, r"[^a-zA-Z0-9\-_.]", "-")
    no_parent = F.regexp_replace(F.regexp_replace(plain, r"\.\.", "-"), r"\A\.+", "")
    risky = F.contains(plain, F.lit("..")) | F.startswith(plain, F.lit("."))
    return F.when(plain != "", F.substring(F.when(risky, no_parent).otherwise(plain), 1, 100))


# Characters that Python's repr never prints as they are.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def _escaped_char(ch: Column) -> Column:
    code = F.ascii(ch)
    digits = F.lower(F.hex(code))
    escape = (
        F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )
    return F.when(ch.rlike(UNPRINTABLE), escape).otherwise(ch)


def py_repr(text: Column) -> Column:
    """A string as Python's ``repr`` shows it."""
    named = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        named = F.replace(named, F.lit(raw), F.lit(shown))

    def finish(s: Column) -> Column:
        by_char = F.array_join(F.transform(F.split(s, ""), _escaped_char), "")
        shown = F.when(s.rlike(UNPRINTABLE), by_char).otherwise(s)
        double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(double, F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(single)

    return bind(named, finish)


def py_list_repr(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, py_repr), ", "), F.lit("]"))


def pull_request_embedding_text(
    title: Column, test: Column, explained: Column, files: Column, summary: Column
) -> Column:
    return F.concat(
        F.lit("Title: "), title,
        F.lit("\n Tests: "), test,
        F.lit("\n Explanation: "), explained,
        F.lit("\n Files changed: "), py_list_repr(files),
        F.lit("\n Code diff summary: "), summary,
    )


def issue_embedding_text(title: Column, steps: Column) -> Column:
    return F.concat(title, F.lit("\n "), steps)


def candidate_card(
    pr_id: Column, title: Column, test: Column, files: Column, summary: Column, score: Column, explained: Column
) -> Column:
    """One ranked candidate as the text block shown to whoever judges it."""
    stripped = lambda text, default: F.coalesce(strip(blank_to_null(text)), F.lit(default))
    listed = F.when(F.size(files) > 0, F.array_join(files, ", ")).otherwise(NO_FILES)
    return F.concat(
        F.lit("PR id #"), pr_id.cast("string"),
        F.lit("\n\nTitle: "), title,
        F.lit("\n\nTest Steps: "), stripped(test, NO_TESTS),
        F.lit("\n\nFiles Changed: "), listed,
        F.lit("\n\nCode diff summary: "), first_filled(summary, F.lit(NO_SUMMARY)),
        F.lit("\n\nScore: "), fixed(score, 2),
        F.lit("\n\nExplanation: "), stripped(explained, NO_EXPLANATION),
    )


CULPRIT_TITLE = "Possible culprit PRs for this issue"


def culprit_comment(culprits: Column, title: str = CULPRIT_TITLE) -> Column:
    """Markdown of ranked culprits: the first two, then the rest under a second heading; '' for none."""

    def bullet(c: Column, at: Column) -> Column:
        heading = F.when(at == 2, "\n#### If not above, check these\n").otherwise("")
        number = c["pull_request_id"].cast("string")
        return F.concat(heading, F.lit("- #"), number, F.lit(": "), c["reason"], F.lit("\n"))

    body = F.array_join(F.transform(culprits, bullet), "")
    return F.when(F.size(culprits) > 0, F.concat(F.lit(f"### {title}\n"), body)).otherwise("")


def review_body(overview: Column, last_sha: Column, signature: str = SIGNATURE) -> Column:
    """Text of a review; a review since an earlier commit says so first."""
    notice = F.concat(
        F.lit("**This review covers only the changes made since the last review (commit "),
        F.substring(last_sha, 1, 7),
        F.lit("), not the entire PR.**\nUse `full review` to review entire PR\n"),
    )
    said = F.when(F.coalesce(last_sha, F.lit("")) != "", notice).otherwise("")
    return F.concat(said, overview, F.lit(signature))


def diff_heading(filename: Column, status: Column, additions: Column, deletions: Column) -> Column:
    return F.concat(
        F.lit("## File: "), filename,
        F.lit("\nStatus: "), status,
        F.lit("\nChanges: +"), additions.cast("string"), F.lit(" -"), deletions.cast("string"),
        F.lit("\n\n"),
    )
