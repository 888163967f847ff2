"""Study paths, exam dates, tool logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of a series that holds a report rather than images.
REPORT_MARKERS = [
    "sr for hl7", "basic text sr", "structured report", "radiological report",
    "rapport", "dose report", "presentation state",
]

# Statuses of a study, best outcome first, and those worth reporting.
STATUSES = ["ok", "partial", "report only", "skipped", "missing", "failed"]
PROBLEMS = ["partial", "report only", "missing", "failed"]

# Exit codes of the conversion tool.
RC_NO_IMAGES = 2
RC_PARTIAL = 8

# A study folder name, an image file name and a dotted identifier in a log.
STUDY_NAME = r"^[A-Za-z]{2}\d"
IMAGE_FILE = r"[^/\s]+\.dcm(?:\.cmp)?\b"
DOTTED_ID = r"\b\d+(?:\.\d+){4,}\b"

# Fixed value: columns of the problem report.
REPORT_COLUMNS = ["accession", "exam_date", "path", "status", "exit_code", "uploaded", "files_converted", "output"]


def exam_date(c: Column) -> Column:
    """Date of a ``Y-M-D`` text, null for any other notation or an impossible day."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    return F.to_date(F.try_to_timestamp(F.when(shaped, text), F.lit("yyyy-M-d")))


def exam_date_problem(c: Column) -> Column:
    """Reason a date is rejected, null when it is accepted."""
    return F.when(
        exam_date(c).isNull(),
        F.concat(F.lit("not a Y-M-D date: "), F.coalesce(c, F.lit(""))),
    )


def exam_date_strict(c: Column) -> Column:
    """As ``exam_date``, but a rejected value fails the job, with an error that does not repeat it."""
    return F.coalesce(exam_date(c), F.raise_error(F.lit("an exam date is not a Y-M-D date")).cast("date"))


def study_path(parent: Column, day: Column, accession: Column) -> Column:
    return F.concat_ws("/", parent, F.date_format(day, "yyyy/MM/dd"), accession)


def remap_study(study: Column, parent: Column) -> Column:
    """The same study below another parent; a path without a parent fails the job."""
    bare = F.rtrim(study, F.lit("/"))
    rest = F.regexp_extract(bare, "^[^/]*/(.*)$", 1)
    problem = F.concat(F.lit("no parent folder to replace in "), study)
    return F.when(bare.contains("/"), F.concat_ws("/", parent, rest)).otherwise(F.raise_error(problem).cast("string"))


def study_accession(study: Column) -> Column:
    return F.element_at(F.split(F.rtrim(study, F.lit("/")), "/"), -1)


def study_exam_date(study: Column) -> Column:
    """Segments two to four as a date text, empty when the path is too short to hold one."""
    parts = F.split(F.rtrim(study, F.lit("/")), "/")
    return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, 2, 3), "-")).otherwise("")


def is_report_path(path: Column) -> Column:
    lowered = F.lower(path)
    found = F.lit(False)
    for marker in REPORT_MARKERS:
        found = found | lowered.contains(marker)
    return found


def scrub_log(text: Column, work_dir: Column | None = None) -> Column:
    """Shorten a tool log: staging folder gone, image names and dotted ids replaced.

    File names go first, because they contain dotted ids of their own.
    """
    if work_dir is not None:
        folder = F.concat(F.rtrim(work_dir, F.lit("/")), F.lit("/"))
        text = F.when(F.coalesce(work_dir, F.lit("")) == "", text).otherwise(F.replace(text, folder, F.lit("")))
    # A plain search spares most texts the pattern, which backtracks at every character.
    text = F.when(text.contains(".dcm"), F.regexp_replace(text, IMAGE_FILE, "<file>")).otherwise(text)
    return F.regexp_replace(text, DOTTED_ID, "<uid>")


def has_glob(pattern: Column) -> Column:
    """Only ``*`` makes a pattern a wildcard pattern."""
    return pattern.contains("*")


def glob_base(pattern: Column) -> Column:
    """Whole segments before the first one holding ``*``."""
    return F.regexp_extract(F.split_part(pattern, F.lit("*"), F.lit(1)), "^(.*)/[^/]*$", 1)


def glob_stem(pattern: Column) -> Column:
    """Characters every match starts with."""
    return F.regexp_extract(pattern, r"^[^*?\[]*", 0)


def is_prefix_glob(pattern: Column) -> Column:
    """Whether a wildcard pattern is nothing but its stem and a final ``*``."""
    return pattern.rlike(r"^[^*?\[]*\*+\z")


def glob_regex(pattern: Column) -> Column:
    """Regular expression of a wildcard pattern over a whole path.

    ``*`` and ``?`` cross folders, ``[...]`` is a character class and ``[!...]`` its complement.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\*+|\?|\[!?\]?[^\]]*\]|."), F.lit(0))

    def rewrite(token: Column) -> Column:
        negated = token.startswith("[!")
        inner = F.when(negated, F.substr(token, F.lit(3))).otherwise(F.substr(token, F.lit(2)))
        inner = F.regexp_replace(inner, r"\]$", "")
        inner = F.regexp_replace(inner, r"([\\\[\]\^&~|])", r"\\$1")
        group = F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), inner, F.lit("]"))
        return (
            F.when(token.startswith("*"), ".*")
            .when(token == "?", ".")
            .when((F.length(token) > 1) & token.startswith("["), group)
            .otherwise(F.regexp_replace(token, r"([^A-Za-z0-9_/\s])", r"\\$1"))
        )

    general = F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, rewrite), ""), F.lit(r"\z"))
    # Almost every pattern only has stars: quote what lies between them.
    quoted = F.concat(F.lit(r"(?s)^\Q"), F.replace(pattern, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E\z"))
    return F.when(pattern.rlike(r"[?\[\\]"), general).otherwise(quoted)
