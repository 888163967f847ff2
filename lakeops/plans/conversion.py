"""Study conversion: resolve what is asked for, convert it, report what went wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.studies import REPORT_COLUMNS
from lakeops.operators.ordering import first_appearance, with_ordinals
from lakeops.operators.studies import (
    CONVERT_SECONDS, Cleaner, Converter, check_selection, classify_studies, convert_studies, match_studies, missing_studies, objects_of_studies,
    problem_report, report_only, split_existing, status_summary,
)
from lakeops.session import durable
from lakeops.sources.files import read_cohort

_CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_report(report: DataFrame, path: str) -> None:
    """The problem report as CSV; a header is written even when nothing went wrong.

    Use a path of its own for each attempt (``report_path``): a rerun skips what was converted before, so its report
    covers fewer studies and must not replace the earlier one.
    """
    report.write.mode("errorifexists").options(**_CSV, emptyValue="").csv(path)


def report_path(base: str, attempt: str) -> str:
    """Where one attempt of a run leaves its report."""
    return f"{base.rstrip('/')}/{attempt}_conversion_report.csv"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in REPORT_COLUMNS)
    return spark.read.schema(schema).options(**_CSV).csv(path).fillna("")


def resolve_studies(objects: DataFrame, patterns: DataFrame, verify: bool = False) -> tuple[DataFrame, DataFrame]:
    """Studies to act on, in order of first appearance, and what resolved to nothing.

    With ``verify`` a study that holds no object is taken out; that nothing at all is left is an error.
    """
    resolved = durable(match_studies(objects, patterns))
    missing = missing_studies(patterns, resolved, objects)
    if verify:
        present = split_existing(resolved.select("study").distinct(), objects).where("present").select("study")
        resolved = resolved.join(present, "study", "left_semi")
    else:
        missing = missing.where("reason = 'unmatched'")
    studies = first_appearance(resolved, "study", "ordinal")
    if studies.isEmpty():
        raise LookupError("nothing to act on: no pattern led to a study")
    return studies, missing


def convert(
    spark: SparkSession, studies: DataFrame, objects: DataFrame, outputs: DataFrame,
    make_converter: Callable[[], Converter], report_path: str, skip_existing: bool = True,
    make_cleaner: Callable[[], Cleaner] | None = None, limit_seconds: float | None = CONVERT_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """Convert studies, write the problem report, return outcomes and the count per status.

    ``objects`` has ``study`` and ``key``; ``outputs`` lists the studies that already have output.
    The outcomes are materialized once, since conversion is the costly part.
    """
    known = report_only(objects, "study", "key")
    done = outputs.select("study").distinct().withColumn("output_exists", F.lit(True))
    facts = (
        studies.select("study").join(known, "study", "left").join(done, "study", "left")
        .fillna(0, ["n_objects"]).fillna(False, ["report_only", "output_exists"])
    )
    outcomes = durable(classify_studies(convert_studies(facts, make_converter, skip_existing, make_cleaner=make_cleaner, limit_seconds=limit_seconds), skip_existing))
    write_report(problem_report(outcomes), report_path)
    return outcomes, status_summary(outcomes)


def selected_patterns(
    spark: SparkSession, paths: list[str] | None, cohort_bucket: str | None, cohort_key: str | None, parent: str,
    accession: str = "accessionNumber", exam: str = "examDate",
) -> DataFrame:
    """``(ordinal, pattern)`` from a list of paths or from a cohort file. Cohort rows with a date that is not
    one are an error that counts them."""
    check_selection(paths, cohort_bucket, cohort_key)
    if paths:
        return spark.createDataFrame(list(enumerate(paths)), "ordinal bigint, pattern string")
    rows = durable(read_cohort(spark, f"{cohort_bucket.rstrip('/')}/{cohort_key.lstrip('/')}", accession, exam, parent))
    rejected = rows.where("reject_reason IS NOT NULL").count()
    if rejected:
        raise ValueError(f"{rejected} rows of the cohort file have no usable exam date")
    return with_ordinals(rows.select("pattern"), [F.col("pattern")]).select("ordinal", "pattern")


def run_study_job(
    spark: SparkSession, objects: DataFrame, outputs: DataFrame, make_converter: Callable[[], Converter], report_path: str,
    parent: str, paths: list[str] | None = None, cohort_bucket: str | None = None, cohort_key: str | None = None,
    verify: bool = False, skip_existing: bool = True, make_cleaner: Callable[[], Cleaner] | None = None,
    limit_seconds: float | None = CONVERT_SECONDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Select, resolve, convert and report: outcomes, the count per status, and what resolved to nothing."""
    patterns = selected_patterns(spark, paths, cohort_bucket, cohort_key, parent)
    studies, missing = resolve_studies(objects, patterns, verify)
    studies = durable(studies)
    held = objects_of_studies(objects, studies)
    outcomes, counts = convert(spark, studies, held, outputs, make_converter, report_path, skip_existing, make_cleaner, limit_seconds)
    return outcomes, counts, missing
