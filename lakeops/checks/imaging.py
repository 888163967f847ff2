"""Study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, staged, table
from lakeops.functions.studies import (
    exam_date, exam_date_problem, remap_study, scrub_log, study_accession, study_exam_date, study_path,
)
from lakeops.functions.objects import inflate
from lakeops.operators.studies import (
    classify_studies, match_studies, missing_studies, objects_of_studies, problem_report, report_only, split_existing,
    status_summary, top_missing,
)
from lakeops.plans.conversion import convert, resolve_studies
from lakeops.session import durable, scratch_dir
from lakeops.sinks.tree import write_files
from lakeops.sources.files import read_cohort, read_objects

_FACTS = ("study_orders", "objects", "object_facts", "logs", "scrubbed", "facts")
_RESOLVED = ("study_orders", "objects", "patterns", "resolved")

_COHORT = r"""
    SELECT 'RA' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS accession, o_orderdate, o_orderkey,
           CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 11 = 0 THEN NULL
                WHEN o_orderkey % 5 = 0 THEN ' ' || year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) || ' '
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS exam_date_text
    FROM orders
"""


def study_facts(spark, sf):
    path = staged(spark, sf, "facts", lambda p: fx.study_facts(spark, sf).write.parquet(p))
    facts = spark.read.parquet(path)
    return facts.withColumn("log", scrub_log(F.col("raw_log"), F.lit(fx.WORK_DIR))).drop("raw_log")


@query("s7_read_cohort", f"""
    SELECT accession, exam_date_text,
           CASE WHEN o_orderkey % 7 = 0 THEN 'not a Y-M-D date: ' || exam_date_text END AS reject_reason,
           CASE WHEN o_orderkey % 7 <> 0 THEN 'dicoms/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || accession END AS pattern
    FROM ({_COHORT}) WHERE exam_date_text IS NOT NULL
""")
def s7_read_cohort(spark, sf):
    return read_cohort(spark, fx.cohort_file(spark, sf), "accessionNumber", "examDate", fx.PARENT)


@query("s8_object_listing", "SELECT key, n_bytes, error FROM image_objects", ("image_objects",))
def s8_object_listing(spark, sf):
    """Objects are written to storage, listed and opened; plain ones are read as they are."""
    def write(path):
        write_files(fx.image_objects(spark, sf), path).write.format("noop").mode("overwrite").save()

    root = staged(spark, sf, "image-objects", write)
    found = read_objects(spark, root)
    # A plain object is taken as it is, so the marker is tested here as it is for inflated ones.
    valid = F.substring("content", 129, 4) == F.lit(b"DICM")
    return found.select(
        "key", F.when(valid, F.length("content")).cast("bigint").alias("n_bytes"),
        F.when(F.coalesce(valid, F.lit(False)), F.col("error")).otherwise("no DICM marker after inflating").alias("error"),
    )


@query("u2_inflate_objects", """
    SELECT page_id, CASE WHEN page_id % 10 <> 3 THEN 132 + octet_length(encode(html)) END AS n_bytes,
           CASE WHEN page_id % 10 <> 3 THEN md5(html) END AS digest,
           CASE WHEN page_id % 10 = 3 THEN 'no DICM marker after inflating' END AS error
    FROM pages
""")
def u2_inflate_objects(spark, sf):
    html = F.encode("html", "UTF-8")
    inner = F.when(F.col("page_id") % 10 == 3, html).otherwise(F.concat(F.lit(bytes(128) + b"DICM"), html))
    packed = table(spark, sf, "pages").select("page_id", fx._pack(inner).alias("blob"))
    opened = packed.select("page_id", inflate("blob").alias("o"))
    return opened.select(
        "page_id", F.length("o.content").cast("bigint").alias("n_bytes"),
        F.md5(F.expr("substring(o.content, 133)")).alias("digest"), F.col("o.error").alias("error"),
    )


@query("p7_exam_date", f"""
    SELECT accession, exam_date_text,
           CASE WHEN o_orderkey % 7 <> 0 AND exam_date_text IS NOT NULL THEN strftime(o_orderdate, '%Y-%m-%d') END AS exam_date,
           CASE WHEN o_orderkey % 7 = 0 OR exam_date_text IS NULL
                THEN 'not a Y-M-D date: ' || coalesce(exam_date_text, '') END AS reject_reason
    FROM ({_COHORT})
""")
def p7_exam_date(spark, sf):
    keep = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows = spark.read.options(**keep).csv(fx.cohort_file(spark, sf))
    text = F.col("examDate")
    return rows.select(
        F.col("accessionNumber").alias("accession"), text.alias("exam_date_text"),
        F.date_format(exam_date(text), "yyyy-MM-dd").alias("exam_date"), exam_date_problem(text).alias("reject_reason"),
    )


@query("p8_study_path", """
    SELECT study, 'nifti/' || substr(study, 8) AS output_path, split_part(study, '/', 5) AS accession,
           strftime(o_orderdate, '%Y-%m-%d') AS exam_date, '' AS short_date
    FROM study_orders
""", ("study_orders",))
def p8_study_path(spark, sf):
    name = F.concat(F.lit("RA"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    study = study_path(F.lit(fx.PARENT), F.col("o_orderdate"), name)
    rows = table(spark, sf, "orders").select(study.alias("study"))
    study = F.col("study")
    return rows.select(
        "study", remap_study(study, F.lit("nifti")).alias("output_path"), study_accession(study).alias("accession"),
        study_exam_date(study).alias("exam_date"), study_exam_date(F.substring_index(study, "/", 4)).alias("short_date"),
    )


@query("p9_scrub_log", "SELECT study, log FROM scrubbed", ("study_orders", "logs", "scrubbed"))
def p9_scrub_log(spark, sf):
    rows = fx.study_orders(spark, sf).select("study", fx.study_log().alias("raw"))
    return rows.select("study", scrub_log(F.col("raw"), F.lit(fx.WORK_DIR)).alias("log"))


@query("p10_report_only", """
    SELECT s.study, coalesce(n_objects, 0) AS n_objects, coalesce(report_only, false) AS report_only
    FROM study_orders s LEFT JOIN object_facts USING (o_orderkey)
""", ("study_orders", "objects", "object_facts"))
def p10_report_only(spark, sf):
    known = report_only(fx.stored_objects(spark, sf), "study", "key")
    joined = fx.study_orders(spark, sf).select("study").join(known, "study", "left")
    return joined.fillna(0, ["n_objects"]).fillna(False, ["report_only"])


@query("p11_study_status", "SELECT * FROM study_outcomes", (*_FACTS, "statuses", "study_outcomes"))
def p11_study_status(spark, sf):
    return classify_studies(study_facts(spark, sf))


@query("x1_problem_report", """
    SELECT split_part(study, '/', 5) AS accession, replace(substr(study, 8, 10), '/', '-') AS exam_date, study AS path, status,
           coalesce(CAST(exit_code AS VARCHAR), '') AS exit_code, CASE WHEN uploaded THEN 'yes' ELSE 'no' END AS uploaded,
           CAST(files_converted AS VARCHAR) AS files_converted, output
    FROM study_outcomes WHERE status IN ('partial', 'report only', 'missing', 'failed')
""", (*_FACTS, "statuses", "study_outcomes"))
def x1_problem_report(spark, sf):
    """The report goes through its file, whose cells span lines."""
    from lakeops.plans.conversion import read_report, write_report

    path = scratch_dir(spark, "conversion-report")
    write_report(problem_report(classify_studies(study_facts(spark, sf))), path)
    return read_report(spark, path)


@query("g1_status_summary", """
    SELECT CAST(position AS BIGINT) AS position, s.status, count(o.study) AS n
    FROM (VALUES (0, 'ok'), (1, 'partial'), (2, 'report only'), (3, 'skipped'), (4, 'missing'), (5, 'failed')) s(position, status)
    LEFT JOIN study_outcomes o ON o.status = s.status GROUP BY ALL
""", (*_FACTS, "statuses", "study_outcomes"))
def g1_status_summary(spark, sf):
    return status_summary(classify_studies(study_facts(spark, sf)))


def line_converter():
    """Stand-in converter: exit code from the study number; some studies make it raise."""
    def convert(study):
        number = int(study["study"].rsplit("/RA", 1)[1])
        if number % 40 == 3:
            raise ValueError(f"unreadable study {number}")
        rc = {0: 2, 1: 8, 2: 1}.get(number % 8, 0)
        return {"rc": rc, "output_files": 0 if number % 50 == 0 else int(study["n_objects"]), "log": f"rc {rc}"}

    return convert


@query("u3_convert_studies", """
    SELECT study, CASE WHEN output_exists THEN 'skipped' WHEN n_objects = 0 THEN 'missing' WHEN o_orderkey % 40 = 3 THEN 'failed'
                       WHEN rc = 2 AND report_only THEN 'report only' WHEN rc NOT IN (0, 8) THEN 'failed'
                       WHEN output_files = 0 THEN 'failed' WHEN rc = 8 THEN 'partial' ELSE 'ok' END AS status,
           CASE WHEN status IN ('ok', 'partial', 'report only') THEN rc END AS exit_code,
           CASE WHEN status IN ('ok', 'partial') THEN output_files ELSE 0 END AS files_converted,
           status IN ('ok', 'partial') AS uploaded,
           CASE WHEN status IN ('partial', 'report only') THEN 'rc ' || rc
                WHEN status = 'failed' AND o_orderkey % 40 = 3 THEN 'ValueError: unreadable study ' || o_orderkey
                WHEN status = 'failed' AND rc = 2 THEN 'no images converted although some series are images (exit code 2): rc 2'
                WHEN status = 'failed' AND rc NOT IN (0, 8) THEN 'converter gave up (exit code ' || rc || '): rc ' || rc
                WHEN status = 'failed' THEN 'converter wrote no file (exit code ' || rc || '): rc ' || rc ELSE '' END AS output
    FROM facts
""", _FACTS)
def u3_convert_studies(spark, sf):
    """The whole job: studies met with their stored objects and earlier outputs, converted and reported."""
    studies = fx.study_orders(spark, sf)
    outputs = studies.where("o_orderkey % 10 = 9").select("study")
    held = objects_of_studies(fx.stored_objects(spark, sf), studies)
    outcomes, _ = convert(spark, studies.select("study"), held, outputs, line_converter, scratch_dir(spark, "conversion-report"))
    return outcomes


@query("j7_pattern_match", "SELECT ordinal, pattern, study FROM resolved", _RESOLVED)
def j7_pattern_match(spark, sf):
    return match_studies(fx.stored_objects(spark, sf), fx.patterns(spark))


@query("j8_existence", """
    SELECT s.study, f.study IS NOT NULL AS present
    FROM study_orders s LEFT JOIN (SELECT DISTINCT study FROM objects) f ON f.study = s.study
""", ("study_orders", "objects"))
def j8_existence(spark, sf):
    return split_existing(fx.study_orders(spark, sf).select("study"), fx.stored_objects(spark, sf))


@query("w1_first_appearance", """
    SELECT study, ordinal, row_number() OVER (ORDER BY ordinal, study) - 1 AS position
    FROM (SELECT study, min(ordinal) AS ordinal FROM resolved GROUP BY study)
""", _RESOLVED)
def w1_first_appearance(spark, sf):
    """As the job resolves them; a study that is named exactly stands for itself, stored or not."""
    studies, _ = resolve_studies(fx.stored_objects(spark, sf), fx.patterns(spark))
    return studies


@query("so3_missing", "SELECT * FROM study_missing", (*_RESOLVED, "study_missing"))
def so3_missing(spark, sf):
    objects, wanted = fx.stored_objects(spark, sf), fx.patterns(spark)
    return missing_studies(wanted, durable(match_studies(objects, wanted)), objects)


@query("o1_top_missing", """
    SELECT pattern AS item, 'unmatched' AS reason, (SELECT count(*) FROM asked WHERE nothing) AS n_missing,
           (SELECT count(*) FROM asked) AS n_patterns
    FROM asked WHERE nothing ORDER BY ordinal LIMIT 20
""", ("study_orders", "objects", "object_facts", "asked"))
def o1_top_missing(spark, sf):
    """Every order is asked for by a wildcard of its own; those without objects stay unmatched."""
    objects = fx.stored_objects(spark, sf)
    wanted = fx.study_orders(spark, sf).select(F.col("o_orderkey").alias("ordinal"), F.concat("study", F.lit("*")).alias("pattern"))
    missing = durable(missing_studies(wanted, durable(match_studies(objects, wanted)), objects))
    return top_missing(missing, wanted)
