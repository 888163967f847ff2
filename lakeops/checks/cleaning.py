"""Cleaning and anonymization queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, table
from lakeops.functions.text import clean_sheet, strip_illegal
from lakeops.operators.cohort import anonymize, build_index, restrict_to_cohort

_TOKEN = """CASE doc_id % 8 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' WHEN 3 THEN 'NULL' WHEN 4 THEN ''
            WHEN 5 THEN ' x ' WHEN 6 THEN 'nan' ELSE 'None' END"""


def _dirty(spark, sf):
    dirty = F.concat(F.lit(" \x01"), "text", F.lit("\t \\n "))
    return table(spark, sf, "documents").select("doc_id", dirty.alias("text"), F.expr(_TOKEN).alias("token"), "n_chars")


@query("p1_strip_illegal", f"""
    SELECT doc_id, md5(regexp_replace(' ' || chr(1) || text || chr(9) || ' \\n ', '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS text,
           {_TOKEN} AS token, n_chars
    FROM documents
""")
def p1_strip_illegal(spark, sf):
    return strip_illegal(_dirty(spark, sf)).withColumn("text", F.md5("text"))


@query("p2_clean_sheet", f"""
    SELECT doc_id, n_chars, CASE WHEN token IN ('NA', 'null', 'None') THEN token WHEN token = ' x ' THEN 'x' END AS token,
           md5(replace(replace(replace(regexp_replace(regexp_replace(' ' || chr(1) || text || chr(9) || ' \\n ',
               '^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$', '', 'g'), '\\\\[tnr]', '', 'g'), chr(9), ''), chr(10), ''), chr(13), '')) AS text
    FROM (SELECT *, {_TOKEN} AS token FROM documents)
""")
def p2_clean_sheet(spark, sf):
    return clean_sheet(_dirty(spark, sf)).withColumn("text", F.md5("text"))


_INDEX = "SELECT c_custkey, sha256('k' || c_custkey) AS index_id FROM customer"


@query("j9_patient_index", _INDEX)
def j9_patient_index(spark, sf):
    return build_index(table(spark, sf, "customer"), "c_custkey", "k")


@query("p16_anonymize", f"""
    SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, index_id
    FROM orders LEFT JOIN ({_INDEX}) i ON i.c_custkey = o_custkey
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def p16_anonymize(spark, sf):
    """Patients with a negative balance stand for the test patients."""
    customers = table(spark, sf, "customer")
    index = build_index(customers, "c_custkey", "k").withColumnRenamed("c_custkey", "o_custkey")
    excluded = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = anonymize(table(spark, sf, "orders"), index, "o_custkey", ["o_orderpriority", "o_orderdate"], excluded)
    return orders.select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "index_id")


@query("j10_cohort_extract", """
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT id FROM cohort)
""", ("cohort",))
def j10_cohort_extract(spark, sf):
    orders = restrict_to_cohort(table(spark, sf, "orders"), fx.cohort(spark, sf, "o_custkey"), "o_custkey")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus")
