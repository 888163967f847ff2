import base64
import datetime as dt
import fnmatch
import os
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.checks import fixtures as fx
from lakeops.operators.catalog import LOAD_ORDER, Catalog, dictionary, expand_lineage, foreign_key_orphans, scan_metadata, value_type
from lakeops.operators.cohort import anonymize, build_index
from lakeops.operators.conform import conform
from lakeops.operators.documents import parse_documents
from lakeops.operators.forms import forms_wide
from lakeops.operators.measures import (
    backfill_extract, duplicates, interval_grid, lab_pairs, next_start, period_of_year,
)
from lakeops.operators.manifests import index_documents, update_index
from lakeops.operators.nested import resource_docs, variable_docs, variable_heads
from lakeops.operators.ordering import first_appearance, latest_per_key, status_history, with_ordinals
from lakeops.operators.quality import greater_or_equal_partition_counts, greater_partition_counts
from lakeops.operators.studies import (
    check_selection, classify_studies, convert_studies, match_studies, missing_studies, problem_report, report_only,
    require_no_failure, split_existing, status_summary, top_missing,
)
from lakeops.plans.catalog_load import load_catalog
from lakeops.sources.versions import VersionedTables
from lakeops.plans.conversion import convert, read_report, resolve_studies, run_study_job, write_report
from lakeops.plans.document_job import run_document_job
from lakeops.plans.publication import publish_search
from lakeops.sinks.bulk import Shared, bulk_documents, read_bulk, write_bulk
from lakeops.sinks.tree import write_files
from lakeops.sources.files import list_objects
from lakeops.functions.grid import ntz
from lakeops.functions.studies import REPORT_COLUMNS


def keys(spark, items):
    return spark.createDataFrame([(k,) for k in items], "key string")


def patterns(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "ordinal int, pattern string")


def resolved(objects, pats):
    return sorted((r.ordinal, r.study) for r in match_studies(objects, pats).collect())


A, B, C = "scans/2031/07/04/QX55", "scans/2031/07/04/QX56", "scans/2031/08/11/KD9"
TREE = [f"{s}/CORONAL/{i}.dcm" for s in (A, B, C) for i in (1, 2)]


@pytest.mark.parametrize("pattern, expected", [
    ("scans/2031", [A, B, C]), ("scans/2031/07/", [A, B]), ("scans/203", []), ("scans/2031/07/04/QX5*", [A, B]),
    ("scans/*/*/*/K*", [C]), ("scans/2031/09/*", []), ("scans/2031/09/01/QX1", ["scans/2031/09/01/QX1"]), ("*", [A, B, C]),
    ("*/QX*", [A, B]), ("*X5*", [A, B]), ("*?4/QX*", [A, B]), ("*[A-L]*", [C]), ("*1*/*", [A, B, C]), ("*/0[78]/*Q*", [A, B]), ("*/0[78]/*", [A, B, C]), ("*nothing*", []), ("**?*", [A, B, C]), ("scans/2031/07/04/QX5[!5]*", [B]), ("scans/2031/0?/*", [A, B, C]), ("", []),
])
def test_patterns_resolve_to_study_folders(spark, pattern, expected):
    assert [s for _, s in resolved(keys(spark, TREE), patterns(spark, [pattern]))] == expected


def studies_of(objects, pattern):
    """All folders, kept when they are the topmost study folder below the part of the pattern without stars."""
    pattern = pattern.rstrip("/")
    is_study = lambda folder: re.match(r"[A-Za-z]{2}\d", folder.rpartition("/")[2])
    if "*" not in pattern and is_study(pattern):
        return {pattern}
    folders = {key[:m.start()] for key in objects for m in re.finditer("/", key)}
    base = pattern if "*" not in pattern else pattern[:pattern.index("*")].rpartition("/")[0]
    below = {f for f in folders if is_study(f) and (not base or f.startswith(f"{base}/"))}
    topmost = {f for f in below if not any(f.startswith(f"{g}/") for g in below)}
    return {f for f in topmost if "*" not in pattern or fnmatch.fnmatchcase(f, pattern)}


def test_patterns_agree_with_all_folders(spark):
    rng = random.Random(3)
    names = ["2031", "7", "07", "QX5", "QX55", "KD9", "knee l", "x", "ab3c"]
    objects = ["/".join(["d"] + rng.choices(names, k=rng.randint(1, 5)) + [f"{i}.dcm"]) for i in range(300)]
    parts = ["d", "*", "Q*", "2031", "0?", "0*", "QX5", "QX5*", "*5", "x", "[A-Z]*", "ab3c"]
    pats = [p for p in {"/".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(150)}]
    want = sorted((i, s) for i, p in enumerate(pats) for s in studies_of(objects, p))
    assert resolved(keys(spark, objects), patterns(spark, pats)) == want


def test_only_keys_below_the_patterns_are_scanned(spark, fresh):
    path = fresh()
    keys(spark, TREE).write.parquet(path)
    found = match_studies(spark.read.parquet(path), patterns(spark, ["scans/2031/07/*/QX*", "scans/2031/08/*"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,scans/2031/0)" in plan
    assert sorted(r.study for r in found.collect()) == [A, B, C]


def test_patterns_that_start_with_a_star_meet_studies_on_their_rarest_gram(spark):
    from lakeops.operators import studies

    n = 1000
    objects = keys(spark, [f"scans/2031/{i % 12:02d}/{i % 28:02d}/QX{i:05d}/s/1.dcm" for i in range(n)])
    pats = patterns(spark, [f"*QX{i:05d}*" for i in range(n)] + ["*/07/*QX??07?*"])
    met, real = [], studies.lookup_join

    def counting(df, dim, keys_, how="inner", salts=1):
        out = real(df, dim, keys_, how, salts)
        if how == "inner":
            met.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(studies, "lookup_join", counting)
        got = resolved(objects, pats)
    assert sorted(got)[:n] == [(i, f"scans/2031/{i % 12:02d}/{i % 28:02d}/QX{i:05d}") for i in range(n)]
    assert {s for o, s in got if o == n} == {s for o, s in got if o < n and re.search("/07/.*QX..07", s)}
    # All pairs would be a million; three of five digits in a row leave a hundredth of the studies at most.
    assert 0 < met[0] <= n * n // 20


def test_patterns_with_one_stem_meet_their_own_studies_only(spark):
    """Candidates of the join grow with the studies, although every pattern has the same stem."""
    n = 400
    objects = keys(spark, [f"scans/2031/{i % 12:02d}/{i % 28:02d}/QX{i:05d}/s/1.dcm" for i in range(n)])
    pats = patterns(spark, [f"scans/2031/*/*/QX{i:05d}*" for i in range(n)])
    seen = []
    joined = type(objects).join

    def counting(self, other, on=None, how=None):
        out = joined(self, other, on, how)
        if on == ["depth", "stem", "anchor"]:
            seen.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(objects), "join", counting)
        got = resolved(objects, pats)
    assert len(got) == n and seen == [n]


def test_studies_keep_the_order_of_first_appearance(spark):
    objects = keys(spark, TREE)
    pats = patterns(spark, [C, "scans/2031/07/04/*", A, "scans/2031/12/*", "scans/2031/07/04/QX9"])
    studies, missing = resolve_studies(objects, pats)
    assert [r.study for r in studies.orderBy("position").collect()] == [C, A, B, "scans/2031/07/04/QX9"]
    assert [r["item"] for r in missing.collect()] == ["scans/2031/12/*"]
    verified, missing = resolve_studies(objects, pats, verify=True)
    assert [r.study for r in verified.orderBy("position").collect()] == [C, A, B]
    assert [r["item"] for r in missing.orderBy("rank", "item").collect()] == ["scans/2031/12/*", "scans/2031/07/04/QX9"]
    with pytest.raises(LookupError, match="nothing to act on"):
        resolve_studies(objects, patterns(spark, ["scans/1999/*", "scans/2031/07/04/QX9"]), verify=True)


def test_the_study_job_runs_from_a_selection_to_a_report(spark, fresh):
    def make_converter():
        return lambda facts: {"rc": 0 if facts["study"] != C else 1, "output_files": facts["n_objects"], "log": "x" * 400}

    cleared = fresh()
    os.makedirs(cleared)

    def make_cleaner():
        return lambda facts: open(f"{cleared}/{facts['study'].replace('/', '_')}", "w").close()

    objects, outputs = keys(spark, TREE), spark.createDataFrame([(A,)], "study string")
    paths = ["scans/2031/07/*", C, "scans/2031/12/*"]
    outcomes, counts, missing = run_study_job(spark, objects, outputs, make_converter, fresh(), "scans", paths=paths)
    assert {r.study: r.status for r in outcomes.collect()} == {A: "skipped", B: "ok", C: "failed"}
    assert {r.study: r.files_converted for r in outcomes.collect()} == {A: 0, B: 2, C: 0}
    assert [r.output for r in outcomes.where("status = 'failed'").collect()][0].endswith("x" * 400)
    assert [r["item"] for r in missing.collect()] == ["scans/2031/12/*"]
    assert {r.status: r.n for r in counts.collect()}["skipped"] == 1
    again, *_ = run_study_job(spark, objects, outputs, make_converter, fresh(), "scans", paths=paths, skip_existing=False, make_cleaner=make_cleaner)
    assert {r.study: r.status for r in again.collect()} == {A: "ok", B: "ok", C: "failed"}
    assert os.listdir(cleared) == [A.replace("/", "_")]
    root = fresh()
    write_files(spark.createDataFrame([("c.csv", "accessionNumber,examDate\nQX55,2031-07-04\nKD*,2031-08-11\n")], "path string, content string"), root).collect()
    outcomes, *_ = run_study_job(spark, objects, outputs.limit(0), make_converter, fresh(), "scans", cohort_bucket=root, cohort_key="c.csv")
    assert {r.study: r.status for r in outcomes.collect()} == {A: "ok", C: "failed"}


def test_selection_is_one_of_two_kinds():
    check_selection(["a"], None, None)
    check_selection(None, "bucket", "key")
    for args, message in ((([], "b", None), "both its bucket"), (([], None, "k"), "both its bucket"), ((["a"], "b", "k"), "not from both"), (([], None, None), "nothing selects")):
        with pytest.raises(ValueError, match=message):
            check_selection(*args)


def test_presence_counts_objects_at_any_level(spark):
    studies = spark.createDataFrame([(A,), ("scans/2031",), ("scans/2031/07/04/QX",)], "study string")
    got = {r.study: r.present for r in split_existing(studies, keys(spark, TREE)).collect()}
    assert got == {A: True, "scans/2031": True, "scans/2031/07/04/QX": False}


def test_the_first_missing_are_named_with_totals(spark):
    pats = patterns(spark, [f"scans/1999/{i:02d}/*" for i in range(30)] + [A])
    found = match_studies(keys(spark, TREE), pats)
    top = top_missing(missing_studies(pats, found, keys(spark, TREE)), pats).collect()
    assert [r["item"] for r in top] == [f"scans/1999/{i:02d}/*" for i in range(20)]
    assert {(r.n_missing, r.n_patterns) for r in top} == {(30, 31)}


def test_report_only_needs_reports_and_nothing_else(spark):
    rows = [("a", "x/my Basic Text SR/1"), ("a", "x/Rapport 7/2"), ("b", "x/a dose report/1"), ("b", "x/CORONAL/2")]
    got = {r.s: r.report_only for r in report_only(spark.createDataFrame(rows, "s string, p string"), "s", "p").collect()}
    assert got == {"a": True, "b": False}


FACTS = "study string, n_objects bigint, report_only boolean, output_exists boolean, rc int, output_files bigint, log string, error string"
BRANCHES = [
    ("skipped", (5, False, True, 0, 3, None)), ("missing", (0, False, False, None, None, None)), ("report only", (5, True, False, 2, 0, None)),
    ("failed", (5, False, False, 2, 0, None)), ("failed", (5, False, False, 1, 3, None)), ("failed", (5, False, False, 0, 0, None)),
    ("partial", (5, False, False, 8, 3, None)), ("ok", (5, False, False, 0, 3, None)), ("failed", (5, False, False, None, None, "E: x")),
]


def facts(spark):
    return spark.createDataFrame([(f"d/2026/01/02/RA{i}", n, r, o, rc, files, "log\nline", e) for i, (_, (n, r, o, rc, files, e)) in enumerate(BRANCHES)], FACTS)


def test_statuses_follow_their_rules(spark):
    got = {r.study: r for r in classify_studies(facts(spark)).collect()}
    assert [got[f"d/2026/01/02/RA{i}"].status for i in range(len(BRANCHES))] == [s for s, _ in BRANCHES]
    assert got["d/2026/01/02/RA6"].uploaded and got["d/2026/01/02/RA6"].output == "log\nline" and got["d/2026/01/02/RA6"].exit_code == 8
    assert got["d/2026/01/02/RA8"].output == "E: x" and got["d/2026/01/02/RA7"].output == ""
    redone = {r.study: r.status for r in classify_studies(facts(spark), skip_existing=False).collect()}
    assert redone["d/2026/01/02/RA0"] == "ok"
    summary = [(r.status, r.n) for r in status_summary(classify_studies(facts(spark)).where("status <> 'partial'")).orderBy("position").collect()]
    assert summary == [("ok", 1), ("partial", 0), ("report only", 1), ("skipped", 1), ("missing", 1), ("failed", 4)]
    with pytest.raises(RuntimeError, match="4 studies failed"):
        require_no_failure(classify_studies(facts(spark)))


def test_the_problem_report_survives_its_file(spark, fresh):
    path = fresh()
    write_report(problem_report(classify_studies(facts(spark))), path)
    rows = {r.path: r for r in read_report(spark, path).collect()}
    assert len(rows) == 7 and rows["d/2026/01/02/RA6"].output == "log\nline"
    assert (rows["d/2026/01/02/RA1"].exit_code, rows["d/2026/01/02/RA1"].uploaded, rows["d/2026/01/02/RA1"].exam_date) == ("", "no", "2026-01-02")
    with pytest.raises(Exception, match="exist"):
        write_report(problem_report(classify_studies(facts(spark))), path)
    empty = fresh()
    write_report(problem_report(classify_studies(facts(spark))).where("status = 'none'"), empty)
    assert spark.read.option("header", True).csv(empty).columns == REPORT_COLUMNS


def test_a_failing_study_stays_alone(spark, fresh):
    studies = spark.createDataFrame([(A,), (B,), (C,), ("scans/2031/07/04/QX9",)], "study string")
    objects = keys(spark, TREE).withColumn("study", F.regexp_extract("key", "^(.*?)/CORONAL", 1))

    def make():
        def run(study):
            if study["study"] == B:
                raise OSError("disk")
            return {"rc": 8, "output_files": int(study["n_objects"]), "log": "some"}
        return run

    outputs = spark.createDataFrame([(C,)], "study string")
    outcomes, summary = convert(spark, studies, objects, outputs, make, fresh())
    got = {r.study: (r.status, r.files_converted, r.output) for r in outcomes.collect()}
    assert got == {
        A: ("partial", 2, "some"), B: ("failed", 0, "OSError: disk"), C: ("skipped", 0, ""), "scans/2031/07/04/QX9": ("missing", 0, ""),
    }
    assert sum(r.n for r in summary.collect()) == 4
    assert convert_studies(spark.createDataFrame([(A, 1, False)], "study string, n_objects bigint, output_exists boolean"), make).first().rc == 8


def test_ordinals_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(9)
    got = with_ordinals(df, [F.col("v")]).collect()
    assert sorted((r.ordinal, r.v) for r in got) == [(i, i) for i in range(5000)]
    seen = spark.createDataFrame([("b", 1), ("a", 2), ("b", 0), ("c", 0)], "k string, o int")
    assert [(r.k, r.position) for r in first_appearance(seen, "k", "o").orderBy("position").collect()] == [("b", 0), ("c", 1), ("a", 2)]


def test_history_agrees_with_a_scan_even_for_one_busy_key(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = 0 if rng.random() < 0.6 else rng.choice([None, *range(1, 20)])
        rows.append((key, t0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 9)), i, rng.choice("ab" if key else "abbb")))
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, i int, s string")
    got = [(r.k, r.valid_from, r.s, r.valid_to) for r in status_history(df, ["k"], "ts", "i", "s", F.to_date("ts")).collect()]
    want = []
    for key in {r[0] for r in rows}:
        spans, last = [], None
        for _, ts, _, s in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if s != last:
                spans.append([ts, s])
                last = s
        want += [(key, ts, s, spans[n + 1][0] if n + 1 < len(spans) else None) for n, (ts, s) in enumerate(spans)]
    assert Counter(got) == Counter(want)


def test_latest_row_takes_ties_by_id(spark):
    rows = [("a", 1, 5, "x"), ("a", 1, 6, "y"), ("b", 2, 1, None)]
    df = spark.createDataFrame(rows, "k string, ts int, i int, v string")
    assert sorted((r.k, r.i, r.v) for r in latest_per_key(df, ["k"], ["ts", "i"]).collect()) == [("a", 6, "y"), ("b", 1, None)]


def test_pairs_agree_with_counting_by_hand(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice("pq"), rng.choice("wxyz")) for _ in range(400)]
    sets = {}
    for p, d, t in rows:
        sets.setdefault((p, d), set()).add(t)
    want = Counter(pair for s in sets.values() for pair in combinations(sorted(s), 2))
    got = lab_pairs(spark.createDataFrame(rows, "p int, d string, t string"), "t", "p", F.col("d")).collect()
    assert {(r.test_a, r.test_b): r.n_patient_days for r in got} == want


def test_duplicate_groups_list_every_member(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "i int, t string")
    got = duplicates(df, "i", F.col("t")).collect()
    assert sorted(r.i for r in got) == [i for i in range(30) if i % 3] and {(r.group_id, r.n) for r in got} == {(1, 20)}


def test_intervals_cover_the_span_without_gaps(spark):
    week = dt.timedelta(days=7)
    grid = interval_grid(spark, "2024-01-03 03:00:00", "2024-02-01 00:00:00", week).orderBy("k").collect()
    assert len(grid) == 4 and all(a.end == b.start for a, b in zip(grid, grid[1:])) and grid[0].start == dt.datetime(2024, 1, 3, 3)
    last = interval_grid(spark, "2024-01-03 03:00:00", "2024-02-01 00:00:00", week, catchup=False).collect()
    assert [(r.k, r.end) for r in last] == [(3, dt.datetime(2024, 1, 31, 3))]
    running = interval_grid(spark, "2024-01-03 03:00:00", "2024-01-05 00:00:00", week, catchup=False).collect()
    assert [r.k for r in running] == [0]
    assert interval_grid(spark, "2024-01-03 03:00:00", "2024-01-05 00:00:00", week).count() == 0
    shifted = spark.range(1).select(next_start(ntz("2026-04-10 03:00:00"), ntz("2026-03-13 04:00:00"), dt.timedelta(weeks=4))).first()[0]
    assert shifted == dt.datetime(2026, 3, 13, 4)
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 4)), (2, dt.datetime(2024, 1, 18)), (1, dt.datetime(2024, 1, 18))], "p int, ts timestamp_ntz")
    got = backfill_extract(rows, "ts", "p", spark.createDataFrame([(1,)], "p int"), "2024-01-03 03:00:00", "2024-02-01 00:00:00", week)
    assert [(r.k, r.n_facts, r.n_cohort_facts, r.n_cohort_patients) for r in got.orderBy("k").collect()] == [(0, 1, 1, 1), (1, 0, 0, 0), (2, 2, 1, 1), (3, 0, 0, 0)]


def test_reporting_periods(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 28), dt.date(2024, 1, 29), dt.date(2024, 12, 2), dt.date(2024, 12, 31)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
    assert [r[0] for r in df.orderBy("i").select(period_of_year(F.col("d"))).collect()] == [1, 1, 2, 13, 13]


def test_forms_take_the_latest_value_of_each_field(spark):
    rows = [(1, "a", "x", 1), (1, "a", "y", 2), (1, "b", "z", 1), (2, "b", None, 1)]
    got = forms_wide(spark.createDataFrame(rows, "doc int, f string, v string, ts int"), ["doc"], "f", "v", ["ts"], ["a", "b", "c"])
    assert sorted(map(tuple, got.collect())) == [(1, "y", "z", None), (2, None, None, None)]


def test_growth_compares_the_two_newest_partitions(spark):
    rows = [("same", "1")] * 2 + [("same", "2")] * 2 + [("up", "1")] + [("up", "2")] * 2 + [("single", "1")]
    df = spark.createDataFrame(rows, "d string, p string")
    assert {r.dataset: r.passed for r in greater_partition_counts(df, "d", "p").collect()} == {"same": False, "up": True, "single": True}
    assert {r.dataset: r.passed for r in greater_or_equal_partition_counts(df, "d", "p").collect()} == {"same": True, "up": True, "single": True}


def test_conforming_fails_on_values_that_do_not_fit(spark):
    schema = T.StructType().add("n", "integer").add("gone", "string")
    assert conform(spark.createDataFrame([("7", 1)], "n string, extra int"), schema).collect() == [(7, None)]
    with pytest.raises(Exception, match="n cannot be int"):
        conform(spark.createDataFrame([("x",)], "n string"), schema).collect()


def test_anonymizing_keeps_rows_and_hides_keys(spark):
    source = spark.createDataFrame([(1, "n1"), (2, "n2"), (None, "n3"), (9, "n9")], "p int, name string")
    index = build_index(source.where("p <> 9"), "p", "salt")
    got = anonymize(source, index, "p", ["name"])
    assert got.columns == ["index_id"] and got.count() == 4 and got.where("index_id IS NULL").count() == 2
    assert anonymize(source, index, "p", [], spark.createDataFrame([(1,)], "p int")).count() == 3


def test_manifest_lines_update_an_index(spark):
    types = spark.createDataFrame([("t", "name")], "type_code string, type_name string")
    lines = spark.createDataFrame([(1, "t", "1"), (1, "u", "2"), (2, "t", "1")], "doc int, type_code string, at string")
    fresh = index_documents(lines, types, "doc", "type_code", ["at"])
    assert sorted((r.doc, r.type_code, r.type_name) for r in fresh.collect()) == [(1, "u", None), (2, "t", "name")]
    target = spark.createDataFrame([(1, "old", "old", "0"), (5, "old", "old", "0")], "doc int, type_code string, type_name string, at string")
    assert index_documents(None, types, "doc", "type_code", ["at"]) is None and update_index(target, None, "doc") is target
    assert sorted((r.doc, r.type_code) for r in update_index(target, fresh, "doc").collect()) == [(1, "u"), (2, "t"), (5, "old")]


def test_large_documents_come_in_parts_that_lose_nothing(spark, sf):
    cat = fx.catalog(spark, sf)
    whole = {r.rs_id: r for r in resource_docs(cat).collect()}
    assert all(r.part == 0 for r in whole.values())
    limit = 6
    split = resource_docs(cat, limit=limit).collect()
    assert len(split) > len(whole)
    for rs_id, doc in whole.items():
        parts = [r for r in split if r.rs_id == rs_id]
        assert sorted(v.var_id for p in parts for v in p.variables) == [v.var_id for v in doc.variables]
        assert sorted(t.tab_id for p in parts for t in p.tables) == [t.tab_id for t in doc.tables]
        assert {p.rs_code for p in parts} == {doc.rs_code}
    whole_sets = {r.var_id: r for r in variable_docs(cat).collect()}
    parts = variable_docs(cat, limit=2).collect()
    for var_id, doc in whole_sets.items():
        codes = sorted(v.vsval_code for p in parts if p.var_id == var_id and p.value_set for v in p.value_set["values"])
        assert codes == ([v.vsval_code for v in doc.value_set["values"]] if doc.value_set else [])


def test_documents_are_indexed_once_per_part(spark, sf, fresh):
    docs = variable_docs(fx.catalog(spark, sf), limit=2)
    ids = [r.id for r in bulk_documents(docs, "var_id").collect()]
    assert len(set(ids)) == len(ids) == docs.count() and any(i.endswith("-1") for i in ids)
    with pytest.raises(ValueError, match="share the id '0-0'"):
        write_bulk(docs.unionByName(docs.where("var_id = 0 AND part = 0")), fresh(), "var_id")


def test_variable_documents_of_shared_value_sets_are_the_same_lines(spark, sf, fresh):
    cat, whole, apart = fx.catalog(spark, sf), fresh(), fresh()
    heads, sets = variable_heads(cat, limit=8)
    write_bulk(variable_docs(cat, limit=8), whole, "var_id", chunk=30)
    write_bulk(heads, apart, "var_id", chunk=30, shared=Shared(sets, "vs_id"))
    want, got = (sorted(map(tuple, read_bulk(spark, p).collect())) for p in (whole, apart))
    assert got == want and len(want) > heads.count()


def test_a_bad_parser_result_is_a_failed_document(spark):
    results = {
        "a": {"status": "success", "markdown": "# a", "tables": [("x,y", 1, 2, None)]}, "b": {"status": "success"}, "c": None, "d": {},
        "e": {"status": "success", "markdown": "m", "tables": [("too", "short")]}, "f": {"status": "failure"}, "g": "text",
        "h": {"status": "success", "markdown": "m", "tables": [("x", "many", 1, 1)]},
    }
    rows = spark.createDataFrame([(k, "2024-01-01", bytearray(b"%PDF-"), "pdf", None, None) for k in results],
                                 "hl7_id string, dte_of_message string, raw binary, source_format string, parse_status string, parse_error string")
    got = {r.hl7_id: r for r in parse_documents(rows, lambda: lambda name, raw: results[name]).collect()}
    assert {k: r.parse_status for k, r in got.items()} == {k: "success" if k == "a" else "failure" for k in results}
    assert got["a"].report_markdown == "# a" and len(got["a"].tables) == 1 and got["b"].report_markdown is None


def test_days_that_vanish_leave_no_files(spark, fresh):
    source, report, root = fresh(), fresh(), fresh()

    def load(days):
        rows = [(f"d{i}", base64.b64encode(b"%PDF-1").decode(), day) for i, day in enumerate(days)]
        spark.createDataFrame(rows, "hl7_id string, observation_value_base64 string, dte_of_message string") \
            .write.mode("overwrite").partitionBy("dte_of_message").parquet(source)
        parser = lambda: lambda name, raw: {"status": "success", "markdown": name, "tables": [("t", 1, 1, None)]}
        return run_document_job(spark, source, report, root, "t/{{date}}/{{hl7_id}}/{{table_no}}.csv", "r/{{date}}/{{hl7_id}}.md",
                                "2024-01-01", "2024-01-04", parser)

    load(["2024-01-01", "2024-01-02", "2024-01-03"])
    counters = load(["2024-01-01", "2024-01-03"])
    assert counters.count() > 0
    keys_ = [r.key for r in list_objects(spark, root).collect()]
    assert {k.split("/d")[0] for k in keys_} == {"t/2024/01/01", "t/2024/01/03", "r/2024/01/01", "r/2024/01/03"}
    assert not any("partial" in k for k in keys_)


def test_captures_at_one_instant_have_one_winner(spark):
    rows = [(1, "f", v, 5) for v in ("b", "c", "a")]
    df = spark.createDataFrame(rows, "doc int, field string, value string, ts int")
    for parts in (1, 2, 3):
        assert forms_wide(df.repartition(parts), ["doc"], "field", "value", ["ts"], ["f"]).collect() == [(1, "c")]


def test_hidden_dictionaries_are_empty(spark, sf, fresh):
    cat = fx.catalog(spark, sf)
    assert all(df.isEmpty() for df in dictionary(cat, "america").values())
    assert publish_search(cat, "america", fresh()) == []
    assert len(publish_search(cat, "asia", fresh())) == 3


def test_lineage_keeps_variables_without_parents(spark, sf):
    got = {r.var_id: r for r in expand_lineage(fx.catalog(spark, sf)).collect()}
    assert got[0].var_from_variables == [] and [v.var_id for v in got[5].var_from_variables] == [3, 4]


def test_scan_covers_nested_fields_and_types(spark):
    df = spark.createDataFrame(
        [(1, (2, "x"), [1], {"k": 1}, 0.0), (None, (2, "x" * 40), None, None, -0.0)],
        "a int, s struct<b: int, c: string>, l array<int>, m map<string, int>, d double",
    )
    exact = {r.path: (r.value_type, r.n_values, r.n_distinct) for r in scan_metadata(spark, "r", {"t": df}).collect()}
    got = {r.path: (r.value_type, r.n_values, r.n_distinct) for r in scan_metadata(spark, "r", {"t": df}, distinct=0.01).collect()}
    assert got == exact and "n_distinct" not in scan_metadata(spark, "r", {"t": df}, distinct=None).columns
    assert got["r.t.a"] == ("integer", 1, 1) and got["r.t.s"] == ("struct", 2, 2) and got["r.t.s.c"] == ("string", 2, 2)
    assert got["r.t.s.b"] == ("integer", 2, 1) and got["r.t.l"] == ("array", 1, 1) and got["r.t.m"] == ("map", 1, 1)
    assert got["r.t.d"] == ("decimal", 2, 1)
    assert [value_type(t) for t in (T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.DecimalType(9, 0), T.BinaryType())] == ["boolean", "date", "datetime", "decimal", "string"]


def test_distinct_values_meet_in_one_exchange(spark):
    from lakeops.operators.catalog import _cells, _fields

    rows = spark.range(0, 4000, 1, 4).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("few"), "id", F.struct((F.col("id") % 3).alias("x"), F.lit(None).cast("int").alias("y")).alias("s"),
        F.array(F.when(F.col("id") % 2 == 0, 1), F.when(F.col("id") % 2 == 1, 1)).alias("l"), F.lit(None).cast("string").alias("none"))
    got = {r.path: (r.n_values, r.n_distinct) for r in scan_metadata(spark, "r", {"t": rows, "u": rows.select("few")}).collect()}
    n = sum(i % 7 > 0 for i in range(4000))
    assert got == {"r.t.few": (n, 5), "r.u.few": (n, 5), "r.t.id": (4000, 4000), "r.t.s": (4000, 3), "r.t.s.x": (4000, 3), "r.t.s.y": (0, 0),
                   "r.t.l": (4000, 2), "r.t.none": (0, 0)}
    # What leaves a task are its distinct values, not its cells.
    cells = _cells(rows, 0, _fields(rows.schema)).groupBy("i", "a", "b").count()
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.rindex("partial_count")


def test_catalog_load_stops_at_a_dangling_reference(spark, sf, fresh):
    cat = fx.catalog(spark, sf)
    root = fresh()
    broken = Catalog(**{**cat.__dict__, "mapping": cat.mapping.withColumn("value_set_code_id", F.col("value_set_code_id") + 10_000_000)})
    assert foreign_key_orphans(broken, "mapping", "value_set_code_id", "value_set_code").count() > 0
    with pytest.raises(ValueError, match="mapping lead nowhere.*value_set_code_id"):
        load_catalog(spark, broken, root)
    assert VersionedTables(spark, root).names() == []
    load_catalog(spark, cat, root)
    before = {n: VersionedTables(spark, root).path(n) for n in LOAD_ORDER}
    with pytest.raises(ValueError, match="mapping lead nowhere"):
        load_catalog(spark, broken, root)
    assert {n: VersionedTables(spark, root).path(n) for n in LOAD_ORDER} == before


def test_catalog_load_stopped_at_any_table_changes_nothing(spark, sf, fresh, monkeypatch):
    cat, root = fx.catalog(spark, sf), fresh()
    load_catalog(spark, cat, root)
    before = {n: VersionedTables(spark, root).path(n) for n in LOAD_ORDER}
    folder = VersionedTables.folder
    for stopped in LOAD_ORDER:
        def fail(self, change, name, stopped=stopped):
            if name == stopped:
                raise KeyboardInterrupt
            return folder(self, change, name)

        with monkeypatch.context() as m:
            m.setattr(VersionedTables, "folder", fail)
            with pytest.raises(KeyboardInterrupt):
                load_catalog(spark, cat, root)
    assert {n: VersionedTables(spark, root).path(n) for n in LOAD_ORDER} == before
    assert {r.n_new for r in load_catalog(spark, cat, root).collect()} == {0}


def test_copies_are_dealt_out_to_tasks_by_their_number(spark, monkeypatch):
    from lakeops.operators import catalog

    monkeypatch.setattr(catalog, "TASK_COPIES", 50)
    monkeypatch.setattr(catalog, "ROW_COPIES", 7)
    df = spark.createDataFrame([(1, 700), (2, 1), (3, 299), (None, 14)], "a int, _times long").coalesce(1)
    copies = catalog._repeat(df, ["a"])
    assert {r.a: r["count"] for r in copies.groupBy("a").count().collect()} == {1: 700, 2: 1, 3: 299, None: 14}
    per_task = [n for n in copies.rdd.glom().map(len).collect() if n]
    assert len(per_task) > 15 and max(per_task) <= 100
    assert catalog._repeat(df.limit(0), ["a"]).count() == 0


def test_python_gets_long_values_in_batches_of_bounded_bytes(spark, tmp_path):
    from lakeops.operators.documents import parse_documents
    from lakeops.session import BATCH_BYTES
    from lakeops.sinks.tree import write_files

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    decoded = spark.createDataFrame([], "hl7_id string, dte_of_message string, raw binary, source_format string, parse_status string, parse_error string")
    files = spark.createDataFrame([], "path string, content string")
    for build in (lambda: parse_documents(decoded, lambda: None), lambda: write_files(files, str(tmp_path))):
        spark.conf.unset(name)
        build()
        assert int(spark.conf.get(name)) == BATCH_BYTES
