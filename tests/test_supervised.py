"""Items that hang, crash or raise are their own problem."""

import os
import subprocess
import time

import pytest

from lakeops.operators.documents import parse_documents
from lakeops.operators.studies import classify_studies, convert_studies
from lakeops.operators.supervised import ItemFailed, Supervised


def troubled():
    def call(item):
        if item == "hangs":
            time.sleep(600)
        if item == "starts a program that hangs":
            subprocess.run(["sleep", "600"])
        if item == "dies":
            os.kill(os.getpid(), 11)
        if item == "leaves":
            os._exit(3)
        if item == "raises":
            raise KeyError("x")
        if item == "cannot be sent":
            return lambda: None
        return os.getpid(), item

    return call


def test_what_happens_to_an_item_is_told_and_the_next_one_is_served():
    run = Supervised(troubled, 1.0)
    first = run("good")[0]
    assert first != os.getpid() and run("again") == (first, "again")
    for item, said in [("hangs", "no result within 1 seconds"), ("starts a program that hangs", "no result"), ("dies", "signal 11"),
                       ("leaves", "exit code 3"), ("raises", "KeyError: 'x'"), ("cannot be sent", "pickle|local")]:
        began = time.monotonic()
        with pytest.raises(ItemFailed, match=said):
            run(item)
        assert time.monotonic() - began < 5
        assert run("good")[1] == "good"
    pid = run("good")[0]
    run.close()
    with pytest.raises(ProcessLookupError):
        os.kill(pid, 0)


def test_a_function_that_cannot_be_made_fails_its_item():
    def broken():
        raise OSError("no model")

    with pytest.raises(ItemFailed, match="OSError: no model"):
        Supervised(broken, 5.0)(1)


def test_a_converter_that_hangs_fails_its_study_alone(spark):
    def make():
        def convert(study):
            if study["study"].endswith("3"):
                time.sleep(600)
            return {"rc": 0, "output_files": 2, "log": ""}

        return convert

    facts = spark.createDataFrame([(f"d/RA{i}", 4, False, False) for i in range(8)], "study string, n_objects bigint, report_only boolean, output_exists boolean")
    began = time.monotonic()
    done = classify_studies(convert_studies(facts, make, tasks=2, limit_seconds=2.0)).collect()
    assert time.monotonic() - began < 60
    assert {r.study: r.status for r in done} == {f"d/RA{i}": "failed" if i == 3 else "ok" for i in range(8)}
    assert [r.output for r in done if r.status == "failed"] == ["no result within 2 seconds"]


def test_a_parser_that_hangs_fails_its_document_alone(spark):
    def make():
        def parse(name, raw):
            if name == "b":
                time.sleep(600)
            return {"status": "success", "markdown": f"# {name}", "tables": [("x", 1, 1, None)]}

        return parse

    rows = spark.createDataFrame([(k, "2024-01-01", bytearray(b"%PDF-"), "pdf", None, None) for k in "abc"],
                                 "hl7_id string, dte_of_message string, raw binary, source_format string, parse_status string, parse_error string")
    got = {r.hl7_id: (r.parse_status, r.report_markdown) for r in parse_documents(rows.coalesce(1), make, limit_seconds=2.0).collect()}
    assert got == {"a": ("success", "# a"), "b": ("failure", None), "c": ("success", "# c")}
