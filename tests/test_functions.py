import base64
import datetime as dt
import fnmatch
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakeops.functions.documents import day_prefix, document_format, sanitize_id, tree_path, uri_bucket, uri_key
from lakeops.functions.grid import anchored_slot, check_interval, ntz
from lakeops.functions.objects import inflate
from lakeops.functions.studies import (
    exam_date, exam_date_strict, glob_regex, remap_study, scrub_log, study_accession, study_exam_date, study_path,
)
from lakeops.functions.text import clean_sheet, fold_keyword, strip_illegal
from lakeops.operators.documents import decode_documents


def one(df):
    return df.first()[0]


def values(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_format_is_told_by_the_first_five_bytes(spark):
    heads = {b"%PDF-": "pdf", b"{\\rtf": "rtf"}
    raw = [h[:n] + tail for h in heads for n in range(6) for tail in (b"", b"2.0 rest", b"\x00")] + [b" %PDF-1.4", b"<html>", b"{\\RTF1"]
    df = values(spark, raw, "binary")
    assert column(df, document_format(F.col("v"))) == [heads.get(r[:5], "other") for r in raw]


def test_ids_become_one_path_segment(spark):
    df = values(spark, ["plain.7", "../up", "two  gaps", "x-y=z", "été"])
    assert column(df, sanitize_id(F.col("v"))) == ["plain.7", ".._up", "two__gaps", "x_y_z", "_t_"]


def test_paths_are_filled_from_templates(spark):
    df = values(spark, ["2031-12-03T23:59:01"])
    tables = F.lit("notes/{{date}}/{{hl7_id}}/part_{{table_no}}.csv")
    day, doc = F.col("v"), F.lit("note 9/b")
    assert column(df, tree_path(tables, day, doc, F.lit(0))) == ["notes/2031/12/03/note_9_b/part_0.csv"]
    assert column(df, tree_path(tables, day, doc)) == ["notes/2031/12/03/note_9_b/part_{{table_no}}.csv"]
    assert column(df, day_prefix(tables, day)) == ["notes/2031/12/03"]
    uri = F.lit("s3://bucket/some/prefix/")
    assert df.select(uri_bucket(uri), uri_key(uri)).first() == ("bucket", "some/prefix")


def test_decoding_agrees_with_python(spark):
    rng = random.Random(7)
    texts = [None, "", "=", "JVBERi0", "QQ", "QQ=", "QQ==", "QQ===", "QUI", "QUI=", "Q", "QUJD\nQUJD", "QU*JD", "é QQ=="]
    for _ in range(300):
        encoded = base64.b64encode(rng.randbytes(rng.randint(0, 20))).decode()
        cut = encoded.rstrip("=")[: rng.randint(0, 30)] + "=" * rng.randint(0, 3)
        junk = "".join(ch + (rng.choice("\r\n -!") if rng.random() < 0.1 else "") for ch in cut)
        texts += [encoded, cut, junk]

    def python(text):
        try:
            return base64.b64decode(text)
        except Exception:
            return None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = [None if r.raw is None else bytes(r.raw) for r in decode_documents(df, "payload").orderBy("i").collect()]
    assert got == [python(t) for t in texts]


def test_exam_dates(spark):
    days = [dt.date(1999, 12, 31), dt.date(2024, 2, 29), dt.date(2031, 7, 4)]
    good = [f(d) for d in days for f in (str, lambda d: f"  {d}", lambda d: f"{d.year}-{d.month}-{d.day}")]
    bad = ["2023-02-29", "2031.07.04", "4 July 2031", "31-7-4x", "today", "-", "07-04"]
    got = column(values(spark, good + bad), exam_date(F.col("v")))
    assert got == [d for d in days for _ in range(3)] + [None] * len(bad)
    with pytest.raises(Exception, match="Y-M-D"):
        values(spark, bad[:1]).select(exam_date_strict(F.col("v"))).collect()


def test_study_paths(spark):
    df = values(spark, ["scans/2031/07/04/QX55"])
    v = F.col("v")
    assert column(df, study_path(F.lit("out"), F.lit(dt.date(2031, 7, 4)), F.lit("QX5*"))) == ["out/2031/07/04/QX5*"]
    assert column(df, remap_study(v, F.lit("copies"))) == ["copies/2031/07/04/QX55"]
    assert df.select(study_accession(v), study_exam_date(v)).first() == ("QX55", "2031-07-04")
    with pytest.raises(Exception, match="no parent folder"):
        values(spark, ["QX55"]).select(remap_study(v, F.lit("out"))).collect()


def test_logs_lose_names_but_keep_series(spark):
    log = (
        "reading /work/q7/QX55/genou gauche/CORONAL 3/im.9.2.25.77.1.2.dcm and /b/c.dcm.cmp\n"
        "frame 2.25.77.1.2 of release 4.1.0 in /b/c.dcmx\n"
    )
    got = one(values(spark, [log]).select(scrub_log(F.col("v"), F.lit("/work/q7/"))))
    assert got == (
        "reading QX55/genou gauche/CORONAL 3/<file> and /b/<file>\n"
        "frame <uid> of release 4.1.0 in /b/c.dcmx\n"
    )


GLOBS = ["a*", "*", "*b", "a/*/c", "a?c*", "[ab]*", "[!a]*", "a[*", "a.c*", "a\\*", "(x)*|y", "[]a]*", "a*[0-9]", "[a^]*", "$*^"]
PATHS = ["a", "abc", "a/b/c", "a/b/x/c", "b", "abcz", "a.c", "aXc", "a[", "a[1", "a\\z", "(x)1|y", "]q", "a7", "^q", "", "$x^", "a\nb"]


def test_wildcards_agree_with_fnmatch(spark):
    pairs = [(i, g, p) for i, (g, p) in enumerate((g, p) for g in GLOBS for p in PATHS)]
    df = spark.createDataFrame(pairs, "i int, g string, v string")
    got = column(df, F.rlike("v", glob_regex(F.col("g"))))
    assert got == [fnmatch.fnmatchcase(p, g) for _, g, p in pairs]


def test_objects_are_inflated_or_explained(spark):
    good = bytes(8) + zlib.compress(bytes(128) + b"DICM" + b"pixels")
    plain = bytes(8) + zlib.compress(b"not an image")
    df = values(spark, [good, plain, b"garbage", None], "binary").select("i", inflate("v").alias("o")).orderBy("i")
    rows = [r.o for r in df.collect()]
    assert bytes(rows[0].content).endswith(b"DICMpixels") and rows[0].error is None
    assert rows[1].content is None and "DICM" in rows[1].error
    assert rows[2].content is None and rows[2].error.startswith("inflate")
    assert rows[3].content is None and rows[3].error


def test_sheet_cleaning(spark):
    df = spark.createDataFrame(
        [("NA", 1), ("N/A", 2), (" x ", 3), ("a\tb\\nc\r\n", 4), ("  y　", 5), ("\\\\tn", 6), ("\\\nn", 7)], "v string, i int"
    )
    assert column(clean_sheet(df), "v") == ["NA", None, "x", "abc", "y", "\\n", "\\n"]
    assert column(strip_illegal(spark.createDataFrame([("a\x01\x0b\t\x1fb", 1)], "v string, i int")), "v") == ["a\tb"]


def test_keywords_fold(spark):
    assert column(values(spark, ["ÉÀÇ Straße Œuvre Łódź", "Ñandú"]), fold_keyword(F.col("v"))) == ["eac strasse oeuvre lodz", "nandu"]


SECOND = dt.timedelta(seconds=1)


@pytest.mark.parametrize("width", [dt.timedelta(hours=5), dt.timedelta(days=10), SECOND * 7])
@pytest.mark.parametrize("mode", ["floor", "ceil"])
def test_grid_slots(spark, mode, width):
    """Slots counted up one by one from the anchor; before it, the anchor itself."""
    anchor = dt.datetime(2030, 5, 17, 22, 15)
    rng = random.Random(11)
    moments = [anchor + k * width + d * SECOND for k in (0, 1, 2, 9) for d in (-1, 0, 1)]
    moments += [anchor + rng.random() * 12 * width - width for _ in range(20)]

    def slot(moment):
        at = anchor
        while at + width <= moment:
            at += width
        return at if mode == "floor" or moment <= at else at + width

    df = values(spark, moments, "timestamp_ntz")
    assert column(df, anchored_slot(F.col("v"), ntz(anchor), width, mode)) == [slot(m) for m in moments]


def test_grid_keeps_the_wall_clock_across_time_changes(spark):
    """Weekly slots at noon in Berlin stay at noon when the clocks go forward on 30 March 2031."""
    anchor = ntz("2031-03-23 12:00:00")
    instant = F.lit("2031-03-30 10:00:00").cast("timestamp_ntz")  # UTC; noon in Berlin by then
    local = F.from_utc_timestamp(instant.cast("timestamp"), "Europe/Berlin").cast("timestamp_ntz")
    assert one(spark.range(1).select(anchored_slot(local, anchor, dt.timedelta(weeks=1)))) == dt.datetime(2031, 3, 30, 12)


@pytest.mark.parametrize("bad", [dt.timedelta(0), -SECOND, 42])
def test_grid_intervals_are_positive(bad):
    with pytest.raises(ValueError):
        check_interval(bad)
