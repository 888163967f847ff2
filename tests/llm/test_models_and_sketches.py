"""Sketches against exact sets, and trained models on held-out rows."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeops.llm import QUERIES, license_scan, quality_model, sketches
from tests.llm.conftest import ODD


def shingles(text):
    words = [w.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (text or "").encode().split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_below_k_are_exact():
    texts = [*ODD, "a b c d e f g", "A B C D E f g", "a b c d e f h"]
    made = sketches.sketch_batch(pa.array(texts))
    for t, s in zip(texts, made):
        assert sketches.distinct(s) == len(shingles(t))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert sketches.resemblance(made[i], made[j]) == pytest.approx(alike(a, b))
            if shingles(a):
                assert sketches.containment(made[i], made[j]) == pytest.approx(len(shingles(a) & shingles(b)) / len(shingles(a)))


def test_estimates_and_merging():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 6000)]
    a, b = " ".join(words[:4000]), " ".join(words[1000:])
    sa, sb, whole = sketches.sketch_batch(pa.array([a, b, " ".join(words)]))
    assert abs(sketches.resemblance(sa, sb) - alike(a, b)) < 0.13
    assert abs(sketches.distinct(sa) / len(shingles(a)) - 1) < 0.3
    assert sketches.merge([sa, sb]).tolist() == whole.tolist()
    assert sketches.of_string(sketches.to_string(sa)).tolist() == sa.tolist()


def test_merging_by_key(spark, odd):
    made = sketches.sketches(odd.withColumn("by", F.col("doc_id") % 3), out="s")
    got = {r.by: np.frombuffer(r.s, "<u8").tolist() for r in sketches.merged(made, "by", "s").collect()}
    parts = collections.defaultdict(list)
    for r in made.collect():
        parts[r.by].append(np.frombuffer(r.s, "<u8"))
    assert got == {k: sketches.merge(v).tolist() for k, v in parts.items()}


def check_compared(rows, got):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = collections.Counter()
    by_digest = collections.defaultdict(list)
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[key, len(text), digest] += 1
        by_digest[key, digest].append((text, edited, following))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    errors = []
    for r in got:
        exact = [(alike(t, e), alike(t, f)) for t, e, f in by_digest[r.doc_id, r.edited_sha256]]
        errors.append(min(abs(r.near_edited - a) + abs(r.near_next - b) for a, b in exact))
    assert np.mean(errors) < 0.05 and max(errors) < 0.4


def test_comparison_with_the_next(spark, odd, no_rows):
    check_compared([(r.doc_id, r.text) for r in odd.collect()], sketches.compare_with_next(odd).collect())
    assert sketches.compare_with_next(no_rows).collect() == []
    one = odd.where("doc_id = 12")
    assert [r.near_next for r in sketches.compare_with_next(one).collect()] == [1.0]


def test_fingerprint_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op6_document_fingerprints"](spark, sf).collect()
    check_compared(rows, got)
    texts = dict(rows)
    prints = collections.defaultdict(set)
    for r in got:
        prints[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    first = labels.where("doc_id % 3 <> 0")
    model = quality_model.fit(docs, first, rows=2000)
    held = quality_model.grade(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).where(F.length("text") > 60)
    rows = held.select("quality", "toxic", "graded.*").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    clean = np.mean([r.expected_grade for r in rows if r.quality == 1 and r.toxic == 0])
    toxic = np.mean([r.expected_grade for r in rows if r.quality == 1 and r.toxic == 1])
    assert clean > toxic > np.mean([r.expected_grade for r in rows if r.quality == 0])
    assert all(r.p_ge_1 >= r.p_ge_2 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in rows)


def test_quality_of_odd_rows(spark, sf, odd, no_rows):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels, rows=100)
    graded = quality_model.grade(odd, model)
    assert graded.columns == [*odd.columns, "graded"] and graded.count() == odd.count()
    assert graded.where("graded.kept IS NULL").count() == 0
    assert quality_model.keep_good(odd, model).columns == odd.columns
    unlabelled = quality_model.fit(no_rows, labels)
    assert quality_model.keep_good(odd, unlabelled).count() == odd.count()


NOTICE = re.compile(r"Released under the MIT License\.|GNU General Public License|Apache License, Version 2\.0|CC BY-NC 4\.0")
NAMES = {"Released under the MIT License.": "MIT", "GNU General Public License": "GPL", "Apache License, Version 2.0": "Apache-2.0", "CC BY-NC 4.0": "CC-BY-NC"}


def test_licences_are_those_in_the_texts(spark, sf):
    sf = sf.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_license_scans"](spark, sf).collect():
        assert r.families == ",".join(sorted({NAMES[m] for m in NOTICE.findall(texts[r.doc_id])}))
        for s in filter(None, r.spans.split(",")):
            _, a, b = s.rsplit(":", 2)
            assert NOTICE.search(texts[r.doc_id][int(a):int(b)])


def test_licence_model_knows_variants_and_strangers():
    others = ["the quick brown fox jumps over the lazy dog", "please read the instructions before use", "we grant nothing of the sort"] * 10
    model = license_scan.train(others)
    texts = ["x\nlicensed under the apache license, version 2.0\ny", "Permission is hereby granted, free of charge, to any person obtaining a copy",
             "My driving license expired in 2020", "", None, "token " * 3000, "first line\n\nlast line"]
    found = license_scan.scan_batch(pa.array(texts), model, 0.5, 0.6)
    assert [[f.family for f in row] for row in found] == [["Apache-2.0"], ["MIT"], [], [], [], [], []]
    assert (found[0][0].start, found[0][0].stop) == (2, 2 + len("licensed under the apache license, version 2.0"))


def test_licences_of_odd_rows(odd, no_rows):
    model = license_scan.fit(odd)
    got = license_scan.scan(odd, model)
    assert got.count() == odd.count() and got.where("licences IS NULL").count() == 0
    assert license_scan.scan(no_rows, license_scan.fit(no_rows)).collect() == []
