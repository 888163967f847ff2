"""The pipeline against a brute-force version of its stages."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lakeops.llm import quality_model, quality_rules, secret_scan
from tests.llm.test_near_copies import exact_groups
from tests.llm.test_rules_and_urls import plain_measures, plain_spans
from tests.llm.test_tokens import WORD_BPE, crc, plain_coders


def plain_keeps(text):
    m = plain_measures(text)
    return not any(eval(condition, {}, m) for _, condition in quality_rules.RULES)


def plain_masked(text):
    """All kinds of secrets masked, private keys with their bodies."""
    pem = [k for k, r in enumerate(secret_scan.RULES) if r.kind == "pem"]
    spans = [(a, b) for a, k, b in plain_spans(text) if k not in pem] + [m.span() for m in re.finditer(secret_scan.PEM_KEY, text, re.A)]
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def plain_pipeline(rows, model):
    rows = sorted((k, t) for k, t in rows if plain_keeps(t))
    tails = model.tails(model.score(pa.array([t for _, t in rows], pa.large_string())))
    rows = [r for r, p in zip(rows, tails[:, -1]) if p >= model.cut]
    roots, _ = exact_groups([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    return {k: plain_coders[WORD_BPE](plain_masked(t)) + [2] for k, t in rows}


def test_pipeline_is_its_stages_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = quality_model.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = plain_pipeline(rows, model)
    pieces = collections.defaultdict(list)
    layout = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id].append(r)
        layout[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for k, ids in want.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    for k, parts in layout.items():
        parts.sort()
        ends = np.cumsum([n for _, n in parts]).tolist()
        assert [o for o, _ in parts] == [0, *ends[:-1]]
        assert ends[-1] == 4096 or k == max(layout)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf, odd, no_rows):
    extra = odd.unionByName(odd.limit(0)).withColumnRenamed("part", "blob")
    for docs in (extra, no_rows):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, docs, sf)
            assert done.columns == columns, name
            assert done.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_clean_documents_stay_in_the_filters(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r.doc_id for r in docs.collect() if labels.get(r.doc_id) == (1, 0) and len(r.text.split()) >= 25}
    junk = {r.doc_id for r in docs.collect() if labels.get(r.doc_id, (1,))[0] == 0 and len(r.text.split()) >= 25}
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = {r.doc_id for r in stage(spark, docs, sf).collect()}
        assert len(clean & kept) > 0.99 * len(clean), name
        assert len(junk & kept) < 0.1 * len(junk), name


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_are_named(name):
    assert name in ("quality_rules", "quality_classifier", "simhash_near_dedup", "secret_scans", "packing")
