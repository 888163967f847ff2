"""Registered queries over all documents against plain versions."""

import collections
import hashlib
import itertools

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakeops.llm import QUERIES, quality_model, secret_scan
from lakeops.llm.vocabularies import BYTE_BPE, WORD_BPE, path
from tests.llm.test_tokens import crc, plain_coders


@pytest.fixture
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_token_files(spark, sf, texts):
    rows = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, sf).collect()}
    assert rows.keys() == texts.keys()
    at = 0
    for k in sorted(texts):
        ids = plain_coders[BYTE_BPE](texts[k]) + [0]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_bpe_round_trip(spark, sf, texts):
    library = Tokenizer.from_file(path(BYTE_BPE))
    rows = {r.doc_id: r for r in QUERIES["op2_bpe_round_trip"](spark, sf).collect()}
    assert rows.keys() == texts.keys()
    for k, t in texts.items():
        ids = plain_coders[BYTE_BPE](t)
        said = library.decode(ids, skip_special_tokens=False)
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_packing(spark, sf, texts):
    pieces, layout = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op4_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        layout[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for k, t in texts.items():
        ids, at = plain_coders[WORD_BPE](t) + [2], 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    for k, parts in layout.items():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 4096 or k == max(layout))


def plain_tails(text, model):
    """P(grade >= 1), P(grade >= 2): words and their shapes by share of the text's words, word by word."""
    words = [w for w in text.encode().split()]
    words = [w.decode() for w in words]
    counts = collections.Counter()
    for i, w in enumerate(words):
        one, two = quality_model.word_features([w])[0].tolist()
        counts[one] += 1
        counts[two] += 1
        counts[quality_model.REPEAT] += i > 0 and words[i - 1] == w
    score = sum(float(model.weights[f]) * (n / len(words)) ** 0.5 for f, n in counts.items() if n)
    return [1 / (1 + np.exp(t - score)) for t in model.thresholds]


def test_quality_classifier(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1] and (model.weights != 0).any()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, sf).collect()}
    assert rows.keys() == texts.keys()
    for k, t in texts.items():
        one, two = plain_tails(t, model)
        assert np.allclose([rows[k].p_ge_1, rows[k].p_ge_2, rows[k].expected_grade], [one, two, one + two], atol=1e-4)
        assert rows[k].kept == (rows[k].p_ge_2 >= model.cut)


def test_a_kept_ledger_scans_only_what_is_new(spark, sf, fresh):
    spark.conf.set(secret_scan.LEDGER, fresh("ledger"))
    try:
        first = QUERIES["op10_secret_scans"](spark, sf).collect()
        ledger = secret_scan.BlobLedger(spark, secret_scan.ledger_path(spark, "reported"))
        scanned = ledger.scanned().count()
        again = QUERIES["op10_secret_scans"](spark, sf).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, first))
        assert ledger.scanned().count() == scanned > 0
    finally:
        spark.conf.unset(secret_scan.LEDGER)
