"""Private keys are masked with their bodies."""

import base64
import re

import numpy as np

import corpus_pipeline
from lakeops.llm import secret_scan

BODY = base64.b64encode(np.random.default_rng(1).bytes(1000)).decode()
LINES = [BODY[i:i + 64] for i in range(0, len(BODY), 64)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
SEALED = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233\n\n"
CASES = [
    ("a\n" + "\n".join([BEGIN, *LINES, END]) + "\nb", "a\n[secret]\nb"),
    ("a " + "\r\n".join([BEGIN, *LINES, END]) + " b", "a [secret] b"),
    ("a\n" + "\n".join([BEGIN, *LINES]) + "\nb words", "a\n[secret]\nb words"),
    ("k='" + "\\n".join([BEGIN, *LINES, END]) + "\\n'", "k='[secret]\\n'"),
    (" ".join([BEGIN, *LINES, END]) + " b", "[secret] b"),
    (BEGIN + "\n" + SEALED + "\n".join([*LINES, END, BEGIN, *LINES, END]), "[secret]\n[secret]"),
    (BEGIN + " is how a key begins", "[secret] is how a key begins"),
    (BEGIN + "\n" + "\n".join(LINES * 3000) + "\nb words", "[secret]\nb words"),
]


def test_whole_keys_are_masked(spark, sf):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, docs, sf).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_python_reads_the_rule_alike():
    assert [re.sub(secret_scan.PEM_KEY, "[secret]", t, flags=re.A) for t, _ in CASES] == [want for _, want in CASES]
