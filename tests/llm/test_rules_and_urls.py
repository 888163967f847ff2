"""Quality rules, URL filters, secrets, and the queries that have SQL."""

import collections
import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeops.llm import ORACLES, QUERIES
from lakeops.llm import quality_rules as rules
from lakeops.llm import secret_scan as secrets
from lakeops.llm import url_filters as urls
from tests.llm.conftest import ODD
from tools.compare import TABLES, rows_of


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_is_its_sql(spark, sf, key):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df = QUERIES[key](spark, sf)
    want = db.sql(ORACLES[key])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)


# --- quality rules ---------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper_words": sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words),
        "n_twice_words": sum(a == b for a, b in zip(words, words[1:])),
    }


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#", max_size=120)), max_size=5))
def test_measures(texts):
    assert rules.measure_batch(pa.array(texts, pa.string())).to_pylist() == [plain_measures(t) for t in texts]


def test_measures_of_odd_texts():
    texts = [*ODD, "w " * 5000, "a b c d e f g h " * 3]
    assert rules.measure_batch(pa.array(texts)).to_pylist() == [plain_measures(t) for t in texts]


def test_ledger_policies_and_ablation(spark, odd, no_rows):
    entries = rules.judge(rules.ledger(odd))
    rows = entries.collect()
    assert len(rows) == odd.count()
    for r in rows:
        for p in rules.POLICIES:
            assert r[f"kept_{p.version}"] == (r.failed & p.mask == 0)
    for r in rules.ablation(entries).collect():
        bit = rules.mask_of((r.rule,))
        assert r.n_failed == sum(bool(x.failed & bit) for x in rows)
        assert r.n_only == sum(x.failed & rules.CURRENT.mask == bit for x in rows)
    kept = rules.keep_passing(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r[f"kept_{rules.CURRENT.version}"] for r in rows)
    assert rules.ledger(no_rows).collect() == [] and rules.keep_passing(no_rows).collect() == []


def test_good_documents_pass_and_junk_fails(spark, sf):
    sf = sf.replace("0.001", "0.01")
    kept = QUERIES["op5_quality_rules"](spark, sf).where("n_words >= 25").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    shares = {r.quality: r.share for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.1


# --- URL filters -----------------------------------------------------------------------------------------


def fits(glob, host, path):
    pattern = lambda s: re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in s), re.S)
    return bool(pattern(glob.host).fullmatch(host) and pattern(glob.path).fullmatch(path))


HOSTS = st.text(alphabet="ab.", max_size=8)
GLOB_PARTS = st.text(alphabet="ab.*?", max_size=7)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(GLOB_PARTS, GLOB_PARTS), min_size=1, max_size=20), st.lists(st.tuples(HOSTS, HOSTS), max_size=6))
def test_automaton_is_the_pattern(globs, parts):
    globs = [urls.Glob("block", h, p) for h, p in globs]
    automaton = urls.Automaton([g.glob() for g in globs])
    got = automaton.match([b"." + h.encode() + urls.EDGE + p.encode() for h, p in parts])
    assert got.tolist() == [[fits(g, h, p) for g in globs] for h, p in parts]


def test_hosts_paths_and_verdicts(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "nothing": ("", "", None, "allow"),
        "http://a.NET/x": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"),
        "http://net/": ("net", "/", "net/", "block"), "http://planet/": ("planet", "/", None, "allow"),
        "https://m.Example.net/en/25#top": ("m.example.net", "/en/25", "example.net/en/", "allow"),
        "https://example.com/de/?a=/b": ("example.com", "/de/", "example.com/de/", "block"),
        "x://a.org?u=://b.net/": ("a.org", "", None, "allow"), "x://y.org/fr/ü": ("y.org", "/fr/ü", "org/fr/", "allow"),
        "http://my-spam.org/en": ("my-spam.org", "/en", None, "block"), "http://a.com/x.net/": ("a.com", "/x.net/", None, "allow"),
        "http://a.com/setup.exe?x": ("a.com", "/setup.exe", None, "block"), "http://a.net#/": ("a.net", "", None, "allow"),
        "http://" + "a" * 5000 + ".net/": ("a" * 5000 + ".net", "/", "net/", "block"),
    }
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = urls.judge_urls(df.unionByName(df.limit(1))).collect()
    assert len(got) == len(cases) + 1
    by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert [by_id[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge_urls(df.limit(0)).collect() == []


# --- secrets ---------------------------------------------------------------------------------------------

SAMPLE = [
    None, "", "no secret here: token", 'Password = "abcdef" and password: abc', "api_key=ABCDEFG apikey:'x.y-z_12' APIKEY= 123456",
    "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 15 + " AKIA12", "f" * 24 + " " + "a" * 23, "é🙂 token = 24be64439e3e49cf46b2d7c90f3602a3",
    "token==a secret=bbbbbb", "ghp_" + "a1" * 18, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "-----BEGIN RSA PRIVATE KEY-----",
    "token=aaaaaa" * 300, "same token=zzzzzz", "same token=zzzzzz", "secret:\tnotblank", "PASSWD:" + "x" * 30000,
]


def plain_spans(text, rules_=secrets.RULES):
    found = []
    for k, r in enumerate(rules_):
        pattern = r.pattern.replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")
        for m in re.finditer(pattern, text or "", re.A):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def contract_spans(text):
    text, found = text or "", []
    for k, (pattern, group, least) in enumerate([
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24),
    ]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "blob", 7) for i, t in enumerate(texts)] + [(None, "secret=keyless", "x", 1), (2, "token=repeated", "y", 1)],
                                 "doc_id long, text string, blob string, spans int").repartition(3)


def test_spans_are_the_definition(spark, fresh):
    docs = frame(spark, SAMPLE)
    ledger = secrets.BlobLedger(spark, fresh("ledger"))
    got = collections.Counter((r.path, tuple((s.start, s.kind, s.stop) for s in r.spans)) for r in ledger.report(ledger.update(docs)).collect())
    assert got == collections.Counter((r.doc_id, tuple(plain_spans(r.text))) for r in docs.collect())
    for t in SAMPLE:
        assert [s for s in plain_spans(t) if s[1] < 3] == contract_spans(t)


def test_only_new_pairs_are_scanned(spark, fresh):
    where = fresh("ledger")
    ledger = secrets.BlobLedger(spark, where, secrets.BASE)
    ledger.update(frame(spark, SAMPLE[:10]))
    assert ledger.todo(spark.read.parquet(f"{where}/runs/00000000/versions")).count() == 0
    versions = ledger.update(frame(spark, SAMPLE[:12]))
    todo = spark.read.parquet(f"{where}/runs/00000001/todo")
    assert todo.count() == 2
    raised = secrets.BlobLedger(spark, where, (secrets.Rule("assign", secrets.ASSIGN, 8, 2, secrets.BASE[0].gates, True, version=2), *secrets.BASE[1:]))
    versions = raised.update(frame(spark, SAMPLE[:12]))
    todo = spark.read.parquet(f"{where}/runs/00000002/todo")
    assert {tuple(r.todo) for r in todo.collect()} == {("assign@2",)}
    want = [sum(1 for m in re.finditer(secrets.ASSIGN.replace("(?i)password|passwd|secret|token|api_?key", "(?i:password|passwd|secret|token|api_?key)"), t or "") if len(m[2]) >= 8) for t in SAMPLE[:12]]
    got = {r.path: sum(s.kind == 0 for s in r.spans) for r in raised.report(versions).collect() if r.path is not None and r.path != 2}
    assert [got[i] for i in range(12) if i != 2] == [w for i, w in enumerate(want) if i != 2]


def test_an_unfinished_run_counts_for_nothing(spark, fresh):
    where = fresh("ledger")
    ledger = secrets.BlobLedger(spark, where)
    ledger.update(frame(spark, SAMPLE))
    before = sorted(map(str, ledger.spans().collect()))
    secrets.Store(spark).delete(f"{where}/runs/00000000/scanned")  # as if the run had died before its last table
    assert ledger.findings().count() == 0
    ledger.update(frame(spark, SAMPLE))
    assert sorted(map(str, ledger.spans().collect())) == before


def plain_redacted(text):
    out, at = [], 0
    for start, _, stop in plain_spans(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_redaction(spark, fresh, no_rows):
    docs = frame(spark, SAMPLE)
    done = secrets.scan_and_redact(docs, secrets.BlobLedger(spark, fresh("ledger")))
    assert done.columns == docs.columns
    assert collections.Counter(tuple(r) for r in done.collect()) == collections.Counter(
        (r.doc_id, r.text and plain_redacted(r.text), r.blob, r.spans) for r in docs.collect())
    assert secrets.scan_and_redact(no_rows, secrets.BlobLedger(spark, fresh("ledger"))).collect() == []


def test_digest_columns(spark, sf):
    for r in QUERIES["op10_secret_scans"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        base = contract_spans(r.text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        names = ["assign", "access", "hex"]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_secret_scan_runs_no_python(spark, sf):
    plan = QUERIES["op10_secret_scans"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
