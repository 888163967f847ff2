"""The Jaccard join against all pairs."""

import re
from itertools import combinations

import numpy as np
import pytest

from lakeops.llm import QUERIES, crowds, jaccard_join
from tests.llm.test_simhash import plain_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i: i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_join(rows, percent=90):
    """Components over all pairs; rows are nodes."""
    sets, links = [plain_set(t) for _, t in rows], []
    for (i, a), (j, b) in combinations(enumerate(sets), 2):
        if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                links.append((i, j))
    roots = plain_components(range(len(rows)), links)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[roots[i]] = min(k, least.get(roots[i], k))
    return sorted(((k, len(s), least.get(roots[i])) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str), links


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        i = rng.integers(len(out))
        if rng.random() < 0.5:
            out[i] = f"n{rng.integers(10**9)}"
        else:
            out.insert(i, f"n{rng.integers(10**9)}") if rng.random() < 0.5 else out.pop(i)
    return out


def crowded_texts(rng):
    texts = [None, "", " \n", "one", "One", "two words", "TWO  words", "a b c", "a b c d"]
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 10**6, rng.integers(8, 300))]
        texts += [" ".join(words), *(" ".join(edited(words, e, rng)) for e in (1, 1, 2, 3, 6))]
    centre = [f"c{i}" for i in range(150)]
    texts += [" ".join(edited(centre, e, rng)) for e in (1, 2, 3) for _ in range(25)]
    common = " ".join(f"k{i}" for i in range(30))
    texts += [f"{common} " + " ".join(f"x{i}" for i in rng.integers(0, 10**6, 6)) for _ in range(60)]  # a passage that many share
    return texts


@pytest.mark.parametrize("options", [
    {}, {"parity_block": 7, "set_block": 5, "hot": 3},
    {"schemes": lambda counts, percent: [jaccard_join.Scheme(b, jaccard_join._uniform(d, -(-(d + 1) // 2))) for b in counts if (d := jaccard_join.most_apart(b, percent))]},
], ids=["planned", "small blocks and hot keys", "one element less"])
def test_components_are_those_of_all_pairs(spark, options):
    rows = list(enumerate(crowded_texts(np.random.default_rng(4))))
    rows += [(None, rows[20][1]), (None, "nobody's"), (3, rows[30][1]), (500, rows[9][1]), (500, "of the same key")]
    want, links = plain_join(rows)
    assert len(links) > 500
    docs = spark.createDataFrame([(k, t, "own", 1) for k, t in rows], "doc_id long, text string, fp string, n int").repartition(5)
    assert got(jaccard_join.similar(docs, **options)) == want


def test_query_is_all_pairs_over_all_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, links = plain_join(rows)
    assert len(links) > 50
    assert got(QUERIES["op13_ngram_jaccard_join"](spark, sf)) == want


def test_any_allocation_keeps_every_pair():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(9, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        out = int(rng.integers(0, n // 19 + 1))  # what is exchanged counts twice
        b = np.concatenate([a[out:], rng.integers(0, 2**63, out).astype(np.uint64)])
        if rng.random() < 0.5:
            b = a[: n - n // 10]
        a, b = np.unique(a), np.unique(b)
        if 10 * len(np.intersect1d(a, b)) < 9 * len(np.union1d(a, b)):
            continue
        bands = jaccard_join.band_of(np.array([len(a), len(b)]), 90)
        assert abs(bands[0] - bands[1]) <= 1
        apart = jaccard_join.most_apart(int(bands.min()), 90)
        m = int(rng.integers(-(-(apart + 1) // 2), apart + 4))
        thresholds = [-1] * m
        while sum(thresholds) + m < apart + 1:
            i = rng.integers(m)
            thresholds[i] = min(1, thresholds[i] + 1)
        keys = jaccard_join.Keys([jaccard_join.Scheme(int(bands.min()), tuple(thresholds))], int(bands.max()) + 1)
        owner, key, *_ = keys([a, b], bands)
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_parities_never_part_what_belongs_together():
    rng = np.random.default_rng(2)
    for n in (1, 30, 500, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.union1d(a[n // 20:], rng.integers(0, 2**63, n // 20).astype(np.uint64))
        p = crowds.parities([a, b])
        assert crowds._apart(p[:1], p[1:])[0, 0] <= len(np.setxor1d(a, b))


def test_a_crowd_costs_about_its_members(monkeypatch):
    """Members that the first one links are not compared with each other."""
    rng, calls = np.random.default_rng(3), []
    centre = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.union1d(np.delete(centre, rng.integers(400, size=4)), rng.integers(0, 2**63, 2).astype(np.uint64)) for _ in range(300)]
    real = np.intersect1d
    monkeypatch.setattr(crowds.np, "intersect1d", lambda *a, **k: calls.append(1) or real(*a, **k))
    labels = crowds.by_sets(np.array([len(s) for s in sets]), [s.tobytes() for s in sets], np.arange(300), np.full(300, -1), 90)
    assert not labels.any() and len(calls) < 2 * len(sets)


def test_rows_that_share_one_key_or_none_are_not_multiplied(spark):
    """One key, and no key, hold most rows, all near copies with texts of their own."""
    rng = np.random.default_rng(9)
    centre = [f"c{i}" for i in range(120)]
    rows = [(k, " ".join(edited(centre, 2, rng))) for k in [7] * 40 + [None] * 40] + [(1, " ".join(centre)), (2, "apart from all")]
    want, _ = plain_join(rows)
    seen, real = [], jaccard_join.lookup_join

    def counting(df, dim, keys, how="inner", salts=1):
        out = real(df, dim, keys, how, salts)
        if "hashes" in df.columns or "t" in df.columns:
            seen.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard_join, "lookup_join", counting)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(jaccard_join.similar(docs)) == want
    assert len(seen) == 2 and max(seen) <= len(rows)


def test_no_rows(spark, no_rows):
    assert got(jaccard_join.similar(no_rows)) == []
