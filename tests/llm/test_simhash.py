"""Fingerprints, the pigeonhole index and components against brute force."""

import re
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lakeops.llm import simhash
from lakeops.llm.components import components
from lakeops.llm import QUERIES
from tests.llm.conftest import ODD


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_groups(rows, distance=4):
    prints = {(k, t): plain_print(t) for k, t in rows}
    first = {}
    for (k, t), p in prints.items():
        if k is not None:
            first[p] = min(k, first.get(p, k))
    values = np.array(list(first), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    links = [(first[int(values[i])], first[int(values[j])]) for i, j in zip(*np.nonzero(near))]
    roots = plain_components(set(first.values()), links)
    return sorted(((k, f"{p:016x}", roots[first[p]] if p in first else None) for (k, t) in rows for p in [prints[k, t]]), key=str)


def test_fingerprints_are_the_definition():
    texts = ODD + ["A b C d E f G", "one two three four", " ".join(map(str, range(400)))]
    assert simhash.fingerprint_batch(pa.array(texts)).tolist() == [plain_print(t) for t in texts]


def test_query_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op9_simhash_near_dedup"](spark, sf)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == plain_groups(rows)


def test_odd_rows(odd, no_rows):
    got = simhash.near_duplicates(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got), key=str) == plain_groups(rows)
    assert simhash.near_duplicates(no_rows).collect() == []


def crowd(n, seed, spread):
    """Fingerprints around a few centres, so that keys are shared by many."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 4, np.uint64)
    out = set()
    while len(out) < n:
        flips = rng.choice(64, rng.integers(0, spread + 1), replace=False)
        out.add(int(centres[rng.integers(4)]) ^ sum(1 << int(b) for b in flips))
    return sorted(out)


@pytest.mark.parametrize("n, spread, distance, block", [(600, 5, 4, 16), (600, 14, 4, 1024), (300, 9, 2, 50), (400, 12, 7, 100)])
def test_links_connect_what_all_pairs_connect(spark, n, spread, distance, block):
    values = crowd(n, n + spread, spread)
    points = spark.createDataFrame([(i, v - (v >> 63 << 64)) for i, v in enumerate(values)], "id long, fp long")
    links = [(r.a, r.b) for r in simhash.near_links(points, distance, block).collect()]
    all_pairs = [(i, j) for i, j in combinations(range(n), 2) if (values[i] ^ values[j]).bit_count() <= distance]
    assert plain_components(range(n), links) == plain_components(range(n), all_pairs)


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(3)
    for parts in (2, 3, 4):
        costs = [[0.0, *rng.random(5).cumsum()] for _ in range(parts)]
        valid = [t for t in product(range(6), repeat=parts) if sum(t) == 5]
        cost, chosen = simhash.allocate(costs, 4)
        assert sum(k + 1 for k in chosen) == 5
        assert cost == pytest.approx(min(sum(c[k] for c, k in zip(costs, t)) for t in valid))


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (500, 64))
    base[:, 40:44] = base[:, :1]
    values = (base.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    groups = simhash.group_bits(values, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({0, 40, 41, 42, 43} <= set(g) for g in groups)


def test_thresholds_follow_crowding():
    values = np.array(crowd(800, 1, 3), np.uint64)
    partitions = simhash.plan(values, 10**9, 4)
    assert sum(k + 1 for _, k in partitions) == 5


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(7)
    n = 300
    if shape == "path":
        order = rng.permutation(n).tolist()
        links = list(zip(order, order[1:]))
    elif shape == "star":
        links = [(299, i) for i in range(0, 299, 2)] + [(298, i) for i in range(1, 298, 2)]
    else:
        links = rng.integers(0, n, (200, 2)).tolist()
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components(range(n), links)
    assert {k: got.get(k, k) for k in range(n)} == want


def test_one_of_each(spark, odd, no_rows):
    more = spark.createDataFrame([(3, "another text under a key that is taken", "x", "y"), (3, "twice the key", "x", "y")], odd.schema)
    docs = odd.unionByName(more)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = {(int(p, 16), k): c for k, p, c in plain_groups(rows)}
    want = {(k, plain_print(t)) for k, t in rows if k is not None and groups[plain_print(t), k] == k}
    got = [(r.doc_id, plain_print(r.text)) for r in kept.collect() if r.doc_id is not None]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert simhash.one_of_each(no_rows).collect() == []
