"""Near copies of the pipeline's stage against exact similarity."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from lakeops.llm import crowds, near_copies
from tests.llm.test_models_and_sketches import shingles
from tests.llm.test_simhash import plain_components, plain_print


def edited(words, share, rng):
    out = list(words)
    for i in rng.choice(len(out), int(len(out) * share), replace=False).tolist():
        out[i] = f"new{rng.integers(10**9)}"
    return out


def exact_groups(texts):
    """Groups, and the similarity of each pair that links."""
    sets, links = [shingles(t) for t in texts], {}
    for (i, a), (j, b) in combinations(enumerate(sets), 2):
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both):
                links[i, j] = both / (len(a) + len(b) - both) if a else 1.0
    return plain_components(range(len(texts)), links), links


@pytest.mark.parametrize("block", [1024, 7])
def test_groups_are_those_of_exact_similarity(spark, block):
    rng = np.random.default_rng(11)
    texts = [None, "", " ", "a b c", "A  b c", "a b d"]
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 10**6, rng.integers(150, 400))]
        texts += [" ".join(words), " ".join(edited(words, 0.02, rng)), " ".join(edited(words, 0.03, rng))]
    centre = [f"c{i}" for i in range(300)]
    texts += [" ".join(edited(centre, 0.01, rng)) for _ in range(30)]  # a crowded group, larger than the smaller block
    roots, links = exact_groups(texts)
    assert sum(x < 0.9 for x in links.values()) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(docs, block=block).collect()}
    first = {}
    assert {k: first.setdefault(c, k) for k, c in sorted(got.items())} == roots


def test_stage_leaves_no_pair_of_near_copies(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    roots, links = exact_groups([texts[k] for k in order])
    pairs = [p for p, x in links.items() if x < 1]
    assert len(pairs) >= 5 and any((plain_print(texts[order[i]]) ^ plain_print(texts[order[j]])).bit_count() > 4 for i, j in pairs)
    kept = {r.doc_id for r in corpus_pipeline.one_per_group(spark, docs, sf).collect()}
    assert kept == {order[r] for r in roots.values()}


def test_pairs_of_the_bound_are_compared_whatever_their_minima(spark):
    """Sizes and parities alone rule pairs out."""
    rng = np.random.default_rng(5)
    for n in (10, 100, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.union1d(a[n // 9:], rng.integers(0, 2**63, n // 9 // 2).astype(np.uint64))
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        labels = crowds.by_sets(np.array([len(a), len(b)]), [a.tobytes(), b.tobytes()], np.arange(2), np.full(2, -1), 80)
        assert (labels[1] == 0) == (alike >= 0.8) and alike >= 0.8


def test_crowds_are_not_copied_by_block(spark):
    """Of a crowd of near copies, rows are compared in their own block and as heads, not in all pairs of blocks."""
    seen = []
    rng = np.random.default_rng(6)
    centre = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    rows = [(7, i, 100, np.sort(np.concatenate([centre[1:], [np.uint64(i)]])).tobytes()) for i in range(600)]
    members = spark.createDataFrame(rows, "root long, node long, n long, payload binary")
    run = crowds.compared(crowds.by_sets, 80)
    links = crowds.components(crowds.crowd_links(members, lambda r: (seen.append(r.count()), run(r))[1], 10)).collect()
    assert len(links) == 599 and {r.root for r in links} == {0}
    assert sum(seen) <= 600 + 60 * 7  # all pairs of 60 blocks would be 36,000 rows


def test_stage_links_simhash_fingerprints(spark, monkeypatch):
    """Fingerprints at most 4 bits apart are candidates of their own, bands or not; similarity decides."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(f"v{i}" for i in range(400)), ""]
    assert (plain_print(texts[0]) ^ plain_print(texts[1])).bit_count() <= 4
    seen, links = [], near_copies.near_links
    monkeypatch.setattr(near_copies, "near_links", lambda points, distance: (seen.append((points.count(), distance)), links(points, distance))[1])
    monkeypatch.setattr(near_copies, "band_keys", lambda sets: np.arange(len(sets) * near_copies.BANDS).reshape(-1, near_copies.BANDS) * 1009 + len(sets[0]) if sets else np.zeros((0, near_copies.BANDS), np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = corpus_pipeline.one_per_group(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert seen == [(3, 4)]
