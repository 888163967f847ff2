"""Groups keep one row each, whatever keys repeat."""

import numpy as np
import pytest

from lakeops.llm import near_copies, simhash
from tests.llm.test_simhash import plain_print


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, near_copies.one_of_each])
def test_every_group_keeps_a_row_under_repeated_keys(spark, one_of_each):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(2000)]
    near = [*words[:-1], "other"]
    assert (plain_print(" ".join(words)) ^ plain_print(" ".join(near))).bit_count() <= 4
    b = " ".join(f"x{i}" for i in rng.integers(0, 10**6, 200))
    rows = [(3, " ".join(words)), (5, " ".join(near)), (5, b), (9, b), (5, b)]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, rows[0][1]), (5, b)])
