"""The licence model on notices that it has not seen, on phrases that tell nothing, and on wrapped paragraphs."""

import textwrap

import numpy as np
import pyarrow as pa
import pytest

from lakeops.llm import license_scan
from lakeops.llm.licence_notices import CARRIERS, NAMES, TEMPLATES

PROSE = [
    "the quick brown fox jumps over the lazy dog", "please read the instructions before use", "we grant nothing of the sort",
    "a list of conditions for the trip to the coast", "the work was done in the spring of that year", "he may use any of the tools in the shed",
]


@pytest.fixture(scope="module")
def model():
    return license_scan.train(PROSE)


def found(model, *texts, least=0.3):
    return [[f.family for f in row] for row in license_scan.scan_batch(pa.array(texts, pa.string()), model, least, 0.6)]


def test_every_notice_is_of_its_family(model):
    for family, notices in TEMPLATES.items():
        for got in found(model, *notices):
            assert got in ([family], []), (family, got)
        assert found(model, *notices).count([]) <= len(notices) // 5


def test_neighbours_are_told_apart(model):
    want = {
        "licensed under the GNU Affero General Public License, version 3": "AGPL",
        "is licensed under the GNU Lesser General Public License": "LGPL",
        "Eclipse Public License, Version 2.0": "EPL-2.0",
        "SPDX-License-Identifier: ISC": "ISC",
        "Licensed under CC BY-SA 4.0": "CC-BY-SA",
        "Licensed under CC BY 4.0": "CC-BY",
    }
    assert found(model, *want) == [[f] for f in want.values()]


@pytest.mark.parametrize("phrase", [
    "under the terms of the", "is licensed under the", "General Public License", "version 3", "of the License", "all rights reserved",
    "My driving license expired in 2020", "this software is licensed under the terms of the agreement", "Distributed under the Boost Software License, Version 1.0.",
])
def test_phrases_that_tell_nothing(model, phrase):
    assert found(model, phrase, f"{phrase} and so it was", f"x\n{phrase}\ny") == [[], [], []]


def test_probabilities_hold_for_notices_not_seen(model):
    e = license_scan.examples(PROSE)
    scores = license_scan.held_out_scores(e)
    named = np.array([any(c.format(n) == t for n in NAMES[license_scan.FAMILIES[k]] for c in CARRIERS) if k else False
                      for t, k in zip(e.texts, e.kinds.tolist())])
    right = scores.argmax(axis=1) == e.kinds
    assert right[named].mean() > 0.9 and right[e.kinds == 0].mean() > 0.6
    assert model.calibration_error < 0.12


def test_wrapped_paragraphs_are_one_finding(model):
    notice = TEMPLATES["MIT"][1]
    wrapped = textwrap.fill(notice, 50)
    commented = textwrap.indent(textwrap.fill(TEMPLATES["Apache-2.0"][1], 50), "# ", lambda line: True)
    texts = [f"Title\n\n{wrapped}\n\nrest of it", f"é\n\n{commented}\n#\nimport this", "Released under the MIT License.\nLicensed under CC BY-SA 4.0."]
    got = license_scan.scan_batch(pa.array(texts), model, 0.3, 0.6)
    assert [[f.family for f in row] for row in got] == [["MIT"], ["Apache-2.0"], ["MIT", "CC-BY-SA"]]
    for text, part, row in zip(texts, (wrapped, commented), got):
        assert text[row[0].start:row[0].stop] == part and row[0].line == 2


def test_lines_around_a_notice_are_not_part_of_it(model):
    notice = textwrap.fill(TEMPLATES["ISC"][0], 60)
    text = f"tools\nlib\n{notice}\nimport this"
    (finding,), = license_scan.scan_batch(pa.array([text]), model, 0.3, 0.6)
    assert finding.family == "ISC" and text[finding.start:finding.stop] == notice


def test_a_line_within_other_lines_is_found_alone(model):
    text = "\n".join([PROSE[0], PROSE[3], "Licensed under the BSD 3-Clause License.", PROSE[4], PROSE[1]])
    (finding,), = license_scan.scan_batch(pa.array([text]), model, 0.3, 0.6)
    assert finding.family == "BSD" and text[finding.start:finding.stop] == "Licensed under the BSD 3-Clause License."


def test_sums_of_lines_are_those_of_the_paragraph(model):
    lines = pa.array(["Permission is hereby granted,", "free of charge, to", "any person # obtaining"], pa.large_string())
    g = license_scan.grams(lines)
    whole = license_scan.grams(pa.array(["\n".join(lines.to_pylist())], pa.large_string()))
    bridges = license_scan._pair(g.last[:-1], g.first[1:])
    joined = model.sums(g).sum(axis=0) + model.weights[:, bridges].sum(axis=1)
    assert np.allclose(joined, model.sums(whole)[0], atol=1e-4) and g.size.sum() == whole.size[0]


def test_odd_texts(model):
    texts = [None, "", "\n\n", "#\n*\n", "token " * 3000, "MIT", "first line\n\nlast line", "a\n" * 2000]
    assert found(model, *texts) == [[]] * len(texts)
    assert license_scan.scan_batch(pa.array([], pa.string()), model, 0.3, 0.6) == []
    assert found(license_scan.train([]), "Released under the MIT License.") == [["MIT"]]
