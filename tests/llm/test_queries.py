"""The queries over the smallest tables."""

import os

import pytest

from labloom.llm import queries

NAMES = queries.queries()


@pytest.mark.parametrize("name", sorted(NAMES))
def test_runs(spark, small, name):
    if not os.path.isdir("/opt/tokenizers") and name[:2] in ("p6", "p7"):
        pytest.skip("no vocabulary files here")
    df = NAMES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_columns(spark, small):
    want = {
        "p2_found": "observation_id string, candidate_code string", "p3_found": "row_id string, field_name string", "p5_found": "observation_id string, field_name string",
        "p6_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id bigint, span_start bigint, span_end bigint",
    }
    for name, columns in want.items():
        assert ", ".join(" ".join(c) for c in NAMES[name](spark, small).dtypes) == columns
