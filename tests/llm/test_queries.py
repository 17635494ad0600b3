import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize(
    "name",
    ["p2_found", "p2_restored", "p3_found", "p3_assign", "p5_subset", "p6_found", "p7_mixture", "p7_shares", "p8_found", "p8_statistics", "p8_rules"]
)
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_found_columns(spark):
    want = {
        "p2_found": "review_id bigint, field_name string", "p3_found": "review_id bigint",
        "p6_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint"
    }
    for name, cols in want.items():
        assert ", ".join(f"{c} {t}" for c, t in entry.queries()[name](spark, SMALL).dtypes) == cols
