import os

import pytest

from loomwork.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
COLUMNS = {
    "p1_found": ["chunk_id"], "p2_found": ["chunk_id", "symbol"], "p3_found": ["rec_a", "rec_b"], "p4_found": ["rec_a", "rec_b"],
    "p5_found": ["result_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        keys = [tuple(map(str, r)) for r in rows]
        assert len(keys) == len(set(keys))
    if name == "p6_chunked":
        whole = {r["doc_id"]: r["ids"] for r in QUERIES["p6_ids"](spark, SMALL).collect()}
        assert {r["doc_id"]: r["ids"] for r in rows} == whole and any(len(x) > 300 for x in whole.values())
    if df.columns[:2] == ["rec_a", "rec_b"]:
        assert all(r["rec_a"] < r["rec_b"] for r in rows)


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
