"""The registered queries against SQL or, where SQL cannot say it, against what must hold of their results."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from vdjlake.llm import queries, tokens  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabulary files")
def test_every_document_is_encoded_and_packed(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()
    e = tokens.encoding()
    want = {d["doc_id"]: e.encode_ordinary(d["text"] or "") for d in docs}
    assert {r["doc_id"]: list(r["ids"]) for r in queries.p8_ids(spark, oracle.DATA).collect()} == want
    sizes: dict = {}
    fill: dict = {}
    for r in queries.p9_containers(spark, oracle.DATA).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["tokens"]
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert sizes == {k: len(v) for k, v in want.items()} and max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(map(len, want.values())) // 2048) + 2


def test_found_rows_are_distinct(spark):
    for name in ("p1_found", "p4_found", "p10_found"):
        df = queries.QUERIES[name](spark, oracle.DATA)
        rows = [tuple(r) for r in df.collect()]
        assert rows and len(rows) == len(set(rows)) and len(df.columns) == 2


def test_matches_have_confidence(spark):
    m = queries.p4_matches(spark, oracle.DATA).collect()
    assert m and all(0 < r["confidence"] < 1 and 1 <= r["rule"] <= 6 for r in m)


def test_percentiles_are_ordered(spark):
    p = queries.p7_percentiles(spark, oracle.DATA).orderBy("sample_file", "q").collect()
    assert p and all(a["value"] <= b["value"] for a, b in zip(p, p[1:]) if a["sample_file"] == b["sample_file"])
    assert all(r["low"] <= r["value"] <= r["high"] for r in p)
