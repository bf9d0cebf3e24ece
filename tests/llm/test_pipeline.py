"""The pipeline on the smallest sample, stage by stage and as a whole."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from riskloom.llm import exact_dedup, queries
from riskloom.llm.tables import documents
from riskloom.session import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are missing")


def test_stages_keep_columns_and_pass_on_what_they_keep(spark):
    docs = documents(spark, SF)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert exact_dedup.deduplicate(docs).count() == counts[-1]


def test_run_returns_gapless_sequences(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert rows and max(ends.values()) <= 2048


def test_exact_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE['op8_exact_dedup']})").fetchall()
    assert sorted(map(tuple, queries.QUERIES["op8_exact_dedup"](spark, SF).select(*columns).collect())) == sorted(expected)
