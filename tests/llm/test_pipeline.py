import os
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from test_dedup import plain_groups, plain_lines
from test_tokens import check_packing

from strandlake.llm import queries

TABLES = "/root/testdata/sf0.001"


def test_each_stage_equals_a_plain_version(spark, awkward, tmp_path):
    docs = awkward
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, "")
        if name != "best_fit_packing":
            assert out.columns == awkward.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if name == "language_id":
            assert Counter(r["doc_id"] for r in after) == Counter(d for d, t in before if d is None or any(c.isalpha() for c in t or ""))
        elif name == "line_dedup":
            assert Counter((r["doc_id"], r["text"] or "") for r in after) == Counter((d, t) for (d, t, _, _), n in plain_lines(before).items() for _ in range(n))
            assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in after)
            assert any(r["n_chars"] is not None for r in after)
        elif name == "minhash_near_dedup":
            kept = {d for d, _, _, keep in plain_groups(before, 80) if keep and d is not None}
            assert Counter(r["doc_id"] for r in after if r["doc_id"] is not None) == Counter(kept)
        else:
            check_packing(after, before, 2048)


def test_columns_of_clashing_names_are_passed_on(spark, awkward):
    clashing = ["row", "ver", "keeps", "n_dropped", "n_lines", "__drops", "__n", "__salt", "__gone", "__rejected", "__id", "id", "host", "node", "shingles", "copy", "piece"]
    docs = awkward.drop("row", "h1", "size").selectExpr("*", *(f"'{c}!' as `{c}`" for c in clashing))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}!" for r in rows for c in clashing), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_empty_documents(spark, nothing):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        docs = out if name != "best_fit_packing" else docs


def test_names():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    df = queries.queries()[name](spark, TABLES)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
