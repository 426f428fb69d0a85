"""Every query of the sequence engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandlake.plans import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables aren't here")


def canonical(rows):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["seq_normalize", "dummy_nodes", "colex_rank", "lcs_array", "left_extend", "matching_statistics", "ext_run", "tokenize", "token_pack", "zip_streams", "rice_param_size", "minbin_size", "roundtrip"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    df = registry.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(want.columns) == columns
    rows = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert canonical(df.select(columns).collect()) == canonical(rows)


def test_every_query_has_sql_or_a_reason():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"random_nucleotide"}


def equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    df = registry.queries()[name](spark, TABLES)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    rows = df.select(*want.columns).collect()
    assert canonical(rows) == canonical(want.fetchall())
    return rows


@pytest.mark.parametrize("name", ["pack_2bit", "unpack_2bit"])
def test_packing_covers_whole_reads(spark, name):
    rows = equals_sql(spark, name)
    lengths = [len(r["seq"]) for r in registry.reads(spark, TABLES).collect()]
    assert max(lengths) > 31
    if name == "pack_2bit":
        assert len(rows) == sum(-(-n // 31) for n in lengths)
    else:
        assert sum(len(r["bases"]) for r in rows) == sum(lengths)


def test_suffix_intervals_of_every_length(spark):
    assert {len(r["suffix"]) for r in equals_sql(spark, "suffix_interval")} == set(range(1, registry.K + 1))
