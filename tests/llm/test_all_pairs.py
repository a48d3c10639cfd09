import duckdb

import __spark_entry__ as entry


def test_pairs_of_few_records_are_kept(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW master_mesh_annotations AS SELECT * FROM '{folder}/master_mesh_annotations.parquet'")
    df = entry.queries()["p4_pairs"](spark, folder)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()['p4_pairs']})").fetchall()
    got = list(map(tuple, df.select(*cols).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    at = cols.index("n_ab")
    assert any(r[at] < 5 for r in got)
