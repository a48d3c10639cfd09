import __spark_entry__ as entry

CHECKED = ["scan_project", "p2_found", "p6_found", "parse_terms", "annotate_articles", "stopword_tag", "citation_expand"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_some_queries_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pmids_table", "master_mesh_annotations", "mesh_stats_df", "mesh_terms"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in CHECKED:
        df = entry.queries()[name](spark, folder)
        cols = sorted(df.columns)
        q = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, q)), name


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_without_the_llm_folder():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "termloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "termloom.llm" not in p.read_text(), p
