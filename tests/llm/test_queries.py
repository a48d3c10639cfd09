import __spark_entry__ as entry


def test_every_problem_has_its_query():
    names = entry.queries()
    for n in range(1, 11):
        assert f"p{n}_found" in names or f"p{n}_ids" in names
    assert set(entry.oracle_sql()) <= set(names)
