import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions.terms import heading_of
from termloom.operators.packed import explode_packed, headings, packed_lists, split_array


def split_terms_slowly(field):
    """Character by character, as a check."""
    if field is None or field.strip().lower() in ("nan", "null", "-", "[]"):
        return []
    quotes = [i for i, c in enumerate(field) if c == '"']
    lone = quotes[-1] if len(quotes) % 2 else -1
    pieces, cur, inside, closed = [], "", False, False
    for i, c in enumerate(field):
        follows = i + 1 < len(field) and field[i + 1] == " "
        if c == '"' and i != lone:
            inside, closed = not inside, True
            cur += c
            continue
        if not inside and (c in ";|\t\n\r" or (c == "," and (closed or not follows))):
            pieces.append(cur)
            cur = ""
        else:
            cur += c
        closed = False
    pieces.append(cur)
    out = []
    for p in pieces:
        p = p.strip()
        if len(p) > 1 and p[0] == p[-1] == '"' and '"' not in p[1:-1].replace('""', ""):
            p = p[1:-1].replace('""', '"').strip()
        if p:
            out.append(p)
    return out


def values(arr, kind="terms"):
    parent, pos, vals = split_array(pa.array(arr, pa.string()), kind)
    out = [[] for _ in arr]
    for p, k, v in zip(parent, pos, vals.to_pylist(), strict=True):
        out[p].append(v)
        assert k == len(out[p])
    return out


def test_examples():
    fields = ['A;B|C\tD\nE\r\nF', '"*Peptides; X, Cyclic";Dermatosis, T', '"a", "b","c"', "x,y, z", '"Receptors, ""Orphan"" Q";*R/s', "", None, " ; ", "nan", "[]", '""', 'a"b', "NULL", "-"]
    assert values(fields) == [["A", "B", "C", "D", "E", "F"], ["*Peptides; X, Cyclic", "Dermatosis, T"], ["a", "b", "c"], ["x", "y, z"], ['Receptors, "Orphan" Q', "*R/s"], [], [], [], [], [], [], ['a"b'], [], []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='ab;|,\t\n" é*', max_size=14)), max_size=6))
def test_against_slow_splitter(fields):
    assert values(fields) == [split_terms_slowly(f) for f in fields]


def test_numbers():
    fields = ["1;2", "['10', '20']", "PMID:5; PMID:6", "10.0;20.0", " ; ", None, "nan", "7 8\t9|10", "[]", "1.", ".5"]
    assert values(fields, "numbers") == [["1", "2"], ["10", "20"], ["5", "6"], ["10", "20"], [], [], [], ["7", "8", "9", "10"], [], ["1"], ["5"]]


def test_rows_of_a_slice_do_not_run_together():
    arr = pa.array(["1", "2", "", "3;4", "5"]).slice(1)
    assert split_array(arr, "numbers")[2].to_pylist() == ["2", "3", "4", "5"]


def test_long_field_and_repeats(spark):
    long = ";".join(f"t{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, long, "x"), (1, "a;a", "x"), (2, None, None), (3, "", "y")], "k int, packed string, val_other string")
    got = explode_packed(df, {"packed": "terms"}, ["k"])
    assert got.columns == ["k", "field_name", "pos", "val"]
    assert got.count() == 50_002
    assert got.where("k = 1 and pos <= 2").count() == 4


def test_empty_table_and_lists(spark):
    empty = spark.createDataFrame([], "k int, packed string")
    assert explode_packed(empty, {"packed": "terms"}, ["k"]).count() == 0
    df = spark.createDataFrame([(1, "a;b"), (2, None), (3, " ")], "k int, packed string")
    assert {r.k: r.vals for r in packed_lists(df, "packed", "terms", ["k"]).collect()} == {1: ["a", "b"], 2: None, 3: []}


@pytest.mark.parametrize("kind", ["terms", "numbers"])
def test_all_null_batch(kind):
    assert values([None, None], kind) == [[], []]


def test_headings_of_arrays_equal_the_column_expression(spark):
    r = random.Random(3)
    toks = ["".join(r.choices(" \t\n*/aB,\"é\xa0\u2003\u3000-", k=r.randint(0, 12))) for _ in range(3000)]
    want = [x["h"] or "" for x in spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "i int, t string").select("i", heading_of(F.col("t")).alias("h")).orderBy("i").collect()]
    assert headings(pa.array(toks)).to_pylist() == want
