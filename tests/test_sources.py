from datetime import date, timedelta

import pytest

from termloom.operators import network
from termloom.sources import graph_json, search, vocab_files
from termloom.sources.search import SearchError
from termloom.sources.tables import validate_columns

FIRST = date(2024, 1, 1)
DAYS = {FIRST + timedelta(days=i): [1000 * i + j for j in range((i * 7) % 5 + (40 if i == 9 else 0))] for i in range(20)}


class FakeIndex:
    calls = 0

    def count(self, term, first, last):
        return len(self.ids(term, first, last, 10**9))

    def ids(self, term, first, last, limit):
        FakeIndex.calls += 1
        if FakeIndex.calls == 2:
            raise search.SearchError("busy", 503)
        return [str(i) for d, ids in DAYS.items() if first <= d <= last for i in ids][:limit]


def test_bisection_covers_every_day():
    got = search.bisect_days([(d, len(v)) for d, v in DAYS.items()], 10)
    assert [g[0] for g in got[1:]] == [g[1] + timedelta(days=1) for g in got[:-1]]
    assert all(n <= 10 or over and a == b for a, b, n, over in got) and sum(g[2] for g in got) == sum(map(len, DAYS.values()))
    assert search.bisect_days([], 10) == []


def test_retries():
    waits, failures = [], [search.SearchError("x", 500), search.SearchError("y")]

    def call():
        if failures:
            raise failures.pop()
        return 7

    assert search.with_retries(call, wait=waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(search.SearchError):
        search.with_retries(lambda: (_ for _ in ()).throw(search.SearchError("no", 404)), wait=waits.append)


def test_search_source(spark, monkeypatch):
    monkeypatch.setattr(search.time, "sleep", lambda _: None)
    reader = search._Reader({"term": "t", "first": "2024-01-01", "last": "2024-01-20", "limit": "50", "factory": f"{__name__}:FakeIndex"})
    monkeypatch.setattr(reader, "_search", FakeIndex)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[0] for r in rows) == sorted(i for v in DAYS.values() for i in v)


def marc(fields):
    directory, body = b"", b""
    for tag, content in fields:
        content += b"\x1e"
        directory += tag + f"{len(content):04d}{len(body):05d}".encode()
        body += content
    start = 24 + len(directory) + 1
    return f"{start + len(body) + 1:05d}nz  a22{start:05d}n  4500".encode().ljust(24) + directory + b"\x1e" + body + b"\x1d"


def test_marc(spark, tmp_path):
    data = marc([(b"001", b"D1"), (b"150", b"  \x1faSkin\x1fbx")]) + marc([(b"150", b"  \x1faNo id")]) + marc([(b"001", "D2".encode()), (b"150", "  \x1faÄrm".encode())]) + b"broken"
    (tmp_path / "m.bin").write_bytes(data)
    got = vocab_files.read_marc(spark, str(tmp_path / "m.bin")).orderBy("position").collect()
    assert [(r.descriptor_name, r.descriptor_ui) for r in got] == [("Skin", "D1"), ("Ärm", "D2")]


def test_ascii(spark, tmp_path):
    (tmp_path / "d.bin").write_text("*NEWRECORD\nRECTYPE = D\nMH = Skin\nMN = A17.8\nMN = z1\n\n*NEWRECORD\nMH = Male\n*NEWRECORD\nRECTYPE = D\n")
    assert sorted(map(tuple, vocab_files.read_ascii(spark, str(tmp_path / "d.bin")).collect()), key=str) == [("Male", None), ("Skin", "A17.8"), ("Skin", "z1")]


def test_graph_document(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "source string, target string, cooccurrence_count long")
    doc = graph_json.round_trip(network.strengths(e), e)
    assert sorted(map(tuple, graph_json.nodes(doc).collect())) == [("a", 1, 2), ("b", 2, 3), ("c", 1, 1)]
    assert sorted(map(tuple, graph_json.edges(doc).collect())) == [("a", "b", 2), ("b", "c", 1)]
    assert graph_json.nodes(graph_json.read(spark, str(tmp_path / "none"))).count() == 0
    (tmp_path / "g.json").write_text('{"elements": {"nodes": [{"data": {"id": "a"}}, {"data": {}}], "edges": [{"data": {"source": "b", "target": "a", "cooccurrence_count": 1}}, {"data": {"source": "a", "target": "b", "cooccurrence_count": 3}}, {"data": {"source": "a"}}]}}')
    doc = graph_json.read(spark, str(tmp_path / "g.json"))
    assert graph_json.nodes(doc).count() == 1 and list(map(tuple, graph_json.edges(doc).collect())) == [("a", "b", 3)]


def test_validation(spark):
    with pytest.raises(ValueError, match="missing columns: y"):
        validate_columns(spark.range(1), ["id", "y"])


def test_fetching_in_batches(spark):
    def make():
        def call(ids):
            if 13 in ids:
                raise SearchError("gone", 400)
            return {i: None if i % 2 else f"t{i}" for i in ids if i != 4}

        return call

    ids = spark.createDataFrame([(i,) for i in [*range(20), None]], "pmid long").coalesce(1)
    got = {r.pmid: (r.status, r.val) for r in search.fetch_in_batches(ids, "pmid", make, 5).collect()}
    assert len(got) == 20 and got[0] == ("ok", "t0") and got[1] == ("empty", "") and got[4] == ("failed", None) and got[12] == ("failed", None) and got[15] == ("empty", "")


class FullDay:
    """25 ids on one day, one on the next."""

    def count(self, term, first, last):
        return len(self._ids(first, last))

    def _ids(self, first, last):
        return [*(range(25) if first.day <= 3 <= last.day else []), *([99] if first.day <= 4 <= last.day else [])]

    def ids(self, term, first, last, limit):
        return self._ids(first, last)[:limit]


class PagedDay(FullDay):
    def page(self, term, first, last, start, limit):
        return self._ids(first, last)[start : start + limit]


def full_day(kind):
    reader = search._Reader({"term": "t", "first": "2024-01-01", "last": "2024-01-09", "limit": "10", "factory": f"{__name__}:{kind}"})
    return sorted(x[0] for p in reader.partitions() for x in reader.read(p))


def test_a_day_over_the_limit_loses_no_id():
    assert full_day("PagedDay") == [*range(25), 99]
    with pytest.raises(SearchError, match=r"2024-01-03 \(25\)"):
        full_day("FullDay")


def test_days_are_bisected_by_prefix_sums():
    from datetime import date

    days = [(date(2024, 1, d), d) for d in range(1, 29)] + [(None, 5)]
    got = search.bisect_days(days, 40)
    assert sum(n for *_, n, _ in got) == sum(range(1, 29)) and all(n <= 40 for *_, n, _ in got) and search.bisect_days([], 4) == []
