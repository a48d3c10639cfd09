"""Answers of remote services: tagged bibliographic records and citation links, as calls for ``search.fetch_in_batches``.

The transport (who asks which address) is the caller's; here are the formats.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.sources.search import fetch_in_batches


def tagged_records(text: str) -> Iterator[dict[str, list[str]]]:
    """Records of ``TAG - value`` lines: a tag of at most four characters, continued lines indented by six, a blank line between."""
    record: dict[str, list[str]] = {}
    tag = None
    for line in [*text.splitlines(), ""]:
        if not line.strip():
            if record:
                yield record
            record, tag = {}, None
        elif line[4:6] == "- ":
            tag = line[:4].strip()
            record.setdefault(tag, []).append(line[6:].strip())
        elif line.startswith("      ") and tag:
            record[tag][-1] += " " + line.strip()


def annotation_call(fetch: Callable[[list[int]], str]) -> Callable[[list[int]], dict[int, str]]:
    """From ids to their headings joined by ``;`` ('' without headings); ids that the answer leaves out are missing."""

    def call(ids: list[int]) -> dict[int, str]:
        wanted = set(ids)
        found = {int(r["PMID"][0]): ";".join(r.get("MH", [])) for r in tagged_records(fetch(ids)) if r.get("PMID", [""])[0].isdigit()}
        return {i: v for i, v in found.items() if i in wanted}

    return call


def link_call(fetch: Callable[[list[int]], str]) -> Callable[[list[int]], dict[int, str]]:
    """From ids to the JSON text of their link lists, out of an answer ``{"data": [{"pmid", "cited_by", "references"}]}``; null lists are empty."""

    def call(ids: list[int]) -> dict[int, str]:
        wanted = set(ids)
        rows = json.loads(fetch(ids)).get("data") or []
        join = lambda x: ";".join(map(str, x or []))
        return {r["pmid"]: json.dumps({"cited_by": join(r.get("cited_by")), "cites": join(r.get("references"))}) for r in rows if r.get("pmid") in wanted}

    return call


def remote_annotations(make: Callable[[], Callable[[list[int]], str]], size: int = 9999) -> Callable[[DataFrame], DataFrame]:
    """``pmid, status, val`` of a table of ids; ``make()`` gives the transport, inside the tasks."""
    return lambda ids: fetch_in_batches(ids, "pmid", lambda: annotation_call(make()), size)


def remote_links(make: Callable[[], Callable[[list[int]], str]], size: int = 100) -> Callable[[DataFrame], DataFrame]:
    """``pmid, status, cited_by, cites`` of a table of ids; a failed look-up has null lists, one without links empty ones."""

    def look_up(ids: DataFrame) -> DataFrame:
        got = fetch_in_batches(ids, "pmid", lambda: link_call(make()), size).withColumn("v", F.from_json("val", "cited_by string, cites string"))
        status = F.when((F.col("status") == "ok") & (F.col("v.cited_by") == "") & (F.col("v.cites") == ""), "empty").otherwise(F.col("status"))
        return got.select("pmid", status.alias("status"), F.col("v.cited_by").alias("cited_by"), F.col("v.cites").alias("cites"))

    return look_up
