"""Vocabulary files: ISO 2709 (MARC) records and the ASCII record format."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import termloom.session  # noqa: F401

FIELD, SUBFIELD, RECORD = b"\x1e", b"\x1f", b"\x1d"


def marc_records(data: bytes) -> Iterator[tuple[str | None, str | None]]:
    """(first 150 subfield a, control number) of every record; records that do not parse give (None, None)."""
    for raw in data.split(RECORD):
        if len(raw) < 25:
            continue
        try:
            start = int(raw[12:17])
            directory = raw[24 : start - 1]
            name = number = None
            for i in range(0, len(directory) - len(directory) % 12, 12):
                tag, size, at = directory[i : i + 3], int(directory[i + 3 : i + 7]), int(directory[i + 7 : i + 12])
                body = raw[start + at : start + at + size].rstrip(FIELD)
                if tag == b"001":
                    number = body.decode().strip() or None
                elif tag == b"150" and name is None:
                    name = next((p[1:].decode().strip() for p in body.split(SUBFIELD)[1:] if p[:1] == b"a"), None) or None
            yield name, number
        except (ValueError, UnicodeDecodeError):
            yield None, None


def read_marc(spark: SparkSession, path: str) -> DataFrame:
    """``descriptor_name, descriptor_ui, position`` of the records of MARC files that have both; files are read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                rows = [(n, u, i) for i, (n, u) in enumerate(marc_records(bytes(content))) if n and u]
                yield pd.DataFrame(rows, columns=["descriptor_name", "descriptor_ui", "position"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "descriptor_name string, descriptor_ui string, position long")


def read_ascii(spark: SparkSession, path: str) -> DataFrame:
    """``name, mn`` per heading and tree number of the ASCII format; a heading without tree number has one row with null."""
    blocks = spark.read.text(path, lineSep="*NEWRECORD").select(F.split("value", "\r?\n").alias("lines"))
    pick = lambda tag: F.transform(F.filter("lines", lambda x: x.startswith(f"{tag} = ")), lambda x: F.trim(F.substring(x, len(tag) + 4, 10**6)))
    made = blocks.select(F.try_element_at(pick("MH"), F.lit(1)).alias("name"), pick("MN").alias("numbers"))
    return made.where(F.col("name").isNotNull() & (F.col("name") != "")).select("name", F.explode_outer("numbers").alias("mn"))
