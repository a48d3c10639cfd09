"""Queries of the core operators on packed fields and hot keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.terms import heading_of
from termloom.operators.hotkeys import combine_by_key, heavy_keys, once
from termloom.operators.packed import explode_packed
from termloom.sources.tables import table

HEADING_SQL = r"""nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '/(.|\n)*', ''), '^\s+|\s+$', '', 'g'), '^\*+\s*', ''), '\s+', ' ', 'g')), '')"""


def heading_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``mesh_stats_df``, redelivered ones once, with their heading."""
    rows = once(table(spark, folder, "mesh_stats_df"), "stat_id", ["stat_id", "mesh_term", "total_pmids", "median_citations"])
    return rows.withColumn("mesh_term", heading_of(F.col("mesh_term")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Headings with at least one in a hundred of all rows that have a heading."""
    rows = once(table(spark, folder, "mesh_stats_df").select("stat_id", heading_of(F.col("mesh_term")).alias("mesh_term")), "stat_id", ["stat_id", "mesh_term"])
    return heavy_keys(rows, F.col("mesh_term"), 100, "mesh_term").select("mesh_term")


def p2_heading_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Algebraic statistics per heading over all its rows; negative stand-ins count as unknown."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    got = combine_by_key(heading_stats(spark, folder), F.col("mesh_term"), {"total": known("total_pmids"), "median": known("median_citations")}, "mesh_term")
    return got.select("mesh_term", "n_rows", "total_n", F.col("total_sum").cast("bigint").alias("total_sum"), F.col("total_max").cast("bigint").alias("total_max"), "median_n", F.round("median_mean", 6).alias("median_mean"), "median_min", "median_max")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the three packed fields with its position."""
    cited = explode_packed(table(spark, folder, "pmids_table"), {"cites": "numbers", "cited_by": "numbers"}, ["record_no"])
    terms = explode_packed(table(spark, folder, "master_mesh_annotations"), {"mesh_terms": "terms"}, ["record_no"])
    both = cited.withColumn("source_table", F.lit("pmids_table")).unionByName(terms.withColumn("source_table", F.lit("master_mesh_annotations")))
    return both.select("source_table", "record_no", "field_name", "pos", "val")


QUERIES = {"p2_found": p2_found, "p2_heading_stats": p2_heading_stats, "p6_found": p6_found}

_STATS = f"SELECT DISTINCT stat_id, {HEADING_SQL.format(x='mesh_term')} AS mesh_term, total_pmids, median_citations FROM mesh_stats_df"
#: Tokens of a packed heading field: quoted runs, commas before a space, anything that does not separate. A comma right after
#: a closing quote is made a semicolon first.
VALUES_SQL = r"""list_filter(list_transform(regexp_extract_all(regexp_replace({x}, '",', '";', 'g'), '("([^"]|"")*"|, |[^;|\t\n\r,"])+'),
  lambda t: CASE WHEN trim(t, E' \t\n\r') LIKE '"%"' THEN trim(replace(substr(trim(t, E' \t\n\r'), 2, length(trim(t, E' \t\n\r')) - 2), '""', '"'), E' \t\n\r') ELSE trim(t, E' \t\n\r') END), lambda v: v <> '')"""
IS_VALUE_SQL = "lower(trim({x})) NOT IN ('nan', 'null', '-', '[]')"
NUMBERS_SQL = r"regexp_extract_all(regexp_replace({x}, '([0-9])[.][0-9]+', '\1', 'g'), '[0-9]+')"

ORACLES = {
    "p2_found": f"""WITH s AS ({_STATS}), c AS (SELECT mesh_term, count(*) n FROM s WHERE mesh_term IS NOT NULL GROUP BY 1)
SELECT mesh_term FROM c WHERE n * 100 >= (SELECT sum(n) FROM c)""",
    "p2_heading_stats": f"""WITH s AS ({_STATS}), k AS (SELECT mesh_term, CASE WHEN total_pmids >= 0 THEN total_pmids END t, CASE WHEN median_citations >= 0 THEN median_citations END m FROM s WHERE mesh_term IS NOT NULL)
SELECT mesh_term, count(*) AS n_rows, count(t) AS total_n, sum(t)::BIGINT AS total_sum, max(t)::BIGINT AS total_max, count(m) AS median_n, round(avg(m), 6) AS median_mean, min(m) AS median_min, max(m) AS median_max FROM k GROUP BY 1""",
    "p6_found": f"""WITH v AS (
SELECT 'pmids_table' AS source_table, record_no, 'cites' AS field_name, {NUMBERS_SQL.format(x='cites')} AS vals FROM pmids_table
UNION ALL SELECT 'pmids_table', record_no, 'cited_by', {NUMBERS_SQL.format(x='cited_by')} FROM pmids_table
UNION ALL SELECT 'master_mesh_annotations', record_no, 'mesh_terms', {VALUES_SQL.format(x='mesh_terms')} FROM master_mesh_annotations WHERE {IS_VALUE_SQL.format(x='mesh_terms')})
SELECT source_table, record_no, field_name, unnest(range(1, len(vals) + 1))::INTEGER AS pos, unnest(vals) AS val FROM v WHERE len(vals) > 0""",
}
