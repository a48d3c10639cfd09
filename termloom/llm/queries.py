"""Queries of the llm operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.terms import heading_of
from termloom.llm import cooccurrence, frequency, leakage, ledger, pii, quantiles, tokens, topn
from termloom.operators.hotkeys import once
from termloom.operators.packed import packed_lists
from termloom.plans.core_queries import HEADING_SQL, IS_VALUE_SQL, VALUES_SQL
from termloom.session import written
from termloom.sources.tables import table


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Both feeds as (source_table, record_no, pmid)."""
    feeds = [table(spark, folder, t).select(F.lit(t).alias("source_table"), "record_no", "pmid") for t in ("pmids_table", "master_mesh_annotations")]
    return feeds[0].unionByName(feeds[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose pmid arrived before in either feed."""
    return ledger.seen_before(arrivals(spark, folder), "pmid", "record_no").where("seen").select("source_table", "record_no")


def p1_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the ledger held against each key's first arrival over all rows at once: rows, wrong answers, their rate."""
    feed = arrivals(spark, folder)
    said = ledger.seen_before(feed, "pmid", "record_no")
    firsts = feed.where(F.col("pmid").isNotNull()).groupBy("pmid").agg(F.min("record_no").alias("first_no")).select("first_no", F.lit(True).alias("is_first"))
    judged = said.join(firsts, said["record_no"] == firsts["first_no"], "left")
    true = F.col("pmid").isNotNull() & F.col("record_no").isNotNull() & F.col("is_first").isNull()
    wrong = F.sum((F.col("seen") != true).cast("bigint"))
    return judged.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("seen").cast("bigint")), F.lit(0)).alias("n_seen"), F.coalesce(wrong, F.lit(0)).alias("n_wrong")).withColumn("error_rate", F.when(F.col("n_rows") > 0, F.col("n_wrong") / F.col("n_rows")).otherwise(0.0))


PCTS = [50, 90, 99]
LEAST = {50: 40.0, 90: 150.0, 99: 600.0}


def measured_values(spark: SparkSession, folder: str, day: bool = False) -> DataFrame:
    """(source_table, group_key, value[, day]) of both percentile inputs: known, non-negative values, redelivered rows once.

    Rows without a group come along under a null key (asking for it here would work out every heading twice).
    """
    stats, art = table(spark, folder, "mesh_stats_df"), table(spark, folder, "df")
    s = stats.select("stat_id", F.lit("mesh_stats_df").alias("source_table"), heading_of(F.col("mesh_term")).alias("group_key"), F.col("median_citations").alias("value"), F.col("harvest_day").alias("day"))
    a = art.select("row_id", F.lit("df").alias("source_table"), F.col("harvest_batch").cast("string").alias("group_key"), F.col("cited_by_count").cast("double").alias("value"), F.lit(None).cast("date").alias("day"))
    cols = ["source_table", "group_key", "value", *(["day"] if day else [])]
    ok = (F.col("value") >= 0) & ~F.isnan("value")
    return once(s.where(ok), "stat_id", cols).unionByName(once(a.where(ok), "row_id", cols))


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles per group by radix selection."""
    got = quantiles.radix_select(measured_values(spark, folder), ["source_table", "group_key"], "value", PCTS)
    return got.where(F.col("group_key").isNotNull()).select("source_table", "group_key", F.col("pct").cast("int").alias("pct"), "value")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups whose percentile reaches the level stated for it."""
    enough = F.col("value") >= F.when(F.col("pct") == 50, LEAST[50]).when(F.col("pct") == 90, LEAST[90]).otherwise(LEAST[99])
    return p3_percentiles(spark, folder).where(enough).select("source_table", "group_key", "pct")


def _daily_sketches(values: DataFrame) -> DataFrame:
    """One histogram per group, merged from one of each day."""
    groups = ["source_table", "group_key"]
    return quantiles.merged(quantiles.sketch(values, [*groups, "day"], "value"), groups)


def p3_sketch_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from daily histograms merged over the days: within the stated error, and combinable across deliveries."""
    got = quantiles.sketch_percentiles(_daily_sketches(measured_values(spark, folder, day=True)), ["source_table", "group_key"], PCTS)
    return got.where(F.col("group_key").isNotNull()).select("source_table", "group_key", F.col("pct").cast("int").alias("pct"), F.round(F.col("value") + 1e-9, 6).alias("value"))  # the offset keeps halves from hanging on the last bit


def p3_sketch_error(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from daily histograms merged over the days, beside the exact ones: largest relative error per source."""
    groups = ["source_table", "group_key"]
    values = written(measured_values(spark, folder, day=True).where(F.col("group_key").isNotNull()), "p3-values")
    rough = quantiles.sketch_percentiles(_daily_sketches(values), groups, PCTS).withColumnRenamed("value", "rough")
    exact = quantiles.radix_select(values, groups, "value", PCTS)
    error = F.abs(F.col("rough") - F.col("value")) / F.greatest(F.col("value"), F.lit(1e-300))
    both = exact.join(rough, [*groups, "pct"])
    return both.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_percentiles"), F.round(F.max(error), 12).alias("max_relative_error"), F.lit(quantiles.SKETCH_ERROR).alias("bound"))


def annotation_records(spark: SparkSession, folder: str) -> DataFrame:
    """Per non-null pmid the row with the lowest record_no, as its sorted set of headings; empty sets left out."""
    rows = table(spark, folder, "master_mesh_annotations").where(F.col("pmid").isNotNull())
    firsts = rows.groupBy("pmid").agg(F.min_by("mesh_terms", "record_no").alias("mesh_terms"))
    lists = packed_lists(firsts, "mesh_terms", "headings", ["pmid"])
    return lists.where(F.size("vals") > 0).select("pmid", F.array_sort(F.array_distinct("vals")).alias("headings"))


def _pairs(spark: SparkSession, folder: str, min_pairs: int, min_share: int | None) -> DataFrame:
    records = written(annotation_records(spark, folder), "records")
    return cooccurrence.pair_statistics(records, "headings", min_pairs, min_share)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of headings found together at least four times as often as independence would give."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return _pairs(spark, folder, 5, 1000).where(big("n_ab") * big("n") >= 4 * big("n_a") * big("n_b")).select("term_a", "term_b")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs sharing a record with counts, lift and log-likelihood ratio."""
    got = _pairs(spark, folder, 1, None)
    return got.withColumn("lift", F.round("lift", 6)).withColumn("llr", F.round("llr", 4))


def frequencies(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """(grp, term, occurrences, records, weight): headings of the annotation ``records``; headings of the statistics with sums."""
    master = records.select(F.lit("master_mesh_annotations").alias("grp"), F.col("headings").alias("terms"), F.lit(0.0).alias("weight"))
    stats = table(spark, folder, "mesh_stats_df").select("stat_id", heading_of(F.col("mesh_term")).alias("h"), "total_pmids")
    stats = once(stats.where(F.col("total_pmids") >= 0), "stat_id", ["h", "total_pmids"])
    stats = stats.select(F.lit("mesh_stats_df").alias("grp"), F.array("h").alias("terms"), F.col("total_pmids").cast("double").alias("weight"))
    return frequency.term_frequencies(master.unionByName(stats), "grp", "terms", "weight")


def p5_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Frequency of every heading with its mark: ``rare``, ``common`` or null."""
    annotated = written(annotation_records(spark, folder), "records")
    got = written(frequencies(spark, folder, annotated), "frequencies")
    is_master = F.col("grp") == "master_mesh_annotations"
    amount = F.when(is_master, F.col("records")).otherwise(F.col("weight").cast("bigint"))
    rows = got.select(F.col("grp").alias("source_table"), "term", "records", amount.alias("amount"))
    n_records = annotated.agg(F.count(F.lit(1)))
    total = rows.where(F.col("source_table") == "mesh_stats_df").agg(F.coalesce(F.sum("amount"), F.lit(0)))
    master = F.col("source_table") == "master_mesh_annotations"
    common = F.when(master, F.col("amount") * 10 >= n_records.scalar()).otherwise(F.col("amount") * 50 >= total.scalar())
    rare = F.when(master, F.col("amount") <= 2).otherwise(F.col("amount") < 5)
    return rows.withColumn("mark", F.when(rare, "rare").when(common, "common"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Headings too rare or too common."""
    return p5_frequencies(spark, folder).where(F.col("mark").isNotNull()).select("source_table", "term", "mark")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best articles of every seed heading."""
    rows = table(spark, folder, "article_relevance_scores")
    seeds = rows.select("pmid", "score_betweenness_centrality", F.explode(F.split("contributing_seeds", ";")).alias("seed"))
    flat = seeds.select(heading_of(F.col("seed")).alias("seed_term"), "pmid", "score_betweenness_centrality")
    return topn.top_n(flat, "seed_term", "pmid", "score_betweenness_centrality", 10).select("seed_term", "pmid", "rnk")


QUERIES = {f.__name__: f for f in (p1_found, p1_error_rate, p3_found, p3_percentiles, p3_sketch_percentiles, p3_sketch_error, p4_found, p4_pairs, p5_found, p5_frequencies, p7_found)}

_FEED = "feed AS (SELECT 'pmids_table' AS source_table, record_no, pmid FROM pmids_table UNION ALL SELECT 'master_mesh_annotations', record_no, pmid FROM master_mesh_annotations)"
_SEEN = "seen AS (SELECT *, pmid IS NOT NULL AND record_no > min(record_no) OVER (PARTITION BY pmid) AS seen FROM feed)"
_VALUES = f"""v AS (SELECT 'mesh_stats_df' AS source_table, h AS group_key, m AS value FROM (SELECT DISTINCT stat_id, {HEADING_SQL.format(x='mesh_term')} h, median_citations m FROM mesh_stats_df) WHERE h IS NOT NULL AND m >= 0
UNION ALL SELECT 'df', harvest_batch::VARCHAR, c::DOUBLE FROM (SELECT DISTINCT row_id, harvest_batch, cited_by_count c FROM df) WHERE c >= 0),
p AS (SELECT source_table, group_key, pct, CASE pct WHEN 50 THEN quantile_cont(value, 0.5) WHEN 90 THEN quantile_cont(value, 0.9) ELSE quantile_cont(value, 0.99) END AS value FROM v, (VALUES (50), (90), (99)) t(pct) GROUP BY 1, 2, 3)"""
_RECORDS = f"""rec AS (SELECT pmid, list_sort(list_distinct(list_filter(list_transform({VALUES_SQL.format(x='mesh_terms')}, lambda w: {HEADING_SQL.format(x='w')}), lambda h: h IS NOT NULL))) AS hs
FROM (SELECT * FROM master_mesh_annotations WHERE pmid IS NOT NULL QUALIFY record_no = min(record_no) OVER (PARTITION BY pmid)) WHERE {IS_VALUE_SQL.format(x='mesh_terms')}),
r AS (SELECT pmid, hs FROM rec WHERE len(hs) > 0), h AS (SELECT pmid, unnest(hs) AS term FROM r), n AS (SELECT count(*) AS n FROM r), c AS (SELECT term, count(*) AS n FROM h GROUP BY 1)"""
_PAIRS = f"""WITH {_RECORDS}, ab AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n_ab FROM h a JOIN h b ON a.pmid = b.pmid AND a.term < b.term GROUP BY 1, 2),
q AS (SELECT term_a, term_b, n_ab, ca.n AS n_a, cb.n AS n_b, n.n AS n FROM ab JOIN c ca ON ca.term = term_a JOIN c cb ON cb.term = term_b, n)"""
_XLX = "CASE WHEN {x} > 0 THEN ({x}) * ln(({x})::DOUBLE) ELSE 0 END"
_LLR = "greatest(0, 2 * (" + " + ".join(_XLX.format(x=x) for x in ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab", "n")) + " - (" + " + ".join(_XLX.format(x=x) for x in ("n_a", "n - n_a", "n_b", "n - n_b")) + ")))"
_FREQ = f"""WITH {_RECORDS}, s AS (SELECT h AS term, count(*) AS records, sum(t)::BIGINT AS amount FROM (SELECT DISTINCT stat_id, {HEADING_SQL.format(x='mesh_term')} h, total_pmids t FROM mesh_stats_df) WHERE h IS NOT NULL AND t >= 0 GROUP BY 1),
f AS (SELECT 'master_mesh_annotations' AS source_table, term, c.n AS records, c.n AS amount, CASE WHEN c.n <= 2 THEN 'rare' WHEN c.n * 10 >= n.n THEN 'common' END AS mark FROM c, n
UNION ALL SELECT 'mesh_stats_df', term, records, amount, CASE WHEN amount < 5 THEN 'rare' WHEN amount * 50 >= (SELECT sum(amount) FROM s) THEN 'common' END FROM s)"""

#: The middle of a value's cell: 8 bits of the fraction below its power of two.
_CELL = "CASE WHEN value = 0 THEN 0 ELSE pow(2, floor(log2(value))) * (1 + (floor((value / pow(2, floor(log2(value))) - 1) * 256) * 2 + 1 - pow(2, -44)) / 512) END"
_SKETCH = f"""WITH {_VALUES}, m AS (SELECT source_table, group_key, {_CELL} AS value FROM v),
r AS (SELECT source_table, group_key, pct, CASE pct WHEN 50 THEN quantile_cont(value, 0.5) WHEN 90 THEN quantile_cont(value, 0.9) ELSE quantile_cont(value, 0.99) END AS rough FROM m, (VALUES (50), (90), (99)) t(pct) GROUP BY 1, 2, 3)"""

ORACLES = {
    "p3_sketch_percentiles": _SKETCH + " SELECT source_table, group_key, pct, round(rough + 1e-9, 6) AS value FROM r",
    "p3_sketch_error": _SKETCH + f" SELECT source_table, count(*) AS n_percentiles, round(max(abs(rough - value) / greatest(value, 1e-300)), 12) AS max_relative_error, {quantiles.SKETCH_ERROR}::DOUBLE AS bound FROM p JOIN r USING (source_table, group_key, pct) GROUP BY 1",
    "p1_found": f"WITH {_FEED}, {_SEEN} SELECT source_table, record_no FROM seen WHERE seen",
    "p1_error_rate": f"WITH {_FEED}, {_SEEN} SELECT count(*) AS n_rows, coalesce(sum(seen::BIGINT), 0)::BIGINT AS n_seen, 0::BIGINT AS n_wrong, 0::DOUBLE AS error_rate FROM seen",
    "p3_percentiles": f"WITH {_VALUES} SELECT * FROM p",
    "p3_found": f"WITH {_VALUES} SELECT source_table, group_key, pct FROM p WHERE value >= CASE pct WHEN 50 THEN 40 WHEN 90 THEN 150 ELSE 600 END",
    "p4_found": _PAIRS + " SELECT term_a, term_b FROM q WHERE n_ab >= 5 AND n_ab * 1000 >= n AND n_ab * n >= 4 * n_a * n_b",
    "p4_pairs": _PAIRS + f" SELECT term_a, term_b, n_ab, n_a, n_b, n, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift, round({_LLR}, 4) AS llr FROM q",
    "p5_frequencies": _FREQ + " SELECT * FROM f",
    "p5_found": _FREQ + " SELECT source_table, term, mark FROM f WHERE mark IS NOT NULL",
    "p7_found": f"""WITH s AS (SELECT {HEADING_SQL.format(x='seed')} AS seed_term, pmid, max(score) AS score FROM (SELECT unnest(string_split(contributing_seeds, ';')) AS seed, pmid, score_betweenness_centrality AS score FROM article_relevance_scores WHERE score_betweenness_centrality IS NOT NULL AND score_betweenness_centrality::VARCHAR <> 'nan') GROUP BY 1, 2)
SELECT seed_term, pmid, rnk::INTEGER AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY seed_term ORDER BY score DESC, pmid) AS rnk FROM s WHERE seed_term IS NOT NULL) WHERE rnk <= 10""",
}


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p8_word_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct word decoded again through the id-to-piece join: words, tokens over the corpus, words that differ.

    As the words of a text joined give the text, no differing word means that the whole corpus comes back unchanged.
    """
    words = written(tokens.distinct_words(table(spark, folder, "documents"), "text", tokens.vocabulary()), "p8-words")
    back = tokens.decode_corpus(words.select("word", "ids"), "word", "ids").withColumnRenamed("word", "w")
    both = words.join(back, F.col("word") == F.col("w"))
    differ = F.sum((F.coalesce(F.col("text"), F.lit("")) != F.col("word")).cast("bigint"))
    return both.agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_occurrences"), F.sum(F.col("n") * F.size("ids")).alias("n_tokens"), differ.alias("n_differing"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again: documents, those with a text, characters, and texts that come back changed."""
    docs = table(spark, folder, "documents")
    back = tokens.decode_corpus(p8_ids(spark, folder), "doc_id", "ids").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n_back"), F.count("text").alias("t_back"), F.sum(F.length("text")).alias("c_back"))
    there = docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    both = there.join(back, there["doc_id"].eqNullSafe(back["doc_id"]) & (there["h"] == back["h"]), "full")
    changed = F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("n_back", F.lit(0))))
    return both.agg(F.coalesce(F.sum("n_back"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("t_back"), F.lit(0)).alias("n_texts"), F.coalesce(F.sum("c_back"), F.lit(0)).alias("n_chars"), F.coalesce(changed, F.lit(0)).alias("n_changed"))


QUERIES |= {f.__name__: f for f in (p8_ids, p8_word_table, p8_decoded)}
ORACLES["p8_decoded"] = "SELECT count(*) AS n_docs, count(text) AS n_texts, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, 0::BIGINT AS n_changed FROM documents"


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items of which they hold twelve consecutive words or more."""
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its leaked runs, and what was removed."""
    return leakage.cleaned(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


QUERIES |= {f.__name__: f for f in (p9_found, p9_cleaned)}


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct personal details of every document."""
    return pii.find(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "kind", "val").distinct()


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with typed placeholders in place of its personal details."""
    return pii.redact(table(spark, folder, "documents"), "doc_id", "text")


QUERIES |= {f.__name__: f for f in (p10_found, p10_redacted)}
