import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import scalars
from termloom.functions.special import binomial_tail, log_gamma
from termloom.functions.terms import heading_of, parse_terms, plain_terms, search_term
from termloom.operators import hotkeys, ingest, network, vocabulary
from termloom.operators.ranks import average_ranks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("token,want", [("*Skin / path", "skin"), ("** Big\t  Toe", "big toe"), ("*", None), ("/x", None), (" ", None), (None, None), ("\xa0A b ", "a b")])
def test_heading(spark, token, want):
    assert one(spark, heading_of, token) == want


def test_token_grammar(spark):
    got = one(spark, parse_terms, "*Skin/pathology; ; Dermatitis, Contact/*etiology;/x;* A;**B;*")
    assert [tuple(r) for r in got] == [("Skin", "mesh_term", True), ("pathology", "subheading", False), ("Dermatitis, Contact", "mesh_term", False), ("etiology", "subheading", True), ("A", "mesh_term", True), ("B", "mesh_term", True)]
    assert one(spark, parse_terms, None) == [] and one(spark, parse_terms, " ") == []
    assert one(spark, plain_terms, "*Skin/x;Nickel; * A;;") == ["Nickel", " A"]
    assert one(spark, search_term, "*Skin*/x") == "Skin"


@pytest.mark.parametrize("gen,k,w,label", [("P0", 0, 1.0, "P0"), (" g2", 2, math.exp(-2), "G2"), ("G10", 10, math.exp(-10), "G10"), ("G", None, 0.0, "Unknown"), (None, None, 0.0, "Unknown"), ("nan", None, 0.0, "Unknown"), ("-3", None, 1.0, "Unknown"), ("1", None, math.exp(-1), "Unknown")])
def test_generations(spark, gen, k, w, label):
    assert one(spark, scalars.generation_number, gen) == k
    assert one(spark, scalars.generation_weight, gen) == pytest.approx(w)
    assert one(spark, lambda c: scalars.generation_label(scalars.generation_number(c)), gen) == label


def test_small_scalars(spark):
    assert [one(spark, scalars.joined_count, x) for x in (None, "", " ", "nan", "1;2", "1;;")] == [0, 0, 0, 0, 2, 3]
    days = [one(spark, scalars.parse_date, x) for x in ("2024/1/5", "2024-01-05", "2024/03", "2024-3", "1999", "soon", None)]
    assert [d and d.isoformat() for d in days] == ["2024-01-05", "2024-01-05", "2024-03-01", "2024-03-01", "1999-01-01", None, None]


def test_log_gamma_and_tail(spark):
    xs = [0.5, 1.0, 2.0, 9.99, 10.0, 55.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11)
    w, n, p = np.array([0, 1, 5, 40, 11]), np.array([10, 7, 30, 1000, 10]), np.array([0.3, 0.1, 0.2, 0.05, 0.5])
    exact = [sum(math.comb(int(m), k) * q**k * (1 - q) ** (int(m) - k) for k in range(int(v), int(m) + 1)) for v, m, q in zip(w, n, p, strict=True)]
    assert binomial_tail(w, n, p) == pytest.approx(exact, rel=1e-9, abs=1e-12)


def test_average_ranks(spark):
    df = spark.createDataFrame([(i, x, float(i)) for i, x in enumerate([3.0, 1.0, 3.0, None, 2.0, 3.0])], "i int, x double, y double")
    got = {r.i: r.rank_x for r in average_ranks(df, ["x", "y"]).collect()}
    assert got == {0: 4 / 5, 1: 1 / 5, 2: 4 / 5, 3: None, 4: 2 / 5, 5: 4 / 5}
    assert average_ranks(df.limit(0), ["x"]).count() == 0


def test_hot_keys(spark):
    rows = [("hot", float(i)) for i in range(700)] + [(f"k{i % 50}", None if i % 2 else 2.0) for i in range(300)] + [(None, 1.0)] * 500
    df = spark.createDataFrame(rows, "key string, v double").withColumn("n_rows", F.lit(-1))
    got = {r.key: r for r in hotkeys.combine_by_key(df, F.col("key"), {"v": F.col("v")}).collect()}
    assert got["hot"].n_rows == 700 and got["hot"].v_mean == pytest.approx(349.5) and got["k1"].v_n == 0 and got["k1"].v_sum is None
    assert [r.key for r in hotkeys.heavy_keys(df, F.col("key"), 100).collect()] == ["hot"]
    assert hotkeys.heavy_keys(df.limit(0), F.col("key"), 100).count() == 0


def test_counted_once(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 1), (None, "a", 1), (None, "a", 1)], "id int, t string, loaded int")
    assert hotkeys.once(df, "id", ["t"]).count() == 4
    assert hotkeys.once(df, "id", ["id", "t"]).count() == 4


def test_ingest(spark):
    a = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, None)], "pmid long, mesh_terms string")
    m = spark.createDataFrame([(1, "no"), (2, "m2"), (3, "m3")], "pmid long, mesh_terms string")
    assert {r.pmid: r.mesh_terms for r in ingest.annotate(a, m, "pmid", "mesh_terms").collect()} == {1: "x", 2: "m2", 3: "m3", 4: None}
    new = spark.createDataFrame([(4, "n4"), (9, "b"), (9, "a"), (None, "z")], "pmid long, mesh_terms string")
    assert sorted((r.pmid, r.mesh_terms) for r in ingest.insert_ignore(m, new, "pmid", F.col("mesh_terms")).collect()) == [(1, "no"), (2, "m2"), (3, "m3"), (4, "n4"), (9, "a")]
    assert [r.pmid for r in ingest.missing(new, m, "pmid").orderBy("pmid").collect()] == [4, 9]
    up = ingest.update_links(a, spark.createDataFrame([(4, "u")], "pmid long, mesh_terms string"), "pmid", ["mesh_terms"])
    assert {r.pmid: r.mesh_terms for r in up.collect()}[4] == "u"
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "pmid long, child long")
    got = ingest.citation_expand(spark.createDataFrame([(1,)], "pmid long"), links, 3)
    assert sorted(map(tuple, got.collect())) == [(1, "P0"), (2, "G1"), (3, "G2")]
    g = spark.createDataFrame([(1, "P0"), (2, "G1"), (3, "g2"), (4, "?"), (5, None)], "pmid long, generation string")
    assert [r.pmid for r in ingest.prune_generations(g, "generation", 2).orderBy("pmid").collect()] == [1, 2, 4, 5]


def test_vocabulary(spark):
    tree = spark.createDataFrame([("A1", "A01"), ("A1", "b02"), ("B1", "B01"), ("Z1", "z9"), ("Z1", "N1"), ("X", "7")], "name string, mn string")
    cats = vocabulary.categories(tree, "name", "mn")
    assert {r.name: r.categories for r in cats.collect()} == {"A1": ["A", "B"], "B1": ["B"], "Z1": ["N", "Z"]}
    assert sorted(map(tuple, vocabulary.classify_stop_words(cats, "name").collect())) == [("B1", "B"), ("Z1", "N")]
    heads = spark.createDataFrame([("A1",), ("X",), ("Male",), ("B1",)], "name string")
    assert sorted(r.term for r in vocabulary.orphans(heads, cats, "name").collect()) == ["Male", "X"]
    aop = spark.createDataFrame([("*Skin", "Organ"), ("skin", "cellular "), ("x", None), (None, "Organ")], "m string, lv string")
    assert sorted(map(tuple, vocabulary.strata(aop, heading_of(F.col("m")), "lv").collect())) == [("skin", "Cellular"), ("x", "Uncategorized")]


GOLDEN = [(1, "P0", 3, ["*Skin/pathology", "Allergens", "Nickel"]), (2, "P0", 0, ["Allergens", "*Nickel", "Dermatitis, Contact/*etiology"]), (3, "G1", 1, ["Skin", "Allergens"]), (4, "G1", 0, ["*Skin"]), (5, "G2", 2, []), (6, "G2", 5, ["Apoptosis"])]


@pytest.fixture(scope="module")
def golden(spark):
    a = spark.createDataFrame([(p, g, c) for p, g, c, _ in GOLDEN], "pmid long, generation string, cited_by_count long")
    a = network.normalise_articles(a.withColumn("generation_weight", scalars.generation_weight(F.col("generation"))).withColumn("generation_no", scalars.generation_number(F.col("generation"))))
    t = spark.createDataFrame([(p, x) for p, _, _, ts in GOLDEN for x in ts], "pmid long, token string")
    name = F.trim(F.ltrim(F.split("token", "/")[0], F.lit("*")))
    toks = t.select("pmid", name.alias("term"), F.col("token").startswith("*").alias("is_major"), F.contains("token", F.lit("/")).alias("qualified"))
    bags = network.article_terms(toks)
    return a, toks, bags, network.cooccurrence_edges(bags, a)


def test_golden_articles_and_terms(golden):
    a, toks, _, _ = golden
    assert [r.normalized_cited_by for r in a.orderBy("pmid").collect()] == pytest.approx([0.833333, 0.25, 0.5, 0.25, 0.666667, 1.0], abs=1e-6)
    got = {r.term: r for r in network.rank_terms(network.term_statistics(toks, a)).collect()}
    assert set(got) == {"Allergens", "Apoptosis", "Nickel", "Skin"}
    assert (got["Nickel"].median_citations, got["Nickel"].rank_total_pmids, got["Nickel"].rank_mean_citations, got["Nickel"].rank_total_citations) == (1.5, 0.625, 0.75, 0.5)


def test_golden_edges_and_nodes(golden):
    a, toks, bags, edges = golden
    scored = network.scored_edges(edges)
    got = {(r.source, r.target): r for r in network.edge_table(scored, bags).collect()}
    want = {("Allergens", "Dermatitis, Contact"): (1, 0.625, 0.3, 0.333333, 0, 0.529244), ("Allergens", "Nickel"): (2, 1.541667, 1.0, 0.666667, 1, 0.434488), ("Allergens", "Skin"): (2, 1.350606, 0.8, 0.5, 1, 0.291983), ("Dermatitis, Contact", "Nickel"): (1, 0.625, 0.3, 0.5, 0, 0.449046), ("Nickel", "Skin"): (1, 0.916667, 0.6, 0.25, 0, 0.599219)}
    assert set(got) == set(want)
    for k, v in want.items():
        r = got[k]
        assert (r.cooccurrence_count, r.cumulative_weight_original, r.weight, r.normalized_cooccurrence, r.log1p_cooccurrence_minmax, r.mlf_p_value) == pytest.approx(v, abs=1e-6)
    assert {r.source + r.target: r.loglik for r in scored.collect()}["AllergensSkin"] == pytest.approx(-4.446982, abs=1e-6)
    nodes = {r.id: r for r in network.node_table(bags, a, network.term_statistics(toks, a), edges).collect()}
    for k, v in {"Allergens": (3, 0, 1.0, 0.9, 0.835, 3), "Apoptosis": (1, 0, 0.135335, 0.3, 0.505901, 0), "Dermatitis, Contact": (1, 0, 1.0, 0.3, 0.495, 2), "Nickel": (2, 0.5, 1.0, 0.6, 0.79, 3), "Skin": (3, 0.6667, 1.0, 0.9, 0.685, 2)}.items():
        r = nodes[k]
        assert (r.article_count, r.major_topic_proportion, r.generation_weight, r.article_count_rank_normalized, r.adjusted_node_weight, r.degree) == pytest.approx(v, abs=1e-4)
    assert nodes["Skin"].generation == "P0" and nodes["Apoptosis"].generation == "G2"


def test_single_edge_and_article(spark):
    a = spark.createDataFrame([(1, 0.0, 3)], "pmid long, generation_weight double, cited_by_count long")
    assert network.normalise_articles(a).first().normalized_cited_by == 0.5
    assert network.normalise_articles(a.withColumn("cited_by_count", F.lit(0).cast("long"))).first().normalized_cited_by == 0.0
    bags = spark.createDataFrame([(1, "a", True), (1, "b", False)], "pmid long, term string, is_major boolean")
    e = network.cooccurrence_edges(bags, network.normalise_articles(a))
    t = network.edge_table(network.scored_edges(e), bags).first()
    assert (t.weight, t.log1p_cooccurrence_minmax) == (0.5, 0.5)
    assert network.scored_edges(e.limit(0)).count() == 0
