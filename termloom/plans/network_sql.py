"""SQL that checks the network queries. Every entry of ``PARTS`` is a common table expression; ``sql`` puts those together
that a statement needs."""

from __future__ import annotations

import re

from termloom.plans.core_queries import HEADING_SQL, IS_VALUE_SQL, NUMBERS_SQL, VALUES_SQL

_GEN = r"regexp_replace(upper({x}), '\s', '', 'g')"
_GNO = f"CASE WHEN {_GEN} = 'P0' THEN 0 WHEN regexp_full_match({_GEN}, 'G[0-9]+') THEN substr({_GEN}, 2)::BIGINT END"
_LEVELS = "['stressor', 'molecular', 'cellular', 'tissue', 'organ', 'adverse outcome', 'uncategorized']"
_NAMES = "['Stressor', 'Molecular', 'Cellular', 'Tissue', 'Organ', 'Adverse Outcome', 'Uncategorized']"
_RANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)::DOUBLE / count(*) OVER ()"


def gno(x: str) -> str:
    return _GNO.format(x=x)


PARTS = {
    "a0": "SELECT pmid, generation, cited_by, cites, mesh_terms FROM pmids_table WHERE pmid IS NOT NULL QUALIFY record_no = min(record_no) OVER (PARTITION BY pmid)",
    "m0": "SELECT pmid, mesh_terms FROM master_mesh_annotations WHERE pmid IS NOT NULL QUALIFY record_no = min(record_no) OVER (PARTITION BY pmid)",
    "annotated": "SELECT a0.pmid, CASE WHEN (a0.mesh_terms IS NULL OR a0.mesh_terms = '') AND m0.pmid IS NOT NULL THEN m0.mesh_terms ELSE a0.mesh_terms END AS mesh_terms FROM a0 LEFT JOIN m0 ON a0.pmid = m0.pmid",
    "arts": f"SELECT pmid, {gno('generation')} AS generation_no, round(coalesce(exp(-({gno('generation')})), 0), 9)::DOUBLE AS generation_weight, coalesce(len({NUMBERS_SQL.format(x='cited_by')}), 0)::BIGINT AS cited_by_count FROM a0",
    "stop": "SELECT DISTINCT lower(descriptor_name) AS stop FROM mesh_terms WHERE mesh_stop_term",
    "rawtok": f"SELECT pmid, unnest({VALUES_SQL.format(x='mesh_terms')}) AS tok FROM annotated WHERE {IS_VALUE_SQL.format(x='mesh_terms')}",
    "toks": f"SELECT * FROM (SELECT pmid, {HEADING_SQL.format(x='tok')} AS term, starts_with(tok, '*') AS is_major, contains(tok, '/') AS qualified FROM rawtok) WHERE term IS NOT NULL AND term NOT IN (SELECT stop FROM stop)",
    "bags": "SELECT pmid, term, bool_or(is_major) AS is_major FROM toks GROUP BY 1, 2",
    "narts": f"SELECT *, {_RANK.format(x='cited_by_count')} AS normalized_cited_by FROM arts",
    "tstat": "SELECT term, count(*) AS total_pmids, median(cited_by_count)::DOUBLE AS median_citations, round(avg(cited_by_count), 9) AS mean_citations, sum(cited_by_count)::BIGINT AS total_citations FROM toks JOIN arts USING (pmid) WHERE NOT qualified GROUP BY 1",
    "trank": "SELECT *, " + ", ".join(f"{_RANK.format(x=c)} AS rank_{c}" for c in ("total_pmids", "median_citations", "mean_citations", "total_citations")) + " FROM tstat",
    "edges": "SELECT a.term AS source, b.term AS target, count(*) AS cooccurrence_count, round(sum((normalized_cited_by + generation_weight) / 2), 9) AS cumulative_weight FROM bags a JOIN bags b ON a.pmid = b.pmid AND a.term < b.term JOIN narts ON narts.pmid = a.pmid GROUP BY 1, 2",
    "k": "SELECT id, count(*) AS degree, sum(w)::BIGINT AS strength FROM (SELECT source AS id, cooccurrence_count AS w FROM edges UNION ALL SELECT target, cooccurrence_count FROM edges) GROUP BY 1",
    "sc0": "SELECT e.*, s.strength AS ks, t.strength AS kt, (SELECT sum(cooccurrence_count) FROM edges)::DOUBLE AS t FROM edges e JOIN k s ON s.id = source JOIN k t ON t.id = target",
    "sc": "SELECT *, ks::DOUBLE * kt / (2 * t * t) AS p, round(cooccurrence_count * ln(ks::DOUBLE * kt / (2 * t * t)) - lgamma(cooccurrence_count + 1), 6) AS loglik FROM sc0",
    "mlf": "SELECT *, CASE WHEN cooccurrence_count <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, cooccurrence_count), lambda i: exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) + i * ln(p) + (t - i) * ln(1 - p)))) END AS mlf FROM sc",
    "tail": "SELECT source, target, (lp + ln(list_sum(list_transform(range(cooccurrence_count, least(cooccurrence_count + 600, t::BIGINT) + 1), lambda i: exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) + i * ln(p) + (t - i) * ln(1 - p) - lp))))) / ln(10) AS tail_log10 FROM (SELECT *, lgamma(t + 1) - lgamma(cooccurrence_count + 1) - lgamma(t - cooccurrence_count + 1) + cooccurrence_count * ln(p) + (t - cooccurrence_count) * ln(1 - p) AS lp FROM sc)",
    "n": "SELECT term, count(*) AS article_count, sum(is_major::BIGINT) AS n_major, bool_or(is_major) AS is_major_topic, greatest(max(generation_weight), 0) AS generation_weight, min(generation_no) AS g FROM bags JOIN arts USING (pmid) GROUP BY 1",
    "suba": "SELECT * FROM sc ORDER BY round(loglik + cooccurrence_count * ln(1000.0::DOUBLE), 6), source, target LIMIT 500",
    "subb": "SELECT * FROM sc ORDER BY round(cooccurrence_count * ln(cooccurrence_count / (t * p)), 6) DESC, source, target LIMIT 500",
    "agreed": "SELECT suba.source, suba.target FROM suba JOIN subb ON suba.source = subb.source AND suba.target = subb.target",
    "links": "SELECT source AS id, target AS other FROM subb UNION SELECT target, source FROM subb",
    "reach": "SELECT id, id AS r FROM links UNION SELECT links.id, reach.r FROM links JOIN reach ON links.other = reach.id",
    "comp": "SELECT id, min(r) AS component FROM reach GROUP BY 1",
    "csize": "SELECT component, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, component) AS community FROM comp GROUP BY 1",
    "mem": "SELECT id, comp.component, community FROM comp JOIN csize USING (component)",
    "lcc": "SELECT id FROM mem WHERE community = 1",
    "paths": "SELECT id AS u, id AS v, 0 AS d FROM lcc UNION SELECT paths.u, links.other, d + 1 FROM paths JOIN links ON links.id = paths.v WHERE d < 40",
    "lcce": "SELECT source, target, cooccurrence_count FROM subb WHERE source IN (SELECT id FROM lcc)",
    "itl": "SELECT id, other FROM links WHERE id IN (SELECT id FROM lcc) UNION ALL SELECT id, id FROM lcc",
    "it": "SELECT id, 0 AS k, 1.0::DOUBLE / (SELECT count(*) FROM lcc) AS x FROM lcc UNION ALL SELECT itl.id, k + 1, sum(x) / 16 FROM it JOIN itl ON itl.other = it.id WHERE k < 120 GROUP BY 1, 2",
    "norm": "SELECT id, k, x, sum(abs(x - before)) OVER (PARTITION BY k) < (SELECT count(*) FROM lcc) * 1e-6 AS small FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY k) AS before FROM (SELECT id, k, CASE WHEN k = 0 THEN x ELSE x / sqrt(sum(x * x) OVER (PARTITION BY k)) END AS x FROM it))",
    "bk": "SELECT id, count(*) AS degree, sum(w)::BIGINT AS strength FROM (SELECT source AS id, cooccurrence_count AS w FROM subb UNION ALL SELECT target, cooccurrence_count FROM subb) GROUP BY 1",
    "tri": "SELECT x.source AS a, x.target AS b, y.target AS c FROM subb x JOIN subb y ON x.target = y.source JOIN subb z ON z.source = x.source AND z.target = y.target",
    "clus": "SELECT bk.id, degree, coalesce(nt, 0)::BIGINT AS n_triangles, CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(nt, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM bk LEFT JOIN (SELECT id, count(*) AS nt FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY 1) q ON q.id = bk.id",
    "lev": f"SELECT term, min(i) AS i FROM (SELECT {HEADING_SQL.format(x='mesh_term')} AS term, coalesce(nullif(list_position({_LEVELS}, lower(trim(aop_level))), 0), 7)::INTEGER AS i FROM aop_annotations_master) WHERE term IS NOT NULL GROUP BY 1",
    "memlev": f"SELECT mem.*, ({_NAMES})[coalesce(lev.i, 7)] AS aop_level FROM mem LEFT JOIN lev ON lev.term = mem.id",
    "top": "SELECT community, first(id ORDER BY strength DESC, id) AS id, count(*) AS n FROM mem JOIN bk USING (id) GROUP BY 1",
    "pooltok": f"SELECT DISTINCT pmid, {HEADING_SQL.format(x='tok')} AS term FROM (SELECT pmid, unnest({VALUES_SQL.format(x='mesh_terms')}) AS tok FROM m0 WHERE {IS_VALUE_SQL.format(x='mesh_terms')})",
    "seeds": "SELECT id AS term, strength::DOUBLE AS strength, degree::DOUBLE AS degree FROM bk",
    "ars": "SELECT pmid, sum(strength) / (SELECT sum(strength) FROM seeds) AS score_strength, sum(degree) / (SELECT sum(degree) FROM seeds) AS score_degree, string_agg(term, ';' ORDER BY term) AS contributing_seeds FROM pooltok JOIN seeds USING (term) GROUP BY 1",
    "crs": "SELECT term, count(*) AS n_articles, avg(score_strength) * log10(count(*) + 1) AS cs, avg(score_degree) * log10(count(*) + 1) AS cd FROM pooltok JOIN seeds USING (term) JOIN ars USING (pmid) GROUP BY 1",
    "crsr": "SELECT term, strength, degree, round(cs, 6) AS crs_strength, round(cd, 6) AS crs_degree FROM crs JOIN seeds USING (term)",
    "srow": "SELECT pmid, score_betweenness_centrality AS score, contributing_seeds FROM article_relevance_scores WHERE score_betweenness_centrality IS NOT NULL AND score_betweenness_centrality::VARCHAR <> 'nan'",
    "sbest": "SELECT pmid, max(score) AS score FROM srow GROUP BY 1",
    "desc": "SELECT descriptor_name, min(descriptor_ui) AS descriptor_ui FROM mesh_terms WHERE descriptor_name IS NOT NULL AND descriptor_ui IS NOT NULL GROUP BY 1",
    "dnum": "SELECT *, substr(descriptor_ui, 2)::BIGINT AS n FROM \"desc\"",
    "tree": "SELECT descriptor_name, substr('ABCDEFGHIJKLMNVZ', (n % 16 + 1)::INTEGER, 1) AS letter FROM dnum WHERE n % 7 <> 0 UNION SELECT descriptor_name, 'G' FROM dnum WHERE n % 7 <> 0 AND n % 5 = 0",
    "cats": "SELECT descriptor_name, list_sort(list(DISTINCT letter)) AS cats FROM tree GROUP BY 1",
    "stopc": "SELECT descriptor_name AS term, cats[1] AS category FROM cats WHERE NOT list_has_any(cats, ['A', 'C', 'D', 'G'])",
    "cite": f"SELECT DISTINCT pmid, v::BIGINT AS child FROM (SELECT pmid, unnest({NUMBERS_SQL.format(x='cited_by')}) AS v FROM a0 UNION ALL SELECT pmid, unnest({NUMBERS_SQL.format(x='cites')}) FROM a0)",
    "hop0": f"SELECT pmid FROM a0 WHERE {gno('generation')} = 0",
    "hop1": "SELECT DISTINCT child AS pmid FROM cite JOIN hop0 USING (pmid) WHERE child NOT IN (SELECT pmid FROM hop0)",
    "hop2": "SELECT DISTINCT child AS pmid FROM cite JOIN hop1 USING (pmid) WHERE child NOT IN (SELECT pmid FROM hop0) AND child NOT IN (SELECT pmid FROM hop1)",
}
_ORDER = list(PARTS)


def sql(final: str, whole: bool = False) -> str:
    """``final`` below the table expressions it uses, directly or through others; ``whole`` puts all edges in place of ``subb``."""
    parts = {n: t.replace("FROM subb", "FROM edges").replace("JOIN subb", "JOIN edges") for n, t in PARTS.items()} if whole else PARTS
    needed: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in needed and re.search(rf'(?:FROM|JOIN)\s+"?{name}\b', text):
                needed.add(name)
                todo.append(parts[name])
    if not needed:
        return final
    body = ",\n".join(f'"{n}" AS {"" if n in ("reach", "paths", "it") else "MATERIALIZED "}({parts[n]})' for n in _ORDER if n in needed)
    return f"WITH {'RECURSIVE ' if 'reach' in needed else ''}{body}\n{final}"


_LABEL = "CASE WHEN {g} = 0 THEN 'P0' WHEN {g} > 0 THEN 'G' || {g} ELSE 'Unknown' END"
_OVER = "SELECT {part} AS part, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, n_both::BIGINT AS n_both, round(n_both / (n_a + n_b - n_both), 9) AS jaccard, round(2 * n_both / (n_a + n_b), 9) AS f1 FROM ({src})"
_ENDS = "(SELECT source AS id FROM {e} UNION SELECT target FROM {e})"
_DAYS = "CASE doc_id % 6 WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN date_trunc('month', day)::DATE WHEN 3 THEN date_trunc('month', day)::DATE WHEN 4 THEN date_trunc('year', day)::DATE END"

#: Articles with a scored row that fulfils a condition: best score of the article, first of these lists of seeds.
_HELD = "SELECT pmid, score, contributing_seeds FROM (SELECT pmid, min(contributing_seeds) AS contributing_seeds FROM srow WHERE {where} GROUP BY 1) h JOIN sbest USING (pmid)"

ORACLES = {
    "scan_project": "SELECT record_no, pmid FROM pmids_table WHERE generation = 'G2'",
    "load_articles": sql("SELECT * FROM arts"),
    "annotate_articles": sql("SELECT * FROM annotated"),
    "descriptor_dedup": sql('SELECT * FROM "desc"'),
    "tree_categories": sql("SELECT descriptor_name, array_to_string(cats, '') AS letters FROM cats"),
    "stopword_classify": sql("SELECT * FROM stopc"),
    "stopword_orphans": sql("SELECT descriptor_name AS term FROM \"desc\" WHERE descriptor_name NOT IN (SELECT descriptor_name FROM cats) UNION SELECT descriptor_name FROM \"desc\" WHERE descriptor_name IN ('Holonax Assay', 'Velarmic Assay')"),
    "stopword_tag": sql('SELECT descriptor_name, descriptor_ui, lower(descriptor_name) IN (SELECT lower(term) FROM stopc) AS is_stop FROM "desc"'),
    "citation_lookup": sql(f"SELECT cite.pmid, child, CASE WHEN k.pmid IS NOT NULL THEN {_LABEL.format(g='k.g')} END AS child_generation FROM cite JOIN (SELECT pmid FROM a0 WHERE {gno('generation')} = 1) r ON r.pmid = cite.pmid LEFT JOIN (SELECT pmid, {gno('generation')} AS g FROM a0) k ON k.pmid = child"),
    "missing_pmids": "SELECT DISTINCT pmid FROM pmids_table WHERE pmid IS NOT NULL AND pmid NOT IN (SELECT pmid FROM master_mesh_annotations WHERE pmid IS NOT NULL)",
    "insert_ignore": "SELECT pmid, record_no, mesh_terms FROM master_mesh_annotations WHERE pmid IS NOT NULL QUALIFY record_no = min(record_no) OVER (PARTITION BY pmid)",
    "prune_generations": sql(f"SELECT pmid, generation FROM a0 WHERE coalesce({gno('generation')} < 2, TRUE)"),
    "citation_expand": sql("SELECT pmid, 'P0' AS generation FROM hop0 UNION ALL SELECT pmid, 'G1' FROM hop1 UNION ALL SELECT pmid, 'G2' FROM hop2"),
    "date_bisect": """WITH RECURSIVE days AS (SELECT fetched_at::DATE AS day, count(*) AS n FROM pmids_table GROUP BY 1), lim AS (SELECT greatest(1, sum(n)::BIGINT // 20) AS most FROM days),
r AS (SELECT min(day) AS a, max(day) AS b FROM days UNION ALL SELECT * FROM (SELECT unnest([a, a + ((b - a) // 2)::INTEGER + 1]) AS a, unnest([a + ((b - a) // 2)::INTEGER, b]) AS b FROM r WHERE a < b AND (SELECT sum(n) FROM days WHERE day BETWEEN r.a AND r.b) > (SELECT most FROM lim)))
SELECT a AS "first", b AS "last", n, n > most AS "over" FROM (SELECT a, b, (SELECT coalesce(sum(n), 0) FROM days WHERE day BETWEEN r.a AND r.b)::BIGINT AS n FROM r), lim WHERE n <= most OR a = b""",
    "eigenvector": sql("""SELECT mem.id, round(coalesce(x, 0), 9) AS eigenvector FROM mem LEFT JOIN (SELECT id, x FROM norm QUALIFY k = min(k) FILTER (small) OVER ()) e ON e.id = mem.id""", whole=True),
    "parse_terms": r"""WITH t AS (SELECT record_no, unnest(string_split(mesh_terms, ';')) AS tok, generate_subscripts(string_split(mesh_terms, ';'), 1) AS i FROM master_mesh_annotations),
p AS (SELECT record_no, i, unnest(string_split(trim(tok), '/')) AS part, generate_subscripts(string_split(trim(tok), '/'), 1) AS j FROM t WHERE trim(tok) <> '' AND trim(string_split(trim(tok), '/')[1]) <> ''),
q AS (SELECT record_no, i, j, trim(ltrim(trim(part), '*')) AS name, CASE j WHEN 1 THEN 'mesh_term' ELSE 'subheading' END AS type, starts_with(trim(part), '*') AS is_major FROM p)
SELECT record_no, (row_number() OVER (PARTITION BY record_no ORDER BY i, j) - 1)::INTEGER AS "at", name, type, is_major FROM q WHERE name <> ''""",
    "generation_weight": f"SELECT row_id, round(coalesce(exp(-({gno('generation')})), 0), 9)::DOUBLE AS w, {_LABEL.format(g='(' + gno('generation') + ')')} AS label FROM df",
    "parse_dates": f"SELECT doc_id, parsed, strftime(parsed, '%Y/%m/%d') AS written, parsed + ((day - parsed) // 2)::INTEGER AS middle FROM (SELECT doc_id, day, {_DAYS} AS parsed FROM (SELECT doc_id, added_at::DATE AS day FROM documents))",
    "term_citation_stats": sql("SELECT term, total_pmids, median_citations, mean_citations, total_citations, round(rank_total_pmids, 9) AS rank_total_pmids, round(rank_median_citations, 9) AS rank_median_citations, round(rank_mean_citations, 9) AS rank_mean_citations, round(rank_total_citations, 9) AS rank_total_citations FROM trank"),
    "article_ranks": sql("SELECT pmid, cited_by_count, round(normalized_cited_by, 9) AS normalized_cited_by FROM narts"),
    "cooccurrence_edges": sql("SELECT source, target, cooccurrence_count, round(cumulative_weight, 6) AS cumulative_weight FROM edges"),
    "node_strengths": sql("SELECT * FROM k"),
    "degree": sql("SELECT id, degree FROM k"),
    "edge_loglik": sql("SELECT source, target, loglik FROM sc"),
    "edge_significance": sql("SELECT source, target, abs(round(mlf, 5)) AS mlf_p_value, round(CASE WHEN mlf > 0.5 THEN log10(mlf) ELSE tail_log10 END, 5) + 0.0 AS mlf_log10_p FROM mlf JOIN tail USING (source, target)"),
    "edge_table": sql(f"SELECT source, target, cooccurrence_count, round(cumulative_weight, 6) AS cumulative_weight_original, round({_RANK.format(x='cumulative_weight')}, 6) AS weight, round(cooccurrence_count / (a.article_count + b.article_count - cooccurrence_count), 6) AS normalized_cooccurrence, round((ln(1 + cooccurrence_count) - min(ln(1 + cooccurrence_count)) OVER ()) / (max(ln(1 + cooccurrence_count)) OVER () - min(ln(1 + cooccurrence_count)) OVER ()), 6) AS log1p_cooccurrence_minmax, abs(round(mlf, 5)) AS mlf_p_value FROM mlf JOIN n a ON a.term = source JOIN n b ON b.term = target"),
    "node_table": sql(f"""SELECT id, CASE WHEN g = 0 THEN 'P0' WHEN g > 0 THEN 'G' || g ELSE 'Unknown' END AS generation, round(gw, 6) AS generation_weight, is_major_topic, article_count, round(r, 6) AS article_count_rank_normalized, round(n_major / article_count, 6) AS major_topic_proportion, round(rm, 6) AS rank_norm_median_cit, round(ra, 6) AS rank_norm_mean_cit, round(rt, 6) AS rank_norm_total_cit, round(0.45::DOUBLE * gw + 0.15::DOUBLE * r + 0.2::DOUBLE * rm + 0.2::DOUBLE * rt, 6) AS adjusted_node_weight, degree FROM (
SELECT x.term AS id, g, x.generation_weight AS gw, is_major_topic, article_count, n_major, r, coalesce(rank_median_citations, 0) AS rm, coalesce(rank_mean_citations, 0) AS ra, coalesce(rank_total_citations, 0) AS rt, coalesce(degree, 0) AS degree FROM (SELECT *, {_RANK.format(x='article_count')} AS r FROM n) x LEFT JOIN trank ON trank.term = x.term LEFT JOIN k ON k.id = x.term)"""),
    "loglik_topk": sql("SELECT source, target, cooccurrence_count FROM suba"),
    "consensus_edges": sql("SELECT * FROM agreed"),
    "components": sql("SELECT * FROM comp", whole=True),
    "lcc_nodes": sql("SELECT * FROM lcc", whole=True),
    "lcc_edges": sql("SELECT source, target FROM lcce", whole=True),
    "lcc_flags": sql("SELECT id, (community = 1)::INTEGER::DOUBLE AS betweenness_centrality, (community = 1)::INTEGER::DOUBLE AS eigenvector_centrality, 0::DOUBLE AS clustering_coefficient, -1 AS community FROM mem", whole=True),
    "induced_subgraph": sql(f"SELECT source, target, cooccurrence_count FROM edges WHERE source IN {_ENDS.format(e='agreed')} AND target IN {_ENDS.format(e='agreed')}"),
    "triangles": sql("SELECT a, b, c FROM tri", whole=True),
    "clustering_coefficient": sql("SELECT id, degree, n_triangles, round(clustering, 9) AS clustering FROM clus", whole=True),
    "shortest_paths": sql("SELECT u, v, min(d)::BIGINT AS dist FROM paths GROUP BY 1, 2"),
    "graph_json_roundtrip": sql("SELECT (SELECT count(*) FROM bk)::INTEGER AS n_nodes, (SELECT count(*) FROM subb)::INTEGER AS n_edges"),
    "community_rank": sql("SELECT community, count(*) AS n, min(id) AS first_id FROM mem GROUP BY 1"),
    "component_degrees": sql("SELECT community, n, id AS top_node FROM top WHERE community BETWEEN 2 AND 6"),
    "annotate_strata": sql("SELECT id, aop_level FROM memlev"),
    "community_composition": sql("SELECT community, " + ", ".join(f"count(*) FILTER (aop_level = '{x}') AS {x.lower().replace(' ', '_')}" for x in ("Stressor", "Molecular", "Cellular", "Tissue", "Organ", "Adverse Outcome", "Uncategorized")) + ", count(*) AS total FROM memlev GROUP BY 1"),
    "community_label": sql("SELECT top.community, top.community || ': ' || top.id || ' (' || aop_level || ')' AS label FROM top JOIN memlev ON memlev.id = top.id"),
    "alluvial_flows": sql(f"SELECT ({_NAMES})[lo] AS source_level, ({_NAMES})[hi] AS target_level, count(*) AS weight FROM (SELECT least(a.i, b.i) AS lo, greatest(a.i, b.i) AS hi FROM edges JOIN lev a ON a.term = source JOIN lev b ON b.term = target) GROUP BY lo, hi"),
    "edge_histogram": sql("SELECT least(floor(cooccurrence_count / 25), greatest(ceil(m / 25), 1) - 1)::BIGINT AS bin, count(*) AS n, part FROM (SELECT cooccurrence_count, max(cooccurrence_count) OVER () AS m, 'before' AS part FROM edges UNION ALL SELECT cooccurrence_count, max(cooccurrence_count) OVER (), 'after' FROM suba) GROUP BY 1, 3"),
    "subgraph_overlap": sql(_OVER.format(part="'edges'", src="SELECT (SELECT count(*) FROM suba) AS n_a, (SELECT count(*) FROM subb) AS n_b, (SELECT count(*) FROM agreed) AS n_both") + " UNION ALL " + _OVER.format(part="'nodes'", src=f"SELECT (SELECT count(*) FROM {_ENDS.format(e='suba')}) AS n_a, (SELECT count(*) FROM {_ENDS.format(e='subb')}) AS n_b, (SELECT count(*) FROM (SELECT * FROM {_ENDS.format(e='suba')} INTERSECT SELECT * FROM {_ENDS.format(e='subb')})) AS n_both")),
    "subgraph_metrics": sql("SELECT count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, round(sum(degree) / (count(*) * (count(*) - 1)), 9) AS density, round(avg(clustering), 9) AS average_clustering FROM clus"),
    "retention_cascade": sql("SELECT stage, n_nodes, n_edges, round(n_nodes / lag(n_nodes) OVER (ORDER BY stage), 9) AS nodes_retained, round(n_edges / lag(n_edges) OVER (ORDER BY stage), 9) AS edges_retained FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS stage, (SELECT count(*) FROM {_ENDS.format(e=e)}) AS n_nodes, (SELECT count(*) FROM {e}) AS n_edges" for name, e in (("1 full", "edges"), ("2 subgraph", "subb"), ("3 component", "lcce"), ("4 consensus", "agreed"))) + ")"),
    "ars_scores": sql("SELECT pmid, round(score_strength, 9) AS score_strength, round(score_degree, 9) AS score_degree, contributing_seeds FROM ars"),
    "crs_scores": sql("SELECT seeds.term, round(coalesce(cs, 0), 6) AS crs_strength, round(coalesce(cd, 0), 6) AS crs_degree FROM seeds LEFT JOIN crs USING (term)"),
    "node_articles": sql(_HELD.format(where="contributing_seeds ILIKE '%assay%'") + " ORDER BY score DESC, pmid LIMIT 20"),
    "node_articles_exact": sql(_HELD.format(where="list_contains(string_split(contributing_seeds, ';'), 'Quinanax Assay')")),
    "edge_articles": sql(_HELD.format(where="contributing_seeds ILIKE '%quinanax assay%' AND pmid IN (SELECT pmid FROM srow WHERE contributing_seeds ILIKE '%messenger%')") + " ORDER BY score DESC, pmid LIMIT 20"),
    "top_articles": sql(_HELD.format(where="TRUE") + " ORDER BY score DESC, pmid LIMIT 20"),
    "top_nodes_joint": sql("SELECT * FROM (SELECT *, 'strength' AS \"by\" FROM crsr ORDER BY crs_strength DESC, term LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'degree' FROM crsr ORDER BY crs_degree DESC, term LIMIT 5)"),
    "crs_gap_top20": sql("SELECT term, crs_strength, crs_degree, round(abs(crs_strength - crs_degree), 6) AS gap FROM crsr ORDER BY gap DESC, term LIMIT 20"),
    "crs_histogram": sql("SELECT least(floor((crs_strength - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, count(*) AS n FROM (SELECT crs_strength, min(crs_strength) OVER () AS lo, max(crs_strength) OVER () AS hi FROM crsr) GROUP BY 1"),
    "scatter_fit": sql(f"SELECT ({_NAMES})[coalesce(lev.i, 7)] AS aop_level, count(*) AS n, round(regr_slope(cs, strength), 6) AS slope, round(regr_intercept(cs, strength), 6) AS intercept FROM crs JOIN seeds USING (term) LEFT JOIN lev USING (term) WHERE strength > 0 AND cs > 0 GROUP BY 1"),
    "scatter_panel": sql("SELECT term, strength, crs_strength FROM crsr WHERE strength > 0 AND crs_strength > 0"),
    "export_nodes": sql("SELECT id, degree, strength FROM bk"),
    "export_edges": sql("SELECT source, target, cooccurrence_count FROM subb"),
}
