"""DuckDB SQL for the queries of ``registry``, written apart from the Spark code it checks."""

from __future__ import annotations

from kgspark.sources.language import SAMPLES as LANGUAGE_SAMPLES

from .encode import SQL_CLOSURE, SQL_GRAPH

SQL: dict[str, str] = {}

CUSTOMER7, NATION3, ORDER7, REGION0 = 30000000000008, 20000000000004, 60000000000008, 10000000000001
EDGE = "id, relation_type, source, target, weight"
TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def graph(name: str, sql: str, more: str = "") -> None:
    SQL[name] = f"WITH RECURSIVE {SQL_GRAPH}{', ' + more if more else ''} {sql}"


def plain(name: str, sql: str) -> None:
    SQL[name] = sql


# Scans, lookups and filters

graph("scan_concepts", "SELECT id, concept_type, name, description FROM concepts")
graph("scan_relations", f"SELECT {EDGE} FROM relations")
graph("concept_by_id", f"SELECT * FROM concepts WHERE id = {CUSTOMER7}")
graph("find_by_name", "SELECT * FROM concepts WHERE concept_type = 'Customer' AND lower(name) = 'customer#000000007'")
graph("concepts_exact_type", "SELECT * FROM concepts WHERE concept_type = 'Part'")
graph("concepts_subsumed", "SELECT c.* FROM concepts c JOIN closure t ON t.descendant = c.concept_type WHERE t.ancestor = 'Party'", SQL_CLOSURE)
graph("name_substring", "SELECT id, concept_type, name FROM concepts WHERE contains(lower(name), 'er#00000001')")
graph("trigram_division", "SELECT id, name FROM concepts WHERE contains(lower(name), 'ring #12')")
graph("relations_filtered", f"SELECT {EDGE} FROM relations WHERE source = {ORDER7} AND relation_type = 'contains_part'")
graph("edge_node_join", "SELECT r.id, a.name AS source_name, b.name AS target_name FROM relations r JOIN concepts a ON a.id = r.source JOIN concepts b ON b.id = r.target")
graph("outgoing", f"SELECT {EDGE} FROM relations WHERE source = {ORDER7}")
graph("incoming", f"SELECT {EDGE} FROM relations WHERE target = {NATION3}")
graph("outgoing_typed_virtual", f"SELECT id, 'placed' AS relation_type, target AS source, source AS target, CAST(1 AS BIGINT) AS virt FROM relations WHERE relation_type = 'placed_by' AND target = {CUSTOMER7}")
graph("neighbors_both", f"SELECT source AS node, target AS neighbor, id AS relation_id, CAST(0 AS BIGINT) AS dir FROM relations WHERE source = {NATION3} UNION ALL SELECT target, source, id, 1 FROM relations WHERE target = {NATION3}")
graph(
    "resolve_named_relations",
    """SELECT o_orderkey AS named_id, a.id AS source_id, b.id AS target_id FROM orders
    LEFT JOIN concepts a ON a.concept_type = 'Order' AND lower(a.name) = 'order#' || o_orderkey
    LEFT JOIN concepts b ON b.concept_type = 'Customer' AND lower(b.name) = CASE WHEN o_orderkey % 50 = 0 THEN 'nobody' ELSE 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END""",
)
graph(
    "dangling_endpoints",
    "SELECT r.id, 'source' AS missing FROM relations r WHERE r.source IN (SELECT id FROM gone) UNION ALL SELECT r.id, 'target' FROM relations r WHERE r.target IN (SELECT id FROM gone)",
    "gone AS (SELECT CAST(30000000000001 + c_custkey AS BIGINT) AS id FROM customer WHERE c_acctbal < 0)",
)

# Validation

graph(
    "validate_edges",
    """SELECT r.id, CASE WHEN d.relation_type IS NULL THEN 'UnknownRelationType' ELSE 'SchemaViolation' END AS code
    FROM rows r LEFT JOIN concepts a ON a.id = r.source LEFT JOIN concepts b ON b.id = r.target LEFT JOIN declared d ON d.relation_type = r.relation_type
    WHERE d.relation_type IS NULL OR NOT EXISTS (SELECT 1 FROM closure t WHERE t.ancestor = d.dom AND t.descendant = a.concept_type) OR NOT EXISTS (SELECT 1 FROM closure t WHERE t.ancestor = d.ran AND t.descendant = b.concept_type)""",
    f"""{SQL_CLOSURE}, declared(relation_type, dom, ran) AS (VALUES ('in_region', 'Nation', 'Region'), ('located_in', 'Party', 'Nation'), ('placed_by', 'Order', 'Customer'), ('contains_part', 'Order', 'Part'), ('shipped_by', 'Order', 'Supplier')),
    rows AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'no_such_type' ELSE relation_type END AS relation_type,
      CASE WHEN relation_type IN ('in_region', 'placed_by') AND id % 7 = 0 THEN target ELSE source END AS source, CASE WHEN relation_type IN ('in_region', 'placed_by') AND id % 7 = 0 THEN source ELSE target END AS target
      FROM relations)""",
)
BATCH = """batch AS (
  SELECT c_custkey * 2 AS seq, 'Customer' AS concept_type, 'Party ' || c_nationkey AS name FROM customer
  UNION ALL SELECT s_suppkey * 2 + 1, 'Supplier', 'PARTY ' || s_nationkey FROM supplier
)"""
plain("disjoint_violations", f"WITH {BATCH} SELECT b.seq, b.concept_type, b.name, min(o.concept_type) AS other_type FROM batch b JOIN batch o ON o.concept_type <> b.concept_type AND lower(o.name) = lower(b.name) AND o.seq < b.seq GROUP BY ALL")
plain(
    "duplicate_names",
    """WITH batch AS (SELECT p_partkey AS seq, 'Part' AS concept_type, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part),
    w AS (SELECT *, min(seq) OVER (PARTITION BY lower(name)) AS first_seq FROM batch) SELECT seq, concept_type, name, first_seq FROM w WHERE seq > first_seq""",
)
plain(
    "validate_concepts",
    f"""WITH {BATCH}, b AS (SELECT seq, CASE WHEN seq % 97 = 0 THEN 'Alien' ELSE concept_type END AS concept_type, name || '-' || seq % 40 AS name FROM batch),
    c AS (SELECT seq, CASE WHEN concept_type = 'Alien' THEN 1
      WHEN EXISTS (SELECT 1 FROM b o WHERE o.seq < b.seq AND lower(o.name) = lower(b.name) AND ((b.concept_type = 'Customer' AND o.concept_type = 'Supplier') OR (b.concept_type = 'Supplier' AND o.concept_type = 'Customer'))) THEN 4
      WHEN EXISTS (SELECT 1 FROM b o WHERE o.seq < b.seq AND lower(o.name) = lower(b.name) AND o.concept_type = b.concept_type) THEN 5 END AS check_no FROM b)
    SELECT seq, CAST(check_no AS BIGINT) AS check_no, CASE check_no WHEN 1 THEN 'UnknownConceptType' WHEN 4 THEN 'DisjointTypeViolation' ELSE 'DuplicateConcept' END AS code FROM c WHERE check_no IS NOT NULL""",
)
graph(
    "cardinality_violations",
    "SELECT id, 'source' AS side FROM (SELECT *, row_number() OVER (PARTITION BY relation_type, source ORDER BY id) AS n FROM rows) WHERE n > 1",
    """rows AS (SELECT id, relation_type, source FROM relations WHERE relation_type IN ('in_region', 'placed_by')
      UNION ALL SELECT CAST(170000000000001 + n_nationkey AS BIGINT), 'in_region', CAST(20000000000001 + n_nationkey % 10 AS BIGINT) FROM nation)""",
)
plain(
    "validate_inverses",
    """WITH t(name, dom, ran, inverse_of) AS (VALUES ('in_region', 'Nation', 'Region', NULL), ('located_in', 'Party', 'Nation', NULL), ('placed_by', 'Order', 'Customer', NULL), ('placed', 'Customer', 'Order', 'placed_by'),
      ('contains_part', 'Order', 'Part', NULL), ('shipped_by', 'Order', 'Supplier', NULL), ('related_to', 'Part', 'Part', NULL), ('lost', 'Part', 'Part', 'nothing'), ('skewed', 'Part', 'Order', 'placed_by'))
    SELECT t.name AS relation_type, CASE WHEN o.name IS NULL THEN 'unknown inverse' ELSE 'not mirrored' END AS reason FROM t LEFT JOIN t o ON o.name = t.inverse_of
    WHERE t.inverse_of IS NOT NULL AND (o.name IS NULL OR o.dom <> t.ran OR o.ran <> t.dom)""",
)

# Text and retrieval

DOC_TOKENS = TOKENS.format("coalesce(text, '')")
plain("tokenize_counts", f"SELECT doc_id, CAST(len({DOC_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({DOC_TOKENS})) AS BIGINT) AS n_distinct FROM documents")
graph("indexable_text", "SELECT id, CASE WHEN description = '' THEN name ELSE name || '. ' || description END AS text FROM concepts")
POSTED = f"posted AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({DOC_TOKENS}) AS term FROM documents) GROUP BY ALL)"
plain("term_stats", f"WITH {POSTED} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM posted GROUP BY term")
plain(
    "lexical_topk",
    f"""WITH {POSTED}, dl AS (SELECT id, sum(tf) AS dl FROM posted GROUP BY id), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
    s AS (SELECT query_id, p.id, round(sum(qtf * sqrt(tf / dl) * ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1)), 9) AS score FROM q JOIN posted p USING (term) JOIN df USING (term) JOIN dl ON dl.id = p.id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
plain(
    "vector_topk",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10""",
)


def hashed(name: str, source: str) -> str:
    """CTEs name(id, dim, value): signed MD5 feature hashing of source(id, text)."""
    return f"""{name}_t AS (SELECT id, unnest({TOKENS.format('text')}) AS term FROM {source}),
    {name}_s AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 8))::UBIGINT % 256 AS BIGINT) AS dim, sum(CASE WHEN ('0x' || substr(md5(term), 9, 2))::UBIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM {name}_t GROUP BY ALL HAVING v <> 0),
    {name} AS (SELECT id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM {name}_s)"""


plain("hash_embed", f"WITH items AS (SELECT item_id AS id, text FROM benchmark), {hashed('e', 'items')} SELECT id, dim, round(value, 6) AS value FROM e")


def hybrid(query: str, pool: int, top: int, types: str = "") -> str:
    keep = f"WHERE id IN (SELECT id FROM concepts WHERE concept_type IN ({types}))" if types else ""
    return f"""corpus AS (SELECT id, CASE WHEN description = '' THEN name ELSE name || '. ' || description END AS text FROM concepts),
    asked AS (SELECT CAST(0 AS BIGINT) AS id, '{query}' AS text),
    posted AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('text')}) AS term FROM corpus) GROUP BY ALL),
    dl AS (SELECT id, sum(tf) AS dl FROM posted GROUP BY id), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
    qt AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({TOKENS.format('text')}) AS term FROM asked) GROUP BY ALL),
    lex AS (SELECT p.id, sum(qtf * sqrt(tf / dl) * ln(((SELECT count(*) FROM corpus) - df + 0.5) / (df + 0.5) + 1)) AS s FROM qt JOIN posted p USING (term) JOIN df USING (term) JOIN dl ON dl.id = p.id GROUP BY ALL),
    {hashed('qv', 'asked')}, {hashed('cv', 'corpus')},
    vec AS (SELECT cv.id, sum(cv.value * qv.value) AS s FROM cv JOIN qv USING (dim) GROUP BY ALL),
    lp AS (SELECT * FROM lex ORDER BY s DESC, id LIMIT {pool}), vp AS (SELECT * FROM vec ORDER BY s DESC, id LIMIT {pool}),
    lm AS (SELECT greatest(coalesce(max(s), 0), 1e-6) AS m FROM lp), vm AS (SELECT greatest(coalesce(max(s), 0), 1e-6) AS m FROM vp),
    lk AS (SELECT * FROM lp {keep}), vk AS (SELECT * FROM vp {keep}),
    f AS (SELECT coalesce(lk.id, vk.id) AS id, coalesce(lk.s, 0) AS lexical, coalesce(vk.s, 0) AS vector FROM lk FULL JOIN vk ON lk.id = vk.id),
    g AS (SELECT id, 0.5 * (lexical / (SELECT m FROM lm)) + 0.5 * (vector / (SELECT m FROM vm)) AS score, lexical, vector FROM f),
    ranked AS (SELECT * FROM g WHERE (SELECT max(score) FROM g) <= 0 OR score >= 0.4 * (SELECT max(score) FROM g) ORDER BY score DESC, id LIMIT {top})"""


ROUNDED = "SELECT id, round(score, 6) AS score, round(lexical, 6) AS lexical, round(vector, 6) AS vector FROM ranked"
graph("hybrid_rank", ROUNDED, hybrid("red widget 1200", 32, 8))
graph("hybrid_rank_typed", ROUNDED, hybrid("nation 3 supplier 000000012", 128, 8, "'Customer', 'Supplier', 'Party'"))
graph(
    "retrieve_subgraph",
    "SELECT id, CAST(0 AS BIGINT) AS depth FROM ranked UNION ALL SELECT DISTINCT n, 1 FROM (SELECT r.target AS n FROM relations r JOIN ranked k ON k.id = r.source UNION SELECT r.source FROM relations r JOIN ranked k ON k.id = r.target) WHERE n NOT IN (SELECT id FROM ranked)",
    hybrid("red widget 1200", 4, 1),
)

# Traversal

plain("type_descendants", f"WITH RECURSIVE {SQL_CLOSURE} SELECT ancestor, descendant FROM closure")
BOTH = "both_ways AS (SELECT source AS a, target AS b FROM relations UNION SELECT target, source FROM relations)"
graph(
    "expand_2hop",
    f"SELECT id, min(depth) AS depth FROM (SELECT CAST({CUSTOMER7} AS BIGINT) AS id, CAST(0 AS BIGINT) AS depth UNION ALL SELECT b, 1 FROM both_ways WHERE a = {CUSTOMER7} UNION ALL SELECT y.b, 2 FROM both_ways x JOIN both_ways y ON y.a = x.b WHERE x.a = {CUSTOMER7}) GROUP BY id",
    BOTH,
)
graph(
    "expand_typed",
    f"""SELECT id, 'placed' AS relation_type, target AS source, source AS target FROM relations WHERE relation_type = 'placed_by' AND target = {CUSTOMER7}
    UNION SELECT p.id, 'contains_part', p.source, p.target FROM relations p JOIN relations o ON o.source = p.source AND o.relation_type = 'placed_by' AND o.target = {CUSTOMER7} WHERE p.relation_type = 'contains_part'""",
)
graph(
    "expand_capped",
    """SELECT id, source, target FROM (SELECT e.*, min(rank) FILTER (WHERE nodes >= 10) OVER () AS stop FROM (SELECT *, dense_rank() OVER (ORDER BY first_at) + 1 AS nodes FROM (SELECT *, min(rank) OVER (PARTITION BY neighbor) AS first_at FROM e)) e)
    WHERE stop IS NULL OR rank < stop""",
    f"""e AS (SELECT *, row_number() OVER (ORDER BY dir, id) AS rank FROM (SELECT id, source, target, target AS neighbor, 0 AS dir FROM relations WHERE source = {NATION3} UNION ALL SELECT id, source, target, source, 1 FROM relations WHERE target = {NATION3}))""",
)
graph(
    "shortest_path",
    f"""SELECT CAST(s.step AS BIGINT) AS step, s.relation_id, s.relation_type, s.concept_id FROM best, LATERAL (VALUES (1, o1, 'placed_by', n1), (2, o2, t2, n2), (3, o3, t3, n3), (4, o4, 'in_region', {REGION0})) s(step, relation_id, relation_type, concept_id)""",
    f"""steps AS (SELECT source AS a, target AS b, id, relation_type AS t, 0 AS dir FROM relations UNION ALL SELECT target, source, id, relation_type, 1 FROM relations),
    l1 AS (SELECT b AS n, min((dir, id, t)) AS k FROM steps WHERE a = {CUSTOMER7} GROUP BY b),
    r1 AS (SELECT *, row_number() OVER (ORDER BY k) AS rank FROM l1),
    l2 AS (SELECT s.b AS n, min((r1.rank, s.dir, s.id, s.t, r1.n)) AS k FROM steps s JOIN r1 ON r1.n = s.a WHERE s.b <> {CUSTOMER7} AND s.b NOT IN (SELECT n FROM r1) GROUP BY s.b),
    r2 AS (SELECT *, row_number() OVER (ORDER BY k) AS rank FROM l2),
    l3 AS (SELECT s.b AS n, min((r2.rank, s.dir, s.id, s.t, r2.n)) AS k FROM steps s JOIN r2 ON r2.n = s.a WHERE s.b <> {CUSTOMER7} AND s.b NOT IN (SELECT n FROM r1) AND s.b NOT IN (SELECT n FROM r2) GROUP BY s.b),
    r3 AS (SELECT *, row_number() OVER (ORDER BY k) AS rank FROM l3),
    two AS (SELECT min((r1.rank, s.dir, s.id, s.t, r1.n)) AS k FROM steps s JOIN r1 ON r1.n = s.a WHERE s.b = {REGION0}),
    l4 AS (SELECT min((r3.rank, s.dir, s.id, s.t, r3.n)) AS k FROM steps s JOIN r3 ON r3.n = s.a WHERE s.b = {REGION0}),
    best AS (SELECT r1.k[2] AS o1, r1.n AS n1, r2.k[3] AS o2, r2.k[4] AS t2, r2.n AS n2, r3.k[3] AS o3, r3.k[4] AS t3, r3.n AS n3, l4.k[3] AS o4 FROM l4 JOIN r3 ON r3.n = l4.k[5] JOIN r2 ON r2.n = r3.k[5] JOIN r1 ON r1.n = r2.k[5])""",
)
graph(
    "closure_in_region",
    "SELECT seed, id, min(depth) AS depth FROM (SELECT target AS seed, source AS id, CAST(1 AS BIGINT) AS depth FROM relations WHERE relation_type = 'in_region') GROUP BY ALL",
)
graph(
    "transitive_enrich",
    """SELECT id, min(depth) AS depth FROM (SELECT id, depth FROM base UNION ALL SELECT id, 1 FROM (SELECT r2.source AS id, 2 AS hops FROM relations r1 JOIN relations r2 ON r2.target = r1.target AND r2.relation_type = 'in_region' WHERE r1.relation_type = 'in_region'
      AND r1.source = %d AND r2.source NOT IN (SELECT id FROM base) ORDER BY hops, id LIMIT 16)) GROUP BY id"""
    % NATION3,
    f"base AS (SELECT CAST({NATION3} AS BIGINT) AS id, CAST(0 AS BIGINT) AS depth UNION ALL SELECT target, 1 FROM relations WHERE relation_type = 'in_region' AND source = {NATION3})",
)
graph("subgraph_default_seeds", "SELECT id, row_number() OVER (ORDER BY concept_type, name, id) AS ord FROM concepts WHERE concept_type IN ('Party', 'Customer', 'Supplier') ORDER BY ord LIMIT 50")

# Statistics and pages

STATS = "s AS (SELECT (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM relations) AS relations, CAST(0 AS BIGINT) AS rules, CAST(0 AS BIGINT) AS actions, CAST(9 AS BIGINT) AS concept_types, CAST(7 AS BIGINT) AS relation_types, CAST(0 AS BIGINT) AS rule_types, CAST(0 AS BIGINT) AS action_types)"
graph("graph_stats", "SELECT * FROM s", STATS)
graph("metrics_gauges", "SELECT gauge, 'ontology_' || gauge || ' ' || value AS line FROM (UNPIVOT s ON COLUMNS(*) INTO NAME gauge VALUE value)", STATS)
graph("degree_by_type", "SELECT source, relation_type, count(*) AS degree FROM relations GROUP BY ALL")
graph("ingest_stats", "SELECT 'concept' AS kind, count(*) AS n FROM concepts UNION ALL SELECT 'relation', count(*) FROM relations")
SAMPLES = "samples AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS second, sum(value) AS value FROM events GROUP BY ALL)"
# each sample, the next one that may be kept after it, and the chain of kept ones from the first on
KEPT = """{source}, later AS (SELECT a.series, a.second, a.value, b.second AS nxt FROM samples a ASOF LEFT JOIN samples b ON a.series = b.series AND a.second + 60 <= b.second),
    kept AS (SELECT * FROM later WHERE (series, second) IN (SELECT (series, min(second)) FROM samples GROUP BY series)
      UNION ALL SELECT l.* FROM kept k JOIN later l ON l.series = k.series AND l.second = k.nxt),
    buffer AS (SELECT series, second, value FROM kept QUALIFY row_number() OVER (PARTITION BY series ORDER BY second DESC) <= 200)"""
plain("stats_history", f"WITH RECURSIVE {KEPT.format(source=SAMPLES.replace('sum(value)', 'min(value)'))} SELECT series, second AS at, value FROM buffer")
plain(
    "stats_delta",
    f"""WITH RECURSIVE {KEPT.format(source=SAMPLES)}, e AS (SELECT series, arg_min(value, second) AS o, arg_max(value, second) AS n FROM buffer GROUP BY series)
    SELECT series, round(o, 6) AS old, round(n, 6) AS new, round(CASE WHEN o = 0 THEN CASE WHEN n = 0 THEN 0.0 ELSE 100.0 END ELSE (n - o) / o * 100 END, 6) AS delta_percent FROM e""",
)
plain("invoiced_total_by_party", "SELECT c_name AS party, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS largest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
PAGE = "SELECT id, concept_type, name FROM concepts"
graph("page_concepts", f"{PAGE} ORDER BY concept_type, name, id LIMIT 50 OFFSET 100")
graph("page_concepts_type", f"{PAGE} WHERE concept_type = 'Part' ORDER BY name, id LIMIT 50 OFFSET 20")
graph("page_concepts_subtypes", f"{PAGE} WHERE concept_type IN ('Party', 'Customer', 'Supplier') ORDER BY name, id LIMIT 60 OFFSET 1480")
graph("page_concepts_search", f"{PAGE} WHERE concept_type = 'Part' AND contains(lower(name), 'red') ORDER BY concept_type, name, id LIMIT 30")
graph("page_relations", f"SELECT {EDGE} FROM relations WHERE relation_type = 'placed_by' ORDER BY id LIMIT 60 OFFSET 40")
graph("page_with_total", "SELECT id, name, (SELECT count(*) FROM concepts WHERE concept_type IN ('Party', 'Customer', 'Supplier')) AS total FROM concepts WHERE concept_type IN ('Party', 'Customer', 'Supplier') ORDER BY name, id LIMIT 25 OFFSET 10")

# Changes

plain("allocate_ids", "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE 1000000 + row_number() OVER (PARTITION BY o_orderkey % 3 = 0 ORDER BY o_orderkey) END AS id FROM orders")
graph(
    "apply_concept_patches",
    """SELECT c.id, c.concept_type, CASE WHEN c_acctbal < 500 AND c_custkey % 2 = 0 THEN 'renamed-' || c_custkey ELSE c.name END AS name, CASE WHEN c_acctbal < 500 THEN 'overdue' ELSE c.description END AS description
    FROM concepts c LEFT JOIN customer ON c.id = 30000000000001 + c_custkey""",
)
graph(
    "cascade_delete",
    "SELECT concept_type AS kind, count(*) AS n FROM concepts WHERE id NOT IN (SELECT id FROM gone) GROUP BY ALL UNION ALL SELECT relation_type, count(*) FROM relations WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY ALL",
    "gone AS (SELECT CAST(40000000000001 + s_suppkey AS BIGINT) AS id FROM supplier WHERE s_nationkey = 3)",
)
graph("delete_relation", f"SELECT {EDGE} FROM relations WHERE NOT (relation_type = 'placed_by' AND weight = 1 AND id % 2 = 0)")
RELATED = "related AS (SELECT CAST(180000000000001 + p_partkey AS BIGINT) AS id, 'related_to' AS relation_type, CAST(50000000000001 + p_partkey AS BIGINT) AS source, CAST(50000000000001 + p_partkey // 2 AS BIGINT) AS target, CAST(0.5 AS DOUBLE) AS weight, p_partkey AS seq FROM part)"
plain("materialize_symmetric", f"WITH {RELATED} SELECT id, relation_type, target AS source, source AS target, weight FROM related WHERE source <> target")
plain(
    "export_symmetric_dedup",
    f"""WITH {RELATED}, both_ways AS (SELECT * FROM related UNION ALL SELECT id + 10000000000000, relation_type, target, source, weight, id + 20000000000000 FROM related WHERE source <> target),
    w AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source, seq, id) AS n FROM both_ways) SELECT {EDGE} FROM w WHERE n = 1""",
)
plain(
    "ingest_deferred",
    """WITH o AS (SELECT o_orderkey * 7919 % 100003 AS seq, o_orderkey AS k FROM orders), c AS (SELECT k, seq AS at FROM o WHERE k <> 0 UNION ALL SELECT 0, -1)
    SELECT o.seq + 1 AS seq, CASE WHEN a.at IS NULL OR b.at IS NULL THEN 'unresolved' WHEN a.at < o.seq + 1 AND b.at < o.seq + 1 THEN 'applied' ELSE 'deferred' END AS status
    FROM o LEFT JOIN c a ON a.k = o.k LEFT JOIN c b ON b.k = o.k * 2""",
)
FOLD = """log AS (SELECT event_id AS seq, CASE WHEN event_id = 1500 THEN 'clear' WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind, user_id AS key FROM events),
    last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log WHERE kind <> 'clear' AND seq > coalesce((SELECT max(seq) FROM log WHERE kind = 'clear'), -1))"""
for fold in ("wal_replay", "compact_equivalence"):
    plain(fold, f"WITH {FOLD} SELECT key, seq FROM last WHERE n = 1 AND kind = 'upsert'")

# Scalars

plain("looks_binary", "SELECT doc_id, doc_id % 5 = 0 AND 40 * 10 >= least(8192, 40 + length(coalesce(text, ''))) AS is_binary FROM documents")
plain(
    "infer_concept_type",
    """WITH w AS (SELECT p_partkey, list_transform(string_split_regex(p_name || '_' || lower(p_type) || 's', '[-_ ]'), lambda x: upper(x[1]) || lower(x[2:])) AS w FROM part)
    SELECT p_partkey, regexp_replace(array_to_string(w, ''), 's$', '') AS concept_type FROM w""",
)
plain("classify_file", "SELECT p_partkey, ['text', 'text', 'text', 'passthrough', 'text', 'docx', 'pdf', 'image', 'text', 'passthrough', 'text'][p_partkey % 11 + 1] AS kind FROM part")
plain("event_props_variant", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
plain("humanize_relation", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'is located in nation ' || n_nationkey ELSE 'signed by nation ' || n_nationkey END AS phrase FROM nation")
plain("mask_key", "WITH k AS (SELECT c_custkey, trim(substr(c_name, 1, CAST(c_custkey % 19 AS INTEGER))) AS k FROM customer) SELECT c_custkey, CASE WHEN k = '' THEN '' ELSE left(k, 3) || '...' || right(k, 4) END AS hint FROM k")
plain(
    "extract_directives",
    """SELECT doc_id AS id, CAST(n AS BIGINT) AS line_no, tag, CASE WHEN rest = '?' THEN 'Party: ' || source ELSE rest END AS rest FROM documents,
    (VALUES (1, 'concept_type', 'Party : Agent'), (2, 'concept', '?'), (5, 'relation', 'A -knows-> B'), (6, 'rule', 'strict r on Party: when x then y'), (7, 'concept', 'Party: Shared'), (8, 'concept', 'Party: Shared')) v(n, tag, rest)""",
)
plain("distinct_mentions", "SELECT doc_id AS id, 'Party' AS concept_type, name, 'mentions_party' AS relation_type FROM (SELECT doc_id, source AS name FROM documents UNION ALL SELECT doc_id, 'Shared' FROM documents)")
plain(
    "bounded_description",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    c AS (SELECT doc_id, t, (SELECT max(n) FROM range(0, 1001) r(n) WHERE strlen(t[1:n]) <= 1000) AS n FROM t)
    SELECT doc_id, CASE WHEN strlen(t) <= 1000 THEN t ELSE t[1:n] || '…' END AS description FROM c""",
)
LINES = """lines AS (
  SELECT l_orderkey AS file_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS chunk,
    'c' || chunk || '-c-0' AS own, 'part ' || l_partkey % 50 AS part, 'Supplier:SUPPLIER#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS supplier, trunc(l_discount * 100) / 100 AS sure, * FROM lineitem
)"""
plain(
    "proposal_refs",
    f"""WITH {LINES} SELECT file_no, chunk, 'concept_type' AS kind, 'c' || chunk || '-ct-0' AS client_ref, NULL AS type, 'Kind ' || l_linenumber AS name, NULL AS source_ref, NULL AS target_ref, NULL AS flag, NULL AS applies_to, CAST(NULL AS DOUBLE) AS weight FROM lines
    UNION ALL SELECT file_no, chunk, 'relation_type', 'c' || chunk || '-rt-0', NULL, 'shipped_by', NULL, NULL, NULL, NULL, NULL FROM lines
    UNION ALL SELECT file_no, chunk, 'concept', own, 'Part', part, NULL, NULL, l_linestatus, NULL, NULL FROM lines
    UNION ALL SELECT file_no, chunk, 'relation', 'c' || chunk || '-r-0', 'shipped_by', NULL, own, supplier, NULL, NULL, l_quantity FROM lines
    UNION ALL SELECT file_no, chunk, 'rule', 'c' || chunk || '-ru-0', 'duty', 'rule ' || l_returnflag, NULL, NULL, NULL, own || ',' || supplier, NULL FROM lines
    UNION ALL SELECT file_no, chunk, 'action', 'c' || chunk || '-a-0', 'audit', 'audit ' || l_suppkey, supplier, CASE WHEN chunk > 1 THEN 'c1-c-0' END, NULL, NULL, NULL FROM lines""",
)
plain(
    "merge_chunks",
    f"""WITH {LINES} SELECT file_no, 'concept_type' AS kind, 'c' || arg_max(chunk, (sure, -chunk)) || '-ct-0' AS client_ref, NULL AS type, 'kind ' || l_linenumber AS name, max(sure) AS confidence FROM lines GROUP BY file_no, l_linenumber
    UNION ALL SELECT file_no, 'relation_type', 'c1-rt-0', NULL, 'shipped_by', 0 FROM lines GROUP BY file_no
    UNION ALL SELECT file_no, 'concept', 'c' || arg_max(chunk, (sure, -chunk)) || '-c-0', 'Part', part, max(sure) FROM lines GROUP BY file_no, part
    UNION ALL SELECT file_no, 'relation', 'c' || chunk || '-r-0', 'shipped_by', NULL, 0 FROM lines
    UNION ALL SELECT file_no, 'rule', 'c' || chunk || '-ru-0', 'duty', 'rule ' || lower(l_returnflag), 0 FROM lines
    UNION ALL SELECT file_no, 'action', 'c' || chunk || '-a-0', 'audit', 'audit ' || l_suppkey, 0 FROM lines""",
)
plain("merge_concepts_confidence", "SELECT 'part ' || l_partkey % 100 AS key, max(CAST(CAST(trunc(l_discount * 100) AS INTEGER) AS DOUBLE)) AS confidence, count(*) AS n_merged FROM lineitem GROUP BY ALL")
plain(
    "merge_proposals",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 50 AS d, 'f' || (p_partkey - least(4, p_partkey % 50)) || '/a' AS a, p_brand, p_type FROM part),
    brands AS (SELECT p_brand, min(k) AS k FROM p GROUP BY p_brand),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, k % 25 ORDER BY k) AS made, row_number() OVER (PARTITION BY a ORDER BY k) AS same, row_number() OVER (PARTITION BY p_brand, k % 40 ORDER BY k) AS ruled, row_number() OVER (PARTITION BY k % 700 ORDER BY k) AS sold FROM p)
    SELECT 'concept_type' AS kind, 'f' || k || '/t' AS client_ref, NULL AS type, p_brand AS name, NULL AS source_ref, NULL AS target_ref, NULL AS applies_to FROM brands
    UNION ALL SELECT 'relation_type', 'f' || min(k) || '/u', NULL, p_type, NULL, NULL, NULL FROM p GROUP BY p_type
    UNION ALL SELECT 'concept', 'f' || k || '/a', 'Part', 'Part ' || k, NULL, NULL, NULL FROM p
    UNION ALL SELECT 'relation', 'f' || k || '/r', 'made_in', NULL, a, 'Nation:' || k % 25, NULL FROM r WHERE made = 1
    UNION ALL SELECT 'relation', 'f' || k || '/s', 'is', NULL, a, 'Nation:all', NULL FROM r WHERE same = 1
    UNION ALL SELECT 'rule', 'f' || k || '/m', 'duty', p_brand || '-' || k % 40, NULL, NULL, a || ',f' || (SELECT b.k FROM brands b WHERE b.p_brand = r.p_brand) || '/t,none' FROM r WHERE ruled = 1
    UNION ALL SELECT 'action', 'f' || k || '/n', 'sell', CAST(k % 700 AS VARCHAR), a, CASE WHEN k % 2 = 0 THEN 'gone' END, NULL FROM r WHERE sold = 1""",
)
graph(
    "proposal_conflicts",
    """SELECT 'concept' AS kind, 'c0-c-' || p_partkey AS client_ref, 'exists' AS conflict, CAST(50000000000001 + p_partkey AS VARCHAR) AS detail FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'relation', 'c0-r-' || p_partkey, 'dangling_ref', CASE WHEN p_partkey * 2 NOT IN (SELECT p_partkey FROM part) THEN 'c0-c-' || p_partkey * 2 ELSE 'Nation:nation_' || p_partkey % 40 END FROM part WHERE p_partkey * 2 NOT IN (SELECT p_partkey FROM part) OR p_partkey % 40 >= 25
    UNION ALL SELECT 'action', 'c0-a-' || p_partkey, 'dangling_ref', CASE WHEN lost THEN 'Part:new part ' || p_partkey + 1 ELSE 'Nation:nation_' || p_partkey % 40 END
      FROM (SELECT p_partkey, p_partkey + 1 NOT IN (SELECT p_partkey FROM part) OR (p_partkey + 1) % 3 = 0 AS lost FROM part) WHERE lost OR (p_partkey % 2 = 0 AND p_partkey % 40 >= 25)
    UNION ALL SELECT 'concept_type', 'c0-ct-' || p_partkey, 'exists', 'Party' FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT 'relation_type', 'c0-rt-' || p_partkey, 'exists', 'placed_by' FROM part WHERE p_partkey % 9 = 0""",
)
plain(
    "apply_proposal",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 2 THEN 'skipped' WHEN c_custkey % 11 = 0 THEN 'nobody' WHEN c_custkey % 2 = 1 THEN 'created' WHEN c_custkey % 3 = 1 THEN 'merged' ELSE 'twice' END AS what FROM customer),
    s AS (SELECT 1 AS phase, k, 'concept' AS kind, what, what IN ('created', 'twice') AS counts FROM c
      UNION ALL SELECT 2, k, 'relation', CASE WHEN k % 7 = 0 THEN 'skipped' WHEN what = 'created' THEN 'created' WHEN what = 'merged' THEN 'CardinalityViolation' ELSE 'DanglingRef' END, what = 'created' AND k % 7 <> 0 FROM c
      UNION ALL SELECT 3, k, 'rule', CASE WHEN k % 8 = 0 THEN 'created' ELSE 'UnknownRelationType' END, k % 8 = 0 FROM c WHERE k % 4 = 0
      UNION ALL SELECT 4, k, 'action', CASE WHEN what IN ('created', 'merged') THEN 'created' ELSE 'DanglingRef' END, what IN ('created', 'merged') FROM c WHERE k % 6 <> 0),
    n AS (SELECT *, 200000000000000 + row_number() OVER (PARTITION BY counts ORDER BY phase, k) - 1 AS id FROM s)
    SELECT kind, 'c0-' || CASE kind WHEN 'concept' THEN 'c' WHEN 'relation' THEN 'r' WHEN 'rule' THEN 'ru' ELSE 'a' END || '-' || k AS client_ref, CASE WHEN what IN ('created', 'merged', 'skipped') THEN what ELSE 'failed' END AS outcome,
      CASE what WHEN 'created' THEN CAST(id AS VARCHAR) WHEN 'merged' THEN CAST(30000000000001 + k AS VARCHAR) END AS id,
      CASE WHEN what = 'nobody' THEN 'UnknownConceptType' WHEN what = 'twice' THEN 'DuplicateConcept' WHEN what NOT IN ('created', 'merged', 'skipped') THEN what END AS code FROM n
    UNION ALL VALUES ('concept_type', 'c0-ct-0', 'created', 'Gadget', NULL), ('relation_type', 'c0-rt-1', 'created', 'likes 1', NULL), ('relation_type', 'c0-rt-2', 'failed', NULL, 'UnknownConceptType')""",
)

# Prompts and answers

plain(
    "prompt_static",
    """SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY name) AS BIGINT) AS line_no, line FROM (
      SELECT 'concept_types' AS section, name, '- ' || name || ' :: ' || d AS line FROM (VALUES ('Place', 'somewhere'), ('Region', '(no description)'), ('Nation', '(no description)'), ('Party', 'who buys or sells'), ('Customer', '(no description)'), ('Supplier', '(no description)'), ('Part', '(no description)'), ('Order', '(no description)'), ('Document', '(no description)')) t(name, d)
      UNION ALL SELECT 'relation_types', name, '- (' || d || ') -[' || name || ']-> (' || r || ')' || f FROM (VALUES ('in_region', 'Nation', 'Region', ' [transitive]'), ('located_in', 'Party', 'Nation', ''), ('placed_by', 'Order', 'Customer', ''), ('placed', 'Customer', 'Order', ' [inverse: placed_by]'),
        ('contains_part', 'Order', 'Part', ''), ('shipped_by', 'Order', 'Supplier', ''), ('related_to', 'Part', 'Part', ' [symmetric]')) t(name, d, r, f))""",
)
graph(
    "prompt_facts",
    "SELECT fact_no, line FROM (SELECT *, row_number() OVER (ORDER BY id) AS fact_no, sum(strlen(line) + 1) OVER (ORDER BY id) AS used FROM l) WHERE used <= 2000",
    f"l AS (SELECT r.id, '- #' || r.source || ' ' || a.name || ' — located in ' || b.name || '.   (raw: ' || a.name || ' -[located_in]-> ' || b.name || ')' AS line FROM relations r JOIN concepts a ON a.id = r.source JOIN concepts b ON b.id = r.target WHERE r.relation_type = 'located_in' AND r.target = {NATION3})",
)
CITED = "c AS (SELECT i AS answer_id, CASE WHEN i % 5 = 0 THEN [] ELSE list_sort(list_distinct([i % 30, i % 7])) END AS ids FROM (SELECT conv_id * 1000 + turn AS i FROM conversations))"
plain("parse_citations", f"WITH {CITED} SELECT answer_id, array_to_string(ids, ',') AS cited_ids FROM c")
plain("citations_valid", f"WITH {CITED} SELECT answer_id, CAST(len(list_filter(ids, lambda x: x BETWEEN 3 AND 19)) AS BIGINT) AS n_valid, CAST(len(list_filter(ids, lambda x: x NOT BETWEEN 3 AND 19)) AS BIGINT) AS n_invalid FROM c")
plain("echo_answer", "SELECT item_id AS prompt_id, '[echo] ' || text AS raw FROM benchmark")

# Ingest

plain("ingest_csv_unpivot", "SELECT c_name AS name, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_name, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 4 <> 0")
plain("ingest_triples", "SELECT 'Order' AS concept_type, CAST(o_orderkey AS VARCHAR) AS name, o_orderkey * 3 AS first_seq FROM orders UNION ALL SELECT 'Customer', CAST(o_custkey AS VARCHAR), min(o_orderkey) * 3 + 1 FROM orders GROUP BY o_custkey")
plain("ingest_jsonl", "SELECT c_custkey AS line_no, CAST(0 AS BIGINT) AS id, 'Customer' AS concept_type, c_name AS name, '' AS description FROM customer WHERE c_custkey % 10 <> 0")

# Rules, actions and small lists

RULES = """rules AS (SELECT 210000000000001 + c_custkey AS id, CASE WHEN c_custkey % 41 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'credit' ELSE 'duty' END AS rule_type, 'rule-' || c_custkey % 500 AS name,
    30000000000001 + c_custkey AS a, 20000000000001 + c_nationkey + CASE WHEN c_custkey % 13 = 0 THEN 100 ELSE 0 END AS b, c_custkey % 3 = 0 AS strict, c_mktsegment AS description, c_custkey AS k, c_acctbal FROM customer)"""
ACTIONS = """actions AS (SELECT 220000000000001 + o_orderkey AS id, CASE WHEN o_orderkey % 43 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'audit' ELSE 'remind' END AS action_type, 'action-' || o_orderkey % 900 AS name,
    CASE WHEN o_orderkey % 17 = 0 THEN 190000000000001 ELSE 30000000000001 END + o_custkey AS subject, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 190000000000001 + o_orderkey ELSE 60000000000001 + o_orderkey END AS object,
    'done' AS effect, o_orderpriority AS description, o_orderkey AS k FROM orders)"""
plain("rule_scan", f"WITH {RULES} SELECT id, rule_type, name, 'balance < 0' AS \"when\", 'hold' AS \"then\", a || ',' || b AS applies_to, strict, description FROM rules")
plain("action_scan", f"WITH {ACTIONS} SELECT * EXCLUDE (k) FROM actions")
graph(
    "rule_refs_valid",
    """SELECT id, 'UnknownRelationType' AS code, CAST(NULL AS BIGINT) AS missing FROM rules WHERE rule_type = 'unknown'
    UNION ALL SELECT r.id, 'UnknownConcept', r.ref FROM (SELECT id, rule_type, unnest([a, b]) AS ref FROM rules) r WHERE rule_type <> 'unknown' AND ref NOT IN (SELECT id FROM concepts)""",
    RULES,
)
graph(
    "action_refs_valid",
    """SELECT id, 'UnknownRelationType' AS code, CAST(NULL AS BIGINT) AS missing FROM actions WHERE action_type = 'unknown'
    UNION ALL SELECT r.id, 'UnknownConcept', r.ref FROM (SELECT id, action_type, unnest([subject, object]) AS ref FROM actions) r WHERE action_type <> 'unknown' AND ref IS NOT NULL AND ref NOT IN (SELECT id FROM concepts)""",
    ACTIONS,
)
plain("rule_page", f"WITH {RULES} SELECT id, rule_type, name FROM rules ORDER BY rule_type, name, id LIMIT 40 OFFSET 30")
plain("action_page", f"WITH {ACTIONS} SELECT id, action_type, name FROM actions ORDER BY action_type, name, id LIMIT 60 OFFSET 100")
plain("rule_update", f"WITH {RULES} SELECT id, CASE WHEN k % 8 = 0 THEN 'release' ELSE 'hold' END AS \"then\", CASE WHEN k % 4 = 0 THEN k % 12 = 0 ELSE strict END AS strict FROM rules")
plain("action_update", f"WITH {ACTIONS} SELECT id, CASE WHEN k % 10 = 0 THEN NULL ELSE object END AS object, CASE WHEN k % 15 = 0 THEN 'undone' ELSE 'done' END AS effect FROM actions")
plain("rule_remove", f"WITH {RULES} SELECT id, name FROM rules WHERE c_acctbal >= 0")
graph("update_relation", "SELECT id, relation_type, source, target, CAST(CASE WHEN relation_type = 'contains_part' AND id % 6 = 0 THEN 0.25 ELSE weight END AS DOUBLE) AS weight FROM relations")
graph("graph_stats_with_rules", "SELECT * REPLACE ((SELECT count(*) FROM customer) AS rules, (SELECT count(*) FROM orders) AS actions, CAST(2 AS BIGINT) AS rule_types, CAST(2 AS BIGINT) AS action_types) FROM s", STATS)
plain("newest_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
plain("json_blocks", """SELECT conv_id, turn, CASE WHEN conv_id % 7 <> 0 THEN '{"a": "x } \\\\ \\" y", "n": {"id": ' || conv_id || '}}' END AS block FROM conversations""")
plain("token_usage", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS input_tokens, turn AS output_tokens, CAST(0 AS BIGINT) AS cache_creation_input_tokens, CASE WHEN conv_id % 3 = 0 THEN conv_id WHEN conv_id % 2 = 0 THEN conv_id + 1 ELSE 0 END AS cache_read_input_tokens FROM conversations")

# Index upkeep, requested subgraphs, prompt context and export

graph(
    "index_upkeep",
    f"""SELECT term, count(DISTINCT id) AS df, count(*) AS total FROM (SELECT id, unnest({TOKENS.format("concat_ws('. ', CASE WHEN concept_type = 'Customer' AND id % 10 = 0 THEN 'renamed ' || name ELSE name END, nullif(description, ''))")}) AS term
    FROM concepts WHERE concept_type <> 'Supplier') GROUP BY term""",
)
graph(
    "requested_subgraph",
    """SELECT id, CAST(0 AS BIGINT) AS depth FROM starts UNION ALL SELECT DISTINCT n, 1 FROM (SELECT r.target AS n FROM relations r JOIN starts k ON k.id = r.source UNION SELECT r.source FROM relations r JOIN starts k ON k.id = r.target) WHERE n NOT IN (SELECT id FROM starts)""",
    hybrid("red widget 1200", 32, 8) + f", starts AS (SELECT id FROM ranked UNION SELECT {NATION3})",
)
CONTEXT = f"""e AS (SELECT r.id, a.id AS party, a.concept_type AS kind, a.name AS a, a.description AS d, b.name AS b FROM relations r JOIN concepts a ON a.id = r.source JOIN concepts b ON b.id = r.target WHERE r.relation_type = 'located_in' AND r.target = {NATION3}),
    c AS (SELECT '# Top concepts' || chr(10) || '- (Nation) ' || n.name || ' [score=0.750 lex=0.500 vec=1.000]' || chr(10) || chr(10) || '# Subgraph' || chr(10)
    || '# Each line: `#<id> [depth] (Type) Name — description`. Cite the `#<id>` tokens verbatim in your answer.' || chr(10) || '- #' || n.id || ' [0] (Nation) ' || n.name || chr(10)
    || (SELECT string_agg('- #' || party || ' [1] (' || kind || ') ' || a || CASE WHEN d <> '' THEN ' — ' || d ELSE '' END || chr(10), '' ORDER BY party) FROM e) || chr(10) || '# Facts' || chr(10)
    || (SELECT string_agg('- #' || party || ' ' || a || ' — located in ' || b || '.   (raw: ' || a || ' -[located_in]-> ' || b || ')' || chr(10), '' ORDER BY id) FROM e) AS context FROM concepts n WHERE n.id = {NATION3})"""
graph("prompt_context", "SELECT context FROM c", CONTEXT)
graph("prompt_context_cut", "SELECT decode(unhex(substr(hex(encode(context)), 1, 240))) || chr(10) || '…[truncated]' || chr(10) AS context FROM c", CONTEXT)
graph(
    "export_records",
    """SELECT 'concept' AS kind, id, concept_type AS type, name FROM concepts UNION ALL SELECT 'relation', id, relation_type, CAST(source AS VARCHAR) FROM relations
    UNION ALL SELECT 'rule', id, rule_type, name FROM rules UNION ALL SELECT 'action', id, action_type, name FROM actions""",
    f"{RULES}, {ACTIONS}",
)


# A stream of records: when each is applied, then one counter over all of them

plain(
    "ingest_records",
    """
WITH customers AS (SELECT c_custkey AS c, c_name, c_nationkey, 50000000000000 + c_custkey * 3 AS own FROM customer),
events AS (
    SELECT 1 AS pass, 101 + c * 10 AS seq, 0 AS sub, 'Customer' AS type, CASE WHEN c % 7 = 0 THEN own END AS own, c AS k FROM customers
    UNION ALL SELECT 1, 10000000000000 + o_orderkey * 10, 0, 'Order', NULL, o_orderkey FROM orders
    UNION ALL SELECT 1, 10000000000001 + o_orderkey * 10, 0, 'placed_by', NULL, o_orderkey FROM orders
    UNION ALL SELECT 1, 110000000000000 + c, 0, 'credit', NULL, c FROM customers WHERE c % 7 = 0
    UNION ALL SELECT 1, 120000000000000 + c, 0, 'remind', CASE WHEN c % 5 = 0 THEN 60000000000000 + c END, c FROM customers WHERE c % 7 = 0
    UNION ALL SELECT 1, 130000000000000 + c, 0, 'knows', CASE WHEN c % 4 = 0 THEN 70000000000000 + c * 10 END, c FROM customers
    UNION ALL SELECT 1, 130000000000000 + c, 1, 'known', NULL, c FROM customers WHERE c // 7 % 20 <> 0
    UNION ALL SELECT 1, 140000000000000 + n_nationkey, 0, 'Nation', NULL, n_nationkey FROM nation
    UNION ALL SELECT 2, 100 + c * 10, 0, 'located_in', NULL, c FROM customers),
counted AS (SELECT *, count(*) FILTER (own IS NULL) OVER (ORDER BY pass, seq, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM events),
reached AS (SELECT *, max(own + 1 - f) OVER (ORDER BY pass, seq, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM counted),
ids AS (SELECT type, k, CAST(coalesce(own, f + greatest(1, coalesce(m, 1))) AS BIGINT) AS id FROM reached),
cust AS (SELECT k, id FROM ids WHERE type = 'Customer'), ord AS (SELECT k, id FROM ids WHERE type = 'Order'), nat AS (SELECT k, id FROM ids WHERE type = 'Nation')
SELECT id, type, CASE type WHEN 'Customer' THEN c_name WHEN 'credit' THEN c_name WHEN 'remind' THEN c_name END AS name,
    CASE WHEN type IN ('credit', 'remind') THEN own END AS a, CASE WHEN type = 'remind' AND c % 2 = 0 THEN own END AS b, CAST(NULL AS DOUBLE) AS weight
    FROM ids JOIN customers ON c = k WHERE type IN ('Customer', 'credit', 'remind')
UNION ALL SELECT id, type, CAST(k AS VARCHAR), NULL, NULL, NULL FROM ids WHERE type = 'Order'
UNION ALL SELECT id, type, 'NATION ' || k, NULL, NULL, NULL FROM ids WHERE type = 'Nation'
UNION ALL SELECT i.id, type, NULL, ord.id, cust.id, 1 FROM ids i JOIN orders ON o_orderkey = i.k JOIN ord ON ord.k = i.k JOIN cust ON cust.k = o_custkey WHERE type = 'placed_by'
UNION ALL SELECT i.id, type, NULL, cust.id, nat.id, 1 FROM ids i JOIN customers ON c = i.k JOIN cust ON cust.k = i.k JOIN nat ON nat.k = c_nationkey WHERE type = 'located_in'
UNION ALL SELECT id, 'knows', NULL, CASE WHEN type = 'knows' THEN x ELSE y END, CASE WHEN type = 'knows' THEN y ELSE x END, k / 8
    FROM (SELECT *, 50000000000021 AS x, 50000000000021 + k // 7 % 20 * 21 AS y FROM ids WHERE type IN ('knows', 'known'))
""",
)


# Languages and encodings

plain(
    "decode_charsets",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'utf-16-le' WHEN doc_id % 4 = 3 AND narrow AND wide THEN 'windows-1252' ELSE 'utf-8' END AS encoding, md5(body) AS body_md5, CAST(length(body) AS INTEGER) AS n_chars
    FROM (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS body, NOT regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F\\x{A0}-\\x{FF}]') AS narrow, regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]') AS wide FROM documents)""",
)
plain(
    "detect_languages",
    """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}]+', ' ', 'g')) || ' ' AS t FROM documents),
    grams AS (SELECT doc_id, lang, text, substr(t, i, 3) AS run FROM d, unnest(range(1, length(t) - 1)) AS u(i)),
    own AS (SELECT doc_id, run, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, run) AS own FROM grams GROUP BY doc_id, run QUALIFY own <= 300),
    known AS (SELECT lang, run, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, run) AS rank FROM grams WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY lang, run QUALIFY rank <= 300),
    near AS (SELECT doc_id, lang, sum(300 - least(abs(own - rank), 300)) AS near FROM own JOIN known USING (run) GROUP BY doc_id, lang HAVING near > 0),
    told AS (SELECT doc_id, lang, near, lead(near, 1, 0) OVER (PARTITION BY doc_id ORDER BY near DESC, lang) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, lang) AS n FROM near)
    SELECT doc_id AS id, told.lang, CASE WHEN regexp_matches(text, '\\p{Latin}') THEN 'Latin' END AS script, round((near - next) / near, 6) AS confidence FROM d LEFT JOIN told USING (doc_id) WHERE n IS NULL OR n = 1""",
)

plain(
    "cited_answers",
    """SELECT item_id AS prompt_id, array_to_string(list_filter(list_sort(list_distinct([item_id % 40, item_id * 7 % 40])), lambda x: x % 2 = 0), ',') AS cited,
    CAST(length(regexp_replace(trim('[echo] ' || chr(10) || 'Answer: ' || replace(text, chr(10), ' ')), '^[Aa]nswer:\\s*', '')) AS INTEGER) AS n_chars, CASE WHEN item_id % 2 = 1 OR item_id * 7 % 40 % 2 = 1 THEN 2 ELSE 1 END AS n_asked FROM benchmark""",
)
plain(
    "parsed_directives",
    """WITH d AS (SELECT doc_id AS k, coalesce(source, 'none') AS s, coalesce(text, '') AS t FROM documents),
    r(line_no, part, kind, type, name, source_name, target_name, declared) AS (VALUES
      (0, 0, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Note","description":""}'), (0, 1, 'concept', 'Note', 'doc-%k', NULL, NULL, NULL),
      (1, 0, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Kind %s","description":"about %s"}'),
      (2, 0, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Party","description":""}'), (2, 1, 'concept', 'Party', 'P%k', NULL, NULL, NULL),
      (3, 0, 'relation_type_decl', NULL, NULL, NULL, NULL, '{"name":"likes %k","domain":"Party","range":"Kind","symmetric":true}'),
      (4, 0, 'relation_type_decl', NULL, NULL, NULL, NULL, '{"name":"works with","domain":"Party","range":"Order"}'), (4, 1, 'named_relation', 'works with', NULL, 'P%k', '%k', NULL),
      (5, 0, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Party","description":""}'), (5, 1, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Order","description":""}'),
      (5, 2, 'rule_type_decl', NULL, NULL, NULL, NULL, '{"name":"pay","when":"due","then":"pay %k","applies_to":["Party","Order"],"strict":true}'),
      (7, 0, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Party","description":""}'), (7, 1, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Order","description":""}'),
      (7, 2, 'action_type_decl', NULL, NULL, NULL, NULL, '{"name":"sign","subject":"Party","object":"Order","parameters":["date","place"],"effect":"done %k"}'),
      (8, 0, 'concept_type_decl', NULL, NULL, NULL, NULL, '{"name":"Party","description":""}'), (8, 1, 'action_type_decl', NULL, NULL, NULL, NULL, '{"name":"wait","subject":"Party","parameters":[],"effect":""}'),
      (2147483647, 0, 'relation_type_decl', NULL, NULL, NULL, NULL, '{"name":"mentions_party","domain":"Note","range":"Party"}'), (2147483647, 1, 'named_relation', 'mentions_party', NULL, 'doc-%k', 'P%k', NULL),
      (2147483647, 0, 'relation_type_decl', NULL, NULL, NULL, NULL, '{"name":"mentions_order","domain":"Note","range":"Order"}'), (2147483647, 1, 'named_relation', 'mentions_order', NULL, 'doc-%k', '%k', NULL)),
    head AS (SELECT *, strlen(t) + strlen('@concept_type Kind  -- about ') + 2 * strlen(s) + strlen('@concept Party: P -- told ,@relation_type likes : Party -> Kind [symmetric]@relation Party:P -works with-> Order:;')
      + strlen('@rule strict pay on Party, Order: when due then pay @rule no colon@action sign: Party -> Order (date, place) => done @action wait: Party') + 6 * strlen(CAST(k AS VARCHAR)) + 8 AS bytes FROM d)
    SELECT k AS doc, line_no, part, kind, type, replace(name, '%k', CAST(k AS VARCHAR)) AS name, replace(source_name, '%k', CAST(k AS VARCHAR)) AS source_name, replace(target_name, '%k', CAST(k AS VARCHAR)) AS target_name,
      replace(replace(declared, '%k', CAST(k AS VARCHAR)), '%s', s) AS declared,
      CASE WHEN kind = 'concept' AND type = 'Party' THEN 4 WHEN kind = 'concept' AND bytes <= 65536 THEN CAST(length(t) + bytes - strlen(t) - 2 * (strlen(s) - length(s)) AS INTEGER) END AS n_description FROM head, r""",
)

plain(
    "chunk_documents",
    """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS l FROM documents), m AS (SELECT *, 8 * (l + 2) <= 12000 AS whole, greatest(1, 12002 // (l + 2)) AS m FROM d),
    k AS (SELECT *, CASE WHEN whole THEN 1 ELSE -(-8 // m) + CASE WHEN 8 % m = 0 THEN 0 ELSE 1 END END AS k FROM m),
    c AS (SELECT doc_id, l, i, whole, i = k - 1 AS last, CASE WHEN i = k - 1 THEN 8 - m * (k - 1) ELSE m END AS n FROM k, unnest(range(k)) AS t(i))
    SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(CASE WHEN whole THEN 8 * (l + 2) WHEN last AND n * (l + 2) <= 12000 THEN n * (l + 2) ELSE n * (l + 2) - 2 END AS INTEGER) AS n_chars FROM c""",
)
plain(
    "ingest_text_docs",
    f"""WITH samples(lang, text) AS (VALUES {", ".join(f"('{lang}', '{body}')" for lang, body in LANGUAGE_SAMPLES.items())}),
    every AS (SELECT 'page-' || page_id AS id, NULL AS lang, nfc_normalize(coalesce(html, '')) AS text FROM pages UNION ALL SELECT NULL, lang, text FROM samples),
    t AS (SELECT *, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' ' AS t FROM every),
    grams AS (SELECT id, lang, substr(t, i, 3) AS run FROM t, unnest(range(1, length(t) - 1)) AS u(i)),
    ranked AS (SELECT id, lang, run, row_number() OVER (PARTITION BY id, lang ORDER BY count(*) DESC, run) AS rank FROM grams GROUP BY id, lang, run QUALIFY rank <= 300),
    near AS (SELECT o.id, k.lang, sum(300 - least(abs(o.rank - k.rank), 300)) AS near FROM ranked o JOIN ranked k USING (run) WHERE o.id IS NOT NULL AND k.lang IS NOT NULL GROUP BY o.id, k.lang HAVING near > 0)
    SELECT id AS name, (SELECT lang FROM near WHERE near.id = every.id ORDER BY near DESC, lang LIMIT 1) AS lang,
      coalesce(contains(text[1:8192], chr(0)) OR 10 * (length(text[1:8192]) - length(regexp_replace(text[1:8192], '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]', '', 'g'))) >= length(text[1:8192]) AND text <> '', false) AS is_binary,
      CAST(length(text) AS INTEGER) AS n_chars FROM every WHERE id IS NOT NULL""",
)
