"""SQL twins of the registered queries, for DuckDB."""

from __future__ import annotations

from .trade_graph import SQL_CALLS, SQL_CONTAINS, SQL_NODES, SQL_TRADE

_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1)"
_ALL = "SELECT * FROM t_imports UNION ALL SELECT * FROM t_extends UNION ALL SELECT * FROM t_calls"

ORACLE_SQL: dict[str, str] = {
    "lang_detect": f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
e AS (SELECT *, CASE WHEN regexp_matches(path, '[^/]\\.[^./]*$') THEN regexp_extract(path, '(\\.[^./]*)$', 1) ELSE '' END AS ext FROM p)
SELECT page_id, CASE ext WHEN '.html' THEN 'html' WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json'
  WHEN '.php' THEN 'php' ELSE 'unknown' END AS language, left(path, length(path) - length(ext)) AS bare_path FROM e""",
    "ignore_filter": f"""
SELECT page_id, url FROM (SELECT *, '/' || {_PATH} AS path FROM pages)
WHERE NOT regexp_matches(path, '/(\\.git|node_modules|dist|build|\\.next|\\.idea|\\.vscode|coverage)/')
  AND NOT regexp_matches(path, '(\\.png|\\.jpg|\\.jpeg|\\.gif|\\.ico|\\.pdf|\\.zip|\\.lock)$')""",
    "clone_url_rewrite": r"""SELECT page_id, 'https://github.com/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/site.git' AS clone_url FROM pages""",
    "size_gate": """
SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1048576 THEN sha256(text) END AS text_sha256,
  length(text) > 12000 OR len(string_split(text, chr(10))) > 250 AS is_large FROM documents""",
    "extract_links": """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
    "link_graph_edges": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS src FROM pages),
l AS (SELECT page_id, regexp_extract(href, '^/([^/?#]+)', 1) AS dst
      FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))
SELECT src, dst, count(DISTINCT page_id) AS n_pages FROM l JOIN p USING (page_id) WHERE dst IN (SELECT src FROM p) GROUP BY ALL""",
    "dir_prefixes": f"""
WITH s AS (SELECT string_split({_PATH}, '/') AS a FROM pages)
SELECT array_to_string(a[1:i], '/') AS folder, count(*) AS n_pages FROM (SELECT a, unnest(range(1, len(a))) AS i FROM s) GROUP BY ALL""",
    "json_payload": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events",
    "children": f"WITH {SQL_CONTAINS} SELECT src AS id, dst AS child FROM t_contains WHERE src LIKE 'nation:%'",
    "parent": f"WITH {SQL_CONTAINS} SELECT dst AS id, src AS parent FROM t_contains",
    "containing_root": """
SELECT 'customer:' || c_custkey AS id, 'region:' || n_regionkey AS container FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'order:' || o_orderkey, 'region:' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "callers": f"WITH {SQL_CALLS} SELECT dst AS id, src AS caller FROM t_calls",
    "callees": f"WITH {SQL_CALLS} SELECT src AS id, dst AS callee FROM t_calls",
    "dependencies": f"WITH {SQL_CALLS}, {SQL_TRADE} SELECT DISTINCT src AS id, dst AS neighbor FROM ({_ALL})",
    "dependents": f"WITH {SQL_CALLS}, {SQL_TRADE} SELECT DISTINCT dst AS id, src AS neighbor FROM ({_ALL})",
    "related": f"""
WITH {SQL_CONTAINS}, {SQL_TRADE}, e AS (SELECT * FROM t_contains UNION ALL SELECT * FROM t_imports)
SELECT src AS id, dst AS neighbor FROM e WHERE src LIKE 'nation:%' UNION SELECT dst, src FROM e WHERE dst LIKE 'nation:%'""",
    "nation_imports": f"WITH {SQL_TRADE} SELECT src AS id, dst AS neighbor FROM t_imports",
    "edges_by_relation": f"""
WITH {SQL_CONTAINS}, {SQL_CALLS}, {SQL_TRADE}
SELECT relation, count(*) AS n_edges, count(DISTINCT src) AS n_src FROM (SELECT * FROM t_contains UNION ALL {_ALL}) GROUP BY relation""",
    "nodes_by_type": f"WITH {SQL_NODES} SELECT type, count(*) AS n_nodes, min(ord) AS first_ord FROM t_nodes GROUP BY type",
    "has_edge": f"WITH {SQL_TRADE} SELECT a.dst AS src, a.src AS dst FROM t_imports a JOIN t_imports b ON a.src = b.dst AND a.dst = b.src",
    "entry_points": f"WITH {SQL_CALLS} SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM t_calls WHERE dst = 'part:' || p_partkey)",
    "leaf_components": f"WITH {SQL_TRADE} SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE 'nation:' || n_nationkey NOT IN (SELECT src FROM t_strong)",
    "root_components": f"WITH {SQL_TRADE} SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE 'nation:' || n_nationkey NOT IN (SELECT dst FROM t_imports)",
    "internal_dependencies": f"WITH {SQL_TRADE} SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE 'nation:' || n_nationkey IN (SELECT dst FROM t_imports)",
    "documentation_context": f"""
WITH {SQL_CONTAINS}, {SQL_TRADE}
SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS parent,
  (SELECT count(*) FROM t_contains WHERE src = 'nation:' || n_nationkey) AS n_children,
  coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM t_imports WHERE src = 'nation:' || n_nationkey), '') AS dependencies,
  coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM t_imports WHERE dst = 'nation:' || n_nationkey), '') AS dependents
FROM nation""",
    "public_api": f"""
WITH RECURSIVE {SQL_NODES}, {SQL_CONTAINS},
r AS (SELECT 'region:1' AS id UNION SELECT dst FROM r JOIN t_contains ON src = r.id)
SELECT id, type FROM r JOIN t_nodes USING (id)""",
    "bfs_depth": f"""
WITH RECURSIVE {SQL_CONTAINS}, {SQL_CALLS}, e AS (SELECT src, dst FROM t_contains UNION SELECT src, dst FROM t_calls),
r AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.id WHERE depth < 4)
SELECT id, min(depth) AS depth FROM r GROUP BY id""",
    "subgraph_edges": f"""
WITH RECURSIVE {SQL_TRADE}, e AS (SELECT * FROM t_imports UNION ALL SELECT * FROM t_extends),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r AS (SELECT 'nation:0' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN u ON a = r.id WHERE depth < 2)
SELECT src, dst, relation FROM e WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)""",
    "inheritance_chain": f"""
WITH RECURSIVE {SQL_TRADE},
r AS (SELECT 'nation:' || n_nationkey AS id, 'nation:' || n_nationkey AS ancestor, 0 AS depth, ['nation:' || n_nationkey] AS seen FROM nation
  UNION ALL SELECT r.id, dst, depth + 1, list_append(seen, dst) FROM r JOIN t_extends ON src = ancestor WHERE NOT list_contains(seen, dst))
SELECT id, ancestor, depth FROM r""",
}

_REACH = f"""{SQL_TRADE}, e AS (SELECT src, dst FROM t_extends),
reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM reach JOIN e ON src = b),
ids AS (SELECT 'nation:' || n_nationkey AS id FROM nation),
comp AS (SELECT id, least(id, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a = id), id)) AS component FROM ids)"""

ORACLE_SQL |= {
    "scc": f"WITH RECURSIVE {_REACH} SELECT id, component FROM comp",
    "cycles": f"WITH RECURSIVE {_REACH} SELECT component, string_agg(id, ',' ORDER BY id) AS members FROM comp GROUP BY component HAVING count(*) > 1",
    "condensation": f"""
WITH RECURSIVE {_REACH} SELECT DISTINCT x.component AS src, y.component AS dst, 'EXTENDS' AS relation
FROM e JOIN comp x ON x.id = src JOIN comp y ON y.id = dst WHERE x.component <> y.component""",
    "topo_unresolved": f"WITH RECURSIVE {_REACH} SELECT id FROM ids WHERE id IN (SELECT a FROM reach WHERE a = b) OR id IN (SELECT b FROM reach WHERE a IN (SELECT a FROM reach WHERE a = b))",
    "connected_components": f"""
WITH RECURSIVE {SQL_CALLS}, u AS (SELECT src AS a, dst AS b FROM t_calls UNION SELECT dst, src FROM t_calls),
ids AS (SELECT 'order:' || o_orderkey AS id FROM orders UNION ALL SELECT 'part:' || p_partkey FROM part),
r AS (SELECT a AS id, a AS root FROM u UNION SELECT b, root FROM r JOIN u ON a = r.id),
m AS (SELECT id, min(root) AS component FROM r GROUP BY id)
SELECT coalesce(component, ids.id) AS component, count(*) AS n_nodes FROM ids LEFT JOIN m USING (id) GROUP BY 1""",
    "topo_levels": """
SELECT 0 AS level, count(*) AS n_nodes FROM region UNION ALL SELECT 1, count(*) FROM nation
UNION ALL SELECT 2, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 3, count(*) FROM orders""",
    "search_name": "SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_partkey LIMIT 50",
    "search_path": "SELECT page_id, url AS path FROM pages WHERE contains(lower(url), 'a') ORDER BY page_id LIMIT 50",
    "fuzzy_contains": """
WITH s AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red' THEN 1000 WHEN starts_with(lower(p_name), 'red') THEN 800 - length(p_name)
  WHEN contains(lower(p_name), 'red') THEN 600 - length(p_name) END AS score FROM part)
SELECT 'part:' || p_partkey AS id, p_name AS name, score FROM s WHERE score > 0 ORDER BY score DESC, p_name, p_partkey LIMIT 20""",
    "fuzzy_scores": """
WITH s AS (SELECT p_partkey, lower(p_name) AS v FROM part),
w AS (SELECT *, strpos(v, 'e') AS e, strpos(substr(v, strpos(v, 'e') + 1), 't') AS t FROM s)
SELECT p_partkey, (CASE WHEN v = 'et' THEN 1000 WHEN starts_with(v, 'et') THEN 800 - length(v) WHEN contains(v, 'et') THEN 600 - length(v)
  WHEN e > 0 AND t > 0 THEN 20 - least(e - 1, 9) - least(t - 1, 9) ELSE 0 END)::INTEGER AS score FROM w""",
    "arch_collapse": f"""
WITH {SQL_CALLS}, {SQL_TRADE}, u AS (
  SELECT 'order:' || o_orderkey AS id, 'region:' || n_regionkey AS unit FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'part:' || p_partkey, p_brand FROM part)
SELECT x.unit AS src, y.unit AS dst, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations
FROM (SELECT * FROM t_calls UNION ALL SELECT * FROM t_imports) e JOIN u x ON x.id = src JOIN u y ON y.id = dst WHERE x.unit <> y.unit GROUP BY ALL""",
    "arch_top_units": f"""
WITH {SQL_TRADE}, n AS (SELECT 'nation:' || n_nationkey AS id FROM nation ORDER BY id LIMIT 10)
SELECT src, dst FROM t_imports WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
    "dot_text": f"""
WITH {SQL_TRADE}
SELECT 0 AS part, unnest(['digraph CodeKnowledgeGraph {{', '  graph [rankdir="LR", bgcolor="#ffffff", fontname="Arial"];',
  '  node [style="filled", fillcolor="#ffffff", fontname="Arial", penwidth="1.5"];', '  edge [fontname="Arial", fontsize="10", color="#64748b"];']) AS line
UNION ALL SELECT 1, '  "nation:' || n_nationkey || '" [label="Nation\\\\n' || n_name || '", shape="ellipse", color="#475569"];' FROM nation
UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '" [label="IMPORTS"];' FROM t_imports
UNION ALL SELECT 3, '}}'""",
    "mermaid_text": f"""
WITH {SQL_TRADE}, n AS (SELECT 'nation:' || n_nationkey AS id, n_name, row_number() OVER (ORDER BY 'nation:' || n_nationkey) - 1 AS i FROM nation)
SELECT '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || (SELECT string_agg('  N' || i || '[' || n_name || ']', chr(10) ORDER BY i) FROM n) || chr(10)
  || (SELECT string_agg('  N' || a.i || ' -->|IMPORTS| N' || b.i, chr(10) ORDER BY a.i, b.i) FROM t_imports JOIN n a ON a.id = src JOIN n b ON b.id = dst) || chr(10) || '```' AS mermaid""",
    "doc_chunks": """
WITH d AS (SELECT doc_id, text, source, 'doc' || doc_id AS name, length(text) > 12000 OR len(string_split(text, chr(10))) > 250 AS large FROM documents WHERE text IS NOT NULL),
p AS (SELECT source, name, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d WHERE large),
r AS (SELECT source, name AS symbol, 'class' AS kind, NULL AS parent, text FROM d WHERE NOT large
  UNION ALL SELECT source, name || '.' || i, 'method', name, text FROM p WHERE trim(text) <> '')
SELECT 'chunk:' || left(sha256(source || ':' || symbol || ':' || kind), 32) AS chunk_id, kind, symbol, sha256(text) AS content_hash,
  sha256('Repository: ' || source || chr(10) || 'File: ' || source || '.txt' || chr(10) || coalesce('Parent: ' || parent || chr(10), '') || 'Symbol: ' || symbol || chr(10) || chr(10) || text) AS shown_hash
FROM r""",
    "content_dedupe": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "upsert_counts": """
SELECT count(*) AS stored, count(*) FILTER (doc_id % 3 <> 0) AS matched, count(*) FILTER (doc_id % 3 = 1) AS modified, count(*) FILTER (doc_id % 3 = 0) AS upserted FROM documents""",
    "vector_topk": """
WITH q AS (SELECT embedding::DOUBLE[] AS w, label AS own FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round((1 + list_cosine_similarity(embedding::DOUBLE[], w)) / 2, 5) AS score FROM embeddings, q WHERE label = own
ORDER BY (1 + list_cosine_similarity(embedding::DOUBLE[], w)) / 2 DESC, vec_id LIMIT 20""",
    "prompt_context": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT source, string_agg('CHUNK_ID: chunk:' || doc_id || chr(10) || 'FILE: ' || coalesce(source, 'unknown') || chr(10) || 'SYMBOL: doc' || doc_id || ' (document)' || chr(10) || 'LINES: 1-?' || chr(10)
  || 'RELEVANCE: unknown' || chr(10) || 'CODE:' || chr(10) || sha256(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context
FROM r WHERE place <= 5 GROUP BY source""",
    "memory_lines": """
SELECT conv_id, coalesce(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> '' AND text <> ''), 'None') AS memory FROM conversations GROUP BY conv_id""",
    "latest_status": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "status_counts": "SELECT event_type, count(*) AS n_users FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY 1",
    "imported_list": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderstatus = 'F'",
    "cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "status_update": """
SELECT p_partkey AS github_repository_id, CASE WHEN p_partkey % 2 = 0 AND p_size > 25 AND p_size * 3 <= 100 THEN 'PARSING' ELSE 'QUEUED' END AS status,
  CASE WHEN p_partkey % 2 = 0 AND p_size > 25 AND p_size * 3 <= 100 THEN p_size * 3 ELSE 0 END AS progress FROM part""",
    "import_new": """
SELECT o_orderpriority AS user_id, o_custkey AS repository_id, '1' AS installation_id, min('https://github.com/o/' || o_orderkey) AS clone_url
FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal >= 0 AND c_custkey = o_custkey AND o_orderpriority = CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END)
GROUP BY o_orderpriority, o_custkey""",
}
