"""Registered queries of the engine's operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths, text
from loomgraph.operators import catalog, chunks, diagram, rag, search, traversal
from loomgraph.plans import trade_graph as tg
from loomgraph.plans.trade_graph import table
from loomgraph.sources.files import text_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- scan and text ---------------------------------------------------------------------------------


@query
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", paths.language(path, {".html": "html"}).alias("language"), paths.without_extension(path).alias("bare_path"))


@query
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").filter(~paths.ignored(path)).select("page_id", "url")


@query
def clone_url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts and first folders as API addresses, rewritten to clone addresses."""
    api = F.regexp_replace("url", r"^[a-z]+://([^/?#]+).*$", "https://api.github.com/repos/$1/site/")
    return table(spark, sf_dir, "pages").select("page_id", paths.web_clone_url(api).alias("clone_url"))


@query
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of documents that aren't too large or binary, as the scan reads them, and which make large chunks."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.encode("text", "UTF-8"))
    return docs.select("doc_id", F.sha2(text_of(F.col("content"), F.octet_length("content")), 256).alias("text_sha256"), chunks.is_large(F.col("text")).alias("is_large"))


@query
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


@query
def link_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the top folders of sites, each pair once with its pages; dropped where no page is in the folder linked to."""
    top = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", top.alias("src"))
    links = extract_links(spark, sf_dir).select("page_id", F.regexp_extract("href", r"^/([^/?#]+)", 1).alias("dst"))
    known = links.join(pages.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return known.join(pages, "page_id").groupBy("src", "dst").agg(F.countDistinct("page_id").alias("n_pages"))


@query
def dir_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.explode(paths.prefixes(path)).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_pages"))


@query
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# -- graph: neighbours -----------------------------------------------------------------------------


@query
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "contains")
    return nav.get_children(nav.search_by_type("Nation")).select("id", "child")


@query
def parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "contains")
    return nav.parents().select("id", "parent")


@query
def containing_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region that holds each customer, order and supplier."""
    nav = tg.navigator(spark, sf_dir, "contains")
    return nav.containing("Region", nav.nodes.filter("type in ('Customer', 'Order', 'Supplier')")).select("id", "container")


@query
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "calls")
    return nav.get_callers(nav.search_by_type("Part")).select("id", F.col("neighbor").alias("caller"))


@query
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "calls")
    return nav.get_calls(nav.search_by_type("Order")).select("id", F.col("neighbor").alias("callee"))


@query
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports", "extends", "calls")
    return nav.get_dependencies(nav.nodes).select("id", "neighbor")


@query
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports", "extends", "calls")
    return nav.get_dependents(nav.nodes).select("id", "neighbor")


@query
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "contains", "imports", "calls")
    return nav.get_related_symbols(nav.search_by_type("Nation")).select("id", "neighbor")


@query
def nation_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports")
    return nav.get_imports(nav.nodes).select("id", "neighbor")


@query
def edges_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "contains", "imports", "calls", "extends")
    return nav.edges.groupBy("relation").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"))


@query
def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_nodes"), F.min("ord").alias("first_ord"))


@query
def has_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which IMPORTS edges have one that goes back."""
    nav = tg.navigator(spark, sf_dir, "imports")
    back = nav.edges.select("repository_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return nav.has_edge(back, ("IMPORTS",)).select("src", "dst")


@query
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "calls")
    return nav.get_entry_points(("Part",)).select("id", "name")


@query
def leaf_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "strong")
    importing = nav.edges.select("repository_id", F.col("src").alias("id"))
    return nav.search_by_type("Nation").join(importing, ["repository_id", "id"], "left_anti").select("id", "name")


@query
def root_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports")
    imported = nav.edges.select("repository_id", F.col("dst").alias("id"))
    return nav.search_by_type("Nation").join(imported, ["repository_id", "id"], "left_anti").select("id", "name")


@query
def internal_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports")
    imported = nav.edges.select("repository_id", F.col("dst").alias("id"))
    return nav.search_by_type("Nation").join(imported, ["repository_id", "id"], "left_semi").select("id", "name")


@query
def documentation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with its parent, children, and import neighbours."""
    nav = tg.navigator(spark, sf_dir, "contains", "imports")
    full = nav.get_documentation_context(nav.search_by_type("Nation"))
    return full.select("id", "parent", F.size("children").cast("bigint").alias("n_children"), F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


# -- graph: traversal ------------------------------------------------------------------------------


@query
def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What region 1 holds, at any depth."""
    nav = tg.navigator(spark, sf_dir, "contains")
    return nav.get_public_api("region:1").select("id", "type")


@query
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "contains", "calls")
    return nav.bfs("region:0", 4).select("id", "depth")


@query
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports", "extends")
    _, within = nav.get_subgraph("nation:0", 2)
    return within.select("src", "dst", "relation")


@query
def inheritance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "extends")
    return nav.get_inheritance_tree(nav.search_by_type("Nation")).select("id", "ancestor", "depth")


def _extends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tg.nodes(spark, sf_dir).filter("type = 'Nation'"), tg.extends(spark, sf_dir)


@query
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.strong_components(*_extends(spark, sf_dir)).select("id", "component")


@query
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.cycles(*_extends(spark, sf_dir)).select("component", F.array_join("members", ",").alias("members"))


@query
def condensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _ = traversal.condensation(*_extends(spark, sf_dir))
    return edges.select("src", "dst", "relation")


@query
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders and parts that CALLS joins."""
    nodes = tg.nodes(spark, sf_dir).filter("type in ('Order', 'Part')")
    return traversal.weak_components(nodes, tg.calls(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n_nodes"))


@query
def topo_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.topological_levels(*_extends(spark, sf_dir)).filter("unresolved").select("id")


@query
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the containment graph, which has no cycle."""
    nodes = tg.nodes(spark, sf_dir).filter("type <> 'Part'")
    levels = traversal.topological_levels(nodes, tg.contains(spark, sf_dir))
    return levels.groupBy("level").agg(F.count("*").alias("n_nodes"))


@query
def dfs_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preorder of the import graph of nations from nation 0."""
    nav = tg.navigator(spark, sf_dir, "imports")
    return nav.dfs("nation:0").select("id", "depth", "parent", "place")


# -- search ----------------------------------------------------------------------------------------


@query
def search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_name(tg.nodes(spark, sf_dir).filter("type = 'Part'"), "an", limit=50).select("id", "name")


@query
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("page_id").alias("ord"))
    return search.by_path(pages, "a", limit=50).select("page_id", "path")


@query
def fuzzy_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tg.nodes(spark, sf_dir).filter("type = 'Part'")
    return search.fuzzy(nodes, "red", limit=20, binary=True).select("id", "name", "score")


@query
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a query that most names hold only with gaps."""
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", text.fuzzy_score(F.col("p_name"), "et").alias("score"))


# -- architecture ----------------------------------------------------------------------------------


@query
def arch_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS and IMPORTS collapsed to regions: a customer's order calls a part, a nation imports a nation."""
    nav = tg.navigator(spark, sf_dir, "contains", "calls", "imports")
    brands = table(spark, sf_dir, "part").select(F.lit(tg.REPOSITORY).alias("repository_id"), F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("unit"))
    regions = nav.containing("Region", nav.nodes.filter("type in ('Order', 'Nation')")).withColumnRenamed("container", "unit")
    edges = diagram.collapse(nav.iterate_edges(diagram.ARCHITECTURE), regions.unionByName(brands))
    return edges.select("src", "dst", F.array_join("relations", ",").alias("relations"))


@query
def arch_top_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports")
    rows = nav.search_by_type("Nation").select("repository_id", "id", "name", "type")
    _, edges = diagram.top_units(rows, nav.edges, max_nodes=10)
    return edges.select("src", "dst")


@query
def dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOT lines of nations and what they import."""
    nav = tg.navigator(spark, sf_dir, "imports")
    return diagram.dot_lines(nav.search_by_type("Nation"), nav.edges).select("part", "line")


@query
def mermaid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = tg.navigator(spark, sf_dir, "imports")
    rows = nav.search_by_type("Nation").select("repository_id", "id", "name", "type")
    shown, edges = diagram.top_units(rows, nav.edges.select("repository_id", "src", "dst", F.array("relation").alias("relations")))
    return diagram.to_mermaid(shown, edges).select("mermaid")


# -- chunks ----------------------------------------------------------------------------------------


@query
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as classes and their non-blank paragraphs as methods: large documents are cut up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    name = F.concat(F.lit("doc"), F.col("doc_id"))
    marked = docs.filter("text is not null").withColumn("large", chunks.is_large(F.col("text")))
    small = marked.filter(~F.col("large")).select("source", name.alias("symbol"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("parent"), "text")
    parts = marked.filter("large").select("source", F.posexplode(F.split("text", "\n")).alias("i", "text"), name.alias("parent"))
    parts = parts.filter(F.trim("text") != "").select("source", F.concat("parent", F.lit("."), "i").alias("symbol"), F.lit("method").alias("kind"), "parent", "text")
    rows = small.unionByName(parts)
    file = F.concat(F.col("source"), F.lit(".txt"))
    return rows.select(
        chunks.chunk_id(F.col("source"), F.col("symbol"), F.col("kind")).alias("chunk_id"),
        "kind",
        "symbol",
        chunks.content_hash(F.col("text")).alias("content_hash"),
        F.sha2(chunks.header(F.col("source"), file, F.col("parent"), F.col("symbol"), F.col("text")), 256).alias("shown_hash"),
    )


@query
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.groupBy(chunks.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserting each document into the two-thirds already stored, a third of them under an older text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    old = docs.filter("doc_id % 3 <> 0").withColumn("content", F.when(F.col("doc_id") % 3 == 1, F.lit("older")).otherwise(F.col("content")))
    return catalog.upsert_counts(old, docs, ["doc_id"], "content")


# -- retrieval -------------------------------------------------------------------------------------


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of its label nearest to vector 0."""
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.filter("vec_id = 0").select(F.col("embedding").alias("wanted"), F.col("label").alias("own_label"))
    near = vectors.join(F.broadcast(wanted), F.col("label") == F.col("own_label"))
    return rag.vector_search(near, F.col("wanted"), 20, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


@query
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents of each source as prompt blocks."""
    docs = table(spark, sf_dir, "documents")
    ranked = docs.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("place <= 5")
    block = rag.chunk_block(F.concat(F.lit("chunk:"), "doc_id"), F.col("source"), F.concat(F.lit("doc"), "doc_id"), F.lit("document"), F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("double"), F.sha2("text", 256))
    rows = ranked.select("source", F.struct("place", block.alias("block")).alias("r"))
    return rows.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["block"]), "\n\n---\n\n").alias("context"))


@query
def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.memory_lines(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


# -- catalog ---------------------------------------------------------------------------------------


@query
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return catalog.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_status(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n_users"))


@query
def imported_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above the mean price as one owner's list, newest first."""
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "owner").otherwise("other").alias("owner"), "o_orderkey", F.col("o_orderdate").alias("updated_at"), "o_totalprice"
    )
    return catalog.imported_list(orders, "owner", ["o_orderkey", "o_totalprice", "updated_at"]).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.remove(table(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as progress: valid updates merged into a catalog of all parts."""
    parts = table(spark, sf_dir, "part")
    old = parts.select(F.col("p_partkey").alias("github_repository_id"), F.lit("QUEUED").alias("status"), F.lit(0).alias("progress"))
    new = parts.filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("github_repository_id"), F.when(F.col("p_size") > 25, "PARSING").otherwise("BROKEN").alias("status"), (F.col("p_size") * 3).alias("progress")
    )
    return catalog.update_status(old, new)


@query
def import_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders imported as repositories unless their owner has them in the catalog already; each once."""
    known = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("owner"), F.col("c_custkey").alias("github_repository_id"))
    wanted = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("github_repository_id"), F.col("o_orderpriority").alias("owner"), F.lit("1").alias("installation_id"), F.concat(F.lit("https://github.com/o/"), "o_orderkey").alias("clone_url")
    )
    _, jobs, _ = catalog.import_repositories(known, wanted)
    return jobs
