"""Property graph extraction from orders, customers and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles as A, graph as G
from .registry import register, table

CONFIG = {
    "Order": {
        "vertex_label": "Order",
        "fields": [
            {"type": "property", "name": "id", "path": "id", "index": True},
            {"type": "property", "name": "status", "path": "status", "default": "unknown"},
            {"type": "property", "name": "urgent", "path": "urgent"},
            {
                "type": "edge", "edge_label": "PLACED_BY", "target_vertex_label": "Customer",
                "target_id": "id", "path": "customer.id",
            },
            {
                "type": "edge", "edge_label": "HAS_PRIORITY", "target_vertex_label": "Priority",
                "target_id": "id", "path": "@",
                "target_property_fields": [
                    {"name": "id", "path": "priority.name"},
                    {"name": "kind", "path": "doc_type"},
                ],
            },
        ],
    },
    "Customer": {
        "fields": [
            {"type": "property", "name": "id", "path": "id", "index": True},
            {"type": "property", "name": "name", "path": "name"},
            {"type": "property", "name": "balance", "path": "balance", "default": "none"},
            {
                "type": "edge", "edge_label": "LIVES_IN", "target_vertex_label": "Place",
                "target_id": "id", "path": "places[]",
                "target_property_fields": [
                    {"name": "id", "path": "name"}, {"name": "level", "path": "level"},
                ],
            },
        ],
    },
}


def order_documents(spark, sf):
    return table(spark, sf, "orders").select(
        F.lit("Order").alias("doc_type"),
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.struct(F.col("o_custkey").alias("id")).alias("customer"),
        F.struct(
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("name")
        ).alias("priority"),
    )


def customer_documents(spark, sf):
    def place(name, level):
        return F.struct(name.alias("name"), F.lit(level).alias("level"))

    return table(spark, sf, "customer").select(
        F.lit("Customer").alias("doc_type"),
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance"),
        F.array(
            place(F.concat(F.lit("N"), "c_nationkey"), "nation"), place(F.col("c_mktsegment"), "segment")
        ).alias("places"),
    )


def all_vertices(spark, sf):
    return G.vertices(order_documents(spark, sf), CONFIG, "Order").unionAll(
        G.vertices(customer_documents(spark, sf), CONFIG, "Customer")
    )


def all_edges(spark, sf):
    return G.edges(order_documents(spark, sf), CONFIG, "Order").unionAll(
        G.edges(customer_documents(spark, sf), CONFIG, "Customer")
    )


VERTICES_SQL = """v AS (
  SELECT 'Order' AS label, CAST(o_orderkey AS VARCHAR) AS id, '' AS name,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'unknown' END AS status,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE '' END AS urgent, false AS poor FROM orders
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), c_name, '', '', c_acctbal <= 0 FROM customer)"""
EDGES_SQL = """e AS (
  SELECT 'Order' AS src_label, CAST(o_orderkey AS VARCHAR) AS src_id, 'PLACED_BY' AS edge, 'Customer' AS dst_label,
         CAST(o_custkey AS VARCHAR) AS dst_id, '' AS kind FROM orders WHERE o_custkey <> 0
  UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), 'HAS_PRIORITY', 'Priority', o_orderpriority, 'Order' FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), 'LIVES_IN', 'Place', 'N' || c_nationkey, 'nation' FROM customer
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), 'LIVES_IN', 'Place', c_mktsegment, 'segment' FROM customer)"""


def prop(name):
    return F.coalesce(F.try_element_at("props", F.lit(name)), F.lit(""))


@register(f"""
WITH {VERTICES_SQL}
SELECT label, CASE WHEN label = 'Order' AND id = '0' THEN '' WHEN id = '0' THEN '' ELSE id END AS id, name, status, urgent, poor FROM v
""")
def graph_vertices(spark, sf):
    # an id of 0 is falsy and becomes the empty default, as every other falsy value
    return all_vertices(spark, sf).select(
        "label",
        "id",
        prop("name").alias("name"),
        prop("status").alias("status"),
        prop("urgent").alias("urgent"),
        (prop("balance") == "none").alias("poor"),
    )


@register(f"WITH {EDGES_SQL} SELECT * FROM e")
def graph_edges(spark, sf):
    kind = F.coalesce(
        F.try_element_at("dst_props", F.lit("kind")),
        F.try_element_at("dst_props", F.lit("level")),
        F.lit(""),
    )
    return all_edges(spark, sf).select("src_label", "src_id", "edge", "dst_label", "dst_id", kind.alias("kind"))


@register("""
WITH m AS (
  SELECT 'Customer' AS label, CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS id, c_name AS name, '' AS level FROM customer
  UNION SELECT 'Customer', CAST(o_custkey AS VARCHAR), NULL, NULL FROM orders WHERE o_custkey <> 0
  UNION SELECT 'Place', 'N' || c_nationkey, '', 'nation' FROM customer
  UNION SELECT 'Place', c_mktsegment, '', 'segment' FROM customer
  UNION SELECT 'Priority', o_orderpriority, '', '' FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT label, id, coalesce(max(name), '') AS name, coalesce(max(level), '') AS level FROM m GROUP BY label, id
""")
def merged_vertices(spark, sf):
    customers = G.vertices(customer_documents(spark, sf), CONFIG, "Customer")
    stubs = G.target_stubs(all_edges(spark, sf))
    rows = stubs.withColumn("seq", F.lit(0)).unionAll(customers.withColumn("seq", F.lit(1)))
    return G.merge_vertices(rows, F.col("seq")).select(
        "label", "id", prop("name").alias("name"), prop("level").alias("level")
    )


@register(f"WITH {VERTICES_SQL} SELECT label, count(*) AS n FROM v GROUP BY label")
def node_counts(spark, sf):
    return G.node_counts(all_vertices(spark, sf))


@register(f"WITH {EDGES_SQL} SELECT edge, count(*) AS n FROM e GROUP BY edge")
def edge_counts(spark, sf):
    return G.edge_counts(all_edges(spark, sf))


@register(f"""
WITH {EDGES_SQL} SELECT src_label, edge, dst_label, count(*) AS n
FROM (SELECT DISTINCT src_label, src_id, edge, dst_label, dst_id FROM e) GROUP BY src_label, edge, dst_label
""")
def triple_counts(spark, sf):
    return G.triple_counts(G.merge_edges(all_edges(spark, sf)))


@register(f"""
WITH {VERTICES_SQL}, {EDGES_SQL}
SELECT 'node' AS part, label AS what, count(*) AS n FROM v WHERE label <> 'Customer' GROUP BY label
UNION ALL SELECT 'edge', edge, count(*) FROM e WHERE src_label <> 'Customer' AND dst_label <> 'Customer' GROUP BY edge
""")
def detach_delete(spark, sf):
    v, e = G.detach_delete(all_vertices(spark, sf), all_edges(spark, sf), "Customer")
    return G.node_counts(v).select(F.lit("node").alias("part"), F.col("label").alias("what"), "n").unionAll(
        G.edge_counts(e).select(F.lit("edge"), "edge", "n")
    )


@register("""
SELECT 'Buyer' AS label, CAST(o_custkey AS VARCHAR) AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1
""")
def duplicate_ids(spark, sf):
    buyers = table(spark, sf, "orders").select(
        F.lit("Buyer").alias("label"), F.col("o_custkey").cast("string").alias("id")
    )
    return G.duplicate_ids(buyers)


@register(f"""
WITH {VERTICES_SQL}
SELECT label || '/' || CASE WHEN id = '0' THEN '' ELSE id END AS node,
  CASE WHEN label = 'Customer' THEN 'Customer (' || name || ')' ELSE 'Order (' || CASE WHEN id = '0' THEN '' ELSE id END || ')' END AS display
FROM v
""")
def subgraph_nodes(spark, sf):
    nodes, _ = G.export_subgraph(all_vertices(spark, sf), all_edges(spark, sf))
    return nodes.select("node", "display")


@register(f"""
WITH {EDGES_SQL} SELECT src_label || '/' || src_id AS source, dst_label || '/' || dst_id AS target, edge AS type FROM e
""")
def subgraph_edges(spark, sf):
    _, links = G.export_subgraph(all_vertices(spark, sf), all_edges(spark, sf))
    return links


@register(r"""
SELECT CAST(p.page_id AS VARCHAR) AS src_id, 'LINKS_TO' AS edge, 'Path' AS dst_label, p.href AS dst_id
FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"#]+)', 1))) AS href FROM pages) p
""")
def page_link_edges(spark, sf):
    config = {
        "Page": {
            "fields": [
                {
                    "type": "edge", "edge_label": "LINKS_TO", "target_vertex_label": "Path",
                    "target_id": "id", "path": "links[]",
                }
            ]
        }
    }
    docs = table(spark, sf, "pages").select(
        F.lit("Page").alias("doc_type"), F.col("page_id").alias("id"), A.page_links(F.col("html")).alias("links")
    )
    return G.edges(docs, config, "Page").select("src_id", "edge", "dst_label", "dst_id")
