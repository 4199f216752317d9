"""Field profiles, links between documents, geo fields, schema rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import rules, schemas as C
from ..session import spread
from .registry import register, table

EVENT_JSON = """'{"props":' || props || ',"user":{"id":' || user_id || '},"level":' ||
  CASE WHEN value > 50 THEN '"high"' ELSE 'false' END || ',"tags":["' || event_type || '"]}'"""


def event_bodies(spark, sf):
    return spread(table(spark, sf, "events")).select(
        F.col("event_type").alias("doc_type"), F.parse_json(F.expr(EVENT_JSON)).alias("body")
    )


@register("""
SELECT event_type AS doc_type, 'props.k' AS path, 'BIGINT' AS value_type, count(*) AS n_docs FROM events GROUP BY ALL
UNION ALL SELECT event_type, 'user.id', 'BIGINT', count(*) FROM events GROUP BY ALL
UNION ALL SELECT event_type, 'tags', 'ARRAY<STRING>', count(*) FROM events GROUP BY ALL
UNION ALL SELECT event_type, 'level', CASE WHEN value > 50 THEN 'STRING' ELSE 'BOOLEAN' END, count(*) FROM events GROUP BY ALL
""")
def field_profile(spark, sf):
    return C.field_profile(event_bodies(spark, sf))


@register("""
SELECT event_type AS doc_type, 'OBJECT<level: ' ||
  CASE WHEN bool_or(value > 50) AND bool_or(value <= 50) THEN 'VARIANT'
       WHEN bool_or(value > 50) THEN 'STRING' ELSE 'BOOLEAN' END ||
  ', props: OBJECT<k: BIGINT>, tags: ARRAY<STRING>, user: OBJECT<id: BIGINT>>' AS inferred
FROM events GROUP BY event_type
""")
def inferred_schema(spark, sf):
    return C.infer_schema(event_bodies(spark, sf))


@register("""
SELECT event_type AS doc_type, '{"properties":{"_id":{"type":"string"},"doc_type":{"type":"string"},"id":{"type":"string"},"level":' ||
  CASE WHEN bool_or(value > 50) AND bool_or(value <= 50) THEN '{}' WHEN bool_or(value > 50) THEN '{"type":"string"}' ELSE '{"type":"boolean"}' END ||
  ',"props":{"properties":{"k":{"type":"integer"}},"type":"object"},"tags":{"items":{"type":"string"},"type":"array"},' ||
  '"user":{"properties":{"id":{"type":"integer"}},"type":"object"}},"required":["doc_type"],"type":"object"}' AS "schema"
FROM events GROUP BY event_type
""")
def json_schema_by_type(spark, sf):
    """JSON schema of every document type, seeded with what all documents have."""
    found = C.json_schemas(event_bodies(spark, sf), base=rules.BASE_SCHEMA)
    rows = [(kind, json.dumps(schema, sort_keys=True, separators=(",", ":"))) for kind, schema in sorted(found.items())]
    return spark.createDataFrame(rows, "doc_type string, schema string")


def linked_documents(spark, sf):
    """Orders link to one customer, customers to a list of places."""

    def link(kind, ident):
        return F.struct(F.lit(kind).alias("doc_type"), ident.cast("string").alias("id"))

    orders = table(spark, sf, "orders").select(
        F.lit("Order").alias("doc_type"),
        F.col("o_orderkey").alias("id"),
        link("Customer", F.col("o_custkey")).alias("placed_by"),
    )
    customers = table(spark, sf, "customer").select(
        F.lit("Customer").alias("doc_type"),
        F.col("c_custkey").alias("id"),
        F.array(
            link("Nation", F.col("c_nationkey")), link("Segment", F.col("c_mktsegment"))
        ).alias("located_in"),
    )
    return orders.unionByName(customers, allowMissingColumns=True)


LINKS_SQL = """
WITH links AS (
  SELECT 'Order' AS src_type, CAST(o_orderkey AS VARCHAR) AS src_id, 'placed_by' AS edge,
         'Customer' AS dst_type, CAST(o_custkey AS VARCHAR) AS dst_id, false AS many FROM orders
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), 'located_in', 'Nation', CAST(c_nationkey AS VARCHAR), true FROM customer
  UNION ALL SELECT 'Customer', CAST(c_custkey AS VARCHAR), 'located_in', 'Segment', c_mktsegment, true FROM customer)
"""


@register(LINKS_SQL + "SELECT * FROM links WHERE dst_type <> 'Segment'")
def link_edges(spark, sf):
    declared = spark.createDataFrame(
        C.schema_link_edges(
            {
                "Order": {"properties": {"placed_by": {"$ref": "#/links/customer"}}},
                "Customer": {
                    "properties": {
                        "located_in": {"type": "array", "items": {"$ref": "#/links/place"}}
                    }
                },
            },
            {
                "customer": {"properties": {"doc_type": {"const": "Customer"}}},
                "place": {"properties": {"doc_type": {"enum": ["Nation", "Region"]}}},
            },
        ),
        "src_type string, edge string, dst_type string, cardinality string",
    )
    return C.link_edges(linked_documents(spark, sf), declared)


@register(
    LINKS_SQL
    + """
SELECT src_type, edge, dst_type, CASE WHEN bool_or(many) THEN 'multiple' ELSE 'single' END AS cardinality,
       count(*) AS n_links FROM links GROUP BY src_type, edge, dst_type
"""
)
def link_graph(spark, sf):
    return C.link_graph(C.link_edges(linked_documents(spark, sf)))


@register("""
WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT 'region/' || r_regionkey AS node, 0 AS distance FROM region WHERE r_name = 'ASIA'
UNION ALL SELECT 'nation/' || n_nationkey, 1 FROM n
UNION ALL SELECT 'customer/' || c_custkey, 2 FROM customer WHERE c_nationkey IN (SELECT * FROM n)
UNION ALL SELECT 'supplier/' || s_suppkey, 2 FROM supplier WHERE s_nationkey IN (SELECT * FROM n)
UNION ALL SELECT 'order/' || o_orderkey, 3 FROM orders WHERE o_custkey IN
  (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n))
""")
def neighbourhood(spark, sf):
    def edges(name, kind, key, other, ref):
        return table(spark, sf, name).select(
            F.concat(F.lit(f"{kind}/"), key).alias("src"), F.concat(F.lit(f"{other}/"), ref).alias("dst")
        )

    graph = (
        edges("nation", "nation", "n_nationkey", "region", "n_regionkey")
        .unionAll(edges("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .unionAll(edges("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionAll(edges("orders", "order", "o_orderkey", "customer", "o_custkey"))
    )
    seeds = (
        table(spark, sf, "region")
        .filter("r_name = 'ASIA'")
        .select(F.concat(F.lit("region/"), "r_regionkey").alias("node"))
    )
    return C.neighbourhood(graph, seeds, 3)


@register("""
SELECT c_custkey, c_mktsegment <> 'BUILDING' AS has_point,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS DOUBLE) ELSE -999 END AS lat,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal ELSE -999 END AS lon,
       CAST(c_custkey AS DOUBLE) AS object_lat
FROM customer
""")
def geo_points(spark, sf):
    docs = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "nowhere")
        .otherwise(F.concat("c_nationkey", F.lit(" , "), "c_acctbal"))
        .alias("home_geopoint"),
        F.struct(F.col("c_custkey").alias("lat"), F.lit(1).alias("lon")).alias("work_geopoint"),
    )
    return C.geo_fields(docs).select(
        "c_custkey",
        F.col("home_geopoint").isNotNull().alias("has_point"),
        F.coalesce("home_geopoint.lat", F.lit(-999.0)).alias("lat"),
        F.coalesce("home_geopoint.lon", F.lit(-999.0)).alias("lon"),
        F.col("work_geopoint.lat").alias("object_lat"),
    )


CUSTOMER_SCHEMA = {
    "properties": {
        "c_mktsegment": {"type": "string", "enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]},
        "c_acctbal": {"type": "number", "minimum": 0, "maximum": 9000},
        "c_name": {"type": "string", "pattern": "^Customer#[0-9]+[02468]$", "maxLength": 18},
        "c_nationkey": {"type": "integer", "multipleOf": 3},
        "note": {"type": "string", "nullable": True},
    },
    "required": ["c_name", "phone"],
}


@register("""
SELECT c_custkey, concat_ws('; ',
  CASE WHEN c_acctbal > 9000 THEN 'c_acctbal: maximum' END,
  CASE WHEN c_acctbal < 0 THEN 'c_acctbal: minimum' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'c_mktsegment: enum' END,
  CASE WHEN length(c_name) > 18 THEN 'c_name: maxLength' END,
  CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]+[02468]$') THEN 'c_name: pattern' END,
  CASE WHEN c_nationkey % 3 <> 0 THEN 'c_nationkey: multipleOf' END,
  CASE WHEN c_acctbal < 1000 THEN 'phone: required' END) AS broken
FROM customer
""")
def schema_rules(spark, sf):
    docs = table(spark, sf, "customer").withColumn(
        "phone", F.when(F.col("c_acctbal") >= 1000, F.lit("555"))
    )
    schema = rules.merge_schemas({"type": "object"}, CUSTOMER_SCHEMA)
    broken = F.array_sort(rules.document_violations(schema, docs))
    return docs.select("c_custkey", F.array_join(broken, "; ").alias("broken"))


@register("""
WITH e AS (SELECT event_id, value, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, concat_ws('; ',
  CASE WHEN value <= 50 THEN '$: anyOf' END,
  CASE WHEN value <= 50 THEN 'level: type' END,
  CASE WHEN k > 90 THEN 'props.k: maximum' END,
  CASE WHEN k <= 10 THEN 'props.k: minimum' END,
  CASE WHEN event_type = 'error' THEN 'tags: items' END) AS broken
FROM e
""")
def schema_rules_open(spark, sf):
    schema = {
        "type": "object",
        "properties": {
            "props": {
                "type": "object",
                "additionalProperties": False,
                "properties": {
                    "k": {
                        "type": "integer", "minimum": 10, "exclusiveMinimum": True, "maximum": 90
                    }
                },
            },
            "level": {"type": "string"},
            "tags": {
                "type": "array", "minItems": 1, "uniqueItems": True,
                "items": {"type": "string", "not": {"enum": ["error"]}},
            },
        },
        "anyOf": [
            {"properties": {"level": {"enum": ["high"]}}},
            {"required": ["never"]},
        ],
        "required": ["props", "user"],
    }
    docs = table(spark, sf, "events").withColumn("body", F.parse_json(F.expr(EVENT_JSON)))
    broken = F.array_sort(rules.document_violations(schema, docs, "body"))
    return docs.select("event_id", F.array_join(broken, "; ").alias("broken"))


TREE_JSON = """
CASE WHEN o_orderkey % 4 = 3 THEN '{"size":3,"kids":[{"size":"x"},{"size":1,"kids":[{"size":' || (o_orderkey % 5 - 2) || '}]}],"more":{"a":{"size":2},"b":{"size":-7}}}'
ELSE repeat('{"size":1,"next":', d) || '{"size":' || (o_orderkey % 3 - 1) || ',"pair":[1,' || CASE WHEN o_orderkey % 2 = 0 THEN '"y"' ELSE '2' END || ',3]}' || repeat('}', d) END"""


@register(f"""
WITH o AS (SELECT o_orderkey, (o_orderkey % 7)::INT AS d FROM orders)
SELECT o_orderkey, repeat('next.', d) || 'size: minimum' AS violation FROM o WHERE o_orderkey % 4 <> 3 AND o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, repeat('next.', d) || 'pair: items[1]' FROM o WHERE o_orderkey % 4 <> 3 AND o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, repeat('next.', d) || 'pair: additionalItems' FROM o WHERE o_orderkey % 4 <> 3
UNION ALL SELECT o_orderkey, v FROM o, (VALUES ('kids[0].size: type'), ('more.b.size: minimum')) t(v) WHERE o_orderkey % 4 = 3
UNION ALL SELECT o_orderkey, 'kids[1].kids[0].size: minimum' FROM o WHERE o_orderkey % 4 = 3 AND o_orderkey % 5 < 2
""")
def schema_cycle(spark, sf):
    """Rules of a node that refers to itself by a field, by the elements of a list and by unnamed fields."""
    node = {
        "type": "object",
        "properties": {
            "size": {"$ref": "#/definitions/Size"},
            "next": {"$ref": "#/definitions/Node"},
            "kids": {"type": "array", "items": {"$ref": "#/definitions/Node"}},
            "more": {"type": "object", "additionalProperties": {"$ref": "#/definitions/Node"}},
            "pair": {"type": "array", "items": [{"type": "integer"}, {"type": "integer"}], "additionalItems": False},
        },
    }
    schema = {"$ref": "#/definitions/Node", "definitions": {"Node": node, "Size": {"type": "integer", "minimum": 0}}}
    docs = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("d"))
    docs = docs.select("o_orderkey", F.parse_json(F.expr(TREE_JSON)).alias("body"))
    return rules.recursive_violations(docs, "o_orderkey", "body", schema)
