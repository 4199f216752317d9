"""Property graphs from documents: vertices, edges, merging and counts.

A graph configuration names, per document type, a vertex label and its fields::

    {"Order": {"vertex_label": "Order", "fields": [
        {"type": "property", "name": "id", "path": "id", "index": True},
        {"type": "edge", "edge_label": "PLACED_BY", "target_vertex_label": "Customer",
         "target_id": "id", "path": "customer.id"}]}}

Paths are dotted, ``[]`` spreads an array and ``@`` is the whole document. They are resolved
against the DataFrame schema, so extraction is a projection over typed columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.rows import each


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """Column and type of a path in the row; null text when the path does not exist."""
    if path == "@":
        return F.struct(*[F.col(f"`{n}`") for n in schema.names]), schema
    head, *rest = path.split(".")
    name = head.removesuffix("[]")
    if name not in schema.names:
        return F.lit(None).cast("string"), T.StringType()
    return _descend(F.col(f"`{name}`"), schema[name].dataType, rest)


def _descend(c: Column, dtype: T.DataType, rest: list[str]) -> tuple[Column, T.DataType]:
    for part in rest:
        name = part.removesuffix("[]")
        inner = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
        if isinstance(inner, T.ArrayType):
            c, dtype, inner = F.flatten(c), inner, inner.elementType
        if not isinstance(inner, T.StructType) or name not in inner.names:
            return F.lit(None).cast("string"), T.StringType()
        c = c[name]
        found = inner[name].dataType
        dtype = T.ArrayType(found) if isinstance(dtype, T.ArrayType) else found
    return c, dtype


def _truthy(c: Column, dtype: T.DataType) -> Column:
    """Null, empty, zero and false all count as no value."""
    if isinstance(dtype, T.StringType):
        return F.length(c) > 0
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, T.NumericType):
        return c != 0
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.size(c) > 0
    return c.isNotNull()


def vertices(docs: DataFrame, config: Mapping, doc_type: str) -> DataFrame:
    """``label, id, props map<string,string>`` of one document type."""
    mine = docs.filter(F.col("doc_type") == doc_type)
    rules = config[doc_type]
    label = rules.get("vertex_label", doc_type)
    id_field, props = "id", []
    for f in rules.get("fields", []):
        if f.get("type") != "property":
            continue
        c, dtype = resolve(docs.schema, f["path"])
        text = F.to_json(c) if isinstance(dtype, (T.StructType, T.ArrayType)) else c.cast("string")
        value = F.when(_truthy(c, dtype), text).otherwise(F.lit(f.get("default", "")))
        props.append((f["name"], value))
        if f.get("index"):
            id_field = f["name"]
    by_name = dict(props)
    ident = by_name.get(id_field, F.col("id").cast("string"))
    rest = [x for n, v in props if n != id_field for x in (F.lit(n), v)]
    bag = F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")
    return mine.select(F.lit(label).alias("label"), ident.alias("id"), bag.alias("props"))


EDGE_ITEM = "array<struct<edge:string,dst_label:string,dst_id:string,dst_props:map<string,string>>>"


def edges(docs: DataFrame, config: Mapping, doc_type: str) -> DataFrame:
    """``src_label, src_id, edge, dst_label, dst_id, dst_props`` of one document type.

    All edge fields of a document are gathered into one array and exploded once, so the
    documents are read a single time however many edge kinds there are.
    """
    mine = docs.filter(F.col("doc_type") == doc_type)
    rules = config[doc_type]
    src_label = rules.get("vertex_label", doc_type)
    lists = []
    for f in rules.get("fields", []):
        if f.get("type") != "edge":
            continue
        c, dtype = resolve(docs.schema, f["path"])
        many = isinstance(dtype, T.ArrayType)
        element = dtype.elementType if many else dtype
        targets = F.coalesce(c, F.array().cast(dtype)) if many else F.array(c)
        lists.append(_edge_items(targets, element, f, many))
    src = next(
        (
            resolve(docs.schema, f["path"])[0].cast("string")
            for f in rules.get("fields", [])
            if f.get("type") == "property" and f.get("index")
        ),
        F.col("id").cast("string"),
    )
    source = [F.lit(src_label).alias("src_label"), src.alias("src_id")]
    return each(mine, source, F.flatten(F.array(*lists)), "e").select("src_label", "src_id", "e.*")


def _edge_items(targets: Column, dtype: T.DataType, f: Mapping, in_list: bool) -> Column:
    items = F.transform(targets, lambda t: _edge_item(t, dtype, f, in_list))
    return F.filter(items, lambda e: e["dst_id"].isNotNull()).cast(EDGE_ITEM)


def _edge_item(t: Column, dtype: T.DataType, f: Mapping, in_list: bool) -> Column:
    target_id = f["target_id"]
    if isinstance(dtype, T.StructType):
        fields = f.get("target_property_fields", [])
        if fields:
            props = {
                x["name"]: _descend(t, dtype, x["path"].split("."))[0].cast("string")
                for x in fields
            }
        else:
            props = {target_id: _descend(t, dtype, [target_id])[0].cast("string")}
        ident = props.get(target_id, F.lit(None).cast("string"))
        rest = [x for n, v in props.items() if n != target_id for x in (F.lit(n), v)]
    else:
        # single falsy values give no edge; list elements only need to be there
        text = t.cast("string")
        ident = text if in_list else F.when(_truthy(t, dtype), text)
        rest = []
    bag = F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(f["edge_label"]).alias("edge"),
        F.lit(f["target_vertex_label"]).alias("dst_label"),
        ident.alias("dst_id"),
        bag.alias("dst_props"),
    )


def target_stubs(edge_rows: DataFrame) -> DataFrame:
    """Vertices that edges point to."""
    return edge_rows.select(
        F.col("dst_label").alias("label"), F.col("dst_id").alias("id"), F.col("dst_props").alias("props")
    )


def merge_vertices(rows: DataFrame, seq: Column) -> DataFrame:
    """One vertex per ``(label, id)``; every property keeps its last written value.

    A partial aggregate per property: a vertex that a third of all edges point to stays cheap.
    """
    flat = rows.select("label", "id", seq.alias("__seq"), F.explode_outer("props").alias("name", "value"))
    last = flat.groupBy("label", "id", "name").agg(F.max_by("value", "__seq").alias("value"))
    return last.groupBy("label", "id").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
            )
        ).alias("props")
    )


def merge_edges(rows: DataFrame) -> DataFrame:
    return rows.select("src_label", "src_id", "edge", "dst_label", "dst_id").distinct()


def node_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("label").agg(F.count("*").alias("n"))


def edge_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("edge").agg(F.count("*").alias("n"))


def triple_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("src_label", "edge", "dst_label").agg(F.count("*").alias("n"))


def detach_delete(v: DataFrame, e: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Remove a label and every edge that touches it; edges carry labels, so no join is needed."""
    gone = F.lit(label)
    return (
        v.filter(F.col("label") != gone),
        e.filter((F.col("src_label") != gone) & (F.col("dst_label") != gone)),
    )


def duplicate_ids(v: DataFrame) -> DataFrame:
    """Ids that break uniqueness within their label."""
    return v.groupBy("label", "id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def indexed_properties(config: Mapping) -> list[tuple[str, str]]:
    """``(label, property)`` pairs that must be unique."""
    found = []
    for doc_type, rules in config.items():
        for f in rules.get("fields", []):
            if f.get("type") == "property" and f.get("index"):
                found.append((rules.get("vertex_label", doc_type), f["name"]))
            elif f.get("type") == "edge":
                found.append((f["target_vertex_label"], f["target_id"]))
    return list(dict.fromkeys(found))


def display_label(label: Column, ident: Column, props: Column) -> Column:
    """``label (name)``, with title or id in place of a missing name."""
    name = F.coalesce(
        F.try_element_at(props, F.lit("name")), F.try_element_at(props, F.lit("title")), ident
    )
    return F.when(name == label, label).otherwise(F.concat(label, F.lit(" ("), name, F.lit(")")))


def export_subgraph(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with display labels, ready for ``write.json``."""
    node_key = F.concat_ws("/", "label", "id")
    nodes = v.select(
        node_key.alias("node"),
        display_label(F.col("label"), F.col("id"), F.col("props")).alias("display"),
        "label",
        "props",
    )
    links = e.select(
        F.concat_ws("/", "src_label", "src_id").alias("source"),
        F.concat_ws("/", "dst_label", "dst_id").alias("target"),
        F.col("edge").alias("type"),
    )
    return nodes, links
