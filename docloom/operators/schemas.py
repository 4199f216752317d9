"""Schemas seen from the data: inference, field profiles, links between types, geo fields."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import variants as V
from ..functions.rows import each
from ..session import written
from .rules import merge_schemas


def infer_schema(df: DataFrame, body: str = "body") -> DataFrame:
    """Union of the observed shapes per type, as ``doc_type, inferred`` (a type text)."""
    return df.groupBy("doc_type").agg(F.schema_of_variant_agg(body).alias("inferred"))


# Spark variant type names and the JSON-schema type they stand for.
JSON_TYPES = {
    "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
    "STRING": "string", "BOOLEAN": "boolean", "TIMESTAMP": "string", "DATE": "string",
}


TYPE_WORD = re.compile(r"\s*(OBJECT|ARRAY|[A-Z_]+(?:\(\d+,\s*\d+\))?)\s*")
FIELD_NAME = re.compile(r"\s*(`(?:[^`]|``)*`|[^:,<>\s]+)\s*:")


def json_schema(inferred: str, base: Mapping | None = None) -> dict:
    """JSON schema of an inferred type text, on top of a ``base`` schema if given; what varies by document is open."""

    def read(at: int) -> tuple[dict, int]:
        word = TYPE_WORD.match(inferred, at)
        if word is None:
            raise ValueError(f"cannot read type {inferred!r} at {at}")
        name, at = word.group(1).partition("(")[0], word.end()
        if name == "ARRAY":
            items, at = read(at + 1)
            return {"type": "array", "items": items}, at + 1
        if name != "OBJECT":
            return ({"type": JSON_TYPES[name]} if name in JSON_TYPES else {}), at
        fields, at = {}, at + 1
        while inferred[at] != ">":
            field = FIELD_NAME.match(inferred, at)
            fields[field.group(1).strip("`").replace("``", "`")], at = read(field.end())
            at += inferred[at] == ","
        return {"type": "object", "properties": fields}, at + 1

    found, _ = read(0)
    return found if base is None else merge_schemas(base, found)


def json_schemas(df: DataFrame, body: str = "body", base: Mapping | None = None) -> dict[str, dict]:
    """JSON schema of every document type; one inferred text per type reaches the driver."""
    return {r["doc_type"]: json_schema(r["inferred"], base) for r in infer_schema(df, body).collect()}


def field_profile(df: DataFrame, body: str = "body", name_pattern: str | None = None) -> DataFrame:
    """Fields and value types present per document type, with counts."""
    out = (
        each(df, ["doc_type"], V.leaves(body), "leaf")
        .select(
            "doc_type",
            V.path_text(F.col("leaf.path")).alias("path"),
            F.regexp_replace(F.schema_of_variant("leaf.value"), r"\(\d+,\d+\)", "").alias("value_type"),
        )
        .groupBy("doc_type", "path", "value_type")
        .agg(F.count("*").alias("n_docs"))
    )
    if name_pattern is not None:
        out = out.filter(F.col("path").rlike(wildcard_regex(name_pattern)))
    return out


def wildcard_regex(pattern: str) -> str:
    """Anchored regex of a name with ``*`` wildcards."""
    escaped = "".join(".*" if ch == "*" else ("." if ch == "?" else _literal(ch)) for ch in pattern)
    return f"^{escaped}$"


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch == "_" else "\\" + ch


def link_fields(schema: T.StructType, path: str = "") -> Iterator[tuple[str, bool]]:
    """Paths of link fields (structs with ``doc_type`` and ``id``), and whether they are arrays."""
    for f in schema.fields:
        where = f"{path}.{f.name}" if path else f.name
        dtype, many = f.dataType, False
        if isinstance(dtype, T.ArrayType):
            dtype, many = dtype.elementType, True
        if not isinstance(dtype, T.StructType):
            continue
        if {"doc_type", "id"} <= set(dtype.names):
            yield where, many
        elif not many:
            yield from link_fields(dtype, where)


def _link_items(path: str, many: bool) -> Column:
    links = F.col(path) if many else F.array(F.col(path))
    return F.transform(
        F.filter(links, lambda x: x.isNotNull() & x["id"].isNotNull()),
        lambda x: F.struct(
            F.lit(path.rsplit(".", 1)[-1]).alias("edge"),
            x["doc_type"].alias("dst_type"),
            x["id"].cast("string").alias("dst_id"),
            F.lit(many).alias("many"),
        ),
    )


def link_edges(df: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One row per link: ``src_type, src_id, edge, dst_type, dst_id, many``.

    All link fields are gathered into one array per document, so the table is read once.
    ``allowed`` (edge, dst_type) keeps only declared targets.
    """
    parts = [_link_items(path, many) for path, many in link_fields(df.schema)]
    if not parts:
        raise ValueError("no link fields: a link is a struct with doc_type and id")
    empty = F.array().cast("array<struct<edge:string,dst_type:string,dst_id:string,many:boolean>>")
    every = F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))
    source = [F.col("doc_type").alias("src_type"), F.col("id").cast("string").alias("src_id")]
    out = each(df, source, every, "l").select("src_type", "src_id", "l.*")
    if allowed is not None:
        out = out.join(allowed.select("edge", "dst_type").distinct(), ["edge", "dst_type"], "left_semi")
    return out.select("src_type", "src_id", "edge", "dst_type", "dst_id", "many")


def link_graph(edges: DataFrame) -> DataFrame:
    """Type-level multigraph with cardinality."""
    return edges.groupBy("src_type", "edge", "dst_type").agg(
        F.when(F.max("many"), "multiple").otherwise("single").alias("cardinality"),
        F.count("*").alias("n_links"),
    )


def schema_link_edges(schemas: Mapping[str, Mapping], links: Mapping[str, Mapping]) -> list[tuple]:
    """Declared ``(src_type, edge, dst_type, cardinality)`` from per-type JSON schemas.

    Configuration, not data: runs on the driver over the schema dictionaries. A link definition
    names its target types by ``const`` or ``enum``.
    """
    found = []

    def targets(link: str) -> Sequence[str]:
        kind = links[link].get("properties", {}).get("doc_type", {})
        return [kind["const"]] if "const" in kind else kind.get("enum", [])

    def walk(doc_type: str, node: Mapping, definitions: Mapping, many: bool, trail: frozenset):
        for name, sub in node.get("properties", {}).items():
            multiple = many
            if sub.get("type") == "array" and isinstance(sub.get("items"), Mapping):
                sub, multiple = sub["items"], True
            kind, _, ref = sub.get("$ref", "").removeprefix("#/").partition("/")
            if kind == "links":
                for dst in targets(ref):
                    found.append((doc_type, name, dst, "multiple" if multiple else "single"))
            elif kind == "definitions" and ref not in trail:
                walk(doc_type, definitions[ref], definitions, multiple, trail | {ref})

    for doc_type, schema in schemas.items():
        walk(doc_type, schema, schema.get("definitions", {}), False, frozenset())
    return found


def neighbourhood(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """Nodes within ``radius`` undirected steps of the seeds: ``node, distance``.

    ``edges`` has ``src`` and ``dst``, ``seeds`` has ``node``. Every round joins only the new
    frontier and is written to the shared folder, so lineage does not grow with the radius.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    reached = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    frontier = reached.select("node")
    for step in range(1, radius + 1):
        hop = both.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi")
        new = (
            hop.select(F.col("dst").alias("node"))
            .distinct()
            .join(reached, "node", "left_anti")
            .withColumn("distance", F.lit(step))
        )
        new = written(new, "frontier")
        reached = reached.union(new)
        frontier = new.select("node")
    return reached


def geo_point(c: Column, dtype: T.DataType) -> Column:
    """Point of a ``*_geopoint`` field: text ``lat,lon`` or an object with ``lat`` and ``lon``."""
    if isinstance(dtype, T.StructType):
        lat, lon = c["lat"].cast("double"), c["lon"].cast("double")
    else:
        parts = F.split(c, ",")
        lat = F.trim(F.get(parts, 0)).try_cast("double")
        lon = F.trim(F.get(parts, 1)).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def geo_fields(df: DataFrame) -> DataFrame:
    """Points and shapes by field-name suffix; other columns stay as they are."""
    out = df
    for f in df.schema.fields:
        if f.name.endswith("_geopoint"):
            out = out.withColumn(f.name, geo_point(F.col(f.name), f.dataType))
        elif f.name.endswith("_geoshape") and isinstance(f.dataType, T.StructType):
            out = out.withColumn(f.name, F.to_json(f.name))
    return out
