"""JSON-schema rules compiled to Columns.

``violations(schema, value)`` returns an array with one text per violated rule, so a document
is validated by one projection over every row. Values come from typed columns or from a VARIANT;
a small adapter hides the difference.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.rows import let
from ..session import written


class InvalidSchema(ValueError):
    """A schema refers to a definition that does not exist, or holds a word that is not checked."""


# Schema words that are checked, and words that say nothing about validity.
CHECKED = set(
    "type nullable enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern "
    "minItems maxItems uniqueItems items additionalItems minProperties maxProperties additionalProperties patternProperties required "
    "properties allOf anyOf oneOf not $ref".split()
)
SILENT = set(
    "title description default example examples format definitions links $defs $schema $id id $comment deprecated readOnly writeOnly discriminator xml externalDocs".split()
)


# Every document needs a type.
BASE_SCHEMA = {
    "type": "object",
    "properties": {
        "doc_type": {"type": "string"},
        "id": {"type": "string"},
        "_id": {"type": "string"},
    },
    "required": ["doc_type"],
}


def merge_schemas(base: Mapping, own: Mapping) -> dict:
    """Objects merge, lists override, ``required`` is a set union."""
    out = copy.deepcopy(dict(base))
    for key, value in own.items():
        if key == "required":
            out[key] = sorted({*out.get(key, []), *value})
        elif isinstance(value, Mapping) and isinstance(out.get(key), Mapping):
            out[key] = merge_schemas(out[key], value)
        else:
            out[key] = copy.deepcopy(value)
    return out


def resolve_refs(schema: Mapping, definitions: Mapping, links: Mapping | None = None) -> dict:
    """Replace ``#/definitions/x`` and ``#/links/x`` by what they name."""
    pools = {"definitions": definitions, "links": links or {}}

    def walk(node, trail: tuple[str, ...]):
        if isinstance(node, list):
            return [walk(x, trail) for x in node]
        if not isinstance(node, Mapping):
            return node
        if "$ref" in node:
            kind, _, name = node["$ref"].removeprefix("#/").partition("/")
            if name not in pools.get(kind, {}):
                raise InvalidSchema(f"unresolved reference {node['$ref']}")
            if node["$ref"] in trail:
                raise InvalidSchema(f"circular reference {node['$ref']}")
            return walk(pools[kind][name], (*trail, node["$ref"]))
        return {k: walk(v, trail) for k, v in node.items()}

    return walk(schema, ())


class TypedValue:
    """A value held in a typed column; SQL null stands for an absent field."""

    def __init__(self, column: Column, dtype: T.DataType):
        self.column, self.dtype = column, dtype

    def present(self) -> Column:
        return self.column.isNotNull()

    def is_null(self) -> Column:
        return F.lit(False)

    def is_type(self, name: str) -> Column:
        d = self.dtype
        ok = {
            "string": isinstance(
                d, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)
            ),
            "boolean": isinstance(d, T.BooleanType),
            "integer": isinstance(d, T.IntegralType),
            "number": isinstance(d, T.NumericType),
            "array": isinstance(d, T.ArrayType),
            "object": isinstance(d, (T.StructType, T.MapType)),
        }[name]
        if name == "integer" and isinstance(d, T.FractionalType):
            return self.column == F.floor(self.column)
        return F.lit(ok)

    def number(self) -> Column:
        if isinstance(self.dtype, T.NumericType):
            return self.column.cast("double")
        return F.lit(None).cast("double")

    def text(self) -> Column:
        if isinstance(self.dtype, T.StringType):
            return self.column
        return F.lit(None).cast("string")

    def json(self) -> Column:
        if isinstance(self.dtype, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(self.column)
        return F.to_json(self.column.cast("variant"))

    def child(self, name: str) -> TypedValue:
        if isinstance(self.dtype, T.StructType) and name in self.dtype.names:
            return TypedValue(self.column[name], self.dtype[name].dataType)
        if isinstance(self.dtype, T.MapType):
            return TypedValue(F.try_element_at(self.column, F.lit(name)), self.dtype.valueType)
        return TypedValue(F.lit(None).cast("string"), T.StringType())

    def keys(self) -> Column:
        if isinstance(self.dtype, T.MapType):
            return F.map_keys(self.column)
        if isinstance(self.dtype, T.StructType):
            held = [F.when(self.column[n].isNotNull(), F.lit(n)) for n in self.dtype.names]
            return F.array_compact(F.array(*held))
        return F.array().cast("array<string>")

    def any_entry(self, test: Callable[[Column, TypedValue | VariantValue], Column]) -> Column:
        if isinstance(self.dtype, T.MapType):
            kind = self.dtype.valueType
            return F.exists(F.map_entries(self.column), lambda e: test(e["key"], TypedValue(e["value"], kind)))
        found = F.lit(False)
        for name in self.dtype.names if isinstance(self.dtype, T.StructType) else []:
            found = found | (self.child(name).present() & test(F.lit(name), self.child(name)))
        return found

    def elements(self) -> tuple[Column, type, T.DataType | None]:
        if isinstance(self.dtype, T.ArrayType):
            return self.column, TypedValue, self.dtype.elementType
        return F.lit(None).cast("array<string>"), TypedValue, T.StringType()


class VariantValue:
    """A value held in a VARIANT; absent is SQL null, an explicit null is a null variant."""

    def __init__(self, column: Column, dtype: T.DataType | None = None):
        self.column = column

    def present(self) -> Column:
        return self.column.isNotNull()

    def is_null(self) -> Column:
        return F.is_variant_null(self.column)

    def _kind(self) -> Column:
        return F.schema_of_variant(self.column)

    def is_type(self, name: str) -> Column:
        kind = self._kind()
        if name == "integer":
            return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (
                kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (self.number() == F.floor(self.number()))
            )
        pattern = {
            "string": "^(STRING|TIMESTAMP|DATE)",
            "boolean": "^BOOLEAN$",
            "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)",
            "array": "^ARRAY<",
            "object": "^OBJECT<",
        }[name]
        return kind.rlike(pattern)

    def number(self) -> Column:
        return F.when(
            self.is_type("number"), F.try_variant_get(self.column, "$", "double")
        )

    def text(self) -> Column:
        return F.when(self.is_type("string"), F.try_variant_get(self.column, "$", "string"))

    def json(self) -> Column:
        return F.to_json(self.column)

    def child(self, name: str) -> VariantValue:
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return VariantValue(F.try_variant_get(self.column, f"$['{quoted}']", "variant"))

    def keys(self) -> Column:
        return F.coalesce(
            F.map_keys(F.try_variant_get(self.column, "$", "map<string,variant>")),
            F.array().cast("array<string>"),
        )

    def entries(self) -> Column:
        return F.map_entries(F.try_variant_get(self.column, "$", "map<string,variant>"))

    def any_entry(self, test: Callable[[Column, TypedValue | VariantValue], Column]) -> Column:
        return F.exists(self.entries(), lambda e: test(e["key"], VariantValue(e["value"])))

    def elements(self) -> tuple[Column, type, T.DataType | None]:
        return F.try_variant_get(self.column, "$", "array<variant>"), VariantValue, None


def _json_texts(values: list) -> list[str]:
    return [json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in values]


def _rules(schema: Mapping, value, path: str) -> Iterator[Column]:
    """Columns of arrays: the messages of broken rules, null or empty elsewhere.

    A reference that leads back to itself is left to :func:`recursive_violations`.
    """
    unknown_words = {w for w in schema if not w.startswith("x-")} - CHECKED - SILENT
    if unknown_words:
        raise InvalidSchema(f"{path or '$'}: cannot check {', '.join(sorted(unknown_words))}")

    def broken(condition: Column, rule: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(f"{path or '$'}: {rule}")))

    def guarded(test: Column) -> Column:
        return value.present() & ~value.is_null() & test

    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        nullable = schema.get("nullable", False) or "null" in kinds
        fits = F.lit(False)
        for kind in kinds:
            if kind != "null":
                fits = fits | value.is_type(kind)
        yield broken(guarded(~fits), "type")
        if not nullable:
            yield broken(value.present() & value.is_null(), "type")
    if "enum" in schema:
        yield broken(guarded(~value.json().isin(_json_texts(schema["enum"]))), "enum")
    if "const" in schema:
        yield broken(guarded(~value.json().isin(_json_texts([schema["const"]]))), "const")
    number = value.number()
    if "minimum" in schema:
        low = schema["minimum"]
        below = number <= low if schema.get("exclusiveMinimum") is True else number < low
        yield broken(guarded(below), "minimum")
    if "maximum" in schema:
        high = schema["maximum"]
        above = number >= high if schema.get("exclusiveMaximum") is True else number > high
        yield broken(guarded(above), "maximum")
    for name, test in (("exclusiveMinimum", "__le__"), ("exclusiveMaximum", "__ge__")):
        if name in schema and not isinstance(schema[name], bool):
            yield broken(guarded(getattr(number, test)(schema[name])), name)
    if "multipleOf" in schema:
        ratio = number / F.lit(float(schema["multipleOf"]))
        yield broken(guarded(F.abs(ratio - F.round(ratio)) > 1e-9), "multipleOf")
    text = value.text()
    if "minLength" in schema:
        yield broken(guarded(F.length(text) < schema["minLength"]), "minLength")
    if "maxLength" in schema:
        yield broken(guarded(F.length(text) > schema["maxLength"]), "maxLength")
    if "pattern" in schema:
        yield broken(guarded(~text.rlike(schema["pattern"])), "pattern")
    if {"minItems", "maxItems", "uniqueItems", "items"} & schema.keys():
        items, kind, dtype = value.elements()
        if "minItems" in schema:
            yield broken(guarded(F.size(items) < schema["minItems"]), "minItems")
        if "maxItems" in schema:
            yield broken(guarded(F.size(items) > schema["maxItems"]), "maxItems")
        if schema.get("uniqueItems"):
            texts = F.transform(items, lambda x: kind(x, dtype).json())
            yield broken(guarded(F.size(F.array_distinct(texts)) < F.size(items)), "uniqueItems")
        if isinstance(schema.get("items"), Mapping) and schema["items"]:
            wrong = F.exists(items, lambda x: ~is_valid(schema["items"], kind(x, dtype)))
            yield broken(guarded(wrong), "items")
        elif isinstance(schema.get("items"), list):
            places = schema["items"]
            for i, sub in enumerate(places):
                yield broken(guarded((F.size(items) > i) & ~is_valid(sub, kind(F.get(items, i), dtype))), f"items[{i}]")
            rest, more = schema.get("additionalItems", True), F.slice(items, len(places) + 1, 1 << 30)
            if rest is False:
                yield broken(guarded(F.size(more) > 0), "additionalItems")
            elif isinstance(rest, Mapping):
                yield broken(guarded(F.exists(more, lambda x: ~is_valid(rest, kind(x, dtype)))), "additionalItems")
    if {"minProperties", "maxProperties", "additionalProperties", "patternProperties"} & schema.keys():
        keys = value.keys()
        if "minProperties" in schema:
            yield broken(guarded(F.size(keys) < schema["minProperties"]), "minProperties")
        if "maxProperties" in schema:
            yield broken(guarded(F.size(keys) > schema["maxProperties"]), "maxProperties")
        extra = schema.get("additionalProperties", True)
        if extra is False:
            yield broken(guarded(F.exists(keys, lambda k: is_extra(schema, k))), "additionalProperties")
        elif isinstance(extra, Mapping):
            wrong = value.any_entry(lambda k, v: is_extra(schema, k) & ~is_valid(extra, v))
            yield broken(guarded(wrong), "additionalProperties")
        for pattern, sub in schema.get("patternProperties", {}).items():
            wrong = value.any_entry(lambda k, v, p=pattern, sub=sub: k.rlike(p) & ~is_valid(sub, v))
            yield broken(guarded(wrong), f"patternProperties {pattern}")
    for name in sorted(schema.get("required", [])):
        missing = ~value.child(name).present()
        yield F.when(
            F.coalesce(guarded(missing), F.lit(False)),
            F.array(F.lit(f"{path + '.' if path else ''}{name}: required")),
        )
    for name, sub in schema.get("properties", {}).items():
        child, below = value.child(name), f"{path}.{name}" if path else name
        if isinstance(child, VariantValue) and sub:
            # taken out of the document once, however many rules look at it
            yield let(child.column, lambda c, sub=sub, below=below: violations(sub, VariantValue(c), below))
        else:
            yield from _rules(sub, child, below)
    for word in ("allOf", "anyOf", "oneOf"):
        if word in schema:
            hits = F.lit(0)
            for sub in schema[word]:
                hits = hits + is_valid(sub, value).cast("int")
            wrong = {
                "allOf": hits < len(schema[word]),
                "anyOf": hits < 1,
                "oneOf": hits != 1,
            }[word]
            yield broken(value.present() & wrong, word)
    if "not" in schema:
        yield broken(value.present() & is_valid(schema["not"], value), "not")


def is_extra(schema: Mapping, key: Column) -> Column:
    """Whether a key is neither a named property nor matched by a pattern."""
    named = sorted(schema.get("properties", {}))
    extra = ~key.isin(named) if named else F.lit(True)
    for pattern in schema.get("patternProperties", {}):
        extra = extra & ~key.rlike(pattern)
    return extra


def violations(schema: Mapping, value, path: str = "") -> Column:
    rules = list(_rules(schema, value, path))
    if not rules:
        return F.array().cast("array<string>")
    return F.flatten(F.array_compact(F.array(*rules)))


def is_valid(schema: Mapping, value) -> Column:
    return F.size(violations(schema, value)) == 0


def document_violations(schema: Mapping, df: DataFrame, body: str | None = None) -> Column:
    """Violations of every row: of a VARIANT body, or of the typed columns themselves."""
    if body is not None:
        return violations(schema, VariantValue(F.col(body)))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return violations(schema, TypedValue(whole, df.schema))


LATER = "array<struct<path:string,ref:string,value:variant>>"


class References:
    """References of a schema: inlined where they end, kept where they lead back to themselves."""

    def __init__(self, root: Mapping, definitions: Mapping | None = None):
        self.root = {**root, "definitions": {**root.get("definitions", {}), **(definitions or {})}}
        self.circular: set[str] = set()
        self.known: dict[str, set[str]] = {}
        for ref in self.named(self.root):
            if ref in self.reached(ref):
                self.circular.add(ref)

    def target(self, ref: str) -> Mapping:
        if not ref.startswith("#"):
            raise InvalidSchema(f"reference {ref} leads out of the schema")
        node = self.root
        for part in filter(None, ref[1:].split("/")):
            part = part.replace("~1", "/").replace("~0", "~")
            if not isinstance(node, Mapping) or part not in node:
                raise InvalidSchema(f"unresolved reference {ref}")
            node = node[part]
        return node

    def named(self, node) -> set[str]:
        """References in a node; definitions count only where something refers to them."""
        if isinstance(node, list):
            return set().union(*map(self.named, node))
        if not isinstance(node, Mapping):
            return set()
        if isinstance(node.get("$ref"), str):
            return {node["$ref"]}
        return set().union(*(self.named(v) for k, v in node.items() if k not in ("definitions", "$defs", "links")))

    def reached(self, ref: str) -> set[str]:
        """All references met on the way from a reference's target."""
        found: set[str] = set()
        edge = [ref]
        while edge:
            for other in self.named(self.target(edge.pop())) - found:
                found.add(other)
                edge.append(other)
        return found

    def every(self) -> set[str]:
        return set().union(*({r} | self.reached(r) for r in self.named(self.root)))

    def inlined(self, node):
        if isinstance(node, list):
            return [self.inlined(x) for x in node]
        if not isinstance(node, Mapping):
            return node
        if isinstance(node.get("$ref"), str):
            ref = node["$ref"]
            return {"$ref": ref} if ref in self.circular else self.inlined(self.target(ref))
        return {k: self.inlined(v) for k, v in node.items() if k not in ("definitions", "$defs", "links")}


def _later(schema: Mapping, value: VariantValue, path: Column) -> Iterator[Column]:
    """Arrays of (path, reference, value) that the circular references of a schema leave to the next round."""
    if "$ref" in schema:
        here = F.array(F.struct(path.alias("path"), F.lit(schema["$ref"]).alias("ref"), value.column.alias("value")))
        yield F.when(value.present(), here.cast(LATER))
        return
    below = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), name)

    def joined(found: list[Column]) -> Column:
        nothing = F.array().cast(LATER)
        return F.concat(*(F.coalesce(x, nothing) for x in found))

    for word in ("anyOf", "oneOf", "not"):
        subs = schema.get(word, [])
        for sub in subs if isinstance(subs, list) else [subs]:
            if list(_later(sub, value, path)):
                raise InvalidSchema(f"a circular reference may not stand below {word}")
    for sub in schema.get("allOf", []):
        yield from _later(sub, value, path)
    for name, sub in schema.get("properties", {}).items():
        yield from _later(sub, value.child(name), below(F.lit(name)))
    element = lambda sub: lambda x, i: joined(list(_later(sub, VariantValue(x), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    items = schema.get("items", [])
    if isinstance(items, Mapping) and list(_later(items, value, path)):
        yield F.flatten(F.transform(value.elements()[0], element(items)))
    for i, sub in enumerate(items if isinstance(items, list) else []):
        yield from _later(sub, VariantValue(F.get(value.elements()[0], i)), F.concat(path, F.lit(f"[{i}]")))
    extra = schema.get("additionalProperties")
    if isinstance(extra, Mapping) and list(_later(extra, value, path)):
        chosen = F.filter(value.entries(), lambda e: is_extra(schema, e["key"]))
        yield F.flatten(F.transform(chosen, lambda e: joined(list(_later(extra, VariantValue(e["value"]), below(e["key"]))))))


def recursive_violations(df: DataFrame, key: str, body: str, schema: Mapping, definitions: Mapping | None = None) -> DataFrame:
    """``key, violation``: one row for every rule that a VARIANT body breaks, through circular references too.

    References that end are inlined. A circular one is followed in rounds: a round checks all values that the round before
    came across, whatever their documents, and finds those one reference further down; it ends when nothing is left, so
    there are as many rounds as the deepest document has references in a row. Values whose check needs
    a truth value of a circular reference (below anyOf, oneOf, not) are refused.
    """
    refs = References(schema, definitions)
    whole = {**refs.inlined(schema)}
    shapes = {"": whole} | {r: refs.inlined(refs.target(r)) for r in sorted(refs.every() & refs.circular)}
    value, path = VariantValue(F.col("value")), F.col("path")
    nothing, broken, later = F.array().cast(LATER), None, None
    for ref, shape in shapes.items():
        here = F.col("ref") == ref
        more = [F.coalesce(x, nothing) for x in _later(shape, value, path)] or [nothing]
        broken = F.when(here, violations(shape, value)) if broken is None else broken.when(here, violations(shape, value))
        later = F.when(here, F.concat(*more)) if later is None else later.when(here, F.concat(*more))
    text = lambda m: F.when(path == "", m).when(m.startswith("$: "), F.concat(path, F.substr(m, F.lit(2)))).otherwise(F.concat(path, F.lit("."), m))
    todo = df.select(key, F.lit("").alias("path"), F.lit("").alias("ref"), F.col(body).alias("value"))
    found = []
    while True:
        done = written(todo.select(key, F.transform(broken, text).alias("broken"), later.alias("later")), "rules")
        found.append(done.where(F.size("broken") > 0).select(key, F.explode("broken").alias("violation")))
        todo = done.where(F.size("later") > 0).select(key, F.explode("later").alias("l")).select(key, "l.path", "l.ref", "l.value")
        if todo.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
