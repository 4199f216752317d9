"""Documents of open shape: VARIANT paths, type families and JSON rebuilding.

All expressions are built-in functions and higher-order lambdas, so whole documents are taken
apart and put together inside one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# what a field can be, see family_of_type
FAMILIES = ("object", "boolean", "mixed", "number", "text")

# a variant type text names fields only when the object has some: ``OBJECT<a: ...>``
_OPEN = "schema_of_variant({0}) like 'OBJECT<%:%'"


def leaves(body: str, max_depth: int | None = None) -> Column:
    """``array<struct<path: array<string>, value: variant, open: boolean>>`` of a VARIANT column.

    Arrays, scalars, explicit nulls and empty objects are leaves. Each round opens the objects
    of one level, and there are as many rounds as the document's own type has objects, so none is
    left closed. Rounds that find nothing to open cost one flag check. ``open`` stays true only below
    a ``max_depth`` that the caller asks for.
    """

    def entry(path: str, value: str) -> str:
        return f"named_struct('path', {path}, 'value', {value}, 'open', {_OPEN.format(value)})"

    fields = "map_entries(try_variant_get({0}, '$', 'map<string,variant>'))"
    top = f"transform({fields.format(body)}, f -> {entry('array(f.key)', 'f.value')})"
    opened = (
        f"flatten(transform(acc, x -> case when x.open then transform({fields.format('x.value')}, "
        f"y -> {entry('array_append(x.path, y.key)', 'y.value')}) else array(x) end))"
    )
    rounds = f"greatest(2, size(split(coalesce(schema_of_variant({body}), ''), 'OBJECT<')))"
    last = rounds if max_depth is None else str(max(2, max_depth))
    return F.expr(
        f"aggregate(sequence(2, {last}), {top}, "
        f"(acc, level) -> case when exists(acc, x -> x.open) then {opened} else acc end)"
    )


def too_deep(all_leaves: Column) -> Column:
    """True when a depth limit left an object unopened."""
    return F.exists(all_leaves, lambda x: x["open"])


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).like("OBJECT<%")


def family_of_type(type_text: Column) -> Column:
    """Storage family of a variant type name; null for nulls and empty arrays.

    Arrays are transparent: an array of numbers belongs to the number family.
    """
    inner = F.regexp_replace(F.regexp_replace(type_text, "^(ARRAY<)+", ""), "^(OBJECT)<.*$", "$1")
    inner = F.regexp_replace(inner, ">+$", "")
    return (
        F.when(inner == "VOID", F.lit(None).cast("string"))
        .when(inner == "OBJECT", "object")
        .when(inner == "BOOLEAN", "boolean")
        .when(inner == "VARIANT", "mixed")
        .when(inner.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .otherwise("text")
    )


def family(v: Column) -> Column:
    return family_of_type(F.schema_of_variant(v))


def fits_family(first: Column, v: Column) -> Column:
    """Whether a value can be stored in a field whose first value had family ``first``."""
    own = family(v)
    as_text = F.try_variant_get(v, "$", "string")
    return (
        F.when(own.isNull() | first.isNull(), True)
        .when(own == first, True)
        .when(first == "number", (own == "text") & as_text.try_cast("double").isNotNull())
        .when(first == "boolean", (own == "text") & as_text.isin("true", "false", ""))
        .when(first == "text", own.isin("number", "boolean"))
        .otherwise(False)
    )


def path_text(path: Column) -> Column:
    return F.array_join(path, ".")


def _shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements two arrays have in common."""
    shorter = F.least(F.size(a), F.size(b))
    return F.when(
        shorter > 0,
        F.aggregate(
            F.sequence(F.lit(1), shorter),
            F.lit(0),
            lambda acc, k: F.when(
                (acc == k - 1) & (F.element_at(a, k) == F.element_at(b, k)), k
            ).otherwise(acc),
        ),
    ).otherwise(0)


def quoted(text: Column) -> Column:
    """JSON string literal of a text."""
    return F.to_json(text.cast("variant"))


def rebuild(entries: Column) -> Column:
    """JSON text from ``array<struct<path, json>>`` sorted by path.

    Each entry closes the objects it does not share with its successor and opens those it does
    not share with its predecessor, so one linear pass writes the nested text.
    """
    nothing = F.array().cast("array<string>")

    def parents(path: Column) -> Column:
        return F.slice(path, F.lit(1), F.size(path) - 1)

    def piece(entry: Column, i: Column) -> Column:
        own = parents(entry["path"])
        before = F.when(i > 0, parents(F.get(entries, i - 1)["path"])).otherwise(nothing)
        after = F.when(
            i < F.size(entries) - 1, parents(F.get(entries, i + 1)["path"])
        ).otherwise(nothing)
        opened = F.slice(own, _shared_prefix(own, before) + 1, F.size(own))
        opening = F.array_join(F.transform(opened, lambda s: F.concat(quoted(s), F.lit(":{"))), "")
        closing = F.repeat(F.lit("}"), F.size(own) - _shared_prefix(own, after))
        return F.concat(
            F.when(i > 0, ",").otherwise(""),
            opening,
            quoted(F.element_at(entry["path"], -1)),
            F.lit(":"),
            entry["json"],
            closing,
        )

    return F.concat(F.lit("{"), F.array_join(F.transform(entries, piece), ""), F.lit("}"))
