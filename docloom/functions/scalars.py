"""Scalar helpers as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

import mimetypes
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .dates import scanned


def percent_encode(c: Column) -> Column:
    """Percent-encode with no safe characters besides letters, digits and ``_.-~``."""
    out = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def text_hash(*cols: Column) -> Column:
    """SHA-256 of the texts put together without a separator; nulls are skipped."""
    return F.sha2(F.concat_ws("", *cols), 256)


def field_hash(df: DataFrame, fields: Sequence[str]) -> Column:
    """SHA-256 over named fields, booleans written ``True`` / ``False``."""
    parts = []
    for name in fields:
        c = F.col(name).cast("string")
        if isinstance(df.schema[name].dataType, T.BooleanType):
            c = F.initcap(c)
        parts.append(c)
    return text_hash(*parts)


# Accepted spellings of a boolean.
TRUE_WORDS = ["true", "t", "1"]
FALSE_WORDS = ["false", "f", "0"]


def to_bool(c: Column) -> Column:
    """Boolean of a text, null when it is none of the accepted spellings."""
    low = F.lower(c)
    return F.when(low.isin(TRUE_WORDS), F.lit(True)).when(low.isin(FALSE_WORDS), F.lit(False))


def bad_bool(c: Column) -> Column:
    """True where ``to_bool`` cannot decide; feeds a quarantine split."""
    return to_bool(c).isNull()


def nest_columns(
    df: DataFrame, delimiter: str = ".", prefix: str | None = None, strip_prefix: bool = False
) -> DataFrame:
    """Turn columns named ``a.b.c`` into nested structs.

    Only columns that begin with ``prefix`` take part. A name that is both a value and the parent of
    others is refused.
    """
    chosen = [c for c in df.columns if prefix is None or c.startswith(prefix)]
    cut = len(prefix) if prefix and strip_prefix else 0

    def level(named: list[tuple[str, str]]) -> list[Column]:
        """Columns for names that share a parent, in the order in which they first occur."""
        groups: dict[str, list[tuple[str, str]]] = {}
        for name, column in named:
            head, _, rest = name.partition(delimiter)
            groups.setdefault(head, []).append((rest if delimiter in name else "", column))
        return [member(head, group).alias(head) for head, group in groups.items()]

    def member(head: str, group: list[tuple[str, str]]) -> Column:
        values = [column for rest, column in group if not rest]
        if not values:
            return F.struct(*level(group))
        if len(group) > 1:
            raise ValueError(f"{head!r} is a value and a parent or occurs twice")
        return F.col(f"`{values[0]}`")

    return df.select(*level([(c[cut:], c) for c in chosen]))


def natural_key(c: Column) -> Column:
    """Sort key that orders digit runs by value: ``a2`` before ``a10``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))

    def rank(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        is_text = ~run.rlike(r"^\d")
        return F.struct(
            is_text.alias("is_text"),
            F.when(is_text, F.lit(0)).otherwise(F.length(digits)).alias("width"),
            F.when(is_text, run).otherwise(digits).alias("run"),
        )

    return F.transform(runs, rank)


def natural_list(m: Column) -> Column:
    """Values of a map as a list in natural key order."""
    ranked = F.transform(
        F.map_entries(m),
        lambda e: F.struct(
            natural_key(e["key"]).alias("rank"), e["key"].alias("key"), e["value"].alias("value")
        ),
    )
    return F.transform(F.array_sort(ranked), lambda e: e["value"])


def doc_ref(id_col: Column, doc_type: Column, label: Column, label_field: str = "title") -> Column:
    """Reference to another document."""
    return F.struct(
        id_col.alias("_id"),
        doc_type.alias("doc_type"),
        label.alias("label"),
        label.alias(label_field),
    )


# Strptime directives and the Java pattern letters that mean the same.
STRPTIME_LETTERS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM",
    "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%a": "EEE", "%A": "EEEE",
    "%f": "SSSSSS", "%j": "DDD",
}


def java_pattern(strptime_format: str) -> str:
    """Java date pattern for a strptime format; literal letters are quoted."""

    def piece(m: re.Match) -> str:
        token = m.group(0)
        if token == "%%":
            return "%"
        if token.startswith("%"):
            if token not in STRPTIME_LETTERS:
                raise ValueError(f"date directive {token} has no Spark equivalent")
            return STRPTIME_LETTERS[token]
        return f"'{token}'"

    return re.sub(r"%.|[A-Za-z]+", piece, strptime_format)


def lenient_timestamp(
    c: Column, formats: Sequence[str] = (), fuzzy: bool = True, now: Column | None = None, day_first: bool = False
) -> Column:
    """Configured formats in order, then ISO, then a text that is a date, then (``fuzzy``) a date inside a text.

    ``now`` is what relative phrases such as "two weeks ago" count from in the fuzzy mode.
    """
    tries = [F.try_to_timestamp(c, F.lit(java_pattern(f))) for f in formats]
    tries.append(F.try_to_timestamp(c))
    tries.append(scanned(c, day_first, whole=not fuzzy, now=now if fuzzy else None))
    return F.coalesce(*tries)


def iso_text(ts: Column) -> Column:
    """ISO 8601 text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(full.endswith(".000000"), whole).otherwise(full)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def content_type(filename: Column) -> Column:
    """Media type by file extension, query string cut off, null when unknown."""
    known = mimetypes.MimeTypes()
    types = known.types_map[True]
    packed = [e.lstrip(".") for e in known.encodings_map]
    name = F.substring_index(filename, "?", 1)
    for short, long in known.suffix_map.items():
        name = F.regexp_replace(name, re.escape(short) + "$", long)
    bare = F.regexp_replace(name, r"\.(" + "|".join(packed) + ")$", "")
    extension = F.lower(F.regexp_extract(bare, r"[^/](\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in sorted(types.items()) for x in pair])
    return F.try_element_at(table, extension)
