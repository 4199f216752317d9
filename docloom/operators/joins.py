"""Joins whose strategy follows a measured size instead of a hope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A broadcast passes through the driver, so its rows stay few; a lookup side beyond that is repeated per salt.
BROADCAST_ROWS = 50_000
SALTS = 8


def fits(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; never counts further than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join many facts with a table that is usually small.

    Up to ``broadcast_rows`` rows the lookup side is broadcast, so a hot key costs nothing.
    Beyond that both sides are shuffled on ``(key, salt)``: the lookup row is repeated per
    salt and every fact picks one salt from a hash of its own columns, which spreads a hot
    key over ``salts`` tasks. The salt is deterministic, so retried tasks agree.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the fact side whole or filters it, not {how}")
    if fits(lookup, broadcast_rows):
        return facts.join(F.broadcast(lookup), on, how)
    hashable = [
        f.name for f in facts.schema.fields if f.dataType.typeName() not in ("variant", "map")
    ]
    salted_facts = facts.withColumn(
        "__salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    )
    salted_lookup = lookup.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    ).hint("merge")
    return salted_facts.join(salted_lookup, on + ["__salt"], how).drop("__salt")
