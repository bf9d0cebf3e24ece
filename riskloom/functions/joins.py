"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from riskloom.session import materialize

BROADCAST_ROWS = 2_000_000
#: Bytes of a lookup: what its text columns hold, and 16 for each other value and array element.
BROADCAST_BYTES = 256 << 20
SALTS = 16


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Prove rows and bytes before broadcasting, by one distributed sum that sends a row per task."""
    size = F.lit(16 * len(df.columns)).cast("bigint")
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, ArrayType):
            size += 16 * F.greatest(F.size(column), F.lit(0))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def salted_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose key is widened by a salt, so one hot key runs in ``salts`` tasks.

    ``spread`` names fact columns that differ inside a hot key; every lookup row
    is copied once per salt. Valid for inner, left and left-semi joins.
    """
    salted_fact = fact.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    )
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_fact.join(copies, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    small: bool | None = None,
) -> DataFrame:
    """Join a stored lookup table: broadcast when its size is proven, else salted.

    The count runs at once unless the caller passes the outcome of an earlier
    :func:`fits_broadcast` as ``small``, so pass tables or cheap projections; for
    derived frames use :func:`salted_join`, which adaptive execution still turns
    into a broadcast when the runtime size allows it.
    """
    if fits_broadcast(lookup, max_rows) if small is None else small:
        return fact.join(F.broadcast(lookup), list(on), how)
    return salted_join(fact, lookup, on, spread, how, salts)


def code_join(
    fact: DataFrame,
    vocabulary: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Look codes up in a vocabulary that may be large although few of its codes are in use.

    A vocabulary beyond a broadcast is first reduced to the codes of ``fact``: these are
    distinct values, so a task sends each once, whatever its share of the rows. What is
    left is stored and as a rule broadcast, so the fact itself is not shuffled.
    """
    if small is None:
        small = fits_broadcast(vocabulary, max_rows)
    if small:
        return fact.join(F.broadcast(vocabulary), list(on), how)
    used = materialize(vocabulary.join(fact.select(*on).distinct(), list(on), "left_semi"), "codes")
    return lookup_join(fact, used, on, spread, how, max_rows)
