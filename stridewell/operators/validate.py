"""Rows that have the declared types, and those that do not with the reasons."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Validated(NamedTuple):
    good: DataFrame
    rejects: DataFrame
    #: ``counts.get`` has rows, rejects and rejects per field once an action has run over ``all``.
    counts: Observation
    all: DataFrame


def validate(rows: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> Validated:
    """``rows`` coerced to ``schema``.

    ``good`` has the schema's columns in its types.  ``rejects`` has a row per input row
    of which some value cannot be coerced, or is null though it is ``required`` or not
    nullable: ``row``, the input as JSON, and ``reasons``, one per such field, in the
    schema's order.  Columns that are missing count as null, others are left out of
    ``good`` but kept in ``row``.  Both outputs come from ``all``, one pass over the
    input in which the counts are taken; write or cache it to read it once for both.
    """
    value = lambda f: F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)
    coerced = lambda f: value(f).try_cast(f.dataType)

    def reason(f):
        needed = f.name in required or not f.nullable
        bad = F.when(value(f).isNotNull() & coerced(f).isNull(), F.lit(f"{f.name}: no {f.dataType.simpleString()}"))
        return bad.when(value(f).isNull(), F.lit(f"{f.name}: missing")) if needed else bad

    reasons = F.array_compact(F.array(*[reason(f) for f in schema]))
    marked = rows.select(F.struct(*[coerced(f).alias(f.name) for f in schema]).alias("good"),
                         F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"), reasons.alias("reasons"))
    counts = Observation()
    failed = F.size("reasons") > 0
    marked = marked.observe(counts, F.count("*").alias("rows"), F.count_if(failed).alias("rejects"),
                            *[F.count_if(F.array_contains("reasons", f"{f.name}: no {f.dataType.simpleString()}")
                                         | F.array_contains("reasons", f"{f.name}: missing")).alias(f"rejects_{f.name}") for f in schema])
    return Validated(marked.where(~failed).select("good.*"), marked.where(failed).select("row", "reasons"), counts, marked)
