"""Messages as maps: the keys that occur, columns made of them, and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def found_keys(messages: DataFrame, column: str, most: int = 5000) -> T.StructType:
    """The union of the keys of a map column over all rows, by name, as a schema.

    Values that are text give a key the narrowest type that all its values have:
    bigint, double, boolean or string; a key whose values are all null is a string.
    Values of another type keep it.  Keys are counted in every task before they
    meet; more than ``most`` of them, too many for columns, raise ValueError.
    """
    kind = messages.schema[column].dataType.valueType
    v = F.col("value")
    fits = {"bigint": v.try_cast("bigint").isNotNull() & ~v.cast("string").contains("."), "double": v.try_cast("double").isNotNull(),
            "boolean": F.lower(v.cast("string")).isin("true", "false")} if isinstance(kind, T.StringType) else {}
    each = messages.select(F.explode(column).alias("key", "value")).groupBy("key").agg(
        F.count("value").alias("n"), *[F.bool_and(F.when(v.isNotNull(), test)).alias(t) for t, test in fits.items()])
    rows = each.orderBy("key").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} keys")
    types = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    own = lambda r: next((t for name, t in types.items() if r["n"] and r[name]), T.StringType())
    return T.StructType([T.StructField(r["key"], own(r) if isinstance(kind, T.StringType) else kind) for r in rows])


def widen(messages: DataFrame, column: str, keys: T.StructType | None = None) -> DataFrame:
    """A column per key in place of the map, null where a message has no such key.  Keys
    that are columns already (whatever their case) get the map's name before them."""
    keys = found_keys(messages, column) if keys is None else keys
    taken = {c.lower() for c in messages.columns if c != column}
    name = lambda k: f"{column}_{k}" if k.lower() in taken else k
    value = lambda f: F.try_element_at(column, F.lit(f.name)).try_cast(f.dataType).alias(name(f.name))
    return messages.select(*[F.col(f"`{c}`") for c in messages.columns if c != column], *[value(f) for f in keys])


def last_wins(entries: Column) -> Column:
    """A map of an array of (key, value): of a repeated key the last value, null too;
    entries without key go."""
    named = F.filter(entries, lambda e: e["key"].isNotNull())
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda e: e["key"] == k), -1)["value"]))


def merged(left: Column, right: Column) -> Column:
    """Both maps' keys; of a common key the value of ``right``, null too.  A null map counts
    as empty; two null maps give null."""
    rest = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(F.map_concat(rest, right))


def fold_maps(messages: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """One map per ``by``: each key's value in the last message, by ``order``, that has it.
    Values are compared per key before they are sent, and only one of each key is
    gathered."""
    each = messages.select(by, order, F.explode(column).alias("key", "value"))
    last = each.groupBy(by, "key").agg(F.max_by(F.struct("value"), order).alias("v")).select(by, F.struct("key", F.col("v.value").alias("value")).alias("e"))
    return last.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias(column))
