"""Joins with a table of one row a key that spread keys with very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with so many rows is hot; where that leaves more than HOT_KEYS hot keys, more rows are needed.
HOT_ROWS, HOT_KEYS = 1_000, 100_000
#: Rows up to which nothing is split: any task holds them.
FEW_ROWS = 20_000
SIDES = 4096


def spreading(rows: DataFrame) -> Column:
    """A hash that tells rows apart well enough to deal them, of any types of columns, without reading whole texts."""

    def part(name: str, kind: T.DataType) -> Column:
        column = F.col(f"`{name}`")
        if isinstance(kind, T.VariantType):
            column = column.cast("string")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(F.struct(column))
        elif isinstance(kind, T.BinaryType):
            return F.concat(F.substring(column, 1, 64), F.octet_length(column).cast("string").cast("binary"))
        elif not isinstance(kind, T.StringType):
            return column
        return F.concat(F.substring(column, 1, 64), F.octet_length(column).cast("string"))

    return F.xxhash64(*[part(f.name, f.dataType) for f in rows.schema.fields])


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row a key, safe against keys that hold a large share of the rows.

    weight: the column of ``keyed`` that says how many of the ``total`` rows have the key; it isn't
    returned. Hot keys go to every task: their number is bounded, as each has total / HOT_KEYS rows or
    more. Rows of hot keys, and rows with a null key, meet nothing in the shuffle that joins the others,
    and are dealt evenly over it. how: inner or left.
    """
    keys = [key] if isinstance(key, str) else key
    adds = [c for c in keyed.columns if c not in keys and c != weight]
    if total <= FEW_ROWS:
        return rows.join(keyed.drop(weight), keys, how).select(*rows.columns, *adds)
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    far = keyed.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias("__"), *adds).alias("__far"), F.col(weight).alias("__rows"))
    same = [F.col(k) == F.col(f"__{i}") for i, k in enumerate(keys)]
    hot = F.broadcast(far.where(F.col("__rows") >= least).withColumnRenamed("__far", "__near").drop("__rows"))
    met = rows.join(hot, same, "left").drop(*[f"__{i}" for i in range(len(keys))])
    aside = F.col("__near").isNotNull()
    for k in keys:
        aside = aside | F.col(k).isNull()
    met = met.withColumn("__side", F.when(aside, 1 + F.pmod(spreading(rows), F.lit(SIDES))).otherwise(F.lit(0)).cast("int"))
    # Always 0, but no constant: a constant side would not be a key of the join.
    cold = far.where(F.col("__rows") < least).withColumn("__zero", F.when(F.col("__rows") < 0, 1).otherwise(0)).drop("__rows")
    both = met.join(cold, [*same, F.col("__side") == F.col("__zero")], "left").withColumn("__found", F.coalesce("__near", "__far"))
    if how == "inner":
        both = both.where(F.col("__found").isNotNull())
    return both.select(*rows.columns, *[F.col("__found")[c].alias(c) for c in adds])
