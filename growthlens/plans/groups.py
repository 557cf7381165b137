"""Group helpers that never gather a whole group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unroll(df: DataFrame, keep, items: Column, name: str) -> DataFrame:
    """One row per element of a computed array (elements are never NULL).

    A plain explode makes Spark infer a filter on the array's size and push it down with the
    whole expression inlined, which builds every array twice and rebuilds outer columns inside
    lambdas for every element. The outer form with a check on the element does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def unroll_with_pos(df: DataFrame, keep, items: Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).filter(F.col(name).isNotNull())


# Largest group limit that Spark cuts before the shuffle by itself, and the salts used beyond it.
GROUP_LIMIT, SALTS = 1000, 512


def first_n(df: DataFrame, keys, order, n: int) -> DataFrame:
    """The first ``n`` rows per group.

    Spark cuts each map task to ``n`` rows per group before the shuffle (window group limit),
    so a group that holds a third of the data moves only ``n`` rows per task. Beyond the size
    Spark does this for, a salted first round cuts the group in parallel.
    """
    if n > GROUP_LIMIT:
        names = [c for c, t in df.dtypes if not t.startswith("map")]
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)))
        df = _cut(salted, [*keys, "__salt"], order, n).drop("__salt")
    return _cut(df, keys, order, n)


def _cut(df: DataFrame, keys, order, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def listed(df: DataFrame, keys, order, item: str, n: int, name: str) -> DataFrame:
    """Per group an array of the first ``n`` items in order (bounded by ``n``)."""
    small = first_n(df, keys, order, n).select(*keys, F.struct(*order, F.col(item).alias("__item")).alias("__s"))
    packed = small.groupBy(*keys).agg(F.array_sort(F.collect_list("__s")).alias("__l"))
    return packed.select(*keys, F.transform("__l", lambda x: x["__item"]).alias(name))


def latest(df: DataFrame, keys, order) -> DataFrame:
    """Latest row per group by ``order`` columns, combined map side."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def earliest(df: DataFrame, keys, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def stitched_list(items: Column, total: Column, shown: int) -> Column:
    """``a, b, c`` or ``a, b, c, and N more``."""
    text = F.array_join(F.slice(items, 1, shown), ", ")
    more = total - shown
    return F.when(more > 0, F.concat(text, F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(text)
