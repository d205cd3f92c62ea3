"""Partitions: which rows of a relation agree on columns. Sizes and statistics, never lists of a group's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.encoding import check_columns, encode, key, value
from lodestar.plans.scratch import materialize


def clusters(df: DataFrame, columns: Sequence[str], null_equals_null: bool = True, min_size: int = 2) -> DataFrame:
    """The values of `columns` that several rows share, with `cluster_size`: a stripped partition; of more columns, a product.

    Where nulls are no equals, rows with a null are in no cluster. min_size=1 keeps single rows.
    """
    columns = check_columns(df, columns)
    keyed = df if null_equals_null else df.where(~_any_null(df, columns))
    return keyed.groupBy(*[value(df, c).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("cluster_size")).where(F.col("cluster_size") >= min_size)


def _any_null(df: DataFrame, columns: Sequence[str]):
    out = F.lit(False)
    for c in columns:
        out = out | value(df, c).isNull()
    return out


def members(df: DataFrame, id_col: str, columns: Sequence[str], null_equals_null: bool = True) -> DataFrame:
    """`id`, `cluster` (the smallest id in it) and `cluster_size` for rows in a cluster of two or more.

    The clusters are summed before they meet the rows again, so a hot value is no large group in a task.
    """
    columns = check_columns(df, columns)
    rows = df if null_equals_null else df.where(~_any_null(df, columns))
    rows = rows.select(df[f"`{id_col}`"].alias("id"), *[F.struct(value(df, c)).alias(f"k{j}") for j, c in enumerate(columns)])
    keys = [f"k{j}" for j in range(len(columns))]
    sizes = rows.groupBy(*keys).agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("cluster_size")).where("cluster_size > 1")
    return rows.join(sizes, keys).select("id", "cluster", "cluster_size")


def statistics(df: DataFrame, null_equals_null: bool = True, compare_as_string: bool = False) -> DataFrame:
    """A row for each column: `column`, `n_rows`, `n_clusters`, `n_non_unique`, `n_distinct`, `is_unique`, `is_constant`.

    `n_clusters` counts values of two rows or more and `n_non_unique` their rows; a column is constant if there is at
    most one row, or one cluster of all. Without equal nulls each null is a value by itself. One job for all columns.
    """
    codes = encode(df, None, null_equals_null, compare_as_string)
    long = codes.select(F.posexplode(F.array(*codes.columns)).alias("k", "code"))
    sizes = long.groupBy("k", "code").agg(F.count(F.lit(1)).alias("n"))
    shared = (F.col("n") > 1) & F.col("code").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = sizes.groupBy("k").agg(total("n").alias("n_rows"), total(F.when(shared, 1).otherwise(0)).alias("n_clusters"), total(F.when(shared, F.col("n")).otherwise(0)).alias("n_non_unique"), total(F.when(F.col("code").isNull(), F.col("n")).otherwise(1)).alias("n_distinct"), F.coalesce(F.max(F.when(shared, F.col("n"))), F.lit(0)).alias("most"))
    names = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(df.columns)], "k int, column string")
    out = names.join(F.broadcast(out), "k", "left").fillna(0)  # a row for each column: bounded by the schema
    return out.select("column", "n_rows", "n_clusters", "n_non_unique", "n_distinct", (F.col("n_clusters") == 0).alias("is_unique"), ((F.col("n_rows") <= 1) | (F.col("most") == F.col("n_rows"))).alias("is_constant"))


def ranked_columns(df: DataFrame, null_equals_null: bool = True) -> DataFrame:
    """Columns by falling number of distinct values, as `rank` from 1, ties by their place in the schema."""
    place = F.array_position(F.array(*map(F.lit, df.columns)), F.col("column"))
    stats = statistics(df, null_equals_null).withColumn("place", place)
    rank = F.row_number().over(Window.orderBy(F.desc("n_distinct"), "place"))  # one row for each column
    return stats.select("column", "n_distinct", rank.cast("long").alias("rank"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """`value`, `code`: the distinct values without null in order, numbered from 0 without gaps.

    Values are range-partitioned and numbered inside each partition; only the partitions' counts are summed up.
    """
    part = df.where(value(df, column).isNotNull()).select(value(df, column).alias("value")).distinct().orderBy("value")
    numbered = materialize(part.select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "dictionary")
    counts = numbered.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return numbered.join(F.broadcast(counts.select("p", before.alias("before"))), "p").select("value", (F.col("before") + F.col("i")).alias("code"))


def records(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """The id and each column's dictionary code under its name; -1 for null and for values of a single row."""
    columns = check_columns(df, columns)
    out = df.select(df[f"`{id_col}`"].alias("__id"), *[value(df, c).alias(c) for c in columns])
    for c in columns:
        shared = clusters(df, [c], null_equals_null=False).select(F.col(c).alias("value"))
        codes = dictionary(df, c).join(shared, "value").withColumnRenamed("value", "__v")
        out = out.join(codes, out[c] == codes["__v"], "left").drop(c, "__v").withColumn(c, F.coalesce("code", F.lit(-1))).drop("code")
    return out.select(F.col("__id").alias(id_col), *columns)


def same_partition(df: DataFrame, one: Sequence[str], other: Sequence[str], null_equals_null: bool = True) -> bool:
    """Whether two sets of columns divide the rows alike: neither splits a cluster of the other."""
    names = list(dict.fromkeys([*one, *other]))
    codes = encode(df, names, null_equals_null)
    a, b = ([names.index(c) for c in x] for x in (one, other))
    count = lambda x: codes.dropna(subset=[f"c{k}" for k in x]).select(F.struct(*key(x)).alias("k")).agg(F.count_distinct("k")).first()[0]
    together = sorted(set(a + b))
    return count(a) == count(b) == count(together)
