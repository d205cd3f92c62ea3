"""Relations from files, and dependencies to text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.discover import limited


def read_csv(spark: SparkSession, path: str, header: bool = False, sep: str = ",", quote: str = '"', escape: str = "\\", null: str = "") -> DataFrame:
    """A relation of strings. Without a header its columns are column1, column2, ...; short rows end in nulls."""
    df = spark.read.csv(path, header=header, sep=sep, quote=quote, escape=escape, nullValue=null, inferSchema=False)
    return df if header else df.toDF(*[f"column{k}" for k in range(1, len(df.columns) + 1)])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", columns: Sequence[str] | None = None, row_limit: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """A relation from any format that Spark reads, or a catalog table (fmt='table'); only named columns are read."""
    df = spark.read.table(path) if fmt == "table" else spark.read.format(fmt).load(path)
    return limited(df.select(*columns) if columns else df, row_limit, order_by)


def from_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[str | None]]) -> DataFrame:
    """A relation of nullable strings; a row of the wrong length is an error."""
    for r in rows:
        if len(r) != len(names):
            raise ValueError(f"{len(r)} values for {len(names)} columns: {r!r}")
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in names))


def dependency_lines(found: DataFrame, table: str | None = None) -> DataFrame:
    """`value`: a line `[a, b] --> c, d` for each left-hand side, both sides by name; columns with a prefix if a table is named."""
    name = (lambda c: F.concat(F.lit(f"{table}."), c)) if table else (lambda c: c)
    left = F.array_sort(F.transform("lhs", name))
    lines = found.groupBy(left.alias("l")).agg(F.array_sort(F.collect_list(name(F.col("rhs")))).alias("r"))  # metadata, not rows
    return lines.select(F.concat(F.lit("["), F.array_join("l", ", "), F.lit("] --> "), F.array_join("r", ", ")).alias("value"))


def write_dependencies(found: DataFrame, path: str, table: str | None = None) -> int:
    """Write the lines, ended by \\r\\n, and return how many dependencies they state."""
    dependency_lines(found, table).coalesce(1).write.option("lineSep", "\r\n").text(path)
    return found.count()


def dependencies(found: DataFrame) -> Iterator[tuple[tuple[str, ...], str]]:
    """The dependencies one by one."""
    return ((tuple(r["lhs"]), r["rhs"]) for r in found.toLocalIterator())
