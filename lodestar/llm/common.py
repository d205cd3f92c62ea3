"""What the operators of this subpackage share.

Rows of one id: rows that repeat both id and text are one document that is written down twice, and get the same
result; ROW tells rows of one id with different texts apart. Operators that hand on the input's columns work on a
table whose columns are renamed (`renamed`), so that no name clashes with their helpers, which start with `__`; result
columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that divides words; any other character belongs to a word.
SPACES = "\t\n\x0b\x0c\r "


#: Rows that a Python worker gets at once; texts may be long, and Spark's default is ten times as many.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows a batch to BATCH_ROWS, where it has more; operators themselves leave it as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a registered query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns, by their places, named in0, in1, ..., and these names."""
    names = [f"in{k}" for k in range(len(df.columns))]
    return df.toDF(*names), names


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f refers to it, even inside lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text without null."""
    return F.array_remove(F.split(F.translate(text, SPACES[:-1], " " * 5), " "), "")


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the given columns, which replace those of the same name whatever its case."""
    low = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low], *[v.alias(k) for k, v in columns.items()])
