"""A corpus from raw documents to packed sequences: each stage works on what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import linededup, neardup, packing, quality, secrets
from lodestar.llm.common import SPACES, small_batches
from lodestar.llm.queries import WORD_BPE, tokenizer_file
from lodestar.plans.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host is rejected, go."""
    return quality.drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of windows that an earlier place has go, and documents of which no word is left then."""
    names = {c: f"__{k}" for k, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_removed")}
    out = linededup.dedup_lines(docs.withColumnsRenamed(names))
    out = out.where((F.col("n_removed") == 0) | (F.translate("text", SPACES, "") != "")).drop("n_lines", "n_removed")
    return _recount(out.withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return neardup.drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark."""
    return _recount(secrets.redact_secrets(docs, whole=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 tokens; a row for each piece of a document, with its ids."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file(WORD_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; all stages but the last are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Signatures and tokens can't be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
