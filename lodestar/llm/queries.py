"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, chroma, counts, linededup, markup, neardup, packing, quality, secrets, suffixes
from lodestar.llm.common import table

#: Files of public tokenizers, by the package that holds them.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no recordings; a text's bytes are taken for those of one, 8-bit samples of one channel."""
    return chroma.align(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("__row")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), digests=True)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), digests=True)


@query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = secrets.spans_text(F.filter("secret_spans", lambda s: s["kind"] < len(secrets.BASE)))
    return df.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(secrets.BASE)], F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(F.col("secret_spans")).alias("spans"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = markup.extract_text(table(spark, sf_dir, "pages"))
    return df.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")})
