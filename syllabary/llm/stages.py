"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents, the last one packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fuzzy_lines import fuzzy_lines, without_repeats
from .mixing import mixed_rows, pareto_mix
from .ngram_join import one_per_class
from .packing import pack
from .quality import classify, keep_good

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary files have this tokenizer; it is at the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, classify(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, fuzzy_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs, pareto_mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())
