"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenreel.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("s", "text_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.sharding import QUERY_LIMIT, assign

    return assign(table(spark, sf_dir, "documents"), QUERY_LIMIT)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.lines import line_digests

    return line_digests(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.binary_codes import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    from lumenreel.llm.pieces import digest_documents

    with open(public_tokenizers.path(model), "rb") as f:
        return digest_documents(table(spark, sf_dir, "documents"), f.read())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_sharding, op4_main_text, op5_line_dedup, op6_mixing, op7_language, op8_embeddings, op9_toxicity, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    from lumenreel.llm import exact, lines, sharding

    return {"op1_exact_dedup": exact.ORACLE, "op3_sharding": sharding.ORACLE, "op5_line_dedup": lines.ORACLE}
