"""The queries opN_<name> of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longweave.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.line_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.language import identified

    return identified(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.sharding import assigned

    return assigned(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_shingles")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from longweave.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    """All of them; a module or library that one needs and that isn't there is an ImportError here and not when it runs."""
    from longweave.llm import bpe, decontaminate, embeddings, language, line_dedup, pii, sharding, simhash, token_counts, toxicity  # noqa: F401

    own = globals()
    return {k: own[k] for k in sorted((k for k in own if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    from longweave.llm import embeddings, line_dedup, sharding

    return {"op1_embedding_near_dedup": embeddings.SQL, "op3_line_dedup": line_dedup.SQL, "op5_sharding": sharding.SQL}
