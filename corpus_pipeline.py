"""A text pipeline over ``documents`` in five stages, each one of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longweave.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from longweave.llm.common import fresh, table
from longweave.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; every document stays, with its new length."""
    aside = fresh(docs, "__lw_lines_dropped")[0]
    own = docs.withColumnsRenamed({"lines_dropped": aside})
    out = line_dedup.without_boilerplate(own).drop("lines_dropped").withColumnsRenamed({aside: "lines_dropped"})
    cols = [F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group with similarity 0.8 or more over five-word shingles."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded again: ids as digests, and their number."""
    return bpe.encoded(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express the first stage's trained score; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written to the shared folder for the next.

    What a stage writes on the way is deleted when it ends, and its input when the next one has ended.
    """
    from longweave.session import drop_saved, saved, scratch

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            after = keep(saved(stage(spark, docs, sf_dir), name))
        drop_saved(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
