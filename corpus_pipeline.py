"""A corpus cleaned and tokenised in stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import dartminhash, decontam, linedup, spencode
from gridspark.llm import quality as quality_rules
from gridspark.llm._shared import saved
from gridspark.llm.queries import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_quality(docs, _table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines are cut out of all texts."""
    return linedup.dedupe_lines(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; of what lost over half of its text, the text as it came is compared too, so that scraps of copies go."""
    came, size = _table(spark, sf_dir, "documents"), F.length("text")
    sizes = came.select("doc_id", size.alias("came")).join(docs.select("doc_id", size.alias("left")), "doc_id")
    cut = saved(sizes.where("2 * left < came").select("doc_id").distinct(), "cut-documents")
    return dartminhash.first_of_class(docs, more=came.join(cut, "doc_id", "left_semi").select("doc_id", "text"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontam.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of the text decoded from them."""
    return spencode.digest_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality_rules", keep_quality), ("line_dedup", drop_lines), ("minhash_dedup", keep_first), ("benchmark_decontamination", cut_benchmark), ("sentencepiece", encode_texts)]

#: The stages train a model and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
