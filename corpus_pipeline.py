"""The corpus pipeline: toxicity, quality, near-duplicates, decontamination and packing, each from the rows the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gazette.llm import decontaminate, near_duplicates, packing, quality, toxicity
from gazette.llm.tokens import tokenizer_path
from gazette.scale import written

_OWN = ("doc_id", "text")


def _set_apart(docs: DataFrame) -> DataFrame:
    """The documents with their other columns under numbered names, which no operator uses."""
    return docs.toDF(*(c if c in _OWN else f"_other_{i}" for i, c in enumerate(docs.columns)))


def _put_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, in its order and by its names."""
    return found.select(*(F.col(a).alias(b) for a, b in zip(_set_apart(docs).columns, docs.columns, strict=True)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is under the threshold; the labels of the folder are learned from."""
    rows = _set_apart(docs)
    weights = toxicity.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _put_back(toxicity.score(rows, weights).where(F.col("score") < toxicity.THRESHOLD), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weak-label model takes for good."""
    rows = _set_apart(docs)
    return _put_back(quality.score(rows, quality.train(rows)).where(F.col("quality") >= quality.THRESHOLD), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates; documents without words stay."""
    return _put_back(near_duplicates.keep_one(_set_apart(docs)), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    marked = decontaminate.mark(_set_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _put_back(marked.where(~F.col("contaminated")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the documents in training sequences, one row per piece."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic), ("quality classifier", keep_quality), ("near-duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_leaks), ("packing", pack),
]
#: The stages train models and draw samples, so SQL can't express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
