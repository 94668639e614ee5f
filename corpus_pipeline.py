"""The corpus pipeline: stages that clean ``documents`` one after another.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and reread as the next stage's documents.  All but the last return the
columns of ``documents``.  Null and empty texts, repeated rows and null ids pass
as the operators' docstrings define; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcweave.llm.decontaminate import Decontaminator
from arcweave.llm.jaccard_join import JaccardJoin
from arcweave.llm.line_dedup import LineDedup
from arcweave.llm.queries import sentencepiece_model
from arcweave.llm.sentencepiece_codec import encode_and_decode
from arcweave.llm.toxicity import ToxicityClassifier
from arcweave.operators.storage import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ToxicityClassifier().fit(docs, labels).score(docs).where("score < 0.7").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that the largest document holding them keeps."""
    found = LineDedup().apply(docs)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    # A null text whose empty line stays is still null.
    text = F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).otherwise(changed["text"])
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, changed["n_chars"]).otherwise(F.col("row.n_chars"))
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five-word shingles and Jaccard 0.8."""
    return JaccardJoin(k=5, num=80, den=100).one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = Decontaminator().match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text they decode to."""
    coded = encode_and_decode(docs, sentencepiece_model())
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: Compression scores and merge rounds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if at:
            scratch.drop(STAGES[at - 1][0])
    return docs
