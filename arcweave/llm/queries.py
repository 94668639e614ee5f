"""Registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcweave.llm import queries_sql as sql
from arcweave.llm.chat_format import ChatFormatter
from arcweave.llm.decontaminate import Decontaminator
from arcweave.llm.host_quality import HostQuality
from arcweave.llm.jaccard_join import JaccardJoin
from arcweave.llm.license_scan import LicenseScan
from arcweave.llm.line_dedup import LineDedup
from arcweave.llm.secret_scan import SecretScan
from arcweave.llm.sentencepiece_codec import encode_and_decode
from arcweave.llm.toxicity import ToxicityClassifier, fold
from arcweave.llm.warc import WarcWriter, read_warc
from arcweave.operators.storage import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentencepiece_model() -> str:
    """Path of the default vocabulary; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and license of which it holds a notice or header."""
    found = LicenseScan().scan(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "containment")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent long lines stay only in the largest document that holds them."""
    found = LineDedup(min_chars=40, min_docs=5).apply(_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed into prefix trees and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "chat")
    found = ChatFormatter.unpack(scratch.keep(ChatFormatter().pack(rows.unionByName(extra)), "packs"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join("masked", "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files and read back."""
    path = Scratch(spark, "warc").path("archive")
    WarcWriter(revisit_from=0).write(_table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path, with_payload=False)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity probability of every text, learnt outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    scored = ToxicityClassifier().fit(docs, _table(spark, sf_dir, "labels")).score(docs.select("doc_id", "text"))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(fold("row.doc_id") == 1, F.lit(False)).alias("held_out"),
        "score",
        F.expr("CASE WHEN score >= 0.7 THEN 1 ELSE 0 END").alias("predicted"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 4-word shingles and Jaccard 0.85: each document's set size and component."""
    docs = _table(spark, sf_dir, "documents")
    found = JaccardJoin(k=4, num=85, den=100).components(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it contains, with the best window."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = Decontaminator(k=5, least=0.8).match(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, its base rule, and its host's verdict."""
    found = HostQuality().verdicts(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(F.col("row.doc_id").alias("doc_id"), *measures, "base_failed", "kept")


def host_verdicts_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host rules where a host is the number of digits of the text length: those of short texts are rejected."""
    docs = _table(spark, sf_dir, "documents")
    hosts = docs.withColumn("host", F.length(F.col("n_chars").cast("string")).cast("string"))
    found = HostQuality().verdicts(hosts, host_col="host", carry=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "host", "host_ok", "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text by kind, and digests of their spans."""
    scan = SecretScan()
    found = scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(scan.rendered(base), 256).alias("base_sha256"), scan.rendered(F.col("spans")).alias("spans"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text they decode to, as digests."""
    coded = encode_and_decode(_table(spark, sf_dir, "documents"), sentencepiece_model())
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_sentencepiece": op10_sentencepiece,
    "host_verdicts_by_length": host_verdicts_by_length,
}

ORACLE_SQL = {
    "op1_license_scan": sql.OP1,
    "op2_line_dedup": sql.OP2,
    "op3_chat_format": sql.OP3,
    "op4_warc": sql.OP4,
    "op6_ngram_jaccard_join": sql.OP6,
    "op7_decontamination": sql.OP7,
    "op8_quality_rules": sql.OP8,
    "host_verdicts_by_length": sql.HOSTS_BY_LENGTH,
    "op9_secret_scan": sql.OP9,
}
