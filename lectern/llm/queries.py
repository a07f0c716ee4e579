"""The registered queries of this subpackage, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    infilling, langid, licenses, merkle, mixing, packing, quality, ranking, secrets, sentencepieces, sharding, simhash, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op1_license_scan", licenses.oracle_sql())
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses of every whole document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs)
    return found.select("doc_id", *[f"licenses.{c}" for c in (
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


@query("op2_secret_scan", secrets.oracle_sql())
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every whole document, weak parts only beside their counterparts."""
    found = secrets.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256")], F.col("secrets.listed").alias("spans")
    )


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and likelihood ratio of every whole document; the corpus is the documents themselves."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratios = quality.fit_ratios(docs, table(spark, folder, "labels"))
    judged = quality.judge_quality(docs, ratios)
    return judged.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")])


@query("op5_merkle_fingerprints", merkle.oracle_sql())
def op5_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text."""
    found = merkle.edited_fingerprints(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        merkle.listed_edits(F.col("edits")).alias("edits"))


@query("op10_mixture_shards", sharding.oracle_sql())
def op10_mixture_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of all documents by stratified interleaving; counts differ by one at most."""
    rows = sharding.measured_rows(table(spark, folder, "documents"))
    dealt = sharding.shard_mixture(rows)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_simhash_components")
def op6_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_copies(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_packed_sequences")
def op7_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens; token ids stay behind their checksums."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, "word_bpe_49k.json").drop("ids")
    return packing.pack(pieces, rows=docs.count())


@query("op3_sentencepiece_roundtrip")
def op3_sentencepiece_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every whole document, and whether decoding gives the text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = sentencepieces.encode_pieces(docs, "piece_bpe_32k.model")
    decoded = sentencepieces.decode_pieces(encoded, "piece_bpe_32k.model")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids_crc32",
        F.length("decoded").cast("bigint").alias("n_chars"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole document, learned on two thirds of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    judged = toxicity.judge_toxicity(docs, model)
    return judged.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole document, learned on two thirds of the documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")


@query("op11_weighted_mixture", mixing.oracle_sql())
def op11_weighted_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every document the mixture takes, by weighted fair queueing of the sources."""
    return mixing.mix_sources(mixing.sized_rows(table(spark, folder, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_fill_in_middle", infilling.oracle_sql())
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Form and cuts of every whole document, the digest of its output and of the text restored from that."""
    made = infilling.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    output, form = F.col("infill.output"), F.col("infill.form")
    return made.select(
        "doc_id", *[f"infill.{c}" for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(output, 256).alias("output_sha256"), F.sha2(infilling.restored(output, form), 256).alias("restored_sha256"),
    )


@query("op13_ranked_search", ranking.oracle_sql())
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranking.rank_documents(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))
