"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dart, decontaminate, extract, fingerprint, language, near, packing, quality, secrets, sharding, substring
from .cluster import table


def tokenizer_path() -> str:
    """The public tokenizer's file, where the installation has it."""
    import public_tokenizers

    return str(public_tokenizers.path(packing.TOKENIZER))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say too of op1_secrets: the spans of the fixed patterns."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles all weigh one, since the similarity asked for is that of plain sets; weights are a parameter of the signatures."""
    return near.classes(table(spark, sf_dir, "documents"), dart.signer)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say too of op6_fingerprint: lengths and edited texts."""
    return op6_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 6: bands of the permutations joined, Jaccard similarities verified."""
    return fingerprint.near_classes(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "secrets_base": secrets_base,
    "op2_minhash": op2_minhash,
    "op3_sharding": op3_sharding,
    "op4_substring": op4_substring,
    "op5_decontaminate": op5_decontaminate,
    "op6_fingerprint": op6_fingerprint,
    "fingerprint_edits": fingerprint_edits,
    "fingerprint_classes": fingerprint_classes,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_extract": op10_extract,
}
