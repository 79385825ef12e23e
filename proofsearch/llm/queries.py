"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fill_middle, license_scan, mixing, mtree, near_dedup, personal_data, spelling
from .base import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is. Others of its kind will do: byte-level BPE that keeps spaces, or lower-case BPE that drops them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digests(personal_data.find_personal_data(table(spark, sf_dir, "documents")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_token_output": op8_token_output,
    "op9_license_scan": op9_license_scan,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_personal_data": op12_personal_data,
    "op13_fill_middle": op13_fill_middle,
}

SQL: dict[str, str] = {
    "op2_mtree_topk": mtree.oracle(),
    "op4_source_mixing": mixing.oracle(),
    "op9_license_scan": license_scan.oracle(),
    "op10_minhash_dedup": near_dedup.oracle(),
    "op11_spelling_variants": spelling.oracle(),
    "op12_personal_data": personal_data.oracle(),
    "op13_fill_middle": fill_middle.oracle(),
}
