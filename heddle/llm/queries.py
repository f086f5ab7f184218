"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import table
from heddle.llm.html_main import ORACLE as MAIN_TEXT_SQL
from heddle.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from heddle.llm.spelling import ORACLE as SPELLING_SQL
from heddle.llm.url_lists import ORACLE as URL_LISTS_SQL

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the package that has it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and two bits, as the contract of this query has it."""
    from heddle.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, max_diff=2)


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.merkle import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.line_dedup import drop_boilerplate

    done = drop_boilerplate(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("text_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.url_lists import dated_pages, demonstration_list, judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(dated_pages(pages), demonstration_list(pages)).withColumnRenamed("id", "page_id")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.piece_codec import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.runs import digests, looped

    return digests(looped(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.spelling import variants, words_with_slips

    return variants(words_with_slips(table(spark, sf_dir, "documents")))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.html_main import main_text

    pages = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_near_vectors": op4_near_vectors,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_temporal_url_lists": op9_temporal_url_lists,
    "op10_piece_codec": op10_piece_codec,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_main_text": op13_main_text,
}

ORACLES: dict[str, str] = {
    "op9_temporal_url_lists": URL_LISTS_SQL,
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_main_text": MAIN_TEXT_SQL,
}
