"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lexical_sql import SQL as SEARCH_SQL
from .pairs_sql import CONTAMINATED, NEAR_DUPLICATES
from .quality_sql import SQL as QUALITY_SQL


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import labelled, mix

    return mix(table(spark, sf_dir, "documents"), labelled(table(spark, sf_dir, "labels")))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_recurrent_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import encode_to_records

    return encode_to_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates
    from .pairs_sql import CONTRACT

    return near_duplicates(table(spark, sf_dir, "documents"), *CONTRACT)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import classify_held_out

    return classify_held_out(table(spark, sf_dir, "documents"))


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import COLUMNS, judge

    return judge(table(spark, sf_dir, "documents")).select(*COLUMNS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .prefix_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_skip_chain_pii, op2_soft_mixing, op3_spaced_seed_decontamination, op4_recurrent_lm_score, op5_assignment_secrets, op6_token_records, op7_setsketch_near_dedup, op8_language_id, op9_quality_divergence, op10_token_counts, op11_spelling_variants, op12_wavelet_search, op13_prefix_bpe)}
ORACLE_SQL: dict[str, str] = {"op3_spaced_seed_decontamination": CONTAMINATED, "op7_setsketch_near_dedup": NEAR_DUPLICATES, "op9_quality_divergence": QUALITY_SQL, "op12_wavelet_search": SEARCH_SQL}
