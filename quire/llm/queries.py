"""The registered queries of this subpackage: each applies one operator with
its production parameters to the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, near_dedup, quality_rules, ranked_search
from quire.llm.decontaminate import decontaminate as _decontaminate
from quire.llm.fingerprint import edited_fingerprints
from quire.llm.frames import documents, table
from quire.llm.language_id import language_id
from quire.llm.line_dedup import line_dedup_rows
from quire.llm.lm_score import lm_score
from quire.llm.mixing import mixing
from quire.llm.near_dedup import near_dedup as _near_dedup
from quire.llm.pii import pii
from quire.llm.quality_classifier import quality_classifier
from quire.llm.quality_rules import quality_rules as _quality_rules
from quire.llm.ranked_search import ranked_search as _ranked_search
from quire.llm.spelling import spelling_variants
from quire.llm.toxicity import toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without globally repeated content-defined line chunks."""
    return line_dedup_rows(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the adaptive quality rules."""
    return _quality_rules(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in each document."""
    return _decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("key")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates and the document that stays of each."""
    return _near_dedup(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document."""
    return language_id(documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and maximum-entropy scores of every document."""
    return lm_score(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, as counts, digest and spans."""
    return pii(documents(spark, sf_dir)).drop("span_list")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_classifier(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling rates that bring the label domains to the target weights."""
    return mixing(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return _ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the words that they may misspell."""
    return spelling_variants(documents(spark, sf_dir))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses."""
    return edited_fingerprints(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_rules, op3_toxicity, op4_decontamination, op5_near_dedup, op6_language_id, op7_lm_score,
    op8_pii, op9_quality_classifier, op10_mixing, op11_ranked_search,
    op12_spelling_variants, op13_fingerprint)}

ORACLE = {"op2_quality_rules": quality_rules.ORACLE_SQL, "op4_decontamination": decontaminate.ORACLE_SQL,
          "op5_near_dedup": near_dedup.ORACLE_SQL, "op11_ranked_search": ranked_search.ORACLE_SQL}
