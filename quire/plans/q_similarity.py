"""Queries: name TF-IDF, cosine pairs, clusters, canonical names (I1-I3,
C12, D2, D11, D12) over ``author_names``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.similarity import char_wb_tfidf, cluster_names, cosine_pairs
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures

_NM = ",\nnm AS (SELECT pos AS id, name FROM author_names),"


def _names(spark, sf_dir):
    return fixture(spark, sf_dir, "author_names")


@register("name_tfidf", with_fixtures(
    _NM + S.tfidf_ctes("nm").rstrip() +
    "\nSELECT id AS pos, gram, CAST(df AS BIGINT) AS df, round(weight, 6) AS weight FROM vec", "author_names"))
def name_tfidf(spark, sf_dir):
    """Word-bounded char 2-4 gram TF-IDF vectors, L2-normalised."""
    v = char_wb_tfidf(_names(spark, sf_dir), "pos", "name")
    return v.select(F.col("id").alias("pos"), "gram", "df", F.round("weight", 6).alias("weight"))


@register("name_pairs", with_fixtures(
    _NM + S.cluster_ctes("nm").rstrip() + "\nSELECT a, b, round(cosine, 6) AS cosine FROM pairs",
    "author_names", recursive=True))
def name_pairs(spark, sf_dir):
    """Name pairs with cosine >= 0.85 (prefix-filtered join, exact)."""
    v = char_wb_tfidf(_names(spark, sf_dir), "pos", "name")
    return cosine_pairs(v, 0.85).select("a", "b", F.round("cosine", 6).alias("cosine"))


@register("name_clusters", with_fixtures(
    _NM + S.cluster_ctes("nm").rstrip() + "\nSELECT id AS pos, name, comp FROM tagged",
    "author_names", recursive=True))
def name_clusters(spark, sf_dir):
    """Connected components of the similarity graph."""
    m = cluster_names(_names(spark, sf_dir), "name", "pos", 0.85)
    return m.select("pos", F.col("alias").alias("name"), "comp")


@register("canonical_names", with_fixtures(
    _NM + S.cluster_ctes("nm").rstrip() + "\nSELECT name AS alias, canonical FROM canon",
    "author_names", recursive=True))
def canonical_names(spark, sf_dir):
    """Alias -> shortest name of its cluster (first seen on ties)."""
    m = cluster_names(_names(spark, sf_dir), "name", "pos", 0.85)
    return m.select("alias", "canonical")
