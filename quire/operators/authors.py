"""Author entities: byline split, raw dimension, standardisation
(B10-B13, H1-H5, C1-C3, C5, D1, L1).

``extract_authors`` routes bylines by the entity-model gate (B10): simple
bylines are split on ';'; gated ones go to an optional user extractor (a
function Column -> ``array<string>`` Column, for instance a pandas UDF around
an entity model) applied to those rows only, and give no authors without
one - the reference's own failure result.
``standardise_authors`` un-inverts names, clusters spellings, keeps valid
canonical names and renumbers them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import (
    fix_caps, is_multi_token, is_valid_author, needs_entity_model, split_byline, uninvert_name,
)
from quire.functions.text import py_strip
from quire.operators.ids import first_appearance_dim
from quire.operators.similarity import cluster_names
from quire.operators.skew import lookup_join


class Authors(NamedTuple):
    articles: DataFrame     # articles with at least one author
    occurrences: DataFrame  # id_articulo, name_pos, autor (+ order keys)
    dim: DataFrame          # autor, id_autor
    links: DataFrame        # id_articulo, id_autor (repeats kept)


def author_occurrences(df: DataFrame, id_col: str = "id_articulo", byline_col: str = "autor",
                       extractor: Callable[[Column], Column] | None = None,
                       fix_keywords: bool = False, split_first: bool = False) -> DataFrame:
    """(id_articulo, name_pos, autor): one row per multi-token author name.

    ``split_first`` (Q2 fixed) splits the byline on ';' before gating, so each
    piece is gated on its own; by default the whole byline is gated, and
    since ';' is itself a gate symbol, the split branch sees one name."""
    b = py_strip(F.col(byline_col))
    base = df.select(F.col(id_col).alias("id_articulo"), b.alias("_b"))
    base = base.where(F.col("_b").isNotNull() & (F.col("_b") != ""))  # B11
    if split_first:
        pieces = F.filter(F.transform(F.split("_b", ";"), lambda p: py_strip(p)), lambda p: F.length(p) > 0)
        base = base.select("id_articulo", F.posexplode_outer(pieces).alias("_piece", "_b")) \
                   .where(F.col("_b").isNotNull())
    else:
        base = base.withColumn("_piece", F.lit(0))
    gated = needs_entity_model(F.col("_b"), fix_keywords)
    simple = base.where(~gated).select("id_articulo", "_piece", split_byline("_b").alias("_names"))
    parts = [simple]
    if extractor is not None:  # L1: the model runs on gated rows only
        model_rows = base.where(gated).select(
            "id_articulo", "_piece",
            F.transform(extractor(fix_caps("_b")), lambda n: fix_caps(n)).alias("_names"))
        parts.append(model_rows)
    named = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    occ = named.select("id_articulo", "_piece", F.posexplode_outer("_names").alias("_k", "autor"))
    # name position inside the byline: piece first, then the name inside the piece
    occ = occ.select("id_articulo", (F.col("_piece").cast("long") * (1 << 20) + F.col("_k")).alias("name_pos"),
                     "autor")
    return occ.where(F.col("autor").isNotNull() & is_multi_token("autor"))  # B12


def extract_authors(df: DataFrame, id_col: str = "id_articulo", byline_col: str = "autor",
                    extractor=None, fix_keywords: bool = False, distinct: bool = False,
                    split_first: bool = False) -> Authors:
    occ = author_occurrences(df, id_col, byline_col, extractor, fix_keywords, split_first)
    dim = first_appearance_dim(occ, "autor", ["id_articulo", "name_pos"], "id_autor")
    links = lookup_join(occ, dim, "autor", count_col="_rows").select("id_articulo", "id_autor")  # C1, hot names salted
    if distinct:
        links = links.distinct()
    articles = df.join(links.select(F.col("id_articulo").alias(id_col)), id_col, "left_semi")  # C5
    return Authors(articles, occ, dim.select("autor", "id_autor"), links)


def uninvert_occurrences(occ: DataFrame, name_col: str = "autor") -> DataFrame:
    """H3/H4 over a table: the whitespace collapse runs only if some name in
    the table holds ', ' (one short-circuiting scalar job decides)."""
    has_comma = occ.where(F.col(name_col).contains(", ")).limit(1).count() > 0
    return occ.withColumn("author_name", uninvert_name(F.col(name_col), collapse=has_comma))


def standardise_authors(occ: DataFrame, order_by: Sequence[str] = ("id_articulo", "name_pos"),
                        threshold: float = 0.85, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(dim(autor, id_autor), links(id_articulo, id_autor)) after
    un-inversion, clustering (C3 alias -> canonical), validity (B13)."""
    order = list(order_by)
    named = uninvert_occurrences(occ)
    first = named.groupBy("author_name").agg(F.min(F.struct(*order)).alias("_f"))
    # distinct names get a dense first-appearance number for the clustering
    from quire.operators.ids import dense_ids
    names = dense_ids(first.select(F.col("author_name").alias("name"),
                                   *[F.col(f"_f.{k}").alias(f"_o{i}") for i, k in enumerate(order)]),
                      [f"_o{i}" for i in range(len(order))], "pos")
    mapping = cluster_names(names.select("name", "pos"), "name", "pos", threshold)
    canon = (lookup_join(named, mapping.select(F.col("alias").alias("author_name"), "canonical"), "author_name")
                  .withColumn("autor", F.col("canonical")))
    valid = canon.where(is_valid_author("autor"))
    dim = first_appearance_dim(valid, "autor", order, "id_autor")
    links = lookup_join(valid, dim, "autor", count_col="_rows").select("id_articulo", "id_autor")  # C2
    if distinct:
        links = links.distinct()
    return dim.select("autor", "id_autor"), links
