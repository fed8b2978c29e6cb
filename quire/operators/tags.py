"""Tag star schema: four tag columns -> tag dimension + article/tag bridge.

G3 union of the tag columns, H6 company prefix removal, B14 validity,
D1 first-appearance dimension, C4 bridge lookup, C5 tagged articles.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import py_strip
from quire.operators.ids import first_appearance_dim
from quire.operators.skew import lookup_join

TAG_COLUMNS = ("materia", "lugar_articulo", "personas", "empresa")
# Fixed value: literal prefix removed from the company tag column.
COMPANY_PREFIX = "Nombre: "


class Tags(NamedTuple):
    articles: DataFrame   # articles with at least one valid tag
    dim: DataFrame        # id_tags, tags
    links: DataFrame      # id_articulo, id_tags (repeats kept unless distinct)


def tag_occurrences(df: DataFrame, id_col: str = "id_articulo",
                    tag_cols: Sequence[str] = TAG_COLUMNS) -> DataFrame:
    """One row per (article, tag position, tag); invalid tags removed."""
    parts = []
    for c in tag_cols:
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        if c == "empresa":
            x = F.replace(x, F.lit(COMPANY_PREFIX), F.lit(""))
        parts.append(x)
    joined = F.concat_ws(";", *parts)
    occ = df.select(F.col(id_col).alias("id_articulo"),
                    F.posexplode_outer(F.split(joined, ";", -1)).alias("tag_pos", "tags"))
    occ = occ.withColumn("tags", py_strip("tags"))
    return occ.where((F.col("tags") != "") & (F.lower("tags") != "nan"))


def extract_tags(df: DataFrame, id_col: str = "id_articulo",
                 tag_cols: Sequence[str] = TAG_COLUMNS, distinct: bool = False) -> Tags:
    occ = tag_occurrences(df, id_col, tag_cols)
    dim = first_appearance_dim(occ, "tags", ["id_articulo", "tag_pos"], "id_tags")
    links = lookup_join(occ, dim, "tags", "left", count_col="_rows").where(F.col("id_tags").isNotNull())  # hot tags salted
    links = links.select("id_articulo", "id_tags")
    if distinct:
        links = links.distinct()
    articles = df.join(links.select(F.col("id_articulo").alias(id_col)), id_col, "left_semi")
    return Tags(articles, dim.select("id_tags", "tags"), links)
