"""Name similarity: char n-gram TF-IDF, cosine neighbours, connected
components, canonical alias (I1-I3, C12, D2, D11, D12).

Data flow (long form, never a matrix on one machine):

* ``char_wb_tfidf``: (id, gram, weight) with word-bounded grams of length
  2..4 over lower-cased text, smooth IDF ``ln((1+n)/(1+df))+1``, L2 norm.
* ``cosine_pairs``: exact pairs with cosine >= t.  Candidates come from an
  equi-join on *prefix* grams only: grams are ordered globally rarest first
  and a vector's prefix is every gram from which on a pair could still reach t.
  Two bounds hold for what two vectors can share from a gram on: the norm of
  the vector's rest (the other vector has norm 1), and the rest's weights times
  the largest weight that any vector has in each gram.  A pair reaching t must
  share a gram inside both prefixes (its first common gram), so nothing is lost,
  and frequent grams - the ones that would pair everything with everything - sit
  in the suffixes.  At a meeting the two rests' norms bound the pair once more;
  a long list is compared block against block.  Candidates are then scored
  exactly.
* ``connected_components``: min-label propagation with pointer jumping,
  one checkpoint per round (DBSCAN with min_samples=1 is exactly this).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import py_strip
from quire.operators import components
from quire.session import materialize, stored
from quire.operators.skew import BLOCK, lookup_join, meet_in_lists

EPS = 1e-9


def char_wb_grams(df: DataFrame, id_col: str, text_col: str, ngram=(2, 4)) -> DataFrame:
    """(id, gram, tf): per whitespace word padded with one blank on each
    side, every substring of length lo..min(hi, padded length)."""
    lo, hi = ngram
    words = df.select(F.col(id_col).alias("id"),
                      F.explode_outer(F.split(py_strip(F.lower(F.col(text_col))), r"\s+")).alias("word"))
    words = words.where(F.length("word") > 0).withColumn("w", F.concat(F.lit(" "), "word", F.lit(" ")))
    grams = F.flatten(F.transform(
        F.sequence(F.lit(lo), F.least(F.lit(hi), F.length("w"))),
        lambda n: F.transform(F.sequence(F.lit(0), F.length("w") - n),
                              lambda i: F.substring(F.col("w"), i + 1, n))))
    g = words.select("id", F.explode_outer(grams).alias("gram")).where(F.col("gram").isNotNull())
    return g.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def char_wb_tfidf(df: DataFrame, id_col: str, text_col: str, ngram=(2, 4)) -> DataFrame:
    """(id, gram, df, weight) with L2-normalised TF-IDF weights."""
    grams = char_wb_grams(df, id_col, text_col, ngram)
    n_docs = df.select(id_col).distinct().count()  # one scalar for the IDF formula
    dfreq = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    g = lookup_join(grams, dfreq, "gram", count_col="df").withColumn(
        "raw", F.col("tf") * (F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0))
    norms = g.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return (g.join(norms, "id")
             .select("id", "gram", "df", (F.col("raw") / F.col("norm")).alias("weight")))


def prefix_grams(vec: DataFrame, threshold: float) -> DataFrame:
    """(id, gram, rest): the grams of each vector that can hold the first
    common gram of a pair; ``rest`` is the squared norm from that gram on."""
    most = vec.groupBy("gram").agg(F.max("weight").alias("_most"), F.count(F.lit(1)).alias("_df"))
    w = (Window.partitionBy("id").orderBy("df", "gram")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    known = lookup_join(vec, most, "gram", count_col="_df")
    tagged = (known.withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(w))
              .withColumn("_reach", F.sum(F.col("weight") * F.col("_most")).over(w)))
    return tagged.where((F.col("rest") >= threshold * threshold - EPS) & (F.col("_reach") >= threshold - EPS)).select("id", "gram", "rest")


def cosine_candidates(vec: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs a < b that share a prefix gram and pass its norm bound."""
    dealt, meet, once = meet_in_lists(prefix_grams(vec, threshold), "gram", "id", block)
    reach = F.col("a.rest") * F.col("b.rest") >= threshold * threshold - EPS
    return (dealt.alias("a").join(dealt.alias("b"), meet).where((F.col("a.id") < F.col("b.id")) & once & reach)
            .select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())


def cosine_pairs(vec: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) for a < b with cosine >= threshold (exact)."""
    cand = cosine_candidates(vec, threshold, block)
    va = vec.select(F.col("id").alias("a"), "gram", F.col("weight").alias("wa"))
    vb = vec.select(F.col("id").alias("b"), "gram", F.col("weight").alias("wb"))
    scored = (cand.join(va, "a").join(vb, ["b", "gram"])
                  .groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")))
    return scored.where(F.col("cosine") >= threshold - EPS)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): comp = smallest id in the node's component (star steps
    until nothing changes; a node without an edge is its own component)."""
    comps = components.connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("_c"))
    return nodes.select("id").join(comps, "id", "left").select("id", F.coalesce("_c", "id").alias("comp"))


def cluster_names(names: DataFrame, name_col: str = "name", order_by: str = "pos",
                  threshold: float = 0.85) -> DataFrame:
    """(alias, canonical).  ``names`` holds distinct names with their
    first position; canonical = shortest name of the cluster, first seen on
    ties (D2)."""
    nodes = names.select(F.col(order_by).alias("id"), F.col(name_col).alias("name"))
    vec = materialize(char_wb_tfidf(nodes, "id", "name"))  # read by three branches below
    comps = connected_components(nodes.select("id"), cosine_pairs(vec, threshold))
    tagged = stored(nodes.join(comps, "id"))
    canon = tagged.groupBy("comp").agg(
        F.min_by("name", F.struct(F.length("name"), F.col("id"))).alias("canonical"))
    return tagged.join(canon, "comp").select(F.col("name").alias("alias"), "canonical", "comp",
                                             F.col("id").alias("pos"))
