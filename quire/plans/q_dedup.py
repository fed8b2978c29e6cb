"""Queries: embedding float16 sets, exact copies, near-duplicate pairs,
greedy keep-first, LSH keep-first (C6, C11, I4-I8) over ``documents`` and
``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import dedup as DD
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.sources.tables import table

THRESHOLD = 0.9


def _doc_sets(spark, sf_dir):
    return DD.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text", 3)


def _emb_sets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", DD.embedding_set("embedding").alias("tokens"))


# ---------------------------------------------------------------- oracle --

def _f16(x: str) -> str:
    a = f"abs({x})"
    e0 = f"floor(log2({a}))"
    e1 = f"(CASE WHEN pow(2.0, {e0} + 1) <= {a} THEN {e0} + 1 ELSE {e0} END)"
    e = f"(CASE WHEN pow(2.0, {e1}) > {a} THEN {e1} - 1 ELSE {e1} END)"
    step = f"pow(2.0, greatest({e}, -14) - 10)"
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / {step}, 0) * {step} END)"


_EMB = f""",
ev AS (SELECT vec_id, CAST(embedding[k] AS DOUBLE) AS x
       FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings) z),
eset AS (SELECT DISTINCT vec_id AS id, {_f16('x')} AS token FROM ev)"""

_WORDS = f"list_filter(string_split_regex({S.strip('lower(text)')}, '\\s+'), lambda w: length(w) > 0)"
def docs_ctes(src: str = "documents", p: str = "") -> str:
    """Shingle-set CTEs over ``src(doc_id, text)``: ``{p}dsh(id, tokens)``, ``{p}dset(id, token)``."""
    return f""",
{p}dw AS (SELECT doc_id, {_WORDS} AS w FROM {src}),
{p}dsh AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(list_transform(generate_series(1, greatest(len(w) - 2, 1)),
          lambda i: array_to_string(list_slice(w, i, i + 2), ' ')), lambda s: length(s) > 0))) AS tokens FROM {p}dw),
{p}dset AS (SELECT id, unnest(tokens) AS token FROM {p}dsh)"""


_DOCS = docs_ctes()


def _pairs(sets: str, listed: str | None, p: str = "") -> str:
    """Representatives (first id per identical set), their verified pairs,
    and pairs over all rows (copies included) for the greedy oracle."""
    lists = listed or f"(SELECT id, list_sort(list(token)) AS tokens FROM {sets} GROUP BY id)"
    return f""",
{p}lists AS {lists},
{p}reps AS (SELECT min(id) AS id FROM {p}lists GROUP BY tokens),
{p}sz AS (SELECT id, count(*) AS n FROM {sets} GROUP BY id),
{p}allp AS (SELECT a.id AS a, b.id AS b, count(*) AS inter FROM {sets} a JOIN {sets} b ON a.token = b.token AND a.id < b.id
         GROUP BY a.id, b.id),
{p}allj AS MATERIALIZED (SELECT q.a, q.b, q.inter / (sa.n + sb.n - q.inter) AS jaccard FROM {p}allp q
         JOIN {p}sz sa ON sa.id = q.a JOIN {p}sz sb ON sb.id = q.b),
{p}edges AS (SELECT a, b FROM {p}allj WHERE jaccard >= {THRESHOLD} - 1e-12),
{p}repj AS (SELECT * FROM {p}allj WHERE jaccard >= {THRESHOLD} - 1e-12 AND a IN (SELECT id FROM {p}reps)
            AND b IN (SELECT id FROM {p}reps))"""


def _greedy(ids: str, p: str = "") -> str:
    return f""",
{p}nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM {ids}),
{p}nb AS MATERIALIZED (SELECT n.id, n.rn, coalesce(list(e.a) FILTER (WHERE e.a IS NOT NULL), []) AS earlier
       FROM {p}nodes n LEFT JOIN {p}edges e ON e.b = n.id GROUP BY n.id, n.rn),
{p}g(rn, kept) AS (SELECT 0, CAST([] AS BIGINT[])
                UNION ALL
                SELECT gg.rn + 1, CASE WHEN len(list_intersect(nn.earlier, gg.kept)) = 0 THEN list_append(gg.kept, nn.id)
                                      ELSE gg.kept END
                FROM {p}g gg JOIN {p}nb nn ON nn.rn = gg.rn + 1),
{p}fin AS (SELECT kept FROM {p}g ORDER BY rn DESC LIMIT 1)"""


# ------------------------------------------------------------------ keys --

@register("embedding_sets", "WITH " + _EMB.lstrip(",\n") + "\nSELECT id AS vec_id, token AS element FROM eset")
def embedding_sets(spark, sf_dir):
    """I4: distinct float16 elements of every embedding."""
    x = _emb_sets(spark, sf_dir).select("vec_id", F.explode_outer("tokens").alias("element"))
    return x.where(F.col("element").isNotNull())


@register("exact_copies", "WITH " + _DOCS.lstrip(",\n") + """,
lists AS (SELECT id, tokens FROM dsh),
fst AS (SELECT tokens, min(id) AS rep FROM lists GROUP BY tokens)
SELECT l.id AS doc_id, f.rep AS copy_of FROM lists l JOIN fst f USING (tokens) WHERE l.id <> f.rep""")
def exact_copies(spark, sf_dir):
    """I8 step 1: documents whose shingle set equals an earlier one's."""
    c = DD.collapse_copies(_doc_sets(spark, sf_dir), "doc_id", "doc_id", "tokens")
    return c.copies.select(F.col("id").alias("doc_id"), "copy_of")


@register("near_dup_pairs", "WITH RECURSIVE " + _DOCS.lstrip(",\n") + _pairs("dset", "(SELECT id, tokens FROM dsh)") + """
SELECT a, b, round(jaccard, 6) AS jaccard FROM repj""")
def near_dup_pairs(spark, sf_dir):
    """C11/I8: document pairs (distinct 3-word shingle sets, shingles stored
    as 64-bit hashes) with Jaccard >= 0.9: sets that share a mark, verified."""
    c = DD.collapse_copies(_doc_sets(spark, sf_dir), "doc_id", "doc_id", "tokens", THRESHOLD)
    p = DD.jaccard_pairs(c.reps, THRESHOLD, DD.shared_marks(c.rows))
    return p.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@register("dedup_greedy", "WITH RECURSIVE " + _DOCS.lstrip(",\n") + _pairs("dset", "(SELECT id, tokens FROM dsh)")
          + _greedy("dsh") + "\nSELECT n.id AS doc_id, list_contains((SELECT kept FROM fin), n.id) AS kept FROM nodes n")
def dedup_greedy(spark, sf_dir):
    """Keep-first de-duplication of documents: Jaccard >= 0.9 between
    3-word shingle sets (shingles stored as 64-bit hashes), verified pairs."""
    d = DD.dedup_sets(_doc_sets(spark, sf_dir), "doc_id", "doc_id", "tokens", THRESHOLD)
    return d.kept.select(F.col("id").alias("doc_id"), "kept")


@register("embedding_dedup", "WITH RECURSIVE " + _EMB.lstrip(",\n") + _pairs("eset", None)
          + _greedy("(SELECT DISTINCT id FROM eset)")
          + "\nSELECT n.id AS vec_id, list_contains((SELECT kept FROM fin), n.id) AS kept FROM nodes n")
def embedding_dedup(spark, sf_dir):
    """I4+I7: keep-first de-duplication of embeddings as float16 sets."""
    d = DD.dedup_sets(_emb_sets(spark, sf_dir), "vec_id", "vec_id", "tokens", THRESHOLD)
    return d.kept.select(F.col("id").alias("vec_id"), "kept")


def lsh_ctes(src: str) -> str:
    """``nodes`` and ``fin(kept)`` of LSH keep-first over ``src(doc_id, text)``."""
    p, base = DD.PRIME, DD.SHINGLE_BASE
    word = f"(('0x' || substr(md5(w), 1, 8))::BIGINT % {p})"
    lanes = ", ".join(f"min(({a} * x + {b}) % {p}) AS h{i}" for i, (a, b) in enumerate(DD.lane_constants()))
    bands = ", ".join("[" + ", ".join(f"coalesce(h{i}, {p})" for i in range(k * 21, k * 21 + 21)) + "]" for k in range(3))
    return f"""dw AS (SELECT doc_id AS id, list_transform({_WORDS}, lambda w: {word}) AS h FROM {src}),
ds AS (SELECT id, CASE WHEN len(h) = 0 THEN [NULL::BIGINT] WHEN len(h) = 1 THEN [h[1]] WHEN len(h) = 2 THEN [(h[1] * {base} + h[2]) % {p}]
       ELSE list_transform(generate_series(1, len(h) - 2), lambda i: (((h[i] * {base} + h[i + 1]) % {p}) * {base} + h[i + 2]) % {p}) END AS t FROM dw),
dx AS (SELECT DISTINCT id, unnest(t) AS x FROM ds),
sig AS (SELECT id, {lanes} FROM dx GROUP BY id),
bk AS MATERIALIZED (SELECT id, unnest(range(3)) AS band, unnest([{bands}]) AS bucket FROM sig),
edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM bk a JOIN bk b ON a.band = b.band AND a.bucket = b.bucket AND a.id < b.id)""" \
        + _greedy("sig")


@register("lsh_dedup", "WITH RECURSIVE " + lsh_ctes("documents")
          + "\nSELECT n.id AS doc_id, list_contains((SELECT kept FROM fin), n.id) AS kept FROM nodes n")
def lsh_dedup(spark, sf_dir):
    """Keep-first with the reference's MinHash LSH relation (64 hashes,
    3 bands x 21 rows) over document shingle sets; the hashes are portable, so
    SQL gets the same buckets."""
    k = DD.lsh_keep_first(DD.portable_shingles(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "doc_id", "tokens")
    return k.select(F.col("id").alias("doc_id"), "kept")


@register("minhash_signatures", f"""WITH dw AS (SELECT vec_id, unnest(embedding) AS e FROM embeddings),
dx AS (SELECT vec_id, ('0x' || substr(md5(CAST(CAST(floor(e * 1000) AS BIGINT) AS VARCHAR)), 1, 8))::BIGINT % {DD.PRIME} AS x FROM dw)
SELECT vec_id, """ + ", ".join(f"min(({a} * x + {b}) % {DD.PRIME}) AS h{i}" for i, (a, b) in enumerate(DD.lane_constants(8)))
          + " FROM dx GROUP BY vec_id")
def minhash_signatures(spark, sf_dir):
    """Eight portable MinHash values per embedding (elements in steps of
    a thousandth)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: DD.portable_base(
        F.floor(x.cast("double") * 1000).cast("long").cast("string"))).alias("tokens"))
    sig = DD.minhash_signatures(e, "vec_id", "tokens", 8)
    return sig.select("vec_id", *[F.col("sig")[i].alias(f"h{i}") for i in range(8)])
