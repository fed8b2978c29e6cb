"""Soft-membership mixing, in DataFrame functions only.

A domain is a pair of labels (quality, toxic), written ``q,t``.  A classifier
(hashed words, multinomial logistic regression of Spark ML) is fitted on a
bounded sample of the labelled documents and gives every document its domain
posteriors p.  A document i of n_i words sampled at rate r_i adds n_i * r_i *
p_ik expected words to domain k.  Starting at r = 1, distributed projected
gradient steps fit rates r >= 0 whose domain totals T match the targets t in
least squares, the residuals weighted by the domains' own totals m:

    T_k = sum over documents of n * r * p_k      (one aggregation per step)
    r   = max(0, r - sum_k p_k * (T_k - t_k) / m_k)

The matrix of such a step is column-stochastic, so that steps of size 1 never
overshoot.  Only the domain totals reach the driver.

The targets are shares of ``budget`` words (default: all words of the input).
Domains without a learnt label or without words are left out and the other
shares scaled up.  A null or empty text has no words: it has posteriors (those
of no words) and a rate, and adds nothing.  Without labelled documents the
domain is null and every rate is 1.  Repeated rows count as often as they stand
in the table and get the same rate.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import documents_of, stored, table

SAMPLE = 6000
FEATURES = 1 << 14
STEPS, TOLERANCE = 60, 1e-4
REFRESH = 15  # steps after which the rates are written, so that plans stay small
TARGETS = {"1,0": 0.90, "0,0": 0.08, "1,1": 0.015, "0,1": 0.005}
CLEAN_TARGETS = {"1,0": 0.95, "0,0": 0.05, "1,1": 0.0, "0,1": 0.0}


def _words(text: Column) -> Column:
    """Lower-cased white-space words; none for a null text."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                    r"[\x20\x09-\x0D]+")
    return F.array_remove(split, "")


def domain_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and domain of the labelled documents with the smallest id hashes;
    the bound makes the broadcast safe."""
    l = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
         .select(F.col("doc_id").alias("_id"), F.concat_ws(",", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("domain"))
         .distinct().orderBy(F.xxhash64("_id"), "_id", "domain").limit(sample))
    return documents_of(docs).join(F.broadcast(l), F.col("doc_id") == F.col("_id")).select("text", "domain")


def posteriors(docs: DataFrame, labels: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    """The kept columns, n_tokens and p (one value per domain), stored; and
    the domains' names."""
    counts = HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="v", binary=True)
    part = stored(domain_sample(docs, labels).select("domain", _words(F.col("text")).alias("words")))
    names = sorted(r["domain"] for r in part.select("domain").distinct().collect())
    rows = docs.select(*keep, _words(F.col("text")).alias("words")).withColumn("n_tokens", F.size("words").cast("long"))
    if len(names) < 2:
        return stored(rows.drop("words").withColumn("p", F.array(*[F.lit(1.0) for _ in names]).cast("array<double>"))), names
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("domain")) - 1
    data = counts.transform(part.select(number.cast("double").alias("label"), "words")).coalesce(6)
    model = LogisticRegression(featuresCol="v", labelCol="label", family="multinomial", maxIter=25, regParam=0.002,
                               probabilityCol="chance").fit(data)
    scored = model.transform(counts.transform(rows))
    return stored(scored.select(*keep, "n_tokens", vector_to_array("chance").alias("p"))), names


def _totals(df: DataFrame, weight: Column, k: int) -> list[float]:
    row = df.agg(*[F.sum(weight * F.col("p")[i]) for i in range(k)]).first()
    return [float(x or 0.0) for x in row]


def fit_rates(scored: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None,
              steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``scored`` with the column rate."""
    k = len(names)
    if not k:
        return scored.withColumn("rate", F.lit(1.0))
    n = F.col("n_tokens")
    mass = _totals(scored, n, k)
    share = [max(0.0, targets.get(d, 0.0)) if m > 0 else 0.0 for d, m in zip(names, mass)]
    if not sum(share):
        return scored.withColumn("rate", F.lit(1.0))
    goal = [s / sum(share) * (sum(mass) if budget is None else budget) for s in share]
    current, rate, total = scored, F.lit(1.0), mass
    for step in range(1, steps + 1):
        slope = [(t - g) / m if m > 0 else 0.0 for t, g, m in zip(total, goal, mass)]
        push = sum((F.col("p")[i] * F.lit(float(s)) for i, s in enumerate(slope)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - push)
        if step % REFRESH == 0:
            current = stored(current.drop("rate").withColumn("rate", rate) if "rate" not in current.columns
                             else current.withColumn("new", rate).drop("rate").withColumnRenamed("new", "rate"))
            rate = F.col("rate")
        total = _totals(current, n * rate, k)
        if max(abs(t - g) for t, g in zip(total, goal)) <= tolerance * sum(goal):
            break
    return current.withColumn("fitted", rate).drop("rate").withColumnRenamed("fitted", "rate")


def mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (the most probable),
    posterior (its value), posteriors, rate."""
    scored, names = posteriors(documents_of(docs), labels, "doc_id")
    done = fit_rates(scored, names, targets or TARGETS)
    return _described(done, names).select("doc_id", "n_tokens", "domain", "posterior", F.col("p").alias("posteriors"), "rate")


def _described(df: DataFrame, names: list[str]) -> DataFrame:
    best = F.array_position("p", F.array_max("p")).cast("int")
    domain = F.element_at(F.array(*[F.lit(n) for n in names]), best) if names else F.lit(None).cast("string")
    return df.withColumn("posterior", F.array_max("p")).withColumn("domain", domain)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their domain and rate (columns mix_domain,
    mix_rate; a column of that name in the input is replaced)."""
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    source = whole.withColumn("doc_id", F.col("row.doc_id"))
    scored, names = posteriors(source, table(spark, sf_dir, "labels"), "row")
    done = _described(fit_rates(scored, names, CLEAN_TARGETS), names)
    own = [c for c in docs.columns if c not in ("mix_domain", "mix_rate")]
    return done.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("domain").alias("mix_domain"), F.col("rate").alias("mix_rate"))
