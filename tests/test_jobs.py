"""Job compositions (J1-J7) run end to end on the smallest tables."""

from pyspark.sql import functions as F

from quire.operators.ids import dense_ids
from quire.plans import jobs as J
from quire.sources.fixtures import fixture
from quire.sources.tables import table
from tests.conftest import SMOKE


def _articles(spark):
    d = table(spark, SMOKE, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return dense_ids(d, "article_id", "i")


def test_article_job_outputs_are_consistent(spark):
    star = J.article_job(fixture(spark, SMOKE, "job_raw_articles"), enforce_fk=True)
    arts = {r.id_articulo for r in star.articles.collect()}
    assert arts and {r.id_articulo for r in star.rel_tags.collect()} <= arts
    assert {r.id_articulo for r in star.rel_authors.collect()} <= arts          # enforce_fk
    assert {r.id_tags for r in star.rel_tags.collect()} <= {r.id_tags for r in star.tags.collect()}
    ids = sorted(r.id_autor for r in star.authors.collect())
    assert ids == list(range(len(ids)))
    c = star.counts.first()
    assert c.kept_articles >= c.tagged_articles == len(arts)


def test_argument_jobs(spark):
    arts = _articles(spark)
    p1 = fixture(spark, SMOKE, "list_responses").select(F.col("i").alias("line"), "custom_id", "content")
    p2 = fixture(spark, SMOKE, "premise_responses")
    direct = J.direct_job(arts, p1, p2)
    n = arts.count()
    assert direct.results.count() == n
    assert direct.flat.count() == direct.results.select(F.greatest(F.size("arguments"), F.lit(1)).alias("k")) \
        .agg(F.sum("k")).first()[0]
    assert direct.stats.first().total_articles == n
    q1 = p1.withColumn("custom_id", F.regexp_replace("custom_id", "^c_", "q_"))
    qa = fixture(spark, SMOKE, "answer_responses")
    arg = fixture(spark, SMOKE, "argument_responses").select(
        (F.col("i") * 1000 + F.col("j")).alias("line"),
        F.concat_ws("_", F.lit("arg"), F.col("i").cast("string"), F.col("j").cast("string")).alias("custom_id"), "content")
    soc = J.socratic_job(arts, q1, qa, arg)
    assert soc.results.where("size(questions) > 10").count() == 0  # F1 cap
    assert soc.stats.first().total_articles == n


def test_profile_matching_and_intake_jobs(spark):
    pages = fixture(spark, SMOKE, "wiki_pages").select(F.col("page_id").alias("id"), F.lit("A").alias("author_name"), "source")
    assert J.degree_text_job(pages).count() == pages.count()
    valid, bad = J.degree_profile_job(fixture(spark, SMOKE, "degree_json"))
    assert valid.count() + bad.count() == fixture(spark, SMOKE, "degree_json").count()
    names = fixture(spark, SMOKE, "query_names")
    cands = fixture(spark, SMOKE, "gold_matches").select("name", "rnk", "candidate_key", "description")
    m, sweep = J.matching_job(names, cands, gold=names)
    assert m.count() == names.count() and sweep.count() == 19
    dated, hwm = J.intake_job(fixture(spark, SMOKE, "export_docs"), "event_id")
    assert dated.count() == fixture(spark, SMOKE, "export_docs").count() and hwm.count() == 1
