"""The article job writes and orders what grows with the texts once."""

import random

from pyspark.sql import functions as F

from quire.operators import dedup as DD
from quire.plans import jobs as J
from quire.sources.fixtures import fixture
from tests.conftest import SMOKE


def _written(monkeypatch, *modules) -> list:
    """Columns of every frame that the modules store from now on."""
    seen = []
    for m in modules:
        for name in ("stored", "stored_counted"):
            if hasattr(m, name):
                def spy(df, keep=getattr(m, name)):
                    seen.append(list(df.columns))
                    return keep(df)
                monkeypatch.setattr(m, name, spy)
    return seen


def test_article_texts_are_written_once(spark, monkeypatch):
    from quire.operators import ids
    seen = _written(monkeypatch, J, ids)
    star = J.article_job(fixture(spark, SMOKE, "job_raw_articles"))
    assert sum("texto_completo" in c for c in seen) == 1  # cleaned, authored, de-duplicated and tagged before
    raw = {r.titulo: r.texto_completo for r in fixture(spark, SMOKE, "job_raw_articles").where("titulo IS NOT NULL").collect()}
    got = star.articles.where("titulo <> 'Unknown'").collect()
    assert got and all(r.texto_completo == raw[r.titulo] for r in got)


def test_frequent_tokens_go_last_without_writing_sets(spark, monkeypatch):
    rng = random.Random(5)
    sets = [(i, i, sorted({*rng.sample(range(40), 12), *rng.sample(range(1000, 9000), 8)})) for i in range(120)]
    df = DD.stored(spark.createDataFrame(sets, "id long, ord long, tokens array<long>").withColumn("n", F.size("tokens")))
    seen = _written(monkeypatch, DD)
    got = DD.prefix_tokens(df, 0.5, hot=20).collect()
    assert not any("tokens" in c for c in seen)  # the sets that hold frequent tokens were written twice before
    count = {}
    for _, _, t in sets:
        for x in t:
            count[x] = count.get(x, 0) + 1
    late = sorted((c, x) for x, c in count.items() if c > 20)
    rank = {x: i + 1 for i, (_, x) in enumerate(late)}
    prefix = {}
    for i, _, t in sets:
        order = sorted(t, key=lambda x: (rank.get(x, 0), x))
        for p, x in enumerate(order[:len(t) - -(-len(t) // 2) + 1]):
            prefix.setdefault(x, []).append((i, x, p + 1))
    want = sorted(e for own in prefix.values() if len(own) > 1 for e in own)
    assert late and sorted((r.id, r.token, r.pos) for r in got) == want
