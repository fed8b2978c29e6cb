"""The trees of the personal-data operator learn from every span."""

from pyspark.sql import functions as F

from quire.llm import pii as P


def test_pii_learns_from_every_span(spark, monkeypatch):
    seen, whole = [], P.GBTClassifier

    def spy(**kwargs):
        model = whole(**kwargs)
        fit = model.fit
        model.fit = lambda frame: (seen.append(frame.agg(F.sum("n") if "n" in frame.columns else F.count(F.lit(1))).first()[0]), fit(frame))[1]
        return model

    monkeypatch.setattr(P, "GBTClassifier", spy)
    text = lambda i: " ".join(f"mail w{i}x{k}@site{k}.org or {i + k} items" for k in range(12))
    docs = spark.createDataFrame([(i, text(i)) for i in range(1250)], "doc_id long, text string")
    got = P.pii(docs)
    assert got.agg(F.sum("n_email")).first()[0] == 15_000
    assert 22_000 < seen[0] < 26_000  # four fifths of 15,000 addresses and 15,000 numbers
